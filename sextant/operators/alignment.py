"""Pieces of a text found again in their source: whole pieces, pieces known by their first and last words, and pieces that run over a section's end.

A source's words are indexed by the places of runs of 1, 2, 4 and 8 words. Runs are named by doubling (a run of 2 w words is the pair of its halves' names), so
equal names are equal words and nothing is hashed. A piece is placed by the longest runs that occur once in what is left of the source; a longest increasing
subsequence of these makes a chain, and what lies between two links is filled in by shorter runs. Work per piece follows its length, not the source's. A piece that stands at the
next word as it is, and a marker that stands whole in its window, have just that place by these rules, so the runs are named only where one does not.
Order matters within a document only, so documents are the groups; with edits, sections and chunks meet in equi-joins of short pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sextant.functions import text as T

#: What JavaScript's \s takes for a space.
SPACE = "\\f\\n\\r\\t\\v \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WORD = re.compile(f"[^{SPACE}]+")
MARKUP = re.compile(r"[$\\{}~]")
RECOVERED = "position int, status string, method string, start long, end long, text string, matched double, size double, head double, tail double"
ANCHORED = "position int, status string, method string, start long, end long, text string"

# Words of the result, and the limits that decide them.
FOUND, SHORTENED, LOST = "recovered", "abbreviated", "FAILED"
NOTHING, NO_ANCHOR, DIFFERS = "empty-or-exhausted", "no-anchor", "boundary-or-match-fail"
NO_START, NO_END = "no-start-anchor", "no-end-anchor"
LEAST_EDGE, LEAST_CLOSE, MOST_SIZE, EDGE_WORDS, CLOSE_WORDS, BARE_WORDS = 0.75, 0.6, 1.5, 8, 3, 3
MOST_WORDS, SNAP_WORDS = 700, 40
PROBE, REST_PROBE, LEAST_CHARS = 80, 60, 50
WHOLE = 8
# end of fixed values

LEVELS = (3, 2, 1, 0)  # runs of 8, 4, 2 and 1 words


@lru_cache(1 << 16)
def canonical_word(word: str) -> str:
    return MARKUP.sub("", word).lower() or word.lower()


def canonical_words(text: str) -> list[str]:
    if not text.isascii():  # there lower case may depend on the neighbours
        return [canonical_word(w) for w in WORD.findall(text)]
    words = WORD.findall(text.lower())
    return [MARKUP.sub("", w) or w for w in words] if MARKUP.search(text) else words


class Places:
    """Where the runs of words of `texts` stand in `source`."""

    def __init__(self, source: str, texts: list[str]):
        self.source, self.words, self.pieces = source, canonical_words(source), [canonical_words(t) for t in texts]
        self.n, self.size, self.at = len(self.words), [len(p) for p in self.pieces], []
        place = self.n
        for size in self.size:
            self.at.append(place + 1)
            place += 1 + size

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in WORD.finditer(self.source)]

    @cached_property
    def _index(self) -> tuple[list, list, list]:
        known: dict[str, int] = {}
        ids = [known.setdefault(w, len(known)) for w in self.words]
        for k, piece in enumerate(self.pieces):
            ids.append(-1 - k)  # no run goes over a border
            ids += [known.setdefault(w, len(known)) for w in piece]
        names = np.unique(np.array(ids, np.int64), return_inverse=True)[1].astype(np.int64)
        index = ([], [], [])
        for level in range(max(LEVELS) + 1):
            width = 1 << level
            if level:
                half = width >> 1
                pairs = names[: max(0, len(names) - half)] * (int(names.max(initial=0)) + 1) + names[half:]
                names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            own = names[: max(0, self.n - width + 1)]
            order = np.argsort(own, kind="stable")
            for column, values in zip(index, (names, order, own[order] * (self.n + 1) + order), strict=True):  # keys ascend by name, then place
                column.append(values)
        return index

    names, order, keys = (property(lambda self, k=k: self._index[k]) for k in range(3))

    @cached_property
    def _whole(self) -> dict[tuple, list[int]]:
        """Where the pieces of up to WHOLE words stand as they are."""
        found: dict[tuple, list[int]] = {tuple(p): [] for p in self.pieces if 0 < len(p) <= WHOLE}
        for size in {len(p) for p in found}:
            for j, run in enumerate(zip(*(self.words[k:] for k in range(size)))):
                if run in found:
                    found[run].append(j)
        return found

    def whole(self, piece: int, j0: int, j1: int) -> list[int]:
        """The places within source words [j0, j1) at which a short piece stands as it is."""
        at = self._whole.get(tuple(self.pieces[piece]), [])
        return at[bisect_left(at, j0) : bisect_left(at, j1 - self.size[piece] + 1)]

    def occurrences(self, piece: int, level: int, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run that starts at i0 ... of a piece and ends before i1: its range in order[level] within source words [j0, j1)."""
        width = 1 << level
        own = self.names[level][self.at[piece] + i0 : self.at[piece] + max(i0, i1 - width + 1)] * (self.n + 1)
        return np.searchsorted(self.keys[level], own + j0), np.searchsorted(self.keys[level], own + max(j0, j1 - width + 1))

    def once(self, piece: int, level: int, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
        """The longest chain of runs that occur once in the window, as (place in the piece, place in the source)."""
        lo, hi = self.occurrences(piece, level, i0, i1, j0, j1)
        some = np.flatnonzero(hi - lo == 1)
        return increasing(list(zip((some + i0).tolist(), self.order[level][lo[some]].tolist(), strict=True)))

    def anchors(self, piece: int, cursor: int) -> tuple[int, list[tuple[int, int]]]:
        """(level, chain) of the longest runs that are left of a piece; where none occurs once, the first place of the first that occurs."""
        for level in LEVELS:
            lo, hi = self.occurrences(piece, level, 0, self.size[piece], cursor, self.n)
            if (hi > lo).any():
                chain = self.once(piece, level, 0, self.size[piece], cursor, self.n)
                first = int(np.argmax(hi > lo))
                return level, chain or [(first, int(self.order[level][lo[first]]))]
        return -1, []

    def blocks(self, piece: int, cursor: int) -> list[tuple[int, int, int]]:
        """(place in the piece, place in the source, words) of what a piece and the source have in common, in order."""
        if self.words[cursor : cursor + self.size[piece]] == self.pieces[piece]:  # its runs stand there; one that occurs once, there only
            return [(0, cursor, self.size[piece])] if self.size[piece] else []
        level, chain = self.anchors(piece, cursor)
        if not chain:
            return []
        width, m = 1 << level, self.size[piece]
        (i, j), (y, z) = chain[0], chain[-1]
        near = lambda words: 3 * words + 16  # noqa: E731  so far outside the chain a rest is looked for
        out = self._between(piece, level, 0, i, max(cursor, j - near(i)), j)
        for (a, b), after in zip(chain, [*chain[1:], None], strict=True):
            out.append((a, b, width))
            if after and after[0] > a + width and after[1] > b + width:
                out += self._between(piece, level, a + width, after[0], b + width, after[1])
        out += self._between(piece, level, y + width, m, z + width, min(self.n, z + width + near(m - y - width)))
        return joined(out)

    def _same(self, piece: int, i: int, j: int) -> bool:
        return self.names[0][self.at[piece] + i] == self.names[0][j]

    def _between(self, piece: int, level: int, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int, int]]:
        head = tail = 0
        while i0 + head < i1 and j0 + head < j1 and self._same(piece, i0 + head, j0 + head):
            head += 1
        while i1 - tail > i0 + head and j1 - tail > j0 + head and self._same(piece, i1 - tail - 1, j1 - tail - 1):
            tail += 1
        out = [(i0, j0, head)] if head else []
        a, b, c, d = i0 + head, i1 - tail, j0 + head, j1 - tail
        for lower in range(level - 1, -1, -1):
            chain = self.once(piece, lower, a, b, c, d) if a < b and c < d else []
            if chain:
                width = 1 << lower
                edges = [(a - width, c - width), *chain, (b, d)]
                for k, (i, j) in enumerate(edges[:-1]):
                    if k:
                        out.append((i, j, width))
                    x, y = edges[k + 1]
                    if x > i + width and y > j + width:
                        out += self._between(piece, lower, i + width, x, j + width, y)
                break
        return [*out, (i1 - tail, j1 - tail, tail)] if tail else out

    def with_bare(self, last: int) -> int:
        """Markup without a word goes with the passage before it."""
        for _ in range(BARE_WORDS):
            if last + 1 < self.n and not MARKUP.sub("", self.source[slice(*self.spans[last + 1])]):
                last += 1
        return last

    def cut(self, first: int, last: int) -> tuple[int, int, str]:
        a, b = self.spans[first][0], self.spans[last][1]
        return a, b, self.source[a:b]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain in which both places grow; pairs come by their first place, equal first places by falling second."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        spot = bisect_left(ends, j)
        before[k] = at[spot - 1] if spot else -1
        if spot == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[spot], at[spot] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def joined(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping and touching blocks of one diagonal as one; of others, the part that is new."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in blocks:
        if out:
            x, y, m = out[-1]
            if i - x == j - y and i <= x + m:
                out[-1] = (x, y, max(m, i - x + n))
                continue
            over = max(x + m - i, y + m - j, 0)
            i, j, n = i + over, j + over, n - over
        if n > 0:
            out.append((i, j, n))
    return out


def likeness(a, b) -> float:
    """Twice the words of the longest common subsequence over all words; for a few words."""
    if a == b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return 2 * row[-1] / (len(a) + len(b)) if len(a) + len(b) else 1.0


def recovered_sequence(pieces: list[str | None], source: str | None, least: float = 0.85) -> list[tuple]:
    """(status, method, start, end, text, matched, size, head, tail) of each piece; pieces are looked for in order, each after the one found before.

    FOUND: text is the piece as the source has it. SHORTENED: the source's passage is over MOST_SIZE times as long. LOST: neither, and the next piece is
    looked for from the same word on. start and end are character offsets; matched is the share of the piece's words that the source has in order, head and tail the
    likeness of the first and last EDGE_WORDS words.
    """
    places = Places(source or "", [p or "" for p in pieces])
    words, out, cursor = places.words, [], 0
    for k, size in enumerate(places.size):
        blocks = places.blocks(k, cursor) if size and cursor < places.n else []
        if not blocks:
            out.append((LOST, NO_ANCHOR if size and cursor < places.n else NOTHING, *[None] * 7))
            continue
        (i, j, _), (x, y, n) = blocks[0], blocks[-1]
        first = max(cursor, j - i)
        last = places.with_bare(min(places.n - 1, max(first, y + size - 1 - x)))
        own, theirs = places.pieces[k], words[first : last + 1]
        matched, ratio = sum(b[2] for b in blocks) / size, len(theirs) / size
        head, tail = likeness(theirs[:EDGE_WORDS], own[:EDGE_WORDS]), likeness(theirs[-EDGE_WORDS:], own[-EDGE_WORDS:])
        whole = ratio <= MOST_SIZE and tail >= LEAST_EDGE and matched >= least
        part = ratio > MOST_SIZE and likeness(theirs[-CLOSE_WORDS:], own[-CLOSE_WORDS:]) >= LEAST_CLOSE and matched >= least - 0.1
        good = head >= LEAST_EDGE and (whole or part)
        a, b, text = places.cut(first, last)
        status, method = ((FOUND, "align") if whole else (SHORTENED, "anchored-abbrev")) if good else (LOST, DIFFERS)
        out.append((status, method, a, b, text if good else None, matched, ratio, head, tail))
        cursor = last + 1 if good else cursor
    return out


def _best(places: Places, marker: int, first: int, stop: int, last_run: bool) -> list[int]:
    """Where a marker's first word may stand, within source words [first, stop): of the places of its first (or last) run of the longest kind that is there, those at
    which most of its words agree. Where it stands whole, these are all of its places."""
    whole = places.whole(marker, first, stop)
    if whole or not places.size[marker]:
        return whole
    size, own = places.size[marker], places.names[0][places.at[marker] : places.at[marker] + places.size[marker]]
    for level in LEVELS:
        lo, hi = places.occurrences(marker, level, 0, size, first, stop)
        some = np.flatnonzero(hi > lo)
        if len(some):
            i = int(some[-1 if last_run else 0])
            begin = places.order[level][lo[i] : hi[i]] - i
            agree = np.zeros(len(begin), np.int64)
            for k in range(size):
                at = begin + k
                inside = (at >= first) & (at < stop)
                agree[inside] += places.names[0][at[inside]] == own[k]
            return begin[agree == agree.max()].tolist()
    return []


def anchored_sequence(pairs: list[tuple[str | None, str | None]], source: str | None) -> list[tuple]:
    """(status, method, start, end, text) of passages known by their first and last words, in order.

    Start markers are placed together: of all their places the longest chain in which they follow one another counts. A passage ends with the last place of its
    end marker before the next start, or else the first one, within MOST_WORDS. Then neighbours are made to touch: an overlap goes to the later one, a gap with content
    to the earlier one, and up to SNAP_WORDS words of content before the first or after the last go with these.
    """
    source = source or ""
    places = Places(source, [t or "" for pair in pairs for t in pair])
    some = [(k, max(0, j)) for k in range(len(pairs)) for j in reversed(_best(places, 2 * k, 0, places.n, False))]
    start = dict(increasing(some))
    method, spans = {k: NO_START for k in range(len(pairs)) if k not in start}, {}
    found = sorted(start)
    follows = {k: start[x] for k, x in zip(found, found[1:], strict=False)}
    for k in found:
        after = follows.get(k)
        stop = min(places.n, start[k] + MOST_WORDS)
        ends = [min(stop, j + places.size[2 * k + 1]) - 1 for j in _best(places, 2 * k + 1, start[k], stop, True)]
        inside = [e for e in ends if after is None or e < after]
        if not ends:
            method[k] = NO_END
            continue
        spans[k] = [start[k], places.with_bare(ends[0] if after is None or not inside else inside[-1])]
    order = sorted(spans)
    content = lambda a, b: not T.droppable_text(source[a:b])
    for k, after in zip(order, order[1:], strict=False):
        (_, end), begin = spans[k], spans[after][0]
        if begin <= end or (begin > end + 1 and content(places.spans[end][1], places.spans[begin][0])):
            spans[k][1] = begin - 1
    if order:
        first, last = spans[order[0]], spans[order[-1]]
        if 0 < first[0] <= SNAP_WORDS and content(0, places.spans[first[0]][0]):
            first[0] = 0
        if 0 < places.n - 1 - last[1] <= SNAP_WORDS and content(places.spans[last[1]][1], len(source)):
            last[1] = places.n - 1
    return [(FOUND, "anchors", *places.cut(spans[k][0], max(spans[k]))) if k in spans else (LOST, method[k], None, None, None) for k in range(len(pairs))]


def _in_order(pieces: DataFrame, sources: DataFrame, columns: list[str], schema: str, find) -> DataFrame:
    """find(rows of a document in order, its text) -> a row each, document by document; a document's text meets its pieces once, not once a piece. Both are exchanged once and
    sorted, so a task sees its documents one after the other, texts before pieces; of several texts of a document the smallest counts."""
    types = {f.name: f.dataType for f in pieces.schema.fields}
    rows = pieces.select("doc_id", F.lit(True).alias("piece"), "position", *columns, F.lit(None).cast("string").alias("text"))
    texts = sources.select("doc_id", F.lit(False).alias("piece"), *(F.lit(None).cast(types[c]).alias(c) for c in ("position", *columns)), "text")
    order = ["doc_id", "piece", *(F.asc_nulls_last(c) for c in ("position", *columns))]
    wanted = f"doc_id long, {schema}"

    def align(batches):
        def done(group):
            place = next((k for k, r in enumerate(group) if r[1]), len(group))
            if not 0 < place < len(group):
                return
            text = min((r[-1] for r in group[:place] if r[-1] is not None), default=None)
            for r, x in zip(group[place:], find([r[3:-1] for r in group[place:]], text), strict=True):
                yield (r[0], r[2], *x)

        def out(found):
            columns = zip(*found) if found else [[]] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        group = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if group and row[0] != group[0][0]:
                    found += done(group)
                    group = []
                group.append(row)
            yield out(found)
        yield out(list(done(group)))

    target = to_arrow_schema(StructType.fromDDL(wanted))
    return rows.unionByName(texts).repartition("doc_id").sortWithinPartitions(*order).mapInArrow(align, wanted)


def recovered(pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """pieces(doc_id, position, content), sources(doc_id, text) -> (doc_id, RECOVERED): recovered_sequence() of each document. Nulls are
    empty texts; pieces without a source, and sources without pieces, give no rows."""
    return _in_order(pieces, sources, ["content"], RECOVERED, lambda rows, text: recovered_sequence([r[0] for r in rows], text))


def anchored(markers: DataFrame, sources: DataFrame) -> DataFrame:
    """markers(doc_id, position, first, last), sources(doc_id, text) -> (doc_id, ANCHORED): anchored_sequence() of each document."""
    return _in_order(markers, sources, ["first", "last"], ANCHORED, anchored_sequence)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def near_places(probes: DataFrame, sections: DataFrame, edits: int = 8) -> DataFrame:
    """probes(doc_id, chunk, probe), sections(doc_id, section, content) -> (doc_id, chunk, section): sections that hold the probe up to `edits` edits.

    A place with that many edits leaves one of edits + 1 neighbouring pieces of the section as it is. So sections are posted under pieces of `size` characters at
    every size-th place, probes under all their pieces; where they meet, the distance of the probe to the text there decides, computed within a band.
    Probes shorter than (edits + 1) * size are held to be found where they stand exactly; without edits those of 2 * size - 1 characters or more are found, and no shorter one is of a chunk that can be cut.
    """
    size = max(4, min(PROBE // (edits + 2), LEAST_CHARS // 2))  # a probe of LEAST_CHARS characters holds a whole piece
    posted = sections.select("doc_id", "section", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.length("content") - size, F.lit(0)), F.lit(size))).alias("p")).select("doc_id", "section", "p", F.substring("content", F.col("p") + 1, F.lit(size)).alias("piece"))
    asked = probes.where(F.length("probe") >= size).select("doc_id", "chunk", "probe", F.explode(F.sequence(F.lit(0), F.length("probe") - size)).alias("q"))
    asked = asked.select("doc_id", "chunk", "probe", "q", F.substring("probe", F.col("q") + 1, F.lit(size)).alias("piece"))
    met = asked.join(posted, ["doc_id", "piece"]).select("doc_id", "chunk", "probe", "section", F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("place")).distinct()
    there = met.join(sections, ["doc_id", "section"])
    distance = F.levenshtein("probe", F.substring("content", F.col("place") + 1, F.length("probe")), 2 * edits)  # an edit may move the end by one as well
    return there.where((distance >= 0) | F.contains("content", F.col("probe"))).select("doc_id", "chunk", "section").distinct()


def held_prefix(chunk: Column, section: Column) -> Column:
    """Length of the longest beginning of chunk that section contains, by halving."""
    steps = F.sequence(F.lit(1), F.lit(31))
    span = F.struct(F.lit(0).alias("lo"), F.length(chunk).alias("hi"))

    def halve(acc, _):
        middle = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        holds = F.contains(section, F.left(chunk, middle))
        next_ = F.struct(F.when(holds, middle).otherwise(acc["lo"]).alias("lo"), F.when(holds, acc["hi"]).otherwise(middle - 1).alias("hi"))
        return F.when(acc["lo"] < acc["hi"], next_).otherwise(acc)

    return F.aggregate(steps, span, halve, lambda acc: acc["lo"])


def bounded_by_sections(chunks: DataFrame, sections: DataFrame, edits: int = 8) -> DataFrame:
    """chunks(doc_id, chunk, section, content), sections(doc_id, section, content) -> (doc_id, chunk, part, section, content, split).

    A chunk whose first PROBE characters stand in several sections is taken for one that runs over its own section's end. It is cut where the longest beginning
    that its section holds ends, if LEAST_CHARS characters are left behind it; the second part goes to the first other section that holds its first REST_PROBE characters, or stays. Parts of
    fewer than LEAST_CHARS characters go. Runs of blanks count as one. Other chunks come back as they are (part 0); a chunk whose section is not
    among the document's, too, and so do all chunks of a document with one section. Null and empty contents have no parts. A document's chunks and sections are one row, so texts
    are exchanged by document only, and not at all where both sides come dealt by it.
    """
    told = sections.select("doc_id", "section", normal(F.coalesce("content", F.lit(""))).alias("content")).where("content <> ''")
    rows = chunks.where(F.length("content") > 0)
    held = rows.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "section", "content")).alias("chunks"))
    held = held.join(told.groupBy("doc_id").agg(F.collect_list(F.struct("section", "content")).alias("told")), "doc_id", "left")
    if edits:
        where = near_places(rows.select("doc_id", "chunk", F.left(normal(F.col("content")), F.lit(PROBE)).alias("probe")), told, edits)
        several = where.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = held.join(several.groupBy("doc_id").agg(F.collect_set("chunk").alias("several")), "doc_id", "left")
    there = lambda probe: F.array_distinct(F.transform(F.filter("told", lambda s: F.contains(s["content"], probe)), lambda s: s["section"]))

    def parts(c: Column) -> Column:
        """The chunk's parts: array<struct<chunk, part, section, content, split>>."""
        in_several = F.array_contains("several", c["chunk"]) if edits else F.size(there(F.left(c["flat"], F.lit(PROBE)))) > 1
        own = F.filter("told", lambda s: (s["section"] == c["section"]) & (F.length(c["flat"]) > LEAST_CHARS) & in_several)
        ends = F.filter(F.transform(own, lambda s: held_prefix(c["flat"], s["content"])), lambda n: (n > 0) & (n < F.length(c["flat"]) - LEAST_CHARS))
        halves = F.transform(ends, lambda n: F.struct(F.trim(F.left(c["flat"], n)).alias("first"), F.trim(F.substring(c["flat"], n + 1, F.length(c["flat"]))).alias("rest")))
        other = lambda rest: F.array_min(F.filter(there(F.left(rest, F.lit(REST_PROBE))), lambda k: k != c["section"]))
        part = lambda n, section, content, split: F.struct(c["chunk"].alias("chunk"), F.lit(n).alias("part"), section.alias("section"), content.alias("content"), F.lit(split).alias("split"))
        cut = lambda h: F.array(part(0, c["section"], h["first"], True), part(1, F.coalesce(other(h["rest"]), c["section"]), h["rest"], True))
        # bound as the only item of an array, so that it is evaluated once
        choose = lambda found: F.when(F.size(found) > 0, F.filter(F.flatten(F.transform(found, cut)), lambda p: F.length(p["content"]) >= LEAST_CHARS)).otherwise(F.array(part(0, c["section"], c["content"], False)))
        return F.flatten(F.transform(F.array(F.coalesce(halves, F.array().cast("array<struct<first: string, rest: string>>"))), choose))

    flat = F.transform("chunks", lambda c: F.struct(c["chunk"].alias("chunk"), c["section"].alias("section"), c["content"].alias("content"), normal(c["content"]).alias("flat")))
    return held.select("doc_id", F.inline(F.flatten(F.transform(flat, parts)))).select("doc_id", "chunk", "part", "section", "content", "split")


def numbered_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, position, content) of the lines with anything in them."""
    rows = documents.select("doc_id", F.posexplode(F.split(text, "\n+")).alias("position", "content"))
    return rows.where(F.col("content").rlike(f"[^{SPACE}]"))


def windows_of_lines(lines: DataFrame, width: int, step: int) -> DataFrame:
    """(doc_id, k, content): lines k * step ... of a document, `width` at a time, joined."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    rows = lines.withColumn("place", place).withColumn("k", F.explode(F.expr(f"sequence(greatest(0, cast(ceil((place - {width} + 1) / {step}) as int)), cast(floor(place / {step}) as int))")))
    grown = rows.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("place", "content"))).alias("held"))  # `width` lines
    return grown.select("doc_id", "k", F.array_join(F.transform("held", lambda x: x["content"]), "\n").alias("content"))
