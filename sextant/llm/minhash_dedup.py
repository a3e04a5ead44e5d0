"""Near-duplicate detection by an inverted join of MinHash coordinates, confirmed on full sets.

1. Each text gives its set of distinct word shingles and COORDS minima, each a 64-bit token of
   (coordinate, value). Equal sets are one class from here on; its smallest doc_id stands for it.
2. Classes are posted under their tokens and postings counted. Tokens of one class only are dropped
   (skipped). A pair at the wanted similarity agrees on fewer than least_matches() of the COORDS tokens
   with a probability of MISSED; so a class with fewer shared tokens has no partner, and, with
   tokens ordered from rare to common, partners meet in the first COORDS - least + 1 of them (prefix).
3. Classes that meet in a prefix form blocks (connected components of class to smallest class of the
   posting). A block is dealt into cells of about CELL classes by a hash. In a cell, collisions
   are counted, pairs of that many or more are confirmed on full sets; pairs already connected are passed over.
4. Blocks of several cells are dealt in DEALS ways, once by the smallest class met, then at random, which
   joins up large groups. After that each class outside the block's largest component is compared with all classes of other components
   that share one of its prefix tokens. These meet in tiles of TILE times TILE with their coordinates and sets: a pair that agrees on
   enough coordinates, and differs in size by no more than the similarity allows, is confirmed under the first token that it shares. Then no pair of classes that meet
   in a prefix is both unconnected and uncompared; at no time do all pairs of a group exist as
   rows, a class goes to its tokens' tiles only and not to all cells of its block, and no cell or tile outgrows its bound.

Nulls and empty tables: null or wordless texts have no set (n_shingles 0) and no link; a null doc_id
counts as the largest and comes back as null. Rows that share a doc_id are one node if they share their text, else one node each. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import LAST, connected_components, join_counted, materialize, row_keys

COORDS, MISSED, CELL, CELL_BYTES, DEALS, TILE = 32, 3e-8, 128, 32 << 20, 3, 1024
U = np.uint64


def least_matches(percent: int) -> int:
    """The largest number of coordinates such that a pair of this similarity agrees on fewer with a probability of MISSED at most (12 at 80).
    A similarity at which even one coordinate can't be counted on raises an error: no pair may go unseen."""
    p, missed = percent / 100, 0.0
    for m in range(COORDS + 1):
        missed += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)  # agrees on m or fewer
        if missed > MISSED:
            if not m:
                raise ValueError(f"{COORDS} coordinates can't find pairs of {percent} percent with a probability of missing one under {MISSED}")
            return m
    return COORDS


@lru_cache(1)
def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4711)
    draw = lambda: rng.integers(0, 1 << 63, COORDS, dtype=np.int64).astype(U) * U(2) + U(1)
    return draw(), draw()


def shingles(hashes: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row in order, and n + 1 offsets; fewer words are one shingle."""
    n = np.diff(first)
    total = len(hashes)
    rolled = np.zeros(total, U)
    factor = U(0xD1B54A32D192ED03)
    for k in range(words):
        part = hashes[k:] if k else hashes
        rolled[: len(part)] = (rolled[: len(part)] ^ part) * factor
        rolled[: len(part)] ^= rolled[: len(part)] >> U(29)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(total) + words <= first[row + 1] if total else np.zeros(0, bool)
    values, owner = [bs.mix(rolled[inside])], [row[inside]]
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        short = np.zeros(len(few), U)
        for m, r in enumerate(few):
            h = U(0x5851F42D4C957F2D) ^ U(n[r])
            for x in hashes[first[r] : first[r + 1]]:
                h = bs.mix(np.array([h ^ x], U))[0]
            short[m] = h
        values.append(short)
        owner.append(few)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int):
    """(rows, values, offsets) run by run."""
    for i, j in bs.runs(offsets, 4 * bs.PIECE):
        hashes, first = bs.word_hashes(data, offsets[i : j + 1])
        yield (i, j, *shingles(hashes, first, words))


def signature(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens (rows with a set x COORDS); rows without one are left out."""
    mult, shift = _coordinates()
    start = at[:-1][np.diff(at) > 0]
    out = np.empty((len(start), COORDS), U)
    for k in range(COORDS if len(start) else 0):
        out[:, k] = bs.mix(np.minimum.reduceat((values ^ shift[k]) * mult[k], start) ^ shift[k])
    return out


def _sign(words: int):
    def sign(batches):
        for ids, text in bs.arrow_batches(batches, ["key", "text"]):
            docs, (data, offsets) = ids.to_numpy(), bs.buffers(text)
            for i, j, values, at in sets_of(data, offsets, words):
                n, some = np.diff(at), np.diff(at) > 0
                lo, hi = np.zeros(j - i, U), np.zeros(j - i, U)
                if len(values):
                    lo[some] = np.add.reduceat(values, at[:-1][some])
                    hi[some] = np.add.reduceat(bs.mix(values ^ U(0xA5A5A5A5A5A5A5A5)), at[:-1][some])
                tokens = signature(values, at)
                count = np.where(some, COORDS, 0)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(tokens.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(docs[i:j]), pa.array(n.astype(np.int64)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(np.diff(offsets[i : j + 1])), lists], names=["doc", "n", "lo", "hi", "bytes", "tokens"])
            bs.give_back()

    return sign


class _Links:
    """Union-find over the classes of one cell, with the links that joined them."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.found, self.up = nodes, [], list(range(len(nodes)))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.found.append((int(self.nodes[x]), int(self.nodes[y])))
        self.up[self.top(x)] = self.top(y)


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[spot] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _collisions(tokens: np.ndarray, x: int, postings: tuple[np.ndarray, np.ndarray, np.ndarray], among: np.ndarray, least: int) -> np.ndarray:
    """How many tokens each class of the cell shares with class x, by merging x's postings: first those of its rarest COORDS - least + 1
    tokens (prefix); the others only count for classes met there, and are skipped where there are none."""
    order, start, end = postings
    rare = np.argsort(end[x] - start[x], kind="stable")
    merged = lambda some: np.bincount(np.concatenate([order[start[x, k] : end[x, k]] for k in some]), minlength=len(tokens)) * among
    same = merged(rare[: COORDS - least + 1])
    met = same > 0
    return np.where(met, same + merged(rare[COORDS - least + 1 :]), 0) if met.any() and least > 1 else same


def _link_cell(nodes, sets, tokens, percent: int) -> list[tuple[int, int]]:
    """Links between the classes of a cell."""
    links, size, least = _Links(nodes), len(nodes), least_matches(percent)
    among = np.ones(size, bool)
    flat = np.sort(tokens.ravel())
    order = np.argsort(tokens.ravel(), kind="stable") // COORDS  # postings: the classes under each token
    postings = order, np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
    for x in range(size):
        among[x] = False  # pairs of x are done after this round
        same = _collisions(tokens, x, postings, among, least)
        keep = np.flatnonzero(same >= least)
        for y in keep[np.argsort(-same[keep], kind="stable")].tolist():
            if links.top(x) != links.top(y) and _near(sets[x], sets[y], percent):
                links.join(x, y)
    return links.found


def _groups(batches, first: str, second: str):
    """Tables of the rows equal in two columns, by which the batches are sorted."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        one, two = table[first].to_numpy(), table[second].to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        for a, b in zip(np.concatenate([[0], cut])[:-1], cut, strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(int(cut[-1]) if len(cut) else 0)
        bs.give_back()
    if rest is not None:
        yield rest


def _link(words: int, percent: int):
    """Batches sorted by (block, cell): links (a, b)."""

    def link(batches):
        for table in _groups(batches, "block", "cell"):
            if table.num_rows < 2:
                continue
            data, offsets = bs.buffers(table["text"].combine_chunks())
            sets, tokens = [], []
            for i, j, values, at in sets_of(data, offsets, words):
                sets += [values[at[k] : at[k + 1]] for k in range(j - i)]
                tokens.append(signature(values, at))
            tokens = np.concatenate(tokens)
            if len(tokens) != len(sets):
                raise ValueError("a class without a set")
            found = _link_cell(table["rep"].to_numpy(), sets, tokens, percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _meet(percent: int):
    """Batches sorted by (token, tile): links of an asking class and one of another component. A pair is looked at under the first token
    that both have in their prefixes, and of two asking classes from the smaller."""
    least = least_matches(percent)

    def meet(batches):
        for table in _groups(batches, "token", "tile"):
            asks = table["ask"].to_numpy(zero_copy_only=False)
            if not 0 < np.count_nonzero(asks) < len(asks):
                continue
            rep, comp, query = (table[c].to_numpy(zero_copy_only=False) for c in ("rep", "comp", "query"))
            tokens, head = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDS) for c in ("tokens", "head"))
            sets = table["set"].combine_chunks()
            n = sets.value_lengths().to_numpy().astype(np.int64)
            at, (known, names) = np.concatenate([[0], np.cumsum(n)]), np.unique(sets.flatten().to_numpy(), return_inverse=True)
            here, there = np.flatnonzero(tokens[0] == table["token"][0].as_py())[0], np.flatnonzero(~asks)
            inside, found = np.zeros(len(known), bool), []
            for x in np.flatnonzero(asks).tolist():
                some = there[(comp[there] != comp[x]) & (~query[there] | (rep[there] > rep[x])) & (100 * np.minimum(n[there], n[x]) >= percent * np.maximum(n[there], n[x]))]
                same = tokens[some] == tokens[x]
                enough = np.count_nonzero(same, axis=1) >= least
                some, same = some[enough], same[enough]
                some = some[(same & head[some] & head[x]).argmax(axis=1) == here] if len(some) else some
                own = names[at[x] : at[x + 1]]
                inside[own] = True
                for k in range(0, len(some), CELL):
                    ys = some[k : k + CELL]
                    both = np.add.reduceat(inside[np.concatenate([names[at[y] : at[y + 1]] for y in ys.tolist()])].astype(np.int64), np.cumsum(n[ys]) - n[ys])
                    found += [(int(rep[x]), y) for y in rep[ys[100 * both >= percent * (n[x] + n[ys] - both)]].tolist()]
                inside[own] = False
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return meet


def _sets(words: int):
    def sets(batches):
        for reps, text in bs.arrow_batches(batches, ["rep", "text"]):
            data, offsets = bs.buffers(text)
            for i, j, values, at in sets_of(data, offsets, words):
                yield pa.RecordBatch.from_arrays([reps[i:j], pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values.view(np.int64)))], names=["rep", "set"])
            bs.give_back()

    return sets


def _dealt(rows: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    rows = rows.select("block", "cell", "rep", "text")
    return rows.repartition(parts, "block", "cell").sortWithinPartitions("block", "cell").mapInArrow(_link(words, percent), "a long, b long")


def _across(posted: DataFrame, marked: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (a, b) between a class marked as query and a class of another component that share a token of posted(rep, token). marked(rep, comp, query, n, tokens, head, set) has the
    coordinates, which of them are posted, and the shingles."""
    spots = posted.join(marked.select("rep", "comp", "query", "n"), "rep")
    told = spots.groupBy("token").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if("query").alias("asks"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.sum(8 * F.col("n")).alias("bytes"), F.sum(F.when(F.col("query"), 8 * F.col("n"))).alias("ask_bytes"),
    ).where("asks > 0 and low <> high")
    over = lambda c, size: F.greatest(F.ceil(F.col(c) / TILE), F.ceil(F.col(size) / CELL_BYTES)).cast("int")
    told = materialize(told.select("token", "posts", over("asks", "ask_bytes").alias("hands"), over("posts", "bytes").alias("strips")))
    spots = materialize(join_counted(spots.select("rep", "token", "query"), told, "token", "posts", "rep"))
    # the asking classes of a token are dealt into hands, all its classes into strips, and each hand meets each strip in a tile
    at = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda hand, strip: (F.shiftleft(hand.cast("long"), 32) + strip).alias("tile")
    asked = spots.where("query").select("rep", "token", "hands", F.explode(every("strips")).alias("strip")).select("rep", "token", F.lit(True).alias("ask"), tile(at("hands"), F.col("strip")))
    there = spots.select("rep", "token", "strips", F.explode(every("hands")).alias("hand")).select("rep", "token", F.lit(False).alias("ask"), tile(F.col("hand"), at("strips")))
    tiles = asked.unionAll(there).join(marked.drop("n"), "rep").repartition(parts, "token", "tile").sortWithinPartitions("token", "tile")
    return tiles.mapInArrow(_meet(percent), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_shingles, class_id, component_id), a row per document row.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id
    is the smallest doc_id reachable over links, class_id the smallest with an equal set.
    """
    rows, names = row_keys(documents)
    if names is None:
        found = linked(rows.select("key", "text"), words, percent)
        real = lambda c: F.when(F.col(c) != LAST, F.col(c))
        return found.select(real("key").alias("doc_id"), F.col("n").alias("n_shingles"), real("rep").alias("class_id"), real("root").alias("component_id"))
    found = linked(materialize(rows.groupBy("key").agg(F.min("text").alias("text"))), words, percent)
    named = lambda key, to: names.select(F.col("key").alias(key), F.col("doc_id").alias(to))
    groups = found.select("rep", "root").distinct().join(named("rep", "class_id"), "rep").join(named("root", "component_id"), "root").drop("root")
    found = found.join(groups, "rep").join(names, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def linked(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """texts(key, text), keys distinct -> (key, n, rep, root): size of the set, smallest key with that set, smallest key reachable."""
    parts, least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), least_matches(percent)
    signed = materialize(texts.mapInArrow(_sign(words), "doc long, n long, lo long, hi long, bytes long, tokens array<long>"))
    key = ["n", "lo", "hi"]
    classes = materialize(signed.where("n > 0").groupBy(*key).agg(F.min("doc").alias("rep")))
    member = signed.where("n > 0").select("doc", *key).join(classes, key)

    reps = signed.where("n > 0").join(classes, key).where("doc = rep")
    posted = reps.select("rep", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("posts")).where("posts > 1")
    kept = join_counted(posted, materialize(shared), "token", "posts", "rep").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("posts", "token"))).alias("posts")).where(F.size("posts") >= least)
    # a class without u of its tokens has them before all others in the order from rare to common
    head = F.slice("posts", 1, F.greatest(F.lit(0), F.size("posts") - (least - 1)))
    kept = materialize(kept.select("rep", F.transform(head, lambda p: p["token"]).alias("tokens")))
    posted = kept.select("rep", F.explode("tokens").alias("token"))
    leads = posted.groupBy("token").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("posts")).where("posts > 1")
    meets = materialize(join_counted(posted, materialize(leads), "token", "posts", "rep").groupBy("rep", "lead").count().drop("count"))
    blocks = connected_components(meets.select(F.col("rep").alias("a"), F.col("lead").alias("b")))

    sizes = signed.groupBy(F.col("doc").alias("node")).agg(F.max("bytes").alias("bytes"))
    placed = blocks.select("node", F.col("root").alias("block")).join(sizes, "node")
    spread = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    spread = spread.select("block", F.greatest(F.ceil(F.col("size") / CELL), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int").alias("cells"))
    leading = meets.groupBy(F.col("rep").alias("node")).agg(F.min("lead").alias("lead"))
    placed = placed.join(spread, "block").join(leading, "node").withColumnRenamed("node", "rep")
    # many classes may have met the same smallest one: they are split as well
    split = placed.groupBy("lead").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("bytes") / CELL_BYTES)).cast("int").alias("splits"))
    placed = materialize(placed.join(split, "lead"))
    body = texts.select(F.col("key").alias("rep"), "text")
    body = materialize(placed.hint("shuffle_hash").join(body, "rep"))
    at = lambda key, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.col("cells")).cast("int")
    # no way of dealing shares a cell with another
    by_lead = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("rep", F.lit(0)), F.col("splits"))), F.col("cells")).cast("int")
    ways = F.when(F.col("cells") == 1, F.array(F.lit(0))).otherwise(F.array(by_lead, *(F.col("cells") * k + at("rep", k) for k in range(1, DEALS))))
    links = materialize(_dealt(body.withColumn("cell", F.explode(ways)), parts, words, percent))
    large = placed.where("cells > 1")
    if not large.isEmpty():
        found = connected_components(links)
        comp = materialize(large.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "block", F.coalesce("root", "rep").alias("comp")))
        main = comp.groupBy("block", "comp").count().groupBy("block").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        marked = materialize(comp.join(main, "block").select("rep", "comp", (F.col("comp") != F.col("main")).alias("query")))
        sets = body.join(marked.select("rep"), "rep").select("rep", "text").mapInArrow(_sets(words), "rep long, set array<long>")
        marked = marked.join(signed.select(F.col("doc").alias("rep"), "n", "tokens"), "rep").join(kept.withColumnRenamed("tokens", "heads"), "rep").join(sets, "rep")
        marked = materialize(marked.select("rep", "comp", "query", "n", "tokens", F.transform("tokens", lambda t: F.array_contains("heads", t)).alias("head"), "set"))
        links = links.unionAll(materialize(_across(posted, marked, parts, percent)))
    roots = connected_components(links)
    joined = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "n", "rep", F.coalesce("root", "rep").alias("root"))
    alone = signed.where("n = 0").select("doc", "n", F.col("doc").alias("rep"), F.col("doc").alias("root"))
    return joined.unionAll(alone).withColumnRenamed("doc", "key")


def op6_minhash_near_dedup(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("class_id")
