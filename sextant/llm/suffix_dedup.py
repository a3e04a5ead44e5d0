"""Substring deduplication by distributed prefix doubling.

A byte goes if a string of `threshold` bytes that covers it also starts earlier. Positions are
ranked by ever longer prefixes, and leave as soon as their rank is unique:

1. Rank of the first GRAM bytes. Only anchors are ranked: for each window of `threshold` bytes the
   leftmost position of the smallest GRAM-byte hash in it. Equal windows have equal anchors, so a
   window whose anchor's rank is unique is unique. Neighbouring windows with one anchor make a
   block. Where all blocks of a rank are equal in full, all but the earliest go as they are.
2. The others are contested. Ranks are paired at growing offsets: that of L bytes at p and at p + L names
   2 L bytes, from GRAM on (32, 64, ...), until the next pair reaches the threshold: (rank at p, rank at p + threshold - L).
   Spark sorts these last pairs with their positions; all but the first of equal pairs go.

Ranks are named by hashes: a pair's name follows from its two ranks, so the pairs in between need no exchange to be
numbered, and the ranks of step 1 serve step 2 as they are. Names have 128 bits in step 1 (64 of the anchor, 64 of the block) and 96 in
step 2. What a task knows by itself leaves at once: later copies within a task are decided
there, so a hot passage sends one row per task and not one per copy.

Order is (doc_id, start); a null doc_id stands last. Rows with the same doc_id and the same text count as the same
document and get the same result; with different texts they are different documents, in the order of a hash of their text. Null text is empty. Texts
shorter than the threshold keep all bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import LAST, materialize, row_keys

GRAM, DECIDED = 32, 1 << 20  # bytes of the first rank; windows that are decided at a time
U = np.uint64
NOTICE, BLOCK, CONTESTED, GONE = 0, 1, 2, 3
COLUMNS = ["key", "name", "doc", "start", "kind", "n"]  # what varies stands together, which packs better in an exchange
PLACES_SQL = "key long, name long, doc long, start long, kind byte, n int"
PAIRS_SQL = PLACES_SQL.replace("name long", "name int")


def _docs(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(key, kind, name, doc, start, n) -> pa.RecordBatch:
    as_signed = lambda x: np.ascontiguousarray(x).view(np.int32 if x.itemsize == 4 else np.int64)
    columns = [as_signed(key), as_signed(name), doc.astype(np.int64), start.astype(np.int64), np.asarray(kind, np.int8), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=COLUMNS)


def _blocks(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, width: int):
    """(anchor hash, block hash, doc, first window, windows) of all blocks of the rows."""
    reach = width - GRAM + 1  # anchors that a window can have
    parts = []
    for i, j in bs.runs(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, hi, bs.PIECE):
            b = min(a + bs.PIECE + width - 1, hi)  # windows that start before a + PIECE
            n = b - a - width + 1
            if n <= 0:
                continue
            sums = bs.prefix(data[a:b])
            grams = np.arange(b - a - GRAM + 1)
            hashes = bs.spans(sums, grams, grams + GRAM)
            low = (hashes & ~U((1 << 21) - 1)) | grams.astype(U)
            size = 1
            while size * 2 <= reach:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < reach:
                low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
            anchor = (low[:n] & U((1 << 21) - 1)).astype(np.int64)
            row = np.searchsorted(offsets[i : j + 1] - a, np.arange(n), "right") - 1 if j - i > 1 else np.zeros(n, np.int64)
            valid = np.arange(n) + width <= (offsets[i : j + 1] - a)[row + 1]
            cut = np.ones(n + 1, bool)
            cut[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
            at = np.flatnonzero(cut)
            start, end = at[:-1], at[1:]
            keep = valid[start]
            start, end = start[keep], end[keep]
            parts.append((hashes[anchor[start]], bs.spans(sums, start, end - 1 + width), docs[i + row[start]], start + a - offsets[i + row[start]], end - start))
    if not parts:
        return None
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _merged(doc, start, n):
    """Neighbouring runs of windows as one; the input is in order."""
    if not len(doc):
        return doc, start, n
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(n, at)


def _scan(width: int):
    def scan(batches):
        for ids, text in bs.arrow_batches(batches, ["doc_id", "text"]):
            data, offsets = bs.buffers(text)
            found = _blocks(data, offsets, _docs(ids), width)
            if found is None:
                continue
            gram, name, doc, start, n = found
            order = np.lexsort((start, doc, name, gram))
            gram, name, doc, start, n = (x[order] for x in (gram, name, doc, start, n))
            new_gram = np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            first = new_gram.copy()
            first[1:] |= name[1:] != name[:-1]
            group = np.cumsum(new_gram) - 1
            several = np.bincount(group, weights=first) > 1
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            later = ~first & ((doc != doc[lead]) | (start != start[lead]))
            own = first & ~several[group]
            fought = first & several[group]
            notice = np.flatnonzero(new_gram)[several]
            zero = np.zeros(len(notice), np.int64)
            yield _batch(gram[notice], np.full(len(notice), NOTICE), zero.view(U), zero, zero, zero)
            yield _batch(gram[own], np.full(own.sum(), BLOCK), name[own], doc[own], start[own], n[own])
            yield _batch(name[fought], np.full(fought.sum(), CONTESTED), gram[fought], doc[fought], start[fought], n[fought])
            gone = np.flatnonzero(later)
            gone = gone[np.lexsort((start[gone], doc[gone]))]
            d, s, k = _merged(doc[gone], start[gone], n[gone])
            yield _batch(bs.mix(d.astype(U) ^ s.astype(U)), np.full(len(d), GONE), d.view(U), d, s, k)

    return scan


def _grouped(batches, decide):
    """decide() over whole groups of `key`; batches come sorted by it. An unfinished group waits for the next batch."""
    rest = None
    for batch in batches:
        table = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(COLUMNS))]
        if rest is not None:
            table = [np.concatenate(x) for x in zip(rest, table, strict=True)]
        if not len(table[0]):
            continue
        last = int(np.searchsorted(table[0], table[0][-1], "left"))
        rest = [x[last:] for x in table]
        if last:
            yield decide(*[x[:last] for x in table])
    if rest is not None and len(rest[0]):
        yield decide(*rest)


def _rank_blocks(batches):
    """Sorted by (key, kind, name, doc, start): contested blocks, and those that go."""

    def decide(key, name, doc, start, kind, n):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        block = kind == BLOCK
        text = block | (kind == CONTESTED)
        first = text.copy()
        first[1:] &= new[1:] | (kind[1:] != kind[:-1]) | (name[1:] != name[:-1])
        fought = (np.bincount(group, weights=first & block) > 1) | (np.bincount(group, weights=(kind == NOTICE)) > 0)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        later = text & ~first & ((doc != doc[lead]) | (start != start[lead]))
        out = np.full(len(key), -1, np.int8)
        out[first & ((kind == CONTESTED) | fought[group])] = CONTESTED
        out[(kind == GONE) | later] = GONE
        k = out >= 0
        return _batch(key[k], out[k], name[k], doc[k], start[k], n[k])

    return _grouped(batches, decide)


def _rank_pairs(batches):
    """Sorted by (key, kind, name, doc, start), rows of windows: those that go."""

    def decide(key, name, doc, start, kind, n):
        window = kind == BLOCK
        first = window.copy()
        first[1:] &= (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (kind[1:] != kind[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        k = (kind == GONE) | (window & ~first & ((doc != doc[lead]) | (start != start[lead])))
        return _batch(key[k], np.full(k.sum(), GONE), name[k], doc[k], start[k], n[k])

    return _grouped(batches, decide)


def lengths(width: int) -> list[int]:
    """Prefix lengths of the ranks, each at most twice the one before."""
    out = [GRAM]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def _rank(sums: np.ndarray, at: np.ndarray, ladder: list[int]) -> np.ndarray:
    """Names of the prefixes of ladder[-1] bytes at the given positions: the pair of two names of the length before."""
    if len(ladder) == 1:
        return bs.spans(sums, at, at + ladder[0])
    return _paired(_rank(sums, at, ladder[:-1]), _rank(sums, at + (ladder[-1] - ladder[-2]), ladder[:-1]))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return bs.mix(left ^ bs.mix(right ^ U(0x6A09E667F3BCC909)))


def _windows(data: np.ndarray, offsets: np.ndarray, spots, width: int):
    """(prefix sums, contested windows as places in them, their rows, their starts), piece by piece."""
    lists, inner = spots.offsets.to_numpy(), spots.values
    start, n = inner.field("start").to_numpy(), inner.field("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(lists))
    start, n = start[lists[0] : lists[-1]], n[lists[0] : lists[-1]]
    low = offsets[row] + start  # places of the first windows
    order = np.argsort(low, kind="stable")
    row, low, n = row[order], low[order], n[order]
    end = np.maximum.accumulate(low + n) if len(low) else low
    for i, j in bs.runs(offsets):
        for a in range(int(offsets[i]), int(offsets[j]), bs.PIECE):
            b = min(a + bs.PIECE, int(offsets[j]))
            k, m = np.searchsorted(end, a, "right"), np.searchsorted(low, b, "left")
            first, last = np.maximum(low[k:m], a), np.minimum(low[k:m] + n[k:m], b)
            size = np.maximum(last - first, 0)
            if not size.sum():
                continue
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            owner = np.repeat(row[k:m], size)
            yield bs.prefix(data[a : min(b + width - 1, len(data))]), at - a, owner, at - offsets[owner]


def _pairs(width: int):
    """Rank pairs of the windows of contested blocks; later copies among DECIDED windows are decided here."""
    ladder = lengths(width)

    def decided(parts):
        key, name, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, name, key))
        key, name, doc, at = key[order], name[order], doc[order], at[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        gone = np.flatnonzero(~first & ((doc != doc[lead]) | (at != at[lead])))
        one = np.ones(first.sum(), np.int64)
        yield _batch(key[first], np.full(len(one), BLOCK), name[first], doc[first], at[first], one)
        gone = gone[np.lexsort((at[gone], doc[gone]))]
        d, s, k = _merged(doc[gone], at[gone], np.ones(len(gone), np.int64))
        yield _batch(bs.mix(d.astype(U) ^ s.astype(U)), np.full(len(d), GONE), np.zeros(len(d), np.uint32), d, s, k)

    def pairs(batches):
        waiting, size = [], 0
        for ids, text, spots in bs.arrow_batches(batches, ["doc_id", "text", "spots"]):
            docs, (data, offsets) = _docs(ids), bs.buffers(text)
            for sums, at, owner, start in _windows(data, offsets, spots, width):
                left, right = _rank(sums, at, ladder[:-1]), _rank(sums, at + (width - ladder[-2]), ladder[:-1])
                # a pair's key is spread over all bits, so that a left half with many right halves doesn't meet in one task
                waiting.append((_paired(left, right), (right >> U(32)).astype(np.uint32), docs[owner], start))
                size += len(at)
                if size >= DECIDED:
                    yield from decided(waiting)
                    waiting, size = [], 0
        if size:
            yield from decided(waiting)

    return pairs


def _covered(start: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes [a, b) that the windows cover."""
    if not len(start):
        return start, start
    order = np.argsort(start, kind="stable")
    a, b = start[order], (start + n - 1 + width)[order]
    far = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > far[:-1]
    at = np.flatnonzero(new)
    return a[at], far[np.append(at[1:], len(a)) - 1]


def _dealt(places: DataFrame, parts: int) -> DataFrame:
    """Places by key, sorted in each task. Start, n and kind travel as one long (31, 31 and 2 bits; a text has fewer than 2^31 bytes), which takes less room in an exchange."""
    start, n, kind = F.col("start"), F.col("n").cast("long"), F.col("kind").cast("long")
    packed = places.select("key", "name", "doc", F.shiftleft(start, 33).bitwiseOR(F.shiftleft(n, 2)).bitwiseOR(kind).alias("place")).repartition(parts, "key")
    place = F.col("place")
    rows = packed.select("key", "name", "doc", F.shiftrightunsigned(place, 33).alias("start"), place.bitwiseAND(F.lit(3)).cast("byte").alias("kind"), F.shiftright(place, 2).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("n"))
    return rows.sortWithinPartitions("key", "kind", "name", "doc", "start")


def removed_spans(documents: DataFrame, threshold: int = 100, extra: list[str] | None = None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, text, spots array<struct<start, n>>, extra): runs of n window
    starts whose string of `threshold` bytes starts earlier too. spots is null where there are none; doc_id is the key
    of row_keys(), extra a struct of the row's own doc_id and the columns named."""
    if threshold <= GRAM:
        raise ValueError(f"threshold must be more than {GRAM}")
    spark = documents.sparkSession
    beside = [F.struct(F.col("doc_id").cast("long").alias("own"), *extra).alias("extra")] if extra is not None else []
    rows, _ = row_keys(documents, *beside)
    texts = rows.select(F.col("key").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = _dealt(texts.mapInArrow(_scan(threshold), PLACES_SQL), parts).mapInArrow(_rank_blocks, PLACES_SQL)
    first = materialize(first.select("kind", "doc", "start", "n"))
    spot = F.struct("start", "n")
    spots = lambda df: df.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(spot).alias("spots"))
    fought = spots(first.where(F.col("kind") == CONTESTED))
    second = texts.join(fought.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spots").mapInArrow(_pairs(threshold), PAIRS_SQL)
    second = _dealt(second, parts).mapInArrow(_rank_pairs, PAIRS_SQL)
    second = materialize(second.select("doc", "start", "n"))
    gone = spots(first.where(F.col("kind") == GONE).select("doc", "start", "n").unionAll(second))
    rows = rows.select(F.col("key").alias("doc_id"), "text", *["extra"] * len(beside))
    return rows.join(gone.hint("shuffle_hash"), "doc_id", "left")


def _cleaned(width: int, extra: bool):
    def clean(batches):
        for ids, text, spots, *more in bs.arrow_batches(batches, ["doc_id", "text", "spots", *["extra"] * extra]):
            data, offsets = bs.buffers(text)
            lists = spots.offsets.to_numpy()
            start, n = spots.values.field("start").to_numpy(), spots.values.field("n").to_numpy().astype(np.int64)
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for r in range(len(offsets) - 1):
                body = data[offsets[r] : offsets[r + 1]]
                lo, hi = (lists[r], lists[r + 1]) if spots[r].is_valid else (0, 0)
                a, b = _covered(start[lo:hi], n[lo:hi], width)
                if len(a):
                    edges = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(body)]])
                    kept = b"".join(bytes(body[edges[k] : edges[k + 1]]) for k in range(0, len(edges), 2))
                else:
                    kept = bytes(body)
                for name, value in zip(out, (len(body), int((b - a).sum()), len(a), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[name].append(value)
            columns = [ids, *map(pa.array, (out["n_bytes"], out["n_removed"], out["n_spans"])), pa.array(out["kept"], pa.binary()), pa.array(out["kept_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", *out, *["extra"] * len(more)])

    return clean


def suffix_dedup(documents: DataFrame, threshold: int = 100, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256, and the columns named in extra), one row per document row.

    Nulls: text counts as empty, doc_id as the last. Empty tables give empty results. Only doc_id,
    text and extra are read, so other columns may have any name. kept are the remaining bytes; a cut may
    split a character, so decode with errors="replace".
    """
    spans = removed_spans(documents, threshold, extra or [])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    found = spans.mapInArrow(_cleaned(threshold, True), f"{schema}, extra {spans.schema['extra'].dataType.simpleString()}")
    return found.select(F.col("extra.own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", *(f"extra.{c}" for c in extra or []))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
