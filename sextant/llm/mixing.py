"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents the same expected number of
copies, target / source size (0 to 2). The whole part is taken as it is, the fraction is rounded: two
documents with fractions meet and, at random and without bias, pass on so many words that one
becomes 0 or 1 while the words expected of both stay the same. Groups of about GROUP documents do this
one after another in a task; the one fraction that each leaves meets the others' in the next level
of a tree, until a source has one left, of which so many words are taken: a source's sum then differs from its
target by less than a word. Draws are hashes of seed, level and rows, where a row is known by its doc_id, 128 bits of hash of its text and its number
among equal rows; so reruns agree, however the table is split and sorted.

Nulls: text counts as empty, the null source is a source of its own and last. Documents without words take none. Rows that share a doc_id, or have none, are
separate documents. Rows equal in doc_id, source and text can't be told apart: they are counted, and numbered in blocks of COPIES, so any number of them spreads over
groups and tasks like other rows.
Empty tables give empty results. Only doc_id, text and source are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import bounded_batches, materialize

GROUP, COPIES = 1024, 10_000
IDENTITY = ["h1", "h2"]
ROUNDED = "h1 long, h2 long, doc_id long, row long, source string, size long, whole long, fraction double, left boolean"


def _sizes(batches):
    for h1, h2, ids, source, text in bs.arrow_batches(batches, ["h1", "h2", "doc_id", "source", "text"]):
        data, offsets = bs.buffers(text)
        size = np.zeros(len(offsets) - 1, np.int64)
        for i, j in bs.runs(offsets, 4 * bs.PIECE):
            inside = bs.WORD_LUT[data[offsets[i] : offsets[j]]]
            if not len(inside):
                continue
            start = inside.copy()
            start[1:] &= ~inside[:-1]
            first = offsets[i:j] - offsets[i]
            first = first[first < len(inside)]
            start[first] = inside[first]
            total = np.concatenate([[0], np.cumsum(start)])
            at = offsets[i : j + 1] - offsets[i]
            size[i:j] = total[at[1:]] - total[at[:-1]]
        yield pa.RecordBatch.from_arrays([h1, h2, ids, source, pa.array(size)], names=[*IDENTITY, "doc_id", "source", "size"])


def identified(documents: DataFrame, *beside: str) -> DataFrame:
    """documents with IDENTITY: 128 bits of hash of the text (null: empty) and the columns named."""
    columns = [F.coalesce(F.col("text").cast("string"), F.lit("")), *beside]
    return documents.withColumns({"h1": F.xxhash64(*columns), "h2": F.xxhash64(F.lit(1), *columns)})


def word_counts(documents: DataFrame, *beside: str) -> DataFrame:
    """(IDENTITY, doc_id, source, size); size is the number of runs of characters other than space and \\x09-\\x0D."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *beside)
    rows = identified(rows, *beside).drop(*beside)
    return bounded_batches(rows).mapInArrow(_sizes, "h1 long, h2 long, doc_id long, source string, size long")


def numbered(counted: DataFrame) -> DataFrame:
    """One row for each row of counted, with `row`, a hash of what tells it from others."""
    key = [*IDENTITY, "doc_id", "source", "size"]
    groups = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    blocks = blocks.repartition(F.xxhash64(*IDENTITY, "doc_id", "block"))  # a group's blocks part here
    first = F.col("block") * COPIES
    copy = F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)).alias("copy")
    return blocks.select(*key, copy).withColumn("row", F.xxhash64("doc_id", *IDENTITY, "copy")).drop("copy")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words for each source: weights repeat over the sources by code point, null last; what a cap of
    `most` times the size leaves over is shared out again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, done, active = share * sum(sizes.values()), {}, list(order)
    while active:
        rest, sum_of = total - sum(done.values()), sum(weight[s] for s in active)
        given = {s: rest * weight[s] / sum_of for s in active}
        above = [s for s in active if given[s] > most * sizes[s]]
        if not above:
            return done | given
        done |= {s: most * sizes[s] for s in above}
        active = [s for s in active if s not in done]
    return done


def _draw(seed: int, level: int, a: int, b: int) -> float:
    return xxhash.xxh3_64_intdigest(f"{seed}/{level}/{a}/{b}") / 2**64


def _pivot(seed: int, level: int, last: bool):
    def pivot(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=[False, True], ignore_index=True)
        size, p = rows["size"].to_numpy(), rows["fraction"].to_numpy().copy()
        ids = rows["row"].to_numpy()
        left = np.zeros(len(rows), bool)
        open_ = -1
        for k in range(len(rows)):
            if size[k] == 0:
                p[k] = 0.0
            if p[k] in (0.0, 1.0):
                continue
            if open_ < 0:
                open_ = k
                continue
            i = open_
            words = {i: p[i] * size[i], k: p[k] * size[k]}
            room = {x: size[x] - words[x] for x in (i, k)}
            gain_i, gain_k = min(room[i], words[k]), min(room[k], words[i])
            take, give = (i, k) if _draw(seed, level, ids[i], ids[k]) * (gain_i + gain_k) < gain_k else (k, i)
            if room[take] <= words[give]:  # exactly one or both of them become integral
                p[give] = 0.0 if room[take] == words[give] else (words[give] - room[take]) / size[give]
                p[take] = 1.0
            else:
                p[take] = (words[take] + words[give]) / size[take]
                p[give] = 0.0
            open_ = next((x for x in (i, k) if 0.0 < p[x] < 1.0), -1)
        if open_ >= 0:
            left[open_] = not last
        return rows.assign(fraction=p, left=left).drop(columns="salt")

    return pivot


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1, beside: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, IDENTITY) for each document row; the columns beside tell rows apart too.

    The driver gets one row per source (name, size, documents), never a row per document.
    """
    spark = documents.sparkSession
    counted = materialize(numbered(word_counts(documents, *beside)))
    found = counted.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["source"]: int(r["s"]) for r in found}
    wanted = targets(sizes, weights, share, most)
    depth, groups = 0, {r["source"]: int(r["n"]) for r in found}
    plan = []
    for r in found:
        size, target, n, steps = sizes[r["source"]], wanted[r["source"]], groups[r["source"]], []
        while True:
            n = math.ceil(n / GROUP)
            steps.append(n)
            if n <= 1:
                break
        depth = max(depth, len(steps))
        rate = target / size if size else 0.0
        plan.append((r["source"], size, float(target), int(rate), rate - int(rate), steps))
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole long, fraction double, steps array<int>")
    done, live = None, counted.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.*", "p.whole", "p.fraction", "p.steps")
    for level in range(max(depth, 1)):
        salt = F.pmod(F.xxhash64("row", F.lit(seed + level)), F.coalesce(F.get("steps", F.lit(level)), F.lit(1)))
        last = level == max(depth, 1) - 1
        step = materialize(live.withColumn("salt", salt).drop("steps").groupBy("source", "salt").applyInPandas(_pivot(seed, level, last), ROUNDED))
        over = step.where("not left").drop("left")
        done = over if done is None else done.unionAll(over)
        live = step.where("left").drop("left").alias("d").join(plan.select("source", "steps").alias("p"), F.expr("d.source <=> p.source")).select("d.*", "p.steps")
    out = done.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
    return out.select("d.doc_id", "d.size", "p.source_size", "p.target", F.expr("d.whole * d.size + cast(round(d.fraction * d.size) as long)").alias("taken"), "d.source", *(f"d.{c}" for c in IDENTITY))


def op4_mix_sources(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", *IDENTITY)
