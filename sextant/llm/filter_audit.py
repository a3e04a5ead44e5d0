"""Filter interaction audit by first-failure lookup.

Five filters A to E leave each document with a mask of five bits, one per filter it fails. FIRST, a table of 32 masks by 120 orders computed once,
says at which step a document with that mask is removed (0: at none). Tasks look their rows up in it and count, with np.bincount, removals by part, order, step and label;
each leaves a row per part, order and step, and Spark adds these partial counts up, with partial sums before the exchange.

E fails where a smaller doc_id has the same text: texts are grouped by SHA-256 and length, only hashes of several rows travel on, and a hash that many rows share is dealt over
tasks on its way back.

Null texts count as empty (no words: A fails, B to D do not), the null source and the empty one are the part ''. A null doc_id counts as larger than any other; rows of one doc_id
never make each other fail E and are counted one by one. Labels are joined by doc_id; of several rows for one the largest values count, and a null label counts as 0. An empty table has no parts, so
the result is empty. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import LAST, join_counted, materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PLACES = np.array([[o.index(f) for f in FILTERS] for o in ORDERS])  # order x filter -> step - 1
STEPS, MOST_PARTS, ROWS = len(FILTERS), 256, 4096
WORD = r"[^\x20\x09-\x0D]+"  # fixed by the contract, like the limits of the filters
COUNTS = ["reached", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def first_failures() -> np.ndarray:
    """32 x 120: the step (1 to 5) at which a mask's document goes, or 0."""
    masks = np.arange(1 << STEPS)
    fails = (masks[:, None] >> np.arange(STEPS) & 1).astype(bool)  # mask x filter
    step = np.where(fails[:, None, :], PLACES[None] + 1, STEPS + 1).min(axis=2)
    return np.where(step > STEPS, 0, step)


FIRST = first_failures()


def masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row: bit k is set where the row fails FILTERS[k]."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.char_length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails)), F.lit(0))
    known = materialize(rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("key"), "part", bits.cast("int").alias("mask"), F.concat(F.sha2("text", 256), F.lit(":"), F.octet_length("text")).alias("h")))
    several = known.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("first")).where("c > 1")
    again = join_counted(known, materialize(several), "h", "c", "key").select("doc_id", "part", (F.col("mask") + F.when(F.col("key") > F.col("first"), 16).otherwise(0)).cast("int").alias("mask"))
    alone = known.join(several.select("h"), "h", "left_anti").select("doc_id", "part", "mask")
    return alone.unionByName(again)


def _counted(batches):
    """Partial counts of a task: (part, o, step, COUNTS...). With more than MOST_PARTS parts at hand the counts go out and begin anew, so memory doesn't follow the number of parts."""
    parts: dict[str, np.ndarray] = {}
    own = [1 << k for k in range(STEPS)]

    def out():
        if parts:
            n = len(ORDERS) * STEPS
            names = pa.array([p for p in parts for _ in range(n)])
            o, step = np.tile(np.repeat(np.arange(len(ORDERS)), STEPS), len(parts)), np.tile(np.arange(1, STEPS + 1), len(ORDERS) * len(parts))
            counts = np.stack(list(parts.values()), axis=1).reshape(len(COUNTS), -1)
            yield pa.RecordBatch.from_arrays([names, pa.array(o.astype(np.int32)), pa.array(step.astype(np.int32)), *(pa.array(c) for c in counts)], names=["part", "o", "step", *COUNTS])
            parts.clear()

    for part, mask, good, toxic in bs.arrow_batches(batches, ["part", "mask", "good", "toxic"]):
        names = part.dictionary_encode()
        code, mask, good, toxic = names.indices.to_numpy(), mask.to_numpy(), good.to_numpy(), toxic.to_numpy()
        size = len(ORDERS) * STEPS
        for k, name in enumerate(names.dictionary.to_pylist()):
            every = np.flatnonzero(code == k)
            total = parts.setdefault(name, np.zeros((len(COUNTS), size), np.int64))
            for a in range(0, len(every), ROWS):
                some = every[a : a + ROWS]
                step = FIRST[mask[some]]  # rows x orders
                place = np.arange(len(ORDERS)) * STEPS + step - 1
                gone = step > 0
                count = lambda which, place=place: np.bincount(place[which], minlength=size)
                total[0, ::STEPS] += len(some)
                total[1] += count(gone)
                total[4] += count(gone & (good[some] == 1)[:, None])
                total[5] += count(gone & (toxic[some] == 1)[:, None])
                for f in range(STEPS):  # where a filter stands in each order, and whether what fails it was gone before
                    fails = mask[some] & own[f] > 0
                    at = np.arange(len(ORDERS)) * STEPS + PLACES[:, f]
                    late = (step < PLACES[:, f] + 1) & fails[:, None]
                    total[2] += np.bincount(np.broadcast_to(at, late.shape)[late], minlength=size)
                    total[3][at] += np.count_nonzero(mask[some] == own[f])
        if len(parts) > MOST_PARTS:
            yield from out()
    yield from out()


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max("quality"), F.lit(0)).cast("int").alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("toxic"))
    rows = masks(documents).join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    partial = rows.mapInArrow(_counted, "part string, o int, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    total = partial.groupBy("part", "o", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))
    # a small table from here on: 600 rows for each part
    names = F.array(*(F.lit(o) for o in ORDERS))
    total = total.withColumn("filter_order", F.get(names, F.col("o"))).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    order = Window.partitionBy("part", "o").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = total.withColumn("kept", F.sum(F.col("reached") - F.col("removed")).over(order))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return total.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def op13_filter_audit(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return filter_audit(documents, labels)


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM t),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, e FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
p AS (SELECT [v.f, w.f, x.f, y.f, z.f] AS o FROM x v, x w, x, x y, x z WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
m AS (SELECT g.*, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM g),
s AS (SELECT m.*, o, list_min(list_transform(fails, lambda k: list_position(o, k))) AS gone FROM m, p),
r AS (SELECT part, o, step, o[step] AS filter, n, good, toxic, fails, gone FROM s, (SELECT unnest(range(1, 6)) AS step)),
u AS (SELECT part, o, step, filter, sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND list_contains(fails, filter) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = [filter] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, o, step, filter)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM u
"""
