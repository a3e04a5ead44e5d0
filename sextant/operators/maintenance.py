"""Upkeep of a corpus: selections of work, audits, refreshes, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching_ids(rows: DataFrame, key: str, forms: dict[str, Column], wanted: DataFrame, whole: Column | None = None) -> DataFrame:
    """Keys of rows of which one form of id is wanted(kind, id): all forms meet in one join, whatever their number.

    A form may be the beginning of a longer id, and in large tables several rows share one. With `whole`, the longer id of rows, and wanted(kind, id, whole) only the row meant is found;
    a null wanted.whole means all that share the form."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("id")) for k, c in forms.items())))
    rows = rows.select(key, (F.lit(None) if whole is None else whole).cast("string").alias("own"), pairs.alias("p")).select(key, "own", "p.*").where("id is not null")
    asked = wanted.select("kind", "id", (F.lit(None).cast("string") if whole is None else F.col("whole")).alias("meant")).distinct()
    met = rows.join(asked, ["kind", "id"]) if whole is not None else rows.join(asked, ["kind", "id"], "left_semi")
    return (met.where("meant is null or meant = own") if whole is not None else met).select(key).distinct()


def not_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def by_importance(chunks: DataFrame, pool: DataFrame | None, doc: str, chunk: str, position: str) -> DataFrame:
    """chunks with `place`, in the order of a search's cached pool(doc, chunk, rank), chunks outside it last; by position, with the reason, where there is no order."""
    if pool is None:
        found = chunks.withColumns({"rank": F.lit(None).cast("long"), "reason": F.lit("no_pool")})
    else:
        known = pool.select(doc).distinct().withColumn("in_pool", F.lit(True))
        found = chunks.join(pool.select(doc, chunk, "rank"), [doc, chunk], "left").join(known, doc, "left")
        found = found.withColumn("reason", F.when(F.col("in_pool").isNull(), "not_in_pool")).drop("in_pool")
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.asc_nulls_last("rank"), position, chunk))
    return found.withColumn("place", place).drop("rank")


def first_stratum(rows: DataFrame, key: str, strata: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """(key, stratum): the first n of each stratum in its order; a key in several strata stays in the first."""
    parts = [rows.where(test).select(key, order.alias("o")).orderBy("o").limit(n).select(key, F.lit(k).alias("place"), F.lit(name).alias("stratum")) for k, (name, (test, order, n)) in enumerate(strata.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy(key).agg(F.min_by("stratum", "place").alias("stratum"))


def collisions(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """(ident, keys, known): identifiers that several keys share."""
    return rows.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count_distinct(key).alias("keys"), F.count(F.lit(1)).alias("known")).where("keys > 1")


def progress(rows: DataFrame, done: Column, orphan: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(done & ~orphan).alias("done"), F.count_if(~done & ~orphan).alias("remaining"), F.count_if(orphan).alias("orphans"))


def compared(rows: DataFrame, by: str, ok: Column, one: list[str], rates: list[str]) -> DataFrame:
    """Per method: successes, failures, averages (one decimal) and rates (two) over successes; 0 where there are none."""
    mean = lambda c, n: F.coalesce(F.round(F.avg(F.when(ok, F.col(c).cast("double"))), n), F.lit(0.0))
    return rows.groupBy(by).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), *(mean(c, 1).alias(f"avg_{c}") for c in one), *(mean(c, 2).alias(f"rate_{c}") for c in rates))


def completed(marks: DataFrame, run: str, stage: str, expected: Column, closed: DataFrame, but: list[str] = ()) -> DataFrame:
    """Runs with as many distinct go marks as stages expected, less those closed and those whose name holds a part in `but`."""
    done = marks.groupBy(run).agg(F.count_distinct(stage).alias("stages"), F.max(expected).alias("expected")).where("stages = expected")
    for part in but:
        done = done.where(~F.col(run).cast("string").contains(part))
    return done.join(closed.select(run), run, "left_anti").select(run, "stages")


def retired(rows: DataFrame, entity: str, version: str) -> DataFrame:
    """is_latest of each row: its entity has no later version."""
    return rows.withColumn("is_latest", F.col(version) == F.max(version).over(Window.partitionBy(entity)))


def refreshed(rows: DataFrame, key: str, column: str, details: DataFrame, value: Column) -> DataFrame:
    """column is the sum of the details where rows have none."""
    sums = details.groupBy(key).agg(F.sum(value).alias("fresh"))
    return rows.join(sums, key, "left").withColumn(column, F.coalesce(column, "fresh")).drop("fresh")


def replayed(requests: DataFrame, log: DataFrame, owner: str, ident: str, order: str) -> DataFrame:
    """For each request the earliest logged outcome of its (owner, key), if there is one."""
    first = log.groupBy(owner, ident).agg(F.min_by("outcome", order).alias("outcome"))
    return requests.join(first, [owner, ident], "left")


def lacks(ids: Column, key: str) -> Column:
    """A map that is null, empty or without the key."""
    return ids.isNull() | (F.size(ids) == 0) | ~F.coalesce(F.map_contains_key(ids, key), F.lit(False))


def stale(rows: DataFrame, key: str, test: Column, after: int | None, limit: int) -> DataFrame:
    """A keyset page of the rows to do again, by key."""
    return (rows if after is None else rows.where(F.col(key) > after)).where(test).orderBy(key).limit(limit)


def reconciled(left: DataFrame, right: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """(key, side): keys that only one of two stores has, at most `limit` a side and run, smallest first."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit).withColumn("side", F.lit(side))
    return only(left, right, "left").unionAll(only(right, left, "right"))


def dossier(asked: DataFrame, stored: DataFrame, key: str, **defaults) -> DataFrame:
    """Read or create: the stored row of each key asked for, with defaults where there is none or a field is null; `created` tells which."""
    found = asked.select(key).distinct().join(stored.withColumn("had", F.lit(True)), key, "left")
    return found.select(key, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()), F.col("had").isNull().alias("created"))


def pdf_pages(content: Column) -> Column:
    """Page objects in the raw bytes of a PDF, those of the page tree left out."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]"))


def reranked(rows: DataFrame, score: Callable[[pd.Series], pd.Series], text: str, key: str, limit: int) -> DataFrame:
    """The best `limit` rows by the sigmoid of an injected scorer, ties by key."""
    logit = F.pandas_udf(score, "double")
    return rows.withColumn("rerank", 1 / (1 + F.exp(-logit(F.col(text))))).orderBy(F.desc("rerank"), key).limit(limit)


def pool_size(limit: int, filtered: bool, rerank: bool) -> int:
    """How many candidates a search takes before it filters, reranks and diversifies."""
    return max(50, 5 * limit) if filtered else max(15, 3 * limit) if rerank else max(30, 3 * limit)


def coverage(spans: DataFrame, sources: DataFrame, key: str, droppable: Callable[[Column], Column]) -> DataFrame:
    """spans(key, i, a, b) with null a for pieces not found, sources(key, text) -> (key, pct, n_gaps, n_overlaps, n_allowed, n_failed, ordered, clean).

    Gaps are stretches in no span with more than blanks in them; droppable ones are allowed and count as no content.
    """
    real = spans.where("a is not null and b is not null")
    by_i, by_a = Window.partitionBy(key).orderBy("i"), Window.partitionBy(key).orderBy("a", "b", "i")
    before = F.struct(F.lag("a").over(by_i), F.lag("b").over(by_i))
    real = real.withColumns({"late": F.lag("a").over(by_i).isNotNull() & (before > F.struct("a", "b")), "over": F.lag("b").over(by_a) > F.col("a"), "reach": F.coalesce(F.max("b").over(by_a.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    found = real.groupBy(key).agg(F.collect_list(F.when(F.col("a") > F.col("reach"), F.struct(F.col("reach").alias("s"), F.col("a").alias("e")))).alias("gaps"), F.max("b").alias("end"), F.count_if("over").alias("n_overlaps"), (~F.max("late")).alias("ordered"))
    failed = spans.groupBy(key).agg(F.count_if(F.expr("a is null or b is null")).alias("n_failed"))
    rows = sources.select(key, "text").join(found, key, "left").join(failed, key, "left")
    tail = F.struct(F.coalesce("end", F.lit(0)).cast("int").alias("s"), F.length("text").alias("e"))
    gaps = F.transform(F.coalesce("gaps", F.array().cast("array<struct<s:int,e:int>>")), lambda g: F.struct(g["s"].cast("int").alias("s"), g["e"].cast("int").alias("e")))
    texts = F.transform(F.filter(F.concat(gaps, F.array(tail)), lambda g: g["e"] > g["s"]), lambda g: F.substring(F.col("text"), g["s"] + 1, g["e"] - g["s"]))
    solid = lambda t: F.length(F.regexp_replace(t, r"\s+", ""))
    rows = rows.withColumn("texts", F.filter(texts, lambda t: solid(t) > 0))
    rows = rows.withColumns({"lost": F.filter("texts", lambda t: ~droppable(t)), "allowed": F.filter("texts", droppable)})
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, t: n + solid(t))
    content, gone = solid(F.col("text")) - total("allowed"), total("lost")
    rows = rows.select(key, F.when(content > 0, F.round(100 * (content - gone) / content, 2)).otherwise(100.0).alias("pct"), F.size("lost").alias("n_gaps"), F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"), F.size("allowed").alias("n_allowed"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("ordered", F.lit(True)).alias("ordered"))
    return rows.withColumn("clean", F.expr("n_gaps = 0 and n_overlaps = 0 and ordered and n_failed = 0"))
