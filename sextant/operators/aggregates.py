"""Aggregates: coverage, costs, guarded sums, samples, cohorts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def weekly(rows: DataFrame, ts: str, latest: int) -> DataFrame:
    return counts(rows.withColumn("week", F.date_trunc("week", ts).cast("date")), "week").orderBy(F.desc("week")).limit(latest)


def coverage(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Counts over all subsets of the dimensions; a null value of a dimension is 'none', a dimension summed over is 'all'."""
    known = rows.select(*(F.coalesce(F.col(d).cast("string"), F.lit("none")).alias(d) for d in dims))
    cube = known.cube(*dims).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(d).alias(f"g_{d}") for d in dims))
    return cube.select(*(F.when(F.col(f"g_{d}") == 1, "all").otherwise(F.col(d)).alias(d) for d in dims), "n")


def safe(amount: Column) -> Column:
    """The amount where it is a number; Spark holds NaN equal to NaN, so equality is no test."""
    return F.when(~F.isnan(amount), amount)


def costs(rows: DataFrame, by: list[str], amount: str, digits: int = 2) -> DataFrame:
    value = safe(F.col(amount))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 4).alias("total"), F.round(F.avg(value), digits).alias("mean"))


def ordered_sample(rows: DataFrame, by: str, value: str, order: str, most: int) -> DataFrame:
    """The first `most` values of a group in order. Ranked before they are gathered, so no group is collected whole."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, value))
    first = rows.select(by, value, order, place.alias("p")).where(F.col("p") <= most)
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", value))), lambda s: s[value]).alias("sample"))


def oversized(rows: DataFrame, content: str, by: str, limits: list[tuple[str, int]], otherwise: int) -> DataFrame:
    """Groups with contents over a limit that depends on the content's pattern."""
    limit = F.lit(otherwise)
    for pattern, most in reversed(limits):
        limit = F.when(F.col(content).rlike(pattern), most).otherwise(limit)
    over = (F.length(content) > limit).cast("int")
    return rows.groupBy(by).agg(F.sum(over).alias("oversized"), F.count(F.lit(1)).alias("n")).where("oversized > 0")


def demand(rows: DataFrame, key: str, amount: str, ts: str, since: str, least: float, top: int) -> DataFrame:
    recent = rows.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy(key).agg(F.round(F.sum(amount), 4).alias("demand")).where(F.col("demand") >= least).orderBy(F.desc("demand"), key).limit(top)


def day_gaps(rows: DataFrame, ts: str, first: str, last: str, expected: int) -> DataFrame:
    """Every day of the span with its rows and how many are missing."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    actual = counts(rows.select(F.to_date(ts).alias("day")), "day")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return days.join(actual, "day", "left").select(F.date_format("day", "yyyyMMdd").alias("day"), n.alias("actual"), F.greatest(F.lit(0).cast("long"), expected - n).alias("gap"))


def best_per_year(rows: DataFrame, year: Column, score: str, rank: str, name: str) -> DataFrame:
    """The best score of a year; the better rank wins among equals."""
    return rows.groupBy(year.alias("year")).agg(F.max(F.struct(F.col(score), -F.col(rank), F.col(name))).alias("b")).select("year", f"b.{score}", f"b.{name}")


def cohort(rows: DataFrame, signals: dict[str, Column], skipped: Column) -> DataFrame:
    """One row: totals, failures by signal, and the failing share of those not skipped."""
    counted = F.sum((~skipped).cast("int"))
    fails = [F.sum(F.when(~skipped & c, 1).otherwise(0)).alias(f"fail_{k}") for k, c in signals.items()]
    any_fail = F.sum(F.when(~skipped & F.greatest(*(c.cast("int") for c in signals.values()), F.lit(0)).cast("boolean"), 1).otherwise(0))
    return rows.agg(F.count(F.lit(1)).alias("rows"), counted.alias("counted"), *fails, F.round(any_fail / counted, 4).alias("fail_share"))


def novelty(neighbours: DataFrame, cited: str) -> DataFrame:
    """neighbours(doc, sample, other, similarity, cited): per doc the median over samples of 1 - the largest similarity that isn't cited (1 without any), and
    the share of cited among similar documents (null without any)."""
    by_sample = neighbours.groupBy("doc", "sample").agg(F.coalesce(1 - F.max(F.when(~F.col(cited), F.col("similarity"))), F.lit(1.0)).alias("own"))
    new = by_sample.groupBy("doc").agg(F.round(F.median("own"), 6).alias("novelty"), F.count(F.lit(1)).alias("samples"))
    others = neighbours.where("other is not null").groupBy("doc", "other").agg(F.max("similarity").alias("s"), F.max(F.col(cited).cast("int")).alias("c"))
    ground = others.groupBy("doc").agg(F.round(F.avg("c"), 6).alias("grounding"), F.sum((F.col("s") > 0.9).cast("int")).alias("copies"))
    return new.join(ground, "doc", "left")


def rollup(rows: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """(dim, bucket, measures): one pass over the rows for all dimensions; null stays a bucket."""
    sets = rows.select(*[c for c in rows.columns if c not in dims], F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("bucket")) for d in dims))).alias("b"))
    return sets.groupBy("b.dim", "b.bucket").agg(*measures)


def breaker(rows: DataFrame, order: str, failed: Column, most: float, least: int = 5) -> DataFrame:
    """Running failure share in order; open once `least` rows are in and the share is over `most`."""
    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.avg(failed.cast("int")).over(w)
    return rows.withColumns({"share": F.round(share, 4), "open": (F.count(F.lit(1)).over(w) >= least) & (share > most)})
