"""Ranking, set and join operators."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the largest version of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(version, *(c for c in rest if c != version))).alias("x")).select(*key, *(F.col(f"x.{c}") for c in rest))


def inherited(rows: DataFrame, key: str, version: str, value: str, default: str) -> DataFrame:
    """A row whose value is the default takes the last other value before it."""
    own = F.when(~F.col(value).eqNullSafe(F.lit(default)), F.col(value))
    before = F.last(own, ignorenulls=True).over(Window.partitionBy(key).orderBy(version).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("effective", F.coalesce(own, before, F.col(value)))


def best_per(rows: DataFrame, key: str, score: str, ident: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(F.struct(score, (-F.col(ident)).alias("i"))).alias("x")).select(key, (-F.col("x.i")).alias(ident), f"x.{score}")


def elections() -> dict[str, list[Column]]:
    """Rules by name: the first in this order is canonical. They differ on purpose."""
    return {
        "verified_degree": [F.desc("verified"), F.desc("degree"), F.desc("strength"), F.asc("attested_at"), F.asc("id")],
        "verified_convergent": [F.desc("verified"), F.desc("convergent"), F.desc("evidence"), F.asc("attested_at"), F.asc("id")],
        "earliest": [F.asc("attested_at"), F.asc("id")],
        "smallest": [F.asc("id")],
    }


def elected(rows: DataFrame, group: str, rule: str) -> DataFrame:
    return rows.withColumn("p", F.row_number().over(Window.partitionBy(group).orderBy(*elections()[rule]))).where("p = 1").drop("p")


def stride_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of a key at even steps."""
    w = Window.partitionBy(key)
    step = F.ceil(F.count(F.lit(1)).over(w) / most)
    return rows.withColumns({"i": F.row_number().over(w.orderBy(order)) - 1, "step": step}).where("i % step = 0").drop("i", "step")


def span_gaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Gaps between what the spans before cover and the next start, and overlaps with it."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("before", before)
    return rows.select(key, start, end, F.greatest(F.col(start) - F.coalesce("before", F.lit(0)), F.lit(0)).alias("gap"), F.greatest(F.coalesce("before", F.lit(0)) - F.col(start), F.lit(0)).alias("overlap"))


def first_wins(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    return rows.withColumn("p", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("p = 1").drop("p")


def set_compare(rows: DataFrame, key: str, value: str, among: list) -> DataFrame:
    """Values of the chosen keys: shared by all, unique to one, or in between."""
    held = rows.where(F.col(key).isin(among)).select(key, value).distinct().groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("owner"))
    return held.select(value, "n", F.when(F.col("n") == len(among), "shared").when(F.col("n") == 1, "unique").otherwise("some").alias("kind"), F.when(F.col("n") == 1, F.col("owner")).alias("owner"))


def crosscheck(claimed: Column, used: Column) -> Column:
    """Two string arrays: what each lacks, and a verdict."""
    missing, extra = F.array_except(used, claimed), F.array_except(claimed, used)
    verdict = F.when(F.size(used) == 0, "inconclusive").when(F.size(extra) > 0, "fabrication").when(F.size(missing) > 0, "under_report").otherwise("pass")
    return F.struct(missing.alias("missing"), extra.alias("extra"), verdict.alias("verdict"))


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ between two stores: positive is missing on the right, negative is orphaned there."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "l"), (right, "r")))
    gap = F.coalesce("l", F.lit(0)) - F.coalesce("r", F.lit(0))
    return a.join(b, key, "full_outer").select(key, gap.alias("difference"), F.when(gap > 0, "missing").otherwise("orphan").alias("kind")).where("difference <> 0")


def upserted(table: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, the incoming ones win."""
    return table.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def insert_ignored(table: DataFrame, incoming: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """Incoming rows that match no row of the table on any of the keys; the first of a batch wins."""
    for key in keys:
        incoming = incoming.join(table.select(*key).distinct(), key, "left_anti")
        incoming = first_wins(incoming, F.struct(*key), [F.asc(order)])
    return incoming


def edges_with_both_ends(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends known, the others)."""
    known = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known, edges.join(known.select("src", "dst"), ["src", "dst"], "left_anti")


def log_window(log: DataFrame, events: DataFrame) -> DataFrame:
    """A run's tool log since its last go (else its first event); rows match by run, or by credential where they have no run."""
    start = events.groupBy("run_id", "credential").agg(F.coalesce(F.max(F.when(F.col("event") == "go", F.col("ts"))), F.min("ts")).alias("start"))
    own = log.where("run_id is not null").join(start.select("run_id", "start"), "run_id").where("called_at >= start")
    loose = log.where("run_id is null").drop("run_id").join(start.select("run_id", "credential", "start"), "credential").where("called_at >= start")
    return own.unionByName(loose)


def stratified(rows: DataFrame, key: str, stratum: Column, sizes: dict[str, int], seed: int) -> DataFrame:
    """The first of each stratum by a seeded hash: reproducible, and no sort of all rows in one task beyond a stratum's top."""
    ranked = rows.withColumn("stratum", stratum).withColumn("h", F.xxhash64(F.col(key), F.lit(seed)))
    parts = [ranked.where(F.col("stratum") == s).orderBy("h", key).limit(n) for s, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.drop("h")


def throttled(rows: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """Rows at least `days` after the last row of their key that was kept; the first of each key is kept. Whether a row stays depends on all
    before it, so a key's rows go through one task in order, batch by batch: what it remembers is one time."""
    at, named = rows.columns.index(ts), rows.columns.index(key)
    gap = datetime.timedelta(days=days)

    def keep(batches):
        nothing = object()
        owner, last = nothing, None
        for batch in batches:
            keys, times = batch.column(named).to_pylist(), batch.column(at).to_pylist()
            kept = []
            for k, t in zip(keys, times, strict=True):
                if k != owner or last is None or (t is not None and t >= last + gap):
                    owner, last = k, t
                    kept.append(True)
                else:
                    kept.append(False)
            yield batch.filter(pa.array(kept, pa.bool_()))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key, ts).mapInArrow(keep, rows.schema)


def resume_state(rows: DataFrame, key: str, status: str) -> DataFrame:
    n = lambda *s: F.sum(F.col(status).isin(*s).cast("int"))
    return rows.groupBy(key).agg(n("pending").alias("p"), n("done").alias("d")).select(key, F.when(F.col("p") > 0, "resume").when(F.col("d") == 0, "virgin").otherwise("rerun").alias("state"))
