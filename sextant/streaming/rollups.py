"""Streaming rollups: daily costs and demand, absolute replacement by key, run status with a timeout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.functions.vector import micro_units
from sextant.operators.shared import materialize


def daily_costs(events: DataFrame) -> DataFrame:
    """events(ts, event_type, user_id, value), at rest or streaming -> (day, event_type, user_id, calls, micro). Integers, so that sums don't depend on order."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
        rows = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(micro_units(F.col("value"))).alias("micro"))
        return rows.select(F.col("w.start").cast("date").alias("day"), "event_type", "user_id", "calls", "micro")
    return events.groupBy(F.to_date("ts").alias("day"), "event_type", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(micro_units(F.col("value"))).alias("micro"))


def daily_demand(events: DataFrame, key: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", "2 days")
    return rows.groupBy(F.window("ts", "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), key, "n")


def replace_by_key(path: str, key: list[str]):
    """A foreachBatch sink: rows of a batch take the place of those with their key, one folder per `day`, so a batch rewrites only the days it touches.
    A replay writes the same again."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            days = [r[0] for r in batch.select("day").distinct().collect()]  # a few days a batch
            jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
            known = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
            out = batch
            if known and days:
                old = spark.read.parquet(path).where(F.col("day").isin(days))
                out = materialize(old.join(batch.select(*key), key, "left_anti").unionByName(batch))  # before its own source is overwritten
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        finally:
            batch.unpersist()

    return write


def start_rollup(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived and stops; daily costs in update mode to a replacing sink."""
    sink = replace_by_key(path, ["day", "event_type", "user_id"])
    return daily_costs(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """An extension: session windows of a user's events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", "2 days")
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_in(events: DataFrame, key: list[str], days: int = 7) -> DataFrame:
    """A row of a key at most once in so many days."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(key)
