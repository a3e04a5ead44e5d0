"""The tables a query reads, and views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """A directed chain customer -> nation -> region as (src, dst, label)."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    a = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("lives_in").alias("label"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("part_of").alias("label"))
    return a.unionAll(b)


def supersedes(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive turns of a conversation as (id, supersedes)."""
    t = table(spark, folder, "conversations")
    ident = lambda turn: F.concat_ws("-", "conv_id", turn)
    earlier = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has"))
    rows = t.select("conv_id", "turn").join(earlier, ["conv_id", "turn"], "left")
    return rows.select(ident(F.col("turn")).alias("id"), F.when(F.col("has"), ident(F.col("turn") - 1)).alias("supersedes"))
