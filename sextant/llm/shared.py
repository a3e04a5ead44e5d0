"""What the operators share: storage and graph functions of the library, keys of rows, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.shared import cleanup, connected_components, materialize, shared_dir

__all__ = ["LAST", "bounded_batches", "cleanup", "connected_components", "join_counted", "materialize", "row_keys", "shared_dir"]

LAST = 2**63 - 1  # stands for a null doc_id
HOT_KEYS, SALTS = 1000, 16


def bounded_batches(df: DataFrame, most: str = "8m") -> DataFrame:
    """df itself; the session's Arrow batches are bounded by bytes too (Spark's own bound is 64 MB, and each task holds several), for texts differ much in length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df


def row_keys(documents: DataFrame, *columns) -> tuple[DataFrame, DataFrame | None]:
    """(rows(key, doc_id, text, columns), names): key is a long that differs between different documents and is in the order of doc_id, null last.

    Where no doc_id is repeated it is the doc_id, and names is None. Otherwise rows with one doc_id are different documents if their
    texts differ (128 bits of hash, which also order them): keys are then places in the order of distinct (doc_id, hash), numbered by ranges, so that
    a doc_id of any number of rows is spread over tasks. Rows equal in both share a key. names(key, doc_id, copies) has one row per key.
    """
    spark = bounded_batches(documents).sparkSession
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return rows, None
    rows = rows.withColumnsRenamed({"key": "id"}).withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    order = ["id", "d1", "d2"]
    found = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("copies"))
    ranged = materialize(found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    names = materialize(ranged.withColumn("place", place).join(F.broadcast(before), "range").select(*order, "copies", (F.col("before") + F.col("place")).alias("key")))
    keyed = rows.join(names.drop("copies"), order).drop(*order)
    return keyed, names.select("key", F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "copies")


def join_counted(rows: DataFrame, counted: DataFrame, key: str, count: str, spread: str, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with counted, a table with one row per key and the number of the key's rows; it is read three times, or once where counts, a small written table of keys and numbers, is given. A key with more than one in HOT_KEYS of all
    rows (there are fewer than HOT_KEYS of these, so they can be broadcast) is dealt into SALTS parts by a hash of column spread: no task gets all rows of one."""
    known = counted if counts is None else counts
    total = known.agg(F.sum(count)).collect()[0][0] or 0
    many = F.col(count) > max(2, total / HOT_KEYS)
    hot = F.broadcast(known.where(many).select(key, F.lit(True).alias("is_hot")))  # fewer than HOT_KEYS rows
    dealt = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")).drop("is_hot")
    parts = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(counted.withColumn("salt", F.explode(parts)), [key, "salt"]).drop("salt")
