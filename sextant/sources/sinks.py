"""Sinks over plain Parquet folders: batch-idempotent writes without a table format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.relations import insert_ignored, upserted
from sextant.operators.shared import materialize


def write_upsert(path: str, incoming: DataFrame, key: list[str]) -> None:
    """Incoming rows take the place of those with their key, in a plain folder. The new state is complete beside the old one before both are moved; a writer that died
    between the two moves is finished by the next (see `settled`). Readers that must never meet a missing folder use `snapshots`."""
    spark = incoming.sparkSession
    settled(spark, path)
    upserted(spark.read.parquet(path), incoming, key).write.mode("overwrite").parquet(f"{path}.new")
    _moved(spark, path)


def settled(spark: SparkSession, path: str) -> None:
    """Finish or undo what an upsert that died left beside a folder."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")):  # died between the moves: the new state is complete
        fs.rename(at(f"{path}.new"), at(path))
    for rest in (f"{path}.new", f"{path}.old"):
        fs.delete(at(rest), True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _moved(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    if not (fs.rename(at(path), at(f"{path}.old")) and fs.rename(at(f"{path}.new"), at(path))):
        raise OSError(f"{path} could not be moved")
    fs.delete(at(f"{path}.old"), True)


def append_new(path: str, incoming: DataFrame, keys: list[list[str]], order: str) -> int:
    """Appends the rows that match none on any key; gives their number."""
    new = materialize(insert_ignored(incoming.sparkSession.read.parquet(path), incoming, keys, order))
    new.write.mode("append").parquet(path)
    return new.count()


def transition(rows: DataFrame, status: str, allowed: dict[str, str]) -> DataFrame:
    """Guarded status changes: only the pairs named happen."""
    change = F.create_map(*(F.lit(x) for pair in allowed.items() for x in pair))
    return rows.withColumn(status, F.coalesce(F.try_element_at(change, F.col(status)), F.col(status)))


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def logged(rows: DataFrame, column: str, entry) -> DataFrame:
    """An entry appended to an array column; null counts as empty."""
    return rows.withColumn(column, F.when(F.col(column).isNull(), F.array(entry)).otherwise(F.concat(column, F.array(entry))))


def verified_write(rows: DataFrame, path: str) -> int:
    """Writes, reads back, and raises where the counts differ."""
    rows = materialize(rows)
    rows.write.mode("overwrite").parquet(path)
    wanted, found = rows.count(), rows.sparkSession.read.parquet(path).count()
    if wanted != found:
        raise RuntimeError(f"{wanted} rows written, {found} read back")
    return found
