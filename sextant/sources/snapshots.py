"""Tables whose versions appear all at once, over plain Parquet folders, and rollups kept up by signed changes.

A version is a manifest `log/<number>` that names data folders. Data is written first, under a name of its own; the manifest is written beside and moved to its number last, and a move to
a number that is taken fails. So a reader sees the version before or the one after, a writer that dies leaves nothing that counts, and of two writers from one version
one gets `Conflict` and starts again. Appends name one folder more, rewrites name new folders only. `vacuum` deletes what no kept manifest names.

All access to files goes through Spark's file systems, so the table may lie wherever Spark reads and a move to an existing name fails (HDFS and local disks; not plain object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.operators.relations import upserted


class Conflict(RuntimeError):
    """Another writer made a version since this one began."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n) for n in (f.getPath().getName() for f in self._fs.listStatus(folder)) if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, or of the last; one without folders where there is none."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "folders": [], "rows": 0, "schema": None}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/log/{version:012d}", wholetext=True).collect()[0][0]  # one small file
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        told = self.manifest(version)
        if told["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        schema = StructType.fromJson(told["schema"])
        if not told["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in told["folders"]))

    # changes

    def _put(self, rows: DataFrame, check: bool) -> tuple[str, int]:
        """Data under a name that nothing refers to yet, and its rows, counted in what was written; with check, in what was given too."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        found = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}").count()
        if check and found != (wanted := rows.count()):
            raise RuntimeError(f"{wanted} rows given, {found} written")
        return name, found

    def _commit(self, before: dict, folders: list[str], rows: int, schema: StructType, note: str) -> int:
        version = before["version"] + 1
        text = json.dumps({"version": version, "folders": folders, "rows": rows, "schema": schema.jsonValue(), "note": note})
        beside = self._at(f"{self.path}/pending/{uuid.uuid4().hex}")
        out = self._fs.create(beside)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._at(f"{self.path}/log"))
        target = self._at(f"{self.path}/log/{version:012d}")
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise Conflict(f"version {version} of {self.path} is another writer's")
        return version

    def append(self, rows: DataFrame, note: str = "append", check: bool = False) -> int:
        before = self.manifest()
        name, n = self._put(rows, check)
        return self._commit(before, [*before["folders"], name], before["rows"] + n, rows.schema, note)

    def replace(self, rows: DataFrame, note: str = "replace", check: bool = False, before: dict | None = None) -> int:
        before = before or self.manifest()
        name, n = self._put(rows, check)
        return self._commit(before, [name], n, rows.schema, note)

    def change(self, make: Callable[[DataFrame], DataFrame], note: str = "change", tries: int = 3, check: bool = False) -> int:
        """make(the last version) becomes the next; begins anew, `tries` times, where another writer was faster."""
        for left in range(tries - 1, -1, -1):
            before = self.manifest()
            try:
                return self.replace(make(self.read(before["version"])), note, check, before)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def upsert(self, incoming: DataFrame, key: list[str], check: bool = True) -> int:
        """Incoming rows take the place of those with their key; the rows written are counted against the rows that should be there before the version counts."""
        if not self.versions():
            return self.replace(incoming, "upsert", check)
        return self.change(lambda old: upserted(old, incoming, key), "upsert", check=check)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the last `keep`, and data that none of these names; gives the number of folders that went. No writer may be at work."""
        known = self.versions()
        kept = known[-keep:] if keep else []
        used = {f for v in kept for f in self.manifest(v)["folders"]}
        for v in known[: len(known) - len(kept)]:
            self._fs.delete(self._at(f"{self.path}/log/{v:012d}"), False)
        self._fs.delete(self._at(f"{self.path}/pending"), True)
        data = self._at(f"{self.path}/data")
        gone = [f.getPath() for f in (self._fs.listStatus(data) if self._fs.exists(data) else []) if f.getPath().getName() not in used]
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)


SIGN = "sign"


def signed_totals(changes: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """changes(key, sums, sign 1 or -1) -> (key, n, sums): what they add up to. Sums should be integers or decimals, of which nothing is lost by adding and taking away."""
    total = [F.sum(F.col(c) * F.col(SIGN)).alias(c) for c in sums]
    return changes.groupBy(*key).agg(F.sum(SIGN).cast("long").alias("n"), *total)


def refreshed(rollup: DataFrame, changes: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """The rollup (key, n, sums) after the changes: one exchange of both, no look at the rows that it was made of. Keys without rows go. A null sum counts as 0."""
    delta = signed_totals(changes, key, sums)
    both = rollup.select(*key, "n", *sums).unionByName(delta.select(*key, "n", *(F.col(c).cast(rollup.schema[c].dataType).alias(c) for c in sums)))
    total = both.groupBy(*key).agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast(rollup.schema[c].dataType).alias(c) for c in sums))
    if not total.where("n < 0").isEmpty():
        raise ValueError("more rows taken away than there were")
    return total.where("n > 0")


def refresh(table: Snapshots, changes: DataFrame, key: list[str], sums: list[str], tag: str) -> int:
    """Apply changes to a rollup once: where the last version was made with this tag nothing changes, so a batch that comes again does no harm. A foreachBatch sink, whose
    batches come one after the other, passes its batch number."""
    if table.manifest().get("note") == f"refresh {tag}":
        return table.versions()[-1]
    if not table.versions():
        first = signed_totals(changes, key, sums)
        return table.replace(first.where("n > 0"), f"refresh {tag}")
    return table.change(lambda old: refreshed(old, changes, key, sums), f"refresh {tag}")
