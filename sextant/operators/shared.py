"""Storage shared by driver and executors, plus distributed connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session has none a temporary one is set if all tasks run in this process (tests); on a cluster, whose
    executors would each write to a disk of their own, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, files: int = 0) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there,
    so a lost executor costs the tasks it ran and not the steps before. The shuffle files of the write go when it ends, for nothing reads them again."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/sextant/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def cleanup(spark: SparkSession | None = None) -> None:
    """Delete the tables of materialize(). Results that read them must have been used by then."""
    while _written:
        if not remove(*_written.pop()):
            return


def remove(owner: SparkSession, path: str) -> bool:
    """Delete a folder through Spark's file system; False if the session is gone."""
    try:
        jvm, jsc = owner._jvm, owner.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        return False
    return True


atexit.register(cleanup)


def tree_roots(step: DataFrame) -> DataFrame:
    """step(node, to) with to <= node and every `to` a node -> (node, root of its tree). Pointer jumping: each pass
    doubles the way that a node looks up, so a tree of depth d takes about log2(d) passes and one that finds nothing to move."""
    while True:
        up = step.select(F.col("node").alias("to"), F.col("to").alias("up"))
        far = materialize(step.join(up, "to").select("node", F.col("up").alias("to"), F.expr("up <> to").alias("moved")))
        step = far.select("node", "to")
        if far.where("moved").isEmpty():
            return step


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long -> (node, root) with root the smallest node reachable.

    Contraction: every node takes its smallest neighbour or itself, then the root of the tree that these links make; both ends
    of each edge are renamed, loops and repeats go. Two rounds at least halve the nodes: those kept by a round had no smaller
    neighbour, and by the next each keeps one at most for every node that the first renamed. So rounds and passes are logarithmic,
    whatever the shape and the order of ids, and the loop runs until no edge is left. Each round is one partially aggregated group-by and
    equi-joins whose right side has one row per node, so a hot node never meets in one task
    (skew-split joins). The smallest node of a component is never renamed, hence it is the root.
    Empty edges give an empty result; null ends are ignored.
    """
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    live = materialize(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = tree_roots(materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))))
        steps.append(step)
        ta, tb = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        live = live.join(ta, "a").join(tb, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        live = materialize(live.distinct())
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        moved = step.select(F.col("node").alias("root"), "to")
        label = label.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(label)
