"""Search pools and run statuses: expiry, replay after a restart, and state that goes."""

import datetime

import pytest

from sextant.streaming.pools import run_statuses, search_pools

T0 = datetime.datetime(2024, 1, 1, 12)
at = lambda seconds: T0 + datetime.timedelta(seconds=seconds)
REQUESTS = "pool string, ts timestamp, action string, items array<string>, first int, most int"
save = lambda pool, s, items: (pool, at(s), "save", items, None, None)
page = lambda pool, s, first=0, most=2: (pool, at(s), "page", None, first, most)
BATCHES = [
    [save("a", 0, ["x", "y", "z"]), page("a", 10), page("a", 20, 2), page("b", 5), (None, at(1), "page", None, 0, 1)],
    [page("a", 1799, 1, 5), save("c", 900, []), page("c", 901)],
    [page("a", 1800), page("c", 2699), save("d", 1900, ["p"]), page("d", 1900)],
    [save("d", 3000, ["q", "r"]), page("d", 3001)],
    [page("d", 4799), page("late", 4700)],
    [page("z", 9000)],
    [page("d", 9001)],
]
WANTED = [
    ("a", 10, "page", 3, ["x", "y"]), ("a", 20, "page", 3, ["z"]), ("b", 5, "expired", None, None), ("a", 1799, "page", 3, ["y", "z"]), ("c", 901, "page", 0, []), ("a", 1800, "expired", None, None), ("c", 2699, "page", 0, []),
    ("d", 1900, "page", 1, ["p"]), ("d", 3001, "page", 2, ["q", "r"]), ("d", 4799, "page", 2, ["q", "r"]), ("late", 4700, "expired", None, None), ("z", 9000, "expired", None, None), ("d", 9001, "expired", None, None),
    ("a", 1800, "gone", None, None), ("c", 2700, "gone", None, None), ("d", 4800, "gone", None, None),
]


def run(spark, make, schema, batches, tmp_path, out="out"):
    """A batch is a file; one query run for each, so every batch but the first starts from a checkpoint."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / out)).collect()


def test_pools_live_for_a_while(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = run(spark, lambda s: search_pools(s, late="1 second"), REQUESTS, BATCHES, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted((r["pool"], int((r["ts"] - T0).total_seconds()), r["kind"], r["total"], r["items"]) for r in found)
    assert [r[:4] + (r[4],) for r in rows] == sorted(WANTED, key=lambda r: r[:3])


@pytest.mark.parametrize("days", [14])
def test_runs_are_abandoned(spark, tmp_path, days):
    day = lambda n: T0 + datetime.timedelta(days=n)
    batches = [
        [("a", day(0), "start"), ("b", day(0), "start"), ("c", day(0), "start"), ("c", day(1), "done"), ("d", day(0), "start"), ("d", day(2), "paused")],
        [("b", day(10), "step"), ("c", day(3), "step")],
        [("x", day(16), "start")],
        [("a", day(17), "step"), ("d", day(18), "step")],
        [("x", day(29), "done")],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = run(spark, lambda s: run_statuses(s, days), "run string, ts timestamp, event string", batches, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted((r["run"], (r["ts"] - T0).days, r["status"]) for r in found)
    assert rows == sorted([("a", 0, "active"), ("a", 14, "abandoned"), ("a", 17, "active"), ("b", 0, "active"), ("b", 24, "abandoned"), ("c", 0, "active"), ("c", 1, "done"), ("d", 0, "active"), ("d", 2, "paused"), ("d", 18, "active"), ("x", 16, "active"), ("x", 29, "done")])
