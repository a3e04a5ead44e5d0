"""The streaming rollup gives what the batch gives, also when a second run finds nothing new."""

from sextant.streaming.rollups import daily_costs, start_rollup


def test_rollup(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("ts", "event_type", "user_id", "value")
    src = str(tmp_path / "in")
    for lo, hi in ((1, 10), (10, 20), (20, 32)):  # in the order of their time: rows two days late are dropped
        events.where(f"day(ts) >= {lo} and day(ts) < {hi}").coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
        start_rollup(stream, out, str(tmp_path / "check")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).select("day", "event_type", "user_id", "calls", "micro").collect()}
    assert got == {tuple(r) for r in daily_costs(events).select("day", "event_type", "user_id", "calls", "micro").collect()}
