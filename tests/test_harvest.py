"""Records of a service as a stream: pages, expired tokens, deletions, batches that come again."""

import os

import pytest

from sextant.sources.harvest import SCHEMA, HarvestSource, Refused, harvested, parsed
from tests import fake_service


@pytest.fixture
def state(tmp_path, monkeypatch):
    os.makedirs(fake_service.STATE, exist_ok=True)
    for f in os.listdir(fake_service.STATE):
        os.remove(os.path.join(fake_service.STATE, f))

    def day(value):
        with open(os.path.join(fake_service.STATE, "today"), "w") as f:
            f.write(value)

    return day


def run(spark, tmp_path):
    spark.dataSource.register(HarvestSource)
    rows = spark.readStream.format("harvest").option("fetch", "tests.fake_service:fetch").option("today", "tests.fake_service:today").option("first", "2024-01-01").option("prefix", "arXiv").option("set", "cs").load()
    rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "o")).collect()


def test_days_come_once(spark, tmp_path, state):
    state("2024-01-03")
    first = run(spark, tmp_path)
    assert sorted(r["id"] for r in first) == [f"oai:x:2024-01-01/{k}" for k in range(5)] and os.path.exists(os.path.join(fake_service.STATE, "expired-2024-01-01"))
    gone = next(r for r in first if r["id"].endswith("/1"))
    kept = next(r for r in first if r["id"].endswith("/2"))
    assert gone["deleted"] and gone["metadata"] is None and gone["license"] is None
    assert not kept["deleted"] and kept["license"] == "http://l/2" and "2024-01-01/2" in kept["metadata"] and kept["sets"] == ["cs"]
    state("2024-01-05")
    again = run(spark, tmp_path)
    assert len(again) == 9 and len({r["id"] for r in again}) == 9
    # a batch that was planned and not finished comes again as it was
    os.remove(str(tmp_path / "c" / "commits" / "1"))
    metadata = tmp_path / "o" / "_spark_metadata" / "1"
    os.remove(metadata)
    for f in (tmp_path / "c" / "commits", tmp_path / "o" / "_spark_metadata"):
        for name in os.listdir(f):
            if name.endswith(".crc"):
                os.remove(f / name)
    assert sorted(r["id"] for r in run(spark, tmp_path)) == sorted(r["id"] for r in again)


def test_errors():
    assert list(harvested(lambda _: "<OAI-PMH><error code='noRecordsMatch'/></OAI-PMH>", {})) == []
    with pytest.raises(Refused, match="badArgument"):
        list(harvested(fake_service.broken, {}))
    with pytest.raises(Refused, match="badResumptionToken"):
        list(harvested(lambda _: "<OAI-PMH><error code='badResumptionToken'/></OAI-PMH>", {}, tries=2))
    assert parsed("<OAI-PMH><ListRecords><record><header/></record><record/></ListRecords></OAI-PMH>") == ([], None)
