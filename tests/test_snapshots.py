"""Versions appear whole or not at all; rollups by signed changes equal those made anew."""

import random

import pytest
from pyspark.sql import functions as F

from sextant.sources import sinks
from sextant.sources.snapshots import Conflict, Snapshots, refresh, refreshed, signed_totals

PAIRS = "k long, v string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, PAIRS)


def held(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_versions(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    assert t.versions() == []
    with pytest.raises(ValueError, match="no version"):
        t.read()
    assert t.append(rows(spark, [(1, "a"), (2, "b")])) == 1
    assert t.append(rows(spark, [(3, "c")]), check=True) == 2 and t.manifest()["rows"] == 3
    assert t.upsert(rows(spark, [(2, "B"), (4, "d")]), ["k"]) == 3
    assert held(t.read()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")] and held(t.read(2)) == [(1, "a"), (2, "b"), (3, "c")]
    assert t.replace(rows(spark, [])) == 4 and held(t.read()) == []
    assert t.vacuum(keep=2) == 2 and held(t.read(3)) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert Snapshots(spark, str(tmp_path / "u")).upsert(rows(spark, [(1, "x")]), ["k"]) == 1


@pytest.mark.parametrize("step", ["data", "manifest", "move"])
def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    t = Snapshots(spark, str(tmp_path / "t"))
    t.replace(rows(spark, [(1, "a")]))

    def die(*_, **__):
        raise KeyboardInterrupt

    dying = Snapshots(spark, t.path)
    if step == "data":  # half of the data is there
        monkeypatch.setattr(dying, "_put", lambda df, check: (df.limit(1).write.parquet(f"{t.path}/data/half"), die()))
    elif step == "manifest":
        monkeypatch.setattr(dying, "_commit", die)
    else:
        monkeypatch.setattr(dying, "_fs", type("Fs", (), {"__getattr__": lambda _, n: die if n == "rename" else getattr(t._fs, n)})())
    with pytest.raises(KeyboardInterrupt):
        dying.upsert(rows(spark, [(1, "b"), (2, "c")]), ["k"])
    assert t.versions() == [1] and held(t.read()) == [(1, "a")]
    assert t.upsert(rows(spark, [(2, "c")]), ["k"]) == 2 and held(t.read()) == [(1, "a"), (2, "c")]
    t.vacuum(keep=1)
    assert held(t.read()) == [(1, "a"), (2, "c")] and len(t._fs.listStatus(t._at(f"{t.path}/data"))) == 1


def test_two_writers(spark, tmp_path):
    a, b = (Snapshots(spark, str(tmp_path / "t")) for _ in range(2))
    a.replace(rows(spark, [(1, "a")]))
    before = b.manifest()
    a.append(rows(spark, [(2, "b")]))
    with pytest.raises(Conflict):
        b.replace(rows(spark, [(9, "z")]), before=before)
    assert held(a.read()) == [(1, "a"), (2, "b")]
    calls = []

    def change(old):
        if not calls:
            a.append(rows(spark, [(3, "c")]))
        calls.append(1)
        return old.withColumn("v", F.upper("v"))

    assert b.change(change) == 4 and len(calls) == 2 and held(b.read()) == [(1, "A"), (2, "B"), (3, "C")]


def test_counts_are_checked_before_a_version_counts(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    t.replace(rows(spark, [(1, "a")]))
    wrong = rows(spark, [(1, "a"), (2, "b")])
    other = type("Odd", (), {"schema": wrong.schema, "write": wrong.limit(1).write, "count": wrong.count})()
    with pytest.raises(RuntimeError, match="2 rows given, 1 written"):
        t.replace(other, check=True)
    assert t.versions() == [1]


def test_rollups_by_changes(spark, tmp_path):
    pick = random.Random(1)
    alive, t = [], Snapshots(spark, str(tmp_path / "r"))
    schema = "kind string, amount long, sign int"
    for batch in range(4):
        new = [(pick.choice(["a", "b", None, "c"]), pick.choice([None, 0, 5, 10**12])) for _ in range(30)]
        gone = [alive.pop(pick.randrange(len(alive))) for _ in range(min(len(alive), 20))]
        alive += new
        changes = spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], schema)
        version = refresh(t, changes, ["kind"], ["amount"], str(batch))
        assert refresh(t, changes, ["kind"], ["amount"], str(batch)) == version  # the same batch again
        wanted = {}
        for k, v in alive:
            n, s = wanted.get(k, (0, 0))
            wanted[k] = n + 1, s + (v or 0)
        assert {r["kind"]: (r["n"], r["amount"] or 0) for r in t.read().collect()} == wanted
    with pytest.raises(ValueError, match="taken away"):
        refreshed(t.read(), spark.createDataFrame([("zz", 1, -1)], schema), ["kind"], ["amount"])
    assert signed_totals(spark.createDataFrame([], schema), ["kind"], ["amount"]).count() == 0


@pytest.mark.parametrize("died", ["before", "between", "after"])
def test_upserts_of_plain_folders_survive(spark, tmp_path, monkeypatch, died):
    path = str(tmp_path / "p")
    rows(spark, [(1, "a"), (2, "b")]).write.parquet(path)

    def die(spark, path):
        fs, at = sinks._files(spark, path)
        if died != "before":
            fs.rename(at(path), at(f"{path}.old"))
        if died == "after":
            fs.rename(at(f"{path}.new"), at(path))
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks, "_moved", die)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_upsert(path, rows(spark, [(2, "B")]), ["k"])
    sinks.write_upsert(path, rows(spark, [(3, "c")]), ["k"])
    assert held(spark.read.parquet(path)) == [(1, "a"), (2, "b" if died == "before" else "B"), (3, "c")]
