"""Doses, routes, replays and escalations of runs; giant sections."""

import random
import re

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import runs as R

STATES = [None, "", "[]", "{}", "not json", '{"error": "x", "run_id": 1}', '{"other": 1}', '{"run_id": "r"}', '{"stage": null}', '{"dose": {}}']
PAYLOADS = {
    None: "ask", "{}": "ask", '{"h": ""}': "ask", '{"h": " \\n"}': "ask", '{"h": "x"}': "checkpoint", '{"h": false}': "ask", '{"h": true}': "checkpoint", '{"h": 0}': "checkpoint", '{"h": null}': "ask", '{"h": []}': "checkpoint",
    '{"h": "false"}': "checkpoint", '{"a": {"b": "go"}}': "checkpoint", '{"a": {"b": "gone"}}': "ask", '{"a": "go"}': "ask", "broken": "ask",
}


def test_routes(spark):
    rows = spark.createDataFrame([(s, p) for s in STATES for p in PAYLOADS], "s string, p string").select("s", "p", R.route(F.col("s"), F.col("p"), [("h", None), ("a.b", "go")]).alias("r"), R.route(F.col("s"), F.col("p"), []).alias("none"))
    for r in rows.collect():
        active = r["s"] in STATES[7:]
        assert r["r"] == (PAYLOADS[r["p"]] if active else "diagnose") and r["none"] == ("ask" if active else "diagnose"), r


def test_doses(spark):
    table = spark.createDataFrame([("1", "2", ["op"], None, ["c"], None), ("01", "3", None, None, None, None), ("x", "1", ["no"], None, None, None)], "cycle string, stage string, operations array<string>, beacons array<string>, counters array<string>, expected_artifacts array<string>")
    asked = [("1", "2"), (" 1 ", "02"), ("1", "3"), ("1", "9"), ("x", "1"), ("1.0", "2"), ("-1", "2"), (None, "2"), ("", "")]
    found = {(r["cycle"], r["stage"]): (r["found"], r["dose_stage"], r["operations"], r["beacons"]) for r in R.doses(spark.createDataFrame(asked, "cycle string, stage string"), table).collect()}
    none = (False, None, None, None)
    assert found == {("1", "2"): (True, 2, ["op"], []), (" 1 ", "02"): (True, 2, ["op"], []), ("1", "3"): (True, 3, [], []), **{a: none for a in asked[3:]}}


def test_replays_and_checkpoints(spark):
    keys = [("s", "r", "1", "h"), (None, "r", "1", "h"), (None, "r", None, "h"), ("", "r", "1", "h"), (None, None, "1", "h"), ("s", None, None, "h")]
    rows = spark.createDataFrame(keys, "s string, r string, g string, h string").select(R.replay_key(F.col("s"), F.col("r"), F.col("g"), F.col("h")).alias("k")).collect()
    assert [r["k"] for r in rows] == ["s:1:h", "r:1:h", "r:h", "h", "h", "s:h"]
    kind = "handin_hash string, at int, response string, go boolean"
    records, answers = R.recorded(spark.createDataFrame([("a", 1, "old", True)], kind), spark.createDataFrame([("a", 5, "new", False), ("b", 7, "second", False), ("b", 6, "first", True), (None, 1, "x", True)], kind))
    assert sorted((r["handin_hash"], r["response"]) for r in records.collect()) == [("a", "old"), ("b", "first")]
    assert sorted((r["handin_hash"], r["asked_at"], r["response"], r["created"]) for r in answers.collect()) == [("a", 5, "old", False), ("b", 6, "first", True), ("b", 7, "first", False)]
    points = spark.createDataFrame([("c", "1", True), ("c", "2", False), ("c", "1", True)], "credential_id string, stage string, go boolean")
    passed = R.stages_passed(points, spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1")], "credential_id string, stage string"))
    assert {(r["credential_id"], r["stage"]): r["passed"] for r in passed.collect()} == {("c", "1"): True, ("c", "2"): False, ("d", "1"): False}


def test_escalations(spark):
    kind = "credential_id string, review_run_id string, issue string, class string, at int"
    raised = spark.createDataFrame([("c", None, "i", "k", 5), ("c", None, "i", "k", 3), ("c", "r", "i", "k", 9), ("d", None, "i", "k", 1)], kind)
    first = R.escalated(spark.createDataFrame([], f"ticket string, {kind}, status string"), raised)
    assert first.count() == 3 and all(len(r["ticket"]) == 24 and r["ticket"].startswith("esc_") and r["status"] == "open" for r in first.collect())
    closed = first.withColumn("status", F.lit("resolved"))
    again = R.escalated(closed, raised)
    assert again.count() == 3 and again.where("status = 'open'").count() == 0
    assert [r["at"] for r in R.escalations_of(again, "c").collect()] == [9, 3]


def plain_giants(name, content, most):
    if len(content) <= most:
        return [(name, content)]
    parts, held = [], ""
    for para in re.split("\n\n+", content):
        if held and len(held) + len(para) > most:
            parts.append(held.strip())
            held = para
        else:
            held += ("\n\n" if held else "") + para
    parts = [p for p in [*parts, held.strip()] if p]
    return [(f"{name} [part {k}]", p) for k, p in enumerate(parts, 1)] if len(parts) > 1 else [(name, p) for p in parts]


def test_giants(spark, folder):
    rng = random.Random(6)
    texts = ["", "short", "x" * 300, "\n\n".join("p" * rng.randint(1, 90) for _ in range(30)), "a" * 40 + "\n\n\n" + "b" * 70, "\n\n" + "c" * 200 + "\n\n"]
    rows = spark.createDataFrame([(k, [("n", "p > n", t)]) for k, t in enumerate(texts)] + [(99, None), (98, [("n", "q", None)])], "k long, s array<struct<name: string, path: string, content: string>>")
    found = {r["k"]: r["x"] for r in rows.select("k", T.giants_split(F.col("s"), 100).alias("x")).collect()}
    for k, t in enumerate(texts):
        assert [(x["name"], x["content"]) for x in found[k]] == plain_giants("n", t, 100) and all(x["path"] == "p > " + x["name"] for x in found[k])
    assert found[99] is None and [x["content"] for x in found[98]] == [""]
    from sextant.plans.registry import QUERIES

    held = {}
    for r in QUERIES["giant_sections"](spark, folder).orderBy("doc_id", "part").collect():
        held.setdefault(r["doc_id"], []).append(r["path"])
    docs = {r["doc_id"]: (r["source"], r["text"].replace("\n", "\n\n")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert held == {k: [f"Top > {n}" for n, _ in plain_giants(s, t, 800)] for k, (s, t) in docs.items() if plain_giants(s, t, 800)}
