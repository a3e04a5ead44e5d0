"""Chains by doubling, reachability, traversal by class, related records, opaque cursors, packed vectors."""

import datetime
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sextant.functions import vector as V
from sextant.operators import graph as G
from sextant.operators import records as R
from sextant.operators import search as S

rng = random.Random(9)


def plain_heads(older, hops):
    newer = {}
    for k, o in older.items():
        if o is not None:
            newer.setdefault(o, []).append(k)
    out = set()
    for start in older:
        front, seen, h = {start}, set(), 0
        while front and h <= (hops if hops is not None else len(older) + 1):
            out |= {(start, x, h) for x in front if x not in newer}
            seen |= front
            front = {y for x in front for y in newer.get(x, [])} - (seen if hops is None else set())
            h += 1
    return out


@pytest.mark.parametrize("hops", [8, 3, None])
def test_heads(spark, hops):
    older = {k: rng.choice([None, *range(max(0, k - 3), k)]) if k else None for k in range(40)}  # forks
    older |= {100 + k: 99 + k if k else None for k in range(21)}  # a chain of 21
    older |= {200: 201, 201: 202, 202: 200, 203: 200, 300: 300}  # cycles, one with a record beside it
    found = {tuple(r) for r in G.heads(spark.createDataFrame(list(older.items()), "id long, supersedes long"), hops).collect()}
    wanted = plain_heads(older, hops)
    if hops is None:  # what stands on a cycle has no head
        wanted = {w for w in wanted if w[0] not in (200, 201, 202, 300)}
    assert found == wanted


@pytest.mark.parametrize("kind", ["functional", "forks"])
def test_in_reach(spark, kind):
    n = 60
    if kind == "functional":
        step = {(k, rng.choice([j for j in range(n) if j != k])) for k in range(n) if k % 9} | {(100 + k, 101 + k) for k in range(40)} | {(200, 200), (211, 210), (210, 212), (212, 211), (213, 212)}
    else:
        step = {(k, rng.randrange(n)) for k in range(n) for _ in range(rng.choice([0, 1, 1, 2]))}
    to = {}
    for a, b in step:
        to.setdefault(a, set()).add(b)
    nodes = sorted({x for e in step for x in e})
    asked = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(400)] + [(a, a) for a in nodes] + [(None, 1), (999, 1), (1, 999)]

    def reach(a):
        out, front = set(), {a}
        while front:
            front = {y for x in front for y in to.get(x, ())} - out
            out |= front
        return out

    found = {tuple(r) for r in G.in_reach(spark.createDataFrame(asked, "a long, b long"), spark.createDataFrame(sorted(step), "node long, to long")).collect()}
    assert found == {(a, b) for a, b in asked if a is not None and b in reach(a)}


def test_guards_see_long_cycles(spark):
    links = [(f"r{k}", f"r{k + 1}") for k in range(30)]
    asked = [("r0", "r30", "o", "o", "t", "t"), ("r5", "r5", "o", "o", "t", "t"), ("new", "r3", "o", None, "t", "u"), ("r30", "r0", "o", "o", "t", "t")]
    rows = spark.createDataFrame(asked, "old string, new string, owner string, old_owner string, type string, old_type string")
    found = {r["old"]: r["violated"] for r in R.supersede_guards(rows, spark.createDataFrame(links, "frm string, to string")).collect()}
    assert found == {"r0": ["cycle"], "r5": ["cycle", "set-once"], "new": ["ownership", "type"], "r30": ["set-once"]}


EDGES = [("a", "b", "SUPPORT"), ("b", "c", "EXTEND"), ("c", "a", "SUPPORT"), ("a", "x", "ENG_DEPENDS_ON"), ("x", "y", "ENG_SATISFIES"), ("y", "a", "ENG_DEPENDS_ON"), ("b", "z", "ODD"), ("c", "d", "REFUTE"), ("d", "e", "QUALIFY"), ("e", "f", "SUPPORT"), ("f", "g", "SUPPORT"), ("g", "h", "SUPPORT")]


@pytest.mark.parametrize("options, wanted, cycle", [
    ({}, [("b", 1), ("c", 2), ("d", 3)], False),
    ({"hops": 9}, [("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5), ("g", 6)], False),
    ({"direction": "in"}, [("c", 1), ("b", 2)], False),
    ({"relation_class": "engineering"}, [("x", 1), ("y", 2)], True),
    ({"relation_class": "engineering", "hops": 2}, [("x", 1), ("y", 2)], False),
    ({"relation_class": "engineering", "subtype": "depends on"}, [("x", 1)], False),
    ({"subtype": "support"}, [("b", 1)], False),
    ({"subtype": "depends_on"}, [], False),
    ({"least": 2}, [("c", 2), ("d", 3)], False),
    ({"hops": 9, "most": 2}, [("b", 1), ("c", 2)], False),
])
def test_class_traverse(spark, options, wanted, cycle):
    rows = G.class_traverse(spark.createDataFrame(EDGES, "src string, dst string, label string"), "a", **options).collect()
    assert sorted((r["hops"], r["id"]) for r in rows) == sorted((h, i) for i, h in wanted)
    assert all(r["cycle_detected"] == cycle and r["truncated"] == (options.get("most") == 2) for r in rows)


def test_traverse_from_process_records(spark):
    assert G.class_traverse(spark.createDataFrame([("run:1", "b", "SUPPORT")], "src string, dst string, label string"), "run:1").count() == 0


RELATIONS = [
    ("r1", "a", "b", "support", None, None), ("r2", "c", "a", "extend", "epistemic", None), ("r3", "a", "d", "depends_on", "engineering", None), ("r4", "a", "run:9", "support", None, None),
    ("r5", "a", "b", "refute", None, "r1"), ("r6", "x", "y", "support", None, None), ("r7", "a", "e", "support", None, None),
]
CLAIMS = [("a", None), ("b", None), ("c", None), ("d", None), ("e", "b"), ("f", None)]


@pytest.mark.parametrize("options, relations, ends", [
    ({}, {"r1": True, "r2": False, "r4": False, "r5": False, "r7": False}, {"b": True, "c": False, "e": False}),
    ({"relation_class": "all"}, {"r1": True, "r2": False, "r3": False, "r4": False, "r5": False, "r7": False}, {"b": True, "c": False, "d": False, "e": False}),
    ({"relation_class": "engineering"}, {"r3": False}, {"d": False}),
    ({"direction": "in"}, {"r2": False}, {"c": False}),
    ({"direction": "out", "subtype": "support"}, {"r1": True, "r4": False, "r7": False}, {"b": True, "e": False}),
    ({"latest": True}, {"r2": False, "r4": False, "r5": False, "r7": False}, {"c": False, "e": False}),
    ({"most": 2}, {"r1": True, "r2": False}, {"b": True, "c": False}),
])
def test_related_records(spark, options, relations, ends):
    made = spark.createDataFrame(RELATIONS, "id string, source string, target string, relation string, relation_class string, supersedes string")
    rows = G.related_records(made, spark.createDataFrame(CLAIMS, "id string, supersedes string"), "a", **options).collect()
    assert {r["id"]: r["superseded"] for r in rows if r["kind"] == "relation"} == relations
    assert {r["id"]: r["superseded"] for r in rows if r["kind"] == "claim"} == ends
    assert all(r["truncated"] == ("most" in options) for r in rows)


def test_related_records_as_one(spark):
    made = spark.createDataFrame(RELATIONS, "id string, source string, target string, relation string, relation_class string, supersedes string")
    member = spark.createDataFrame([("b", "b"), ("e", "b")], "id string, cluster string")
    rows = G.related_records(made, spark.createDataFrame(CLAIMS, "id string, supersedes string"), "a", member=member).where("kind = 'claim'").collect()
    assert {r["id"]: r["members"] for r in rows} == {"b": 2, "c": 1}


def test_cursor_pages_walk_over_all_rows(spark):
    day = datetime.datetime(2024, 5, 1, 12, 0, 0, 123456)
    made = [(k, day + datetime.timedelta(milliseconds=rng.randrange(5))) for k in range(23)] + [(99, None), (None, day)]
    rows = spark.createDataFrame(made, "id long, at timestamp")
    seen, cursor, more = [], None, True
    while more:
        page = S.cursor_page(rows, "at", "id", cursor, 5, r"\d+").collect()
        page.sort(key=lambda r: (r["at"].replace(microsecond=r["at"].microsecond // 1000 * 1000), r["id"]), reverse=True)
        seen += [r["id"] for r in page]
        cursor, more = page[-1]["cursor"], page[-1]["more"]
    assert seen == [k for k, t in sorted(((k, t.replace(microsecond=t.microsecond // 1000 * 1000)) for k, t in made if k is not None and t), key=lambda r: (r[1], r[0]), reverse=True)]
    for bad in ("", "%%%", "bm90IGEgY3Vyc29y", "MjAyNC0wMS0wMVQwMDowMDowMFp8eA"):
        assert S.opened_cursor(bad, r"\d+") is None
        assert len(S.cursor_page(rows, "at", "id", bad, 5, r"\d+").collect()) == 5
    assert S.opened_cursor("MjAyNC0wMS0wMVQwMDowMDowMC4wMDBafDEy", r"\d+") == ("2024-01-01T00:00:00.000Z", "12")


def test_packed_vectors(spark):
    made = [(0, [1.5, -2.25, 3e38]), (1, None), (2, [0.1, 0.2, 0.3]), (3, [1.0, None, 2.0]), (4, [float("nan"), float("inf"), 0.0]), (5, []), (6, [7.0])]
    rows = spark.createDataFrame(made, "k long, v array<double>").withColumn("p", V.packed_vector("v"))
    held = {r["k"]: r["p"] for r in rows.collect()}
    assert {k: None if p is None else bytes(p) for k, p in held.items()} == {k: None if v is None or None in v else np.array(v, "<f4").tobytes() for k, v in made}
    back = {r["k"]: r["u"] for r in rows.where("k in (0, 1, 2, 4)").select("k", V.unpacked_vector(F.col("p"), 3).alias("u")).collect()}
    assert back[0] == [1.5, -2.25, float(np.float32(3e38))] and back[1] is None and back[2] == [float(np.float32(x)) for x in (0.1, 0.2, 0.3)] and np.isnan(back[4][0])
    with pytest.raises(PySparkException, match="4 bytes, not 12"):
        rows.where("k = 6").select(V.unpacked_vector(F.col("p"), 3)).collect()
    key = spark.range(1).select(V.vector_key("m", 768, F.lit("abc")).alias("k")).collect()[0]["k"]
    assert key == "emb:m:768:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
