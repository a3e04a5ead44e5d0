"""Exact neighbours and containment against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import neighbours as N

rng = np.random.default_rng(2)
VECTORS = "vec_id long, embedding array<double>, label string"


def table(n=600, dim=5):
    centres = rng.normal(size=(12, dim)) * 4
    x = centres[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * 0.3
    x[50:60] = x[40]  # copies: ties by key
    rows = [(k, [float(v) for v in x[k]], None if k % 11 == 0 else f"l{k % 4}") for k in range(n)]
    return [*rows, (n, None, "l1"), (n + 1, [0.0] * dim, "l1"), (n + 2, [None] * dim, "l1"), (n + 3, [float("nan")] * dim, "l1")]


def brute(rows, queries, k, aside):
    good = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v, g in queries:
        found = sorted((-round(float(v / np.linalg.norm(v) @ x), 9), i) for i, x, h in good if not (aside and g is not None and g == h))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize("aside", [None, "label"])
@pytest.mark.parametrize("small", [False, True])  # small blocks and parts: every query meets several
def test_nearest_of_all(spark, monkeypatch, aside, small):
    if small:
        monkeypatch.setattr(N, "PART", 16)
        monkeypatch.setattr(N, "BLOCK", 4)
    rows = table()
    queries = [(k, rows[k][1], rows[k][2]) for k in range(0, 600, 50)] + [(7000, [1.0, 0.0, 0.0, 0.0, 0.0], "l2")]
    df, asked = spark.createDataFrame(rows, VECTORS), spark.createDataFrame([*queries, (9000, None, "l1")], "query long, vector array<double>, label string")
    found = {}
    for r in N.nearest_of_all(df, asked, 4, not_same=aside).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["vec_id"], round(r["similarity"], 9)))
    wanted = brute(rows, [(q, np.array(v), g) for q, v, g in queries], 4, aside)
    assert {q: [s for _, s in v] for q, v in found.items()} == {q: pytest.approx([s for _, s in v], abs=1e-8) for q, v in wanted.items()}
    assert all([i for i, _ in found[q]] == [i for i, _ in wanted[q]] for q in wanted if len({round(s, 6) for _, s in wanted[q]}) == 4)
    assert aside or [i for i, _ in found[50]] == [40, 50, 51, 52]


def test_clusters_out_of_reach_are_passed_over():
    centres, radius = np.eye(4), np.array([0.1, 0.1, 0.1, -1.0])
    import pandas as pd

    asked = pd.DataFrame({"query": [1, 2], "v": [[1.0, 0, 0, 0], [1.0, 0, 0, 0]], "aside": 0, "has_aside": False, "t": [0.2, None]})
    out = pd.concat(N._reached(centres, radius)([asked]))
    assert list(zip(out["query"], out["cluster"])) == [(2, 2)]  # nearest two are done before, the empty one is never met


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<double>")
    assert N.nearest_of_all(empty, asked, 3).count() == 0
    two = spark.createDataFrame([(1, [1.0, 1.0], "a"), (2, [0.0, 1.0], "a"), (2, [0.0, 1.0], "a")], VECTORS)
    assert [(r["vec_id"], r["rank"]) for r in N.nearest_of_all(two, asked, 5).orderBy("rank").collect()] == [(1, 1), (2, 2), (2, 3)]
    assert N.nearest_of_all(two, asked.limit(0), 3).count() == 0


def test_contained(spark):
    pick = random.Random(3)
    text = lambda n: "".join(pick.choice("ab\n é") for _ in range(n))
    bodies = [(k, text(pick.randint(0, 400))) for k in range(60)] + [(60, None), (61, "")]
    items = []
    for k, (_, body) in enumerate(bodies):
        if body and len(body) > 60:
            for n in (1, 3, 22, 23, 24, 60):
                at = pick.randrange(len(body) - n)
                items.append((100 * k + n, body[at : at + n]))
    items += [(90001, None), (90002, ""), (90003, "c" * 40), (90004, "zz"), (90005, text(30))]
    found = {tuple(r) for r in N.contained(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(bodies, "doc_id long, text string"), "item_id", "doc_id").collect()}
    assert found == {(i, d) for i, t in items for d, b in bodies if t and b and t in b} and len(found) > 1000


def test_equal_stretches_share_a_fingerprint(spark):
    pick = random.Random(4)
    rows = []
    for k in range(40):
        common = "".join(pick.choice("abc") for _ in range(N.GRAM + N.REACH - 1))
        rows += [(2 * k, "".join(pick.choice("xyz") for _ in range(pick.randint(0, 50))) + common), (2 * k + 1, common + "".join(pick.choice("uvw") for _ in range(pick.randint(0, 50))))]
    held = {}
    for r in N.winnowed(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect():
        held.setdefault(r["k"], set()).add(r["h"])
    assert all(held[2 * k] & held[2 * k + 1] for k in range(40))
    assert N.winnowed(spark.createDataFrame([(1, "short"), (2, None)], "k long, t string"), "k", "t").count() == 0
