"""Whitening, rule cascade and filter audit against plain Python."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import quality_cascade as qc
from sextant.llm.filter_audit import FIRST, ORDERS, filter_audit
from sextant.llm.queries import ORACLE_SQL, QUERIES
from sextant.llm.whitening import covariance, exact_scatter, fit_whitening, jacobi, whitened

SF = "/root/testdata/sf0.01"
rng = random.Random(7)


# whitening

def vectors(spark, rows, schema="vec_id long, embedding array<double>"):
    return spark.createDataFrame(rows, schema)


def plain_whitening(good):
    x = np.floor(64 * np.array(good, float)) + 1_000_000
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    return x, values, (x - x.mean(axis=0)) @ basis / np.sqrt(np.maximum(values, 1e-300))


def test_whitening_matches_a_dense_solver(spark):
    gen = np.random.default_rng(3)
    rows = [(k, list(map(float, v))) for k, v in enumerate(gen.normal(size=(300, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.05]))]
    bad = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1005, [1.0, 2.0])]
    found = whitened(vectors(spark, rows + bad + [(None, rows[0][1]), (5, rows[0][1])])).toPandas()
    good = [v for _, v in rows] + [rows[0][1]] * 2
    x, values, z = plain_whitening(good)
    assert len(found) == 302 * 6 and set(found.n) == {302}
    once = found[found.vec_id != 5].dropna(subset=["vec_id"]).pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    keep = [k for k in range(300) if k != 5]
    sign = np.sign((once * z[keep]).sum(axis=0))
    assert np.abs(once * sign - z[keep]).max() < 1e-8
    assert np.allclose(found[found.vec_id == 7].explained, values / values.sum(), rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9
    total = [int(s) for s in x.sum(axis=0)]
    wanted = sum((302 * int(v) - s) ** 2 for v, s in zip(x[7], total, strict=True))
    assert set(found[found.vec_id == 7].deviation) == {wanted}
    assert (found.vec_id == 5).sum() == 12 and found.vec_id.isna().sum() == 6


def test_whitening_of_degenerate_tables(spark):
    assert whitened(vectors(spark, [])).count() == 0
    assert whitened(vectors(spark, [(1, None), (2, [None])])).count() == 0
    assert whitened(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0  # no variance
    flat = whitened(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).toPandas()  # rank 1
    assert set(flat.component) == {1} and flat.explained.iloc[0] == pytest.approx(1) and flat.identity_error.iloc[0] < 1e-9
    clash = vectors(spark, [(1, [0.0], 7, "x"), (2, [1.0], 8, "y")], "vec_id long, embedding array<double>, n long, id string")
    assert whitened(clash).count() == 2


def test_whitening_is_repeatable_and_exact(spark):
    rows = [(k, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for k in range(200)]
    a, b = (fit_whitening(vectors(spark, rows).repartition(p)) for p in (1, 7))
    assert a.sums == b.sums and (a.vectors == b.vectors).all() and (a.values == b.values).all()
    y = np.array([[int(np.floor(64 * v)) for v in r[1]] for r in rows], object)
    assert (exact_scatter(y.astype(np.int64)) == y.T @ y).all()


def test_covariance_is_rounded_once():
    y = [[3, 10**9 + 1], [5, 10**9], [8, 10**9 + 7]]
    sums = [sum(r[k] for r in y) for k in range(2)]
    v = covariance(3, sums, [[sum(r[i] * r[j] for r in y) for j in range(2)] for i in range(2)])
    mean = [Fraction(s, 3) for s in sums]
    assert all(v[i][j] == float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in y) / 3) for i in range(2) for j in range(2))


def test_jacobi_holds_small_eigenvalues():
    scale = np.diag([1.0, 1e-6, 1e-9])
    core = np.array([[2.0, 0.5, 0.3], [0.5, 1.5, 0.2], [0.3, 0.2, 1.0]])
    values, basis = jacobi(scale @ core @ scale)
    exact = np.linalg.det(core) * 1e-30  # the product of the eigenvalues
    assert np.prod(values) == pytest.approx(exact, rel=1e-12)
    assert np.allclose(basis.T @ basis, np.eye(3), atol=1e-15)


# rules

def plain_counts(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for ch in text + " ":
        if ch in blank:
            words += [word] if word else []
            word = ""
        else:
            word += ch
    places = defaultdict(list)
    for k in range(len(words) - 2):
        places[tuple(words[k : k + 3])].append(k)
    repeated = {k + m for at in places.values() if len(at) > 1 for k in at for m in range(3)}
    lines = [x for x in text.split("\n") if x.strip(blank)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "\n\nx\nx\n \nx ", "  a b \u0085", "é😀 # <b> | & é😀", "a\x0bb\x0cc\rd", "x " * 3000, ("w%d " * 60) % tuple(range(60)),
    *(" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randint(0, 80))) for _ in range(60)),
]


@pytest.mark.parametrize("place", [24, 3])  # 3: no row can be packed, so windows are sorted by their words
def test_counts_of_whole_texts(spark, monkeypatch, place):
    monkeypatch.setattr(qc, "PLACE", place)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in qc.with_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_windows_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(qc.F, "xxhash64", lambda *c: F.lit(5).cast("long"))  # every window has the same hash
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:9])], "doc_id long, text string")
    for r in qc.with_counts(docs).collect():
        assert r.n_repeat_words == plain_counts(TEXTS[r.doc_id])[4]


def test_order_of_rules_does_not_change_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = qc.with_counts(docs).limit(300)
    first, last = qc.cascade(rows, qc.RULES), qc.cascade(rows, qc.RULES[::-1])
    failed = lambda df: {r.doc_id for r in df.where("first_failed is not null").collect()}
    assert failed(first) == failed(last) and 0 < len(failed(first)) < 300


def test_rules_are_ordered_by_rejections_per_cost():
    rules = [qc.Rule(n, "true") for n in "abc"]
    # a rejects 60 for 3 s; b 50 for 1 s; c 45 for 1 s, but 40 of these fail b too
    failed = {0b001: 60, 0b010: 10, 0b110: 40, 0b100: 5}
    assert [r.name for r in qc.ordered(rules, {"a": 3.0, "b": 1.0, "c": 1.0}, failed)] == ["b", "a", "c"]
    assert qc.ordered([], {}, {}) == []


def test_rules_on_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, words string")
    assert qc.quality_rules(empty).count() == 0
    good = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame([(None, good, 1), (1, good, 2), (1, good, 3), (2, None, 4), (3, good + " #" * 40, 5)], "doc_id long, text string, n_words int")
    found = sorted(((r.doc_id, r.kept, r.base_failed, r.first_failed) for r in qc.quality_rules(docs).collect()), key=str)
    assert found == sorted([(None, True, False, None), (1, True, False, None), (1, True, False, None), (2, False, True, "base"), (3, False, False, "symbols")], key=str)
    unknown = qc.short_circuit(docs.select("doc_id", "text", "n_words"), [qc.Rule("null", "n_words > 0 and null")])
    assert unknown.where("first_failed is not null").count() == 0


# audit

def test_first_failures():
    for m in range(32):
        for o, order in enumerate(ORDERS):
            fails = [k + 1 for k, f in enumerate(order) if m >> "ABCDE".index(f) & 1]
            assert FIRST[m, o] == (fails[0] if fails else 0)


def plain_audit(docs, labels):
    quality, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        quality[i], toxic[i] = max(quality[i], q or 0), max(toxic[i], t or 0)
    last = float("inf")
    key = lambda i: last if i is None else i
    first = {}
    for i, text, _ in docs:
        first[text or ""] = min(first.get(text or "", last), key(i))
    out = Counter()
    parts = {s or "" for _, _, s in docs}
    for i, text, source in docs:
        text, part = text or "", source or ""
        words = text.replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        fails = {f for f, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), key(i) > first[text]), strict=True) if bad}
        for order in permutations("ABCDE"):
            gone = None
            for step, f in enumerate(order, 1):
                at = part, "".join(order), step
                if f in fails and gone is None:
                    gone = step
                    out[at, "removed"] += 1
                    out[at, "good_lost"] += i is not None and quality[i] == 1
                    out[at, "toxic_lost"] += i is not None and toxic[i] == 1
                    out[part, f] += 1
                elif f in fails:
                    out[at, "redundant"] += 1
                out[at, "kept"] += gone is None
                out[at, "unique_fails"] += fails == {f}
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, "".join(o), s): (*(out[(p, "".join(o), s), c] for c in names), out[p, o[s - 1]]) for p in parts for o in permutations("ABCDE") for s in range(1, 6)}


def test_audit_against_plain_python(spark):
    prose = [" ".join(f"w{rng.randint(0, m)}" for _ in range(n)) for m, n in ((500, 60), (20, 70), (900, 55))]
    texts = [None, "", *prose, prose[0] + " #", prose[1].upper(), prose[2].upper() + " $", "SHORT TEXT"]
    docs = [(k if k % 17 else None, rng.choice(texts), rng.choice([None, "", "a", "b"])) for k in range(150)] + [(3, prose[0], "a"), (3, prose[0], "a")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    found = filter_audit(spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert rows == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    assert filter_audit(one, labels).count() == 600


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = db.sql(ORACLE_SQL[name]).df()
    found = QUERIES[name](spark, SF).toPandas()
    assert list(found.columns) == list(wanted.columns)
    order = list(found.columns)
    a, b = (df.sort_values(order).reset_index(drop=True) for df in (found, wanted))
    assert a.equals(b.astype(a.dtypes.to_dict()))
