"""Operators that SQL does not express, against plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from sextant.functions import projection as P
from sextant.functions import text as T
from sextant.operators import maintenance as M
from sextant.operators import relations as R
from sextant.operators import search as S
from sextant.plans import texts as texts_plan
from sextant.plans import upkeep


def test_throttled_counts_from_the_last_row_kept(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [("a", day(n)) for n in (0, 5, 10, 15, 20)] + [("b", day(3)), ("b", day(3)), (None, day(1)), (None, day(2))]
    found = R.throttled(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 7).collect()
    assert sorted(((r["k"] or ""), r["ts"]) for r in found) == [("", day(1)), ("a", day(0)), ("a", day(10)), ("a", day(20)), ("b", day(3))]


def test_repaired_json_doubles_lone_backslashes_only(spark):
    rows = [(r'{"a":"\alpha x"}', "\\alpha x"), (r'{"a":"\\a \q"}', "\\a \\q"), (r'{"a":"\n\u00e9\\"}', "\né\\"), (r'{"a":"\u12"}', "\\u12"), ("{oops", None)]
    df = spark.createDataFrame(rows, "t string, wanted string")
    assert all(r["got"] == r["wanted"] for r in df.select("wanted", F.try_variant_get(T.repaired_json(F.col("t")), "$.a", "string").alias("got")).collect())


def test_nearest_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    none = df.limit(0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    assert S.nearest(df, none, 3).collect() == [] and S.nearest(df, none, 3).columns == ["query", "vec_id", "similarity", "rank"]


def plain_batches(sections, most=3500, carried=500):
    out, now = [], []
    for part in (s for s in sections if len(s.strip(" ")) >= 30):
        if now and sum(map(len, now)) + len(part) > most:
            out.append(now)
            now = [now[-1]] if len(now[-1]) <= carried else []
        now = [*now, part]
    return [*out, now] if now else out


def test_section_batches_carry_the_last_section(spark):
    rng = random.Random(1)
    rows = [(k, ["x" * rng.choice([5, 40, 300, 480, 700, 2000, 4000]) for _ in range(rng.randrange(12))]) for k in range(40)]
    found = spark.createDataFrame(rows, "k long, s array<string>").select("k", T.section_batches(F.col("s")).alias("b")).collect()
    assert {r["k"]: r["b"] for r in found} == {k: plain_batches(s) for k, s in rows}


def test_section_paths(spark):
    df = spark.createDataFrame([(["A", "B", "C", "D", "E"], [1, 2, 3, 2, 1]), ([], [])], "n array<string>, d array<int>")
    assert [r["p"] for r in df.select(T.section_paths(F.col("n"), F.col("d")).alias("p")).collect()] == [["A", "A > B", "A > B > C", "A > D", "E"], []]


def plain_latex(text, most):
    out = []
    for part in (p.strip(" ") for p in re.split(T.LATEX_PARTS, text)):
        if len(part) <= 50:
            continue
        paras = [p for p in (q.strip(" ") for q in re.split(r"\n\n+", part)) if len(p) > 50]
        if len(part) <= most:
            out.append(part)
        elif len(paras) > 1 and all(len(p) <= most for p in paras):
            out += paras
        else:
            now = ""
            for line in (q.strip(" ") for q in part.split("\n")):
                if len(line) <= 30:
                    continue
                if len(now) + len(line) + 1 > most and len(now) > 50:
                    out.append(now.strip(" "))
                    now = line
                else:
                    now = f"{now}\n{line}" if now else line
            if len(now.strip(" ")) > 50:
                out.append(now.strip(" "))
    return out


def test_latex_parts(spark, folder):
    rows = [(r["doc_id"], "\\section{One}\n" + r["text"] + "\n\\begin{proof}" + r["text"] + "\\end{proof}\n\n" + r["text"][:300]) for r in spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").collect()]
    found = spark.createDataFrame(rows, "k long, t string").select("k", T.latex_parts(F.col("t"), 400).alias("p")).collect()
    assert {r["k"]: r["p"] for r in found} == {k: plain_latex(t, 400) for k, t in rows}


def plain_coverage(spans, text):
    real = [(a, b) for a, b in spans if a is not None]
    order = sorted(real)
    overlaps = sum(y[0] < x[1] for x, y in zip(order, order[1:]))
    cursor, lost, allowed = 0, [], []
    solid = lambda t: len(re.sub(r"\s+", "", t))
    for a, b in [*order, (len(text), len(text))]:
        if a > cursor and solid(text[cursor:a]):
            (lost if re.search("[A-Za-z]{3,}", text[cursor:a]) else allowed).append(solid(text[cursor:a]))
        cursor = max(cursor, b)
    content = solid(text) - sum(allowed)
    return (round(100 * (content - sum(lost)) / content, 2) if content > 0 else 100.0, len(lost), overlaps, len(allowed), len(spans) - len(real), real == order)


def test_coverage(spark):
    rng = random.Random(2)
    texts = {k: " ".join(rng.choices(["alpha", "be", "gamma", "12", "x\n"], k=60)) for k in range(30)}
    spans = {}
    for k, t in texts.items():
        cuts = sorted(rng.sample(range(len(t)), 8))
        found = [(a, b + rng.choice([0, 0, 3])) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        if k % 5 == 0:
            rng.shuffle(found)
        spans[k] = found + [(None, None)] * (k % 3) if k else []
    spans = {k: [(a, b if b is None else min(b, len(texts[k]))) for a, b in v] for k, v in spans.items()}
    df = spark.createDataFrame([(k, i, *s) for k, v in spans.items() for i, s in enumerate(v)], "k long, i int, a int, b int")
    found = M.coverage(df, spark.createDataFrame(list(texts.items()), "k long, text string"), "k", T.droppable).collect()
    assert {r["k"]: (r["pct"], r["n_gaps"], r["n_overlaps"], r["n_allowed"], r["n_failed"], r["ordered"]) for r in found} == {k: plain_coverage(spans[k], t) for k, t in texts.items()}


def test_projected_records_without_json(spark):
    df = spark.createDataFrame([("not json",), (None,), ("[1]",)], "t string")
    assert [r["x"] for r in df.select(P.scientific(F.col("t")).alias("x")).collect()] == [None, None, "[1]"]
    assert [r["x"] for r in df.select(P.redacted(F.col("t"), "a").alias("x")).collect()] == [None, None, "[1]"]


@pytest.mark.parametrize("limit, filtered, rerank, n", [(5, True, True, 50), (20, True, False, 100), (4, False, True, 15), (20, False, True, 60), (5, False, False, 30)])
def test_pool_size(limit, filtered, rerank, n):
    assert M.pool_size(limit, filtered, rerank) == n


def test_span_coverage_query(spark, folder):
    found = upkeep.span_coverage(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").count() and all(0 <= r["pct"] <= 100 for r in found)


def plain_similarity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[j] + 1, row[-1] + 1, d[j - 1] + (x != y)))
        d = row
    return 1 - d[-1] / max(len(a), len(b), 1)


def plain_borders(batches):
    batches = [b or [] for b in batches]
    gone = set()
    for k in range(len(batches) - 1):
        tail = [(k, i) for i in range(max(0, len(batches[k]) - 2), len(batches[k])) if (k, i) not in gone]
        for p in tail:
            for c in [(k + 1, i) for i in range(min(2, len(batches[k + 1])))]:
                x, y = batches[p[0]][p[1]], batches[c[0]][c[1]]
                if c not in gone and x is not None and y is not None and plain_similarity(x, y) >= 0.85:
                    gone.add(c if len(x) >= len(y) else p)
    return [[c for i, c in enumerate(b) if (k, i) not in gone] for k, b in enumerate(batches)]


def test_border_repeats_against_plain_python(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(40)) for _ in range(3)]
    near = lambda: (t := rng.choice(base))[: rng.randint(34, 40)] + rng.choice(["", "x", "yz"])
    rows = [[[near() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 5))] for _ in range(60)]
    rows += [[], [["one"]], [None, ["a"], [None, base[0]], [base[0], None]], [[base[0]], [base[0]], [base[0]]]]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, b array<array<string>>")
    found = {r["k"]: r["got"] for r in df.select("k", T.border_repeats_dropped(F.col("b")).alias("got")).collect()}
    assert found == {k: plain_borders(b) for k, b in enumerate(rows)}
    assert [len(b) for b in found[len(rows) - 1]] == [1, 0, 1]  # what went at the first border is not compared at the second


def test_border_repeats_query(spark, tmp_path):
    lines = [chr(97 + k) * 60 + " " + chr(107 + k) * 1700 for k in range(5)]
    texts = ["\n".join(lines), "\n".join([lines[0], lines[1], lines[1], lines[2]]), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: (r["batches"], r["dropped"]) for r in texts_plan.border_repeats(spark, str(tmp_path)).collect()}
    assert found == {0: (5, 0), 1: (4, 1), 2: (0, 0), 3: (0, 0)}
