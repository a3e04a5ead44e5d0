"""Small cases of the operators against values worked out by hand or by brute force."""

import random

from pyspark.sql import functions as F

from sextant.functions import identity as I
from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import curation, graph
from sextant.operators import search as S
from sextant.operators.shared import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: top(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_paths(spark):
    path = [(k, k + 1) for k in range(1, 400)]
    crossed = [(5000 + (k * 37) % 400, 5000 + ((k + 1) * 37) % 400) for k in range(399)]
    hub = [(k, 9999) for k in range(9000, 9050)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path + crossed + hub, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 401)} | {k: 5000 for k in range(5000, 5400)} | {k: 9000 for k in [*range(9000, 9050), 9999]}


def test_title_pairs_match_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(80)]
    for t in titles[:40]:
        k = rng.randrange(len(t))
        titles.append(t[:k] + rng.choice("xyz") + t[k + rng.randint(0, 1) :])
    titles += ["", "", "!!"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    found = {(r["a"], r["b"]) for r in curation.title_pairs(rows, "id", "title", 0.9).collect()}
    named = rows.select("id", T.normalize_title(F.col("title")).alias("t"))
    pairs = named.alias("x").crossJoin(named.alias("y")).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.t").alias("t"), T.edit_similarity(F.col("x.t"), F.col("y.t")).alias("s"), (F.col("x.t") == F.col("y.t")).alias("e"))
    wanted = {(r["a"], r["b"]) for r in pairs.where("s >= 0.9 and not e").collect()}
    smallest = {}
    for r in named.orderBy("id").collect():
        smallest.setdefault(r["t"], r["id"])
    texts = {r["id"]: r["t"] for r in named.collect()}
    near = {tuple(sorted((smallest[texts[a]], smallest[texts[b]]))) for a, b in wanted} | {(smallest[t], i) for i, t in texts.items() if smallest[t] != i}
    assert found == near


def test_pieces_are_recovered_after_a_long_gap(spark):
    said = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    text = f"{said('a', 20)}\n{said('gap', 500)}\n{said('B', 20)} $$\n{said('row', 40)}\n{said('c', 20)}"
    table = f"{said('row', 12)} {' '.join(f'row{i}' for i in range(28, 40))}"
    parts = [said("a", 20), said("b", 20), said("none", 10), table, "", said("c", 20), said("a", 20)]
    pieces = spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "doc_id long, position int, content string")
    rows = curation.recovered(pieces, spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).orderBy("position").collect()
    assert [(r["status"], r["method"]) for r in rows] == [
        ("recovered", "align"), ("recovered", "align"), ("FAILED", "no-anchor"), ("abbreviated", "anchored-abbrev"), ("FAILED", "empty-or-exhausted"), ("recovered", "align"), ("FAILED", "empty-or-exhausted"),
    ]
    assert rows[1]["text"] == f"{said('B', 20)} $$" and rows[3]["text"] == said("row", 40) and rows[5]["text"] == said("c", 20)
    assert all(r["text"] is None or text[r["start"] : r["end"]] == r["text"] for r in rows)
    assert [x[0] for x in curation.recovered_sequence(["one two three four seven eight nine ten"], "one two three four five six seven eight nine ten")] == ["recovered"]
    assert [x[1] for x in curation.recovered_sequence(["one x y z q"], "one two three four five")] == ["boundary-or-match-fail"]


def test_long_documents_are_aligned(spark, tmp_path):
    from sextant.plans.texts import align_recover

    rows = [(1, "word " * 700 + "\nend.", 3505), (2, "short one\ntwo", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["doc_id"], r["position"], r["status"]) for r in align_recover(spark, str(tmp_path)).collect()) == [(1, 0, "recovered"), (1, 1, "recovered"), (2, 0, "recovered"), (2, 1, "recovered")]


def test_all_headings_and_all_neighbours(spark, tmp_path):
    from sextant.plans.texts import html_sections, text_likeness

    page = "<p>before</p>" + "".join(f"<h2>t{i}</h2><p>{'x' * (i % 7)}</p>" for i in range(1500))
    spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((r["place"], r["heading"], r["chars"]) for r in html_sections(spark, str(tmp_path)).collect())
    assert found == [(i, f"t{i}", i % 7) for i in range(1500)]
    spark.createDataFrame([(k, "abcd"[: k % 5]) for k in range(100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    likeness = {r["doc_id"]: r["similarity"] for r in text_likeness(spark, str(tmp_path)).collect()}
    assert likeness == {k: round(1 - 1 / max(k % 5, (k - 1) % 5), 6) if k % 5 else 0.0 for k in range(1, 100)}


def test_licences(spark):
    cases = {
        None: "NOASSERTION", " ": "NOASSERTION", "http://creativecommons.org/licenses/by-nc-sa/3.0/": "CC-BY-NC-SA-3.0", "CC BY": "CC-BY-4.0", "cc_by_nd": "CC-BY-ND-4.0", "CC0": "CC0-1.0", "mit": "MIT",
        "https://creativecommons.org/publicdomain/zero/1.0/": "CC0-1.0", "public domain": "CC-PDDC", "cc-foo": "NOASSERTION", "http://arxiv.org/licenses/nonexclusive-distrib/1.0/": "LicenseRef-arxiv-nonexclusive",
    }
    for raw, wanted in cases.items():
        assert one(spark, I.licence(F.lit(raw).cast("string"))) == wanted, raw
    assert one(spark, I.effective_licence(F.create_map(F.lit("crossref"), F.lit("CC-BY-NC-4.0"), F.lit("core"), F.lit("CC-BY-4.0")))) == "CC-BY-4.0"


def test_canonical_json():
    assert I.canonical({"b": 1.0, "a": [1e21, 1e-7, 0.1, None, True, "é\n"], "€": {}}) == '{"a":[1e+21,1e-7,0.1,null,true,"é\\n"],"b":1,"€":{}}'


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert abs(one(spark, V.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, V.lenient_cosine(a, F.array())) == 0.0
    assert [round(x, 6) for x in one(spark, V.shortened(a, 1))] == [1.0]


def test_heads_cycle_and_fork(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")], "id string, supersedes string")
    found = {(r["id"], r["head"]) for r in graph.heads(rows).collect()}
    assert found == {("a", "b"), ("a", "c"), ("b", "b"), ("c", "c")}
    stamps = {r["id"]: (r["newer"], r["ambiguous"]) for r in graph.superseded(rows).collect()}
    assert stamps["a"] == (2, True)


def test_soft_filter_and_diversify(spark):
    rows = spark.createDataFrame([(1, "en", "x"), (2, None, "x"), (3, "de", "y"), (4, "EN", None), (5, "en", "x")], "i int, lang string, k string")
    kept = S.soft_filtered(rows, lang=(F.col("lang"), ["en"]))
    assert {(r["i"], r["tier"]) for r in kept.collect()} == {(1, 2), (2, 1), (4, 2), (5, 2)}
    assert {r["i"] for r in S.diversified(kept, "k", 1, [F.asc("i")]).collect()} == {1, 4}


def test_empty_search(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.keyword_search(none, "a b").count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query long, vector array<float>")
    assert [(r["query"], r["vec_id"]) for r in S.nearest(vectors, asked, 3).collect()] == [(9, 1)]


def test_spam(spark):
    case = lambda body, abstract=None: one(spark, T.spam_screen(F.lit(body), F.lit(abstract).cast("string")))
    assert case(" ") == "EMPTY_BODY" and case("short") == "BELOW_MIN_LENGTH"
    assert case("spam!" * 80) == "REPETITIVE_CONTENT"
    assert case(" ".join(map(str, range(200))), "tiny") == "ABSTRACT_TOO_SHORT"
    assert case(" ".join(map(str, range(200)))) is None
