"""What the third round of review found."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F


def test_a_shortened_id_that_two_documents_share_finds_the_one_meant(spark, tmp_path):
    from sextant.plans.upkeep import cited_by_any_id

    pq.write_table(pa.table({"doc_id": [184528, 270324], "source": ["s", "s"]}), tmp_path / "documents.parquet")  # the first 8 hex digits of their ids agree
    pq.write_table(pa.table({"doc_id": [270324]}), tmp_path / "labels.parquet")
    assert [r["doc_id"] for r in cited_by_any_id(spark, str(tmp_path)).collect()] == [270324]


def test_shortened_ids_without_the_whole_one_find_all(spark):
    from sextant.operators.maintenance import matching_ids

    rows = spark.createDataFrame([(1, "ab1"), (2, "ab2"), (3, "cd3")], "k long, whole string")
    wanted = spark.createDataFrame([("short", "ab", None), ("short", "cd", "cd4")], "kind string, id string, whole string")
    forms = {"short": F.left("whole", F.lit(2))}
    assert sorted(r["k"] for r in matching_ids(rows, "k", forms, wanted, F.col("whole")).collect()) == [1, 2]
    assert sorted(r["k"] for r in matching_ids(rows, "k", forms, wanted).collect()) == [1, 2, 3]


def test_an_id_that_many_documents_share_meets_an_ask_once(spark):
    from sextant.operators.runs import by_precedence

    docs = spark.range(400).withColumnRenamed("id", "doc_id")
    asked = spark.createDataFrame([(k, "dblp", "db/1") for k in range(50)], "ask long, kind string, id string")
    found = by_precedence(asked, docs, [("dblp", F.lit("db/1"))], F.col("doc_id") >= 7)
    assert {(r["ask"], r["doc_id"]) for r in found.collect()} == {(k, 7) for k in range(50)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [kind"), "documents are grouped by id before they meet the asks"


def test_distances_against_the_table_cell_by_cell(spark):
    import random

    from sextant.functions.edits import distances, edit_distance
    from tests.test_values import edits

    draw = random.Random(5)
    sizes = [0, 1, 5, 63, 64, 65, 127, 128, 129, 200]
    text = lambda signs: "".join(draw.choices(signs, k=draw.choice(sizes)))
    a, b = [text("abcé𝄞") for _ in range(160)], [text("abcdé") for _ in range(160)]
    assert distances(a, b).tolist() == [edits(x, y) for x, y in zip(a, b, strict=True)]
    rows = spark.createDataFrame([(0, "kitten", "sitting"), (1, None, "a"), (2, "a", None), (3, "", "ab")], "k long, a string, b string")
    assert [r["d"] for r in rows.select("k", edit_distance("a", "b").alias("d")).orderBy("k").collect()] == [3, None, None, 2]


def test_title_pairs_send_no_side_whole_and_find_all(spark):
    import random

    from sextant.operators.curation import title_pairs
    from tests.test_values import edits

    draw = random.Random(3)
    texts = ["".join(draw.choices("abc ", k=draw.choice([1, 9, 10, 11, 20, 29, 30, 60]))) for _ in range(40)]
    for t in texts[:40]:
        out = list(t)
        for _ in range(draw.choice([0, 1, 2, 4])):
            k = draw.randrange(len(out) + 1)
            out[k : k + draw.choice([0, 1])] = draw.choice(["", "a", "b"])
        texts.append("".join(out))
    found = title_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", 0.9)
    plain = {k: " ".join(t.split()) for k, t in enumerate(texts)}
    first = {}
    for k, t in plain.items():
        first.setdefault(t, k)
    wanted = {(first[t], k) for k, t in plain.items() if first[t] != k}
    kept = sorted(first.values())
    for a in kept:
        for b in kept:
            size = max(len(plain[a]), len(plain[b]))
            if a < b and plain[a] and plain[b] and 1 - edits(plain[a], plain[b]) / size >= 0.9 - 1e-12:
                wanted.add((a, b))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(wanted)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_chunk_whose_beginning_stands_elsewhere_with_other_signs_is_not_cut(spark, tmp_path):
    import duckdb

    from sextant.plans.texts import ORACLE_SQL, section_boundaries

    line = "the first line of a section is long enough to be a probe of eighty characters and more"
    lines = [f"{line} {k} and it ends with words of its own, number {k * 37}" for k in range(9)]
    other = [f"{x} once" for x in lines[:3]] + [x.replace("first", "fjrst") for x in lines[3:6]] + [f"quite another text in place {k}, nothing like the rest of them at all" for k in range(6)]
    words = [[f"w{k}x{j}" for j in range(30)] for k in range(20)]
    plain = [" ".join(w) for w in words]
    near = plain[:]
    near[8] = plain[0].replace("w0x3", "w0y3")  # a section that holds the first chunk's probe but for one sign
    texts = ["\n".join(lines), "\n".join(other), "\n".join(near), "\n".join([*plain[:8], plain[0], *plain[9:]])]
    pq.write_table(pa.table({"doc_id": list(range(4)), "text": texts}), tmp_path / "documents.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    wanted = sorted(base.execute(ORACLE_SQL["section_boundaries"]).fetchall())
    assert sorted(tuple(r) for r in section_boundaries(spark, str(tmp_path)).collect()) == wanted


def test_likeness_within_a_band_decides_like_the_whole_distance(spark):
    import random

    from sextant.functions import text as T

    draw = random.Random(9)
    rows = [(0, None, "a"), (1, "", ""), (2, "a" * 2100, "a" * 1700), (3, "a" * 2100, "a" * 1699)]
    for k in range(4, 60):
        a = "".join(draw.choices("ab c", k=draw.choice([1, 7, 20, 100])))
        rows.append((k, a, "".join(draw.choice("xy") if draw.random() < 0.16 else c for c in a)))
    a, b = F.col("a"), F.col("b")
    found = spark.createDataFrame(rows, "k long, a string, b string").select("k", T.text_like(a, b, 0.85).alias("band"), (T.text_similarity(a, b) >= 0.85).alias("whole")).collect()
    assert [r["band"] for r in found] == [r["whole"] for r in found] and {r["whole"] for r in found} == {None, True, False}


def test_winnowing_shares_what_texts_share_whatever_the_place(spark):
    from sextant.operators.neighbours import _least_hashes

    of = _least_hashes(12, 12).func.__closure__[0].cell_contents
    piece = "é𝄞 shared run of 23 ch."
    assert len(piece) == 23
    assert set(of(piece).tolist()) <= set(of("x" * 77 + piece + "tail of another text").tolist()) and len(of(piece)) == 1
    assert len(of(piece[:-1])) == 0 and len(of(None)) == 0 and len(of("a" * 5000)) == 1
