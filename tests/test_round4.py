"""What the fourth round of review found."""

import random

import pyarrow as pa
import pyarrow.parquet as pq


def test_border_repeats_compares_whole_parts(spark, tmp_path):
    from sextant.plans.texts import border_repeats

    draw = random.Random(4)
    text = lambda n: "".join(draw.choices("abcdefgh ", k=n - 1)) + "."
    same, head = text(4000), text(2000)
    edited = "".join("#" if k < 2000 and k % 5 == 0 else c for k, c in enumerate(same))  # a fifth of its beginning, a tenth of it all
    texts = [f"{head}{text(2500)}\n{head}{text(2500)}", f"{same}\n{edited}", f"{same}\n{same}x", f"{same}\n{same[:3300]}", f"{same}\n{same[:3500]}"]
    pq.write_table(pa.table({"doc_id": list(range(5)), "text": texts}), tmp_path / "documents.parquet")
    found = {r["doc_id"]: (r["batches"], r["dropped"]) for r in border_repeats(spark, str(tmp_path)).collect()}
    assert found == {0: (2, 0), 1: (2, 1), 2: (2, 1), 3: (2, 0), 4: (2, 1)}


def near(texts, percent=80):
    """Smallest key reachable over links, by comparing all with all; op6's words and sets."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)} for w in words]
    root = list(range(len(texts)))
    top = lambda k: k if root[k] == k else top(root[k])
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in range(len(texts))}


def test_a_line_that_many_documents_share_does_not_deal_texts_to_all_cells(spark, monkeypatch):
    from sextant.llm import minhash_dedup as md

    dealt, deal = [], md._dealt
    monkeypatch.setattr(md, "_dealt", lambda rows, *a: (dealt.append(rows.count()), deal(rows, *a))[1])
    monkeypatch.setattr(md, "CELL", 16)
    monkeypatch.setattr(md, "TILE", 24)  # tiles of several hands and strips
    draw = random.Random(8)
    line = " ".join(f"common{k}" for k in range(16))
    own = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    texts = [f"{line}\n{own(draw.randrange(1, 9))}" for _ in range(240)]
    texts += [f"{t} {own(1)}" for t in texts[:40]] + [f"{own(1)} {t} {own(1)}" for t in texts[20:60]]
    draw.shuffle(texts)
    found = md.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == near(texts)
    assert sum(dealt) <= md.DEALS * len(texts)


def test_section_boundaries_exchanges_each_side_once(spark, folder):
    from sextant.plans.texts import section_boundaries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where no side is small
    try:
        plan = section_boundaries(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 2 and "Broadcast" not in plan


def test_titles_that_share_a_segment_only_are_no_rows(spark):
    from sextant.operators.curation import title_pairs

    draw = random.Random(6)
    texts = ["in of the beginning " + "".join(draw.choices("abcdefghij", k=38)) for _ in range(60)]
    found = title_pairs(spark.createDataFrame([*enumerate(texts), (60, texts[0][:-1]), (61, "b" + texts[1])], "k long, t string"), "k", "t", 0.9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("bit_count" in x for x in plan.splitlines() if "Join Inner" in x)  # dropped where they meet
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(0, 60), (1, 61)]
