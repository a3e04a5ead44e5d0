"""The full-text index: stems, exact top lists, and what a query reads."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sextant.operators import fulltext as T

#: words and stems as Porter's paper gives them
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is a a""".split()


def test_stems(spark):
    wanted = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    rows = spark.createDataFrame([(w,) for w in wanted], "word string")
    assert {r["word"]: r["t"] for r in T.with_stem(rows, "word", "t").collect()} == wanted
    db = duckdb.connect()
    db.execute("CREATE TABLE words AS SELECT unnest(?) AS word", [list(wanted)])
    assert dict(db.sql(T.stem_sql("SELECT word FROM words")).fetchall()) == wanted


def corpus(n=400):
    rng = random.Random(5)
    words = ["running", "runs", "jumped", "jump", "cats", "cat", "dogs", "relational", "the", "of", "zebra"]
    return [(k, " ".join(rng.choices(words, weights=[3, 3, 2, 2, 2, 2, 2, 1, 5, 5, 0.05], k=rng.randint(1, 120)))) for k in range(n)]


STEM_OF = {"running": "run", "runs": "run", "jumped": "jump", "jump": "jump", "cats": "cat", "cat": "cat", "dogs": "dog", "relational": "relat", "zebra": "zebra"}


def plain(rows, terms):
    bags = {k: Counter(STEM_OF[w] for w in (t or "").lower().split() if w in STEM_OF) for k, t in rows}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    out = {}
    for k, b in bags.items():
        if all(b[t] for t in terms):
            score = 0.0
            for t in terms:
                df = sum(1 for o in bags.values() if o[t])
                score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / mean))
            out[k] = score
    return out


@pytest.fixture(scope="module")
def index(spark):
    cell, T.CELL = T.CELL, 8  # about 50 cells
    yield T.write_index(spark.createDataFrame(corpus(), "doc_id long, text string"))
    T.CELL = cell


@pytest.mark.parametrize("query, terms", [("the Running CATS", ["run", "cat"]), ("relational zebra", ["relat", "zebra"]), ("dog", ["dog"])])
def test_top_is_exact(index, query, terms):
    wanted = plain(corpus(), terms)
    found = {r["doc_id"]: r["bm25"] for r in index.matches(query).collect()}
    assert found == pytest.approx(wanted)
    best = sorted(wanted, key=lambda k: (-round(wanted[k], 12), k))[:5]
    assert [r["doc_id"] for r in index.top(query, 5).collect()] == best


def test_no_terms_or_unknown_terms(index):
    for query in ("", "the of and", "cat unheardof"):
        assert index.matches(query).count() == 0 and index.top(query, 3).count() == 0


def test_reads_only_its_buckets(spark, index):
    blocks = index._of("postings", ["cat"])
    scan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PushedFilters: [" in scan and "EqualTo(term,cat)" in scan and "In(term" not in scan
    all_files = index.read("postings").select(F.input_file_name().alias("f")).distinct().count()
    read = {f.split("bucket=")[1].split("/")[0] for f in (r["f"] for r in blocks.select(F.input_file_name().alias("f")).distinct().collect())}
    assert len(read) == 1 and all_files > 1
    slim = index.bounds(blocks, {"cat": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "posts" not in slim.split("ReadSchema")[1].split(">")[0]  # bounds come from the block rows alone


def test_bounds_hold_and_cut(index):
    wanted = plain(corpus(), ["cat"])
    weights = index.weights(["cat"])
    bounds = {r["cell"]: r["bound"] for r in index.bounds(index._of("postings", ["cat"]), weights).collect()}
    cells = {r["doc_id"]: r["cell"] for r in index._of("postings", ["cat"]).select("cell", F.inline("posts")).collect()}
    assert all(wanted[k] <= bounds[c] + 1e-9 for k, c in cells.items()) and len(bounds) > 20
    edge = sorted(wanted.values())[-5]
    assert sum(b >= edge for b in bounds.values()) < len(bounds) / 2


def test_odd_tables(spark):
    empty = T.write_index(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.matches("cat").count() == 0 and empty.top("cat", 3).count() == 0
    rows = [(1, "cat cat"), (1, "dog"), (None, "cats"), (2, None), (3, ""), (None, "zebra")]
    found = T.write_index(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.docs == 4 and {r["doc_id"] for r in found.matches("cat").collect()} == {1, None} and {r["doc_id"] for r in found.matches("cat zebra").collect()} == {None}


def test_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "cat")], "doc_id long, text string").write.parquet(path)
    first = T.index_of(spark.read.parquet(path))
    assert T.index_of(spark.read.parquet(path)) is first
    spark.createDataFrame([(2, "cat")], "doc_id long, text string").write.mode("append").parquet(path)
    assert T.index_of(spark.read.parquet(path)).matches("cat").count() == 2


def exchanged(spark):
    """Records that this session's stages wrote for exchanges so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_postings_are_exchanged_once_as_blocks(spark):
    texts = spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(1)
    before = exchanged(spark)
    index = T.write_index(texts)
    posts = index.read("postings").agg(F.sum("df")).collect()[0][0]
    assert exchanged(spark) - before < posts / 2  # once word by word, then term by term, before


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_index_of_text_keys_in_several_rows(spark, monkeypatch, lanes):
    for name, value in (("CELL", 4), ("LANES", lanes), ("SLICE", 2)):
        monkeypatch.setattr(T, name, value)
    rows = [(None if k % 50 == 7 else f"d{k % 90}", None if k % 31 == 3 else t) for k, t in corpus(200)]
    merged = {}
    for k, t in rows:
        merged[k] = f"{merged.get(k, '')} {t or ''}"
    index = T.write_index(spark.createDataFrame(rows, "name string, body string").repartition(3), "name", "body")
    for query, terms in (("running cats", ["run", "cat"]), ("zebra", ["zebra"])):
        found = index.matches(query).collect()
        assert {r["name"]: r["bm25"] for r in found} == pytest.approx(plain(list(merged.items()), terms)) and len(found) == len({r["name"] for r in found})
    whole = index.read("postings").groupBy("term", "cell").count().where("count > 1").count()
    assert whole == 0  # a term's postings of a cell are one row


def test_search_exchanges_no_texts(spark):
    docs = spark.createDataFrame([(k, "en", f"s{k % 3}", f"text {k}") for k in range(50)], "doc_id long, lang string, source string, text string")
    near = docs.select("doc_id", (F.col("doc_id") / 50).alias("similarity")).where("doc_id < 9")
    words = docs.select("doc_id", (F.col("doc_id") / 60).alias("bm25")).where("doc_id < 12")
    from sextant.operators import search as S

    page, _ = S.searched(near, words, docs, "doc_id", 5, soft={"lang": ["en"]}, diversify="source", most=2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert [r["doc_id"] for r in page.orderBy("place").collect()] == [8, 7, 6, 5, 4]
