"""Each stage of the pipeline on what the stage before kept, against a brute-force version."""

import collections
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sextant.llm.shared import materialize
from sextant.llm.toxicity import fit_toxicity, held_out
from tests.llm.test_operators import WORD, brute_components


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in cp.STAGES:
        docs = out[name] = materialize(stage(spark, docs, folder))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=repr)


def test_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == cp.COLUMNS and stages[name].count() > 0


def test_toxicity(spark, folder, stages):
    docs = stages["input"]
    model = fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(4, 2)))
    kept = {r["doc_id"] for r in model.score(docs).where(F.col("score") < cp.THRESHOLD).collect()}
    assert rows(stages["toxicity"]) == rows(docs.where(F.col("doc_id").isin(list(kept))))


def test_near_dedup(stages):
    before = {r["doc_id"]: r["text"] for r in stages["toxicity"].collect()}
    order = sorted(before)
    found = brute_components([before[k] for k in order], words=5)
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == {order[k] for k, (n, top) in found.items() if top == k or n == 0}


def test_passages(stages):
    seen, wanted = set(), {}
    for r in sorted(stages["near_dedup"].collect(), key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, v in zip(b, covered) if not v)
        if kept or not b:
            wanted[r["doc_id"]] = kept.decode("utf-8", "ignore")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["passages"].collect()}
    assert {k: v[0] for k, v in got.items()} == wanted and all(n == len(t) for t, n in got.values())


def test_mixing(stages):
    size, source = {}, {}
    for r in stages["passages"].collect():
        size[r["doc_id"]], source[r["doc_id"]] = len(WORD.findall(r["text"] or "")), r["source"]
    taken, copies = collections.Counter(), collections.Counter()
    for r in stages["mixing"].collect():
        taken[source[r["doc_id"]]] += len(WORD.findall(r["text"] or ""))
        copies[r["doc_id"]] += 1
    from sextant.llm.mixing import targets

    wanted = targets({s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())})
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted) and max(copies.values()) <= 2 and set(copies) <= set(size)


def test_tokens(stages):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    encoded = lambda t: (lambda ids: struct.pack(f"<{len(ids)}I", *ids))(library.encode(t or "", add_special_tokens=False).ids)
    wanted = collections.Counter((r["doc_id"], encoded(r["text"])) for r in stages["mixing"].collect())
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in stages["tokens"].collect()) == wanted


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, key long, row long"
WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated and null doc_ids, null, empty and equal rows, extra columns with names that the stages use."""
    a, b, c = (" ".join(WORDS[k : k + 60]) for k in (0, 100, 200))
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (None, c, "t"), (None, c, None), (None, None, "t"), (7, "", "s"), (7, "", "s"), (9, a + " more", "t"), (None, "x y z", None), (4, "one two three", "s"), (4, "four five six", "t")]
    return spark.createDataFrame([(d, t, None, s, None, 1, 2) for d, t, s in rows], AWKWARD)


def texts_of(df):
    return sorted((r["text"] is None, r["text"] or "") for r in df.collect())


def test_near_dedup_keeps_what_is_unique(spark, folder, awkward):
    a, b, c = (" ".join(WORDS[k : k + 60]) for k in (0, 100, 200))
    kept = cp.near_dedup(spark, awkward, folder)
    assert kept.columns == cp.COLUMNS and texts_of(kept) == sorted([(False, t) for t in (a, b, c, "", "", "x y z", "one two three", "four five six")] + [(True, "")])


def test_passages_keep_what_is_unique(spark, folder, awkward):
    kept = cp.passages(spark, cp.near_dedup(spark, awkward, folder), folder)
    assert kept.columns == cp.COLUMNS and "".join(r["text"] or "" for r in kept.collect()).count("w110 ") == 1 and kept.count() == 9


def test_mixing_takes_no_row_more_than_twice(spark, folder, awkward):
    out = collections.Counter(r["text"] for r in cp.mixing(spark, awkward, folder).collect())
    given = collections.Counter(r["text"] for r in awkward.collect())
    whole = {t: n for t, n in out.items() if t in given}
    assert all(n <= 2 * given[t] for t, n in whole.items()) and sum(n for t, n in out.items() if t not in given) <= 3
    assert out[None] == 1 and out[""] == 2  # without words: once each


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, folder, awkward, stage):
    run = dict(cp.STAGES)[stage]
    for docs in (awkward, awkward.limit(0)):
        out = run(spark, docs, folder)
        assert stage == "tokens" or out.columns == cp.COLUMNS
        assert (out.count() > 0) == (docs.count() > 0)
