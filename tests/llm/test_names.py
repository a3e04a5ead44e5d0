"""Hashes that hold for regular words, lines over the borders of pieces, similarities other than 80, mixes that don't depend on the layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sextant.llm import bytescan, minhash_dedup, mixing, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words_are_told_apart(spark, n):
    a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
    five = "one two three four five "
    texts = [a, b, five + a, five + b, a + " " + b, b + " " + a]
    docs = frame(spark, texts)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, words=4).collect()} == {k: k for k in range(6)}
    assert cp.near_dedup(spark, docs, "").count() == 6
    measured = {r.doc_id: r for r in quality.measured(frame(spark, [a + " " + b, a + "\n" + b, a + "\n" + a])).collect()}
    assert measured[0].distinct_words == 1 and measured[1].distinct_lines == 1
    found = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, texts[:2])).collect()}
    plain = [x.encode() for x in texts[:2]]
    seen, wanted = set(), {}
    for k, body in enumerate(plain):
        covered = bytearray(len(body))
        for p in range(len(body) - 99):
            if body[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(body[p : p + 100])
        wanted[k] = sum(covered)
    assert found == wanted


@pytest.mark.parametrize("piece", [700, 1 << 18])
def test_lines_go_on_over_pieces(monkeypatch, piece):
    monkeypatch.setattr(bytescan, "PIECE", piece)
    bytescan.tables.cache_clear()
    texts = ["x" * 99 + "\n", ("y" * 60 + "\n") * 400, "", "no end", "a\n\na\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = quality.statistics(data, offsets)[:, quality.STATISTICS.index("distinct_lines")]
    assert found == pytest.approx([1, 1 / 400, 0, 1, 2 / 3])
    bytescan.tables.cache_clear()


@pytest.mark.parametrize("percent", [100, 60, 45])
def test_other_similarities(spark, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for k in range(30):
        words = [f"w{k}x{m}" for m in range(40)]
        texts.append(" ".join(words))
        for cut in (2, 6, 12, 18):
            texts.append(" ".join(words[cut:] + [f"v{rng.integers(1 << 30)}" for _ in range(cut)]))
    sets = [frozenset(zip(*(t.split()[m:] for m in range(3)))) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i - i % 5, i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, texts), words=3, percent=percent).collect()}
    assert found == {k: top(k) for k in range(len(texts))}
    with pytest.raises(ValueError, match="coordinates"):
        minhash_dedup.near_duplicates(frame(spark, texts), percent=20)


def test_mix_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    rows = [(k, "w " * (3 + k % 9), "en", "a" if k % 3 else None, 1) for k in range(150)] + [(5, "w w", "en", "a", 1), (None, "w w w", "en", "a", 1)] * 7
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = lambda df: sorted(((r.doc_id, r.size, r.taken, r.source) for r in mixing.mix_sources(df).collect()), key=repr)
    first = taken(docs.repartition(1))
    assert len(first) == len(rows) and first == taken(docs.orderBy(F.desc("doc_id")).repartition(7)) == taken(docs.repartition(3, "doc_id"))
    mixed = lambda df: sorted(map(tuple, cp.mixing(spark, df, "").collect()), key=repr)
    assert mixed(docs.repartition(1)) == mixed(docs.orderBy(F.desc("doc_id")).repartition(7))
    monkeypatch.setattr(mixing, "COPIES", 3)
    assert sum(t[2] for t in taken(docs)) == sum(t[2] for t in first)
