"""Each operator against brute force, round trips or edge cases, on small tables."""

import collections
import hashlib
import random
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sextant.llm import bytescan, chat_format, fingerprints, license_scan, media, minhash_dedup, mixing, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def texts(seed=3, n=60):
    """Copies, near copies, shared passages, nulls, empty and repeated characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for k in range(n):
        body = " ".join(rng.choices(vocabulary, k=rng.randint(5, 80)))
        kind = k % 6
        if kind == 1 and out:
            body = out[-1] or ""
        elif kind == 2 and out:
            words = (rng.choice(out) or "a b").split()
            words[rng.randrange(len(words))] = "changed"
            body = " ".join(words)
        elif kind == 3:
            body = body[:50] + passage + body[50:]
        out.append(body)
    return [*out, None, "", "a" * 500, "a" * 700, "\n \t", "x", passage * 3]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return frame(spark, [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(rows)])


def brute_removed(rows, width=100):
    seen, out = set(), {}
    for k, t in enumerate(rows):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                covered[p : p + width] = b"\1" * width
            else:
                seen.add(b[p : p + width])
        kept = bytes(c for c, v in zip(b, covered) if not v)
        out[k] = (len(b), sum(covered), sum(1 for i in range(len(b)) if covered[i] and not (i and covered[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(bytescan, "PIECE", 700)
    bytescan.tables.cache_clear()
    yield
    bytescan.tables.cache_clear()


def test_suffix_dedup_in_pieces(small_pieces):
    """The kernels in this process, with texts longer than a piece, one row a batch."""
    rows = texts()
    each = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for k, t in enumerate(rows)]

    def exchange(batches, rank):
        table = pa.Table.from_batches([b for b in batches if b.num_rows]).sort_by([(c, "ascending") for c in ("key", "kind", "name", "doc", "start")])
        return pa.Table.from_batches(list(rank(iter(table.to_batches(max_chunksize=37))))).to_pylist()

    first = exchange(suffix_dedup._scan(100)(iter(each)), suffix_dedup._rank_blocks)
    spots = collections.defaultdict(list)
    for r in first:
        if r["kind"] == suffix_dedup.CONTESTED:
            spots[r["doc"]].append({"start": r["start"], "n": r["n"]})
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spots", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32())])))])
    fought = [pa.RecordBatch.from_pydict({"doc_id": [d], "text": [rows[d]], "spots": [x]}, kind) for d, x in spots.items()]
    second = exchange(suffix_dedup._pairs(100)(iter(fought)), suffix_dedup._rank_pairs)
    gone = collections.defaultdict(list)
    for r in [*first, *second]:
        if r["kind"] == suffix_dedup.GONE:
            gone[r["doc"]].append({"start": r["start"], "n": r["n"]})
    last = [pa.RecordBatch.from_pydict({"doc_id": [d], "text": [t], "spots": [gone.get(d)]}, kind) for d, t in enumerate(rows)]
    found = pa.Table.from_batches(list(suffix_dedup._cleaned(100, False)(iter(last)))).to_pylist()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_removed(rows)


def test_suffix_dedup(spark):
    rows = texts()
    found = suffix_dedup.suffix_dedup(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_removed(rows)


def test_suffix_dedup_repeated_rows_and_nulls(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300))
    df = frame(spark, [(1, long), (1, long), (None, long), (2, long + "tail")], "doc_id long, text string").withColumns({"key": F.lit(1), "doc": F.lit(2), "spots": F.lit(3)})
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect())
    assert found == [(False, 1, 0), (False, 1, 0), (False, 2, 300), (True, 0, 300)]
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    """Rows with one doc_id or none but different texts are different documents: nobody loses what is unique."""
    rng = random.Random(2)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=250)) for _ in range(3))
    df = frame(spark, [(2, a), (2, b), (None, c), (None, c + a), (1, b)], "doc_id long, text string")
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect())
    assert found[:3] == [(False, 1, 250, 0), (False, 2, 250, 0), (False, 2, 250, 250)]
    assert all(n >= gone for _, _, n, gone in found) and sorted(n - gone for *_, n, gone in found) in ([0, 0, 250, 250, 250], [0, 0, 0, 250, 500], [0, 0, 250, 250, 250])


@pytest.mark.parametrize("width", [33, 64, 100, 129, 400])
def test_suffix_dedup_at_any_length(spark, width):
    rows = texts(n=36)
    found = suffix_dedup.suffix_dedup(documents(spark, rows), width).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_removed(rows, width)


def brute_components(rows, words=4):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t in enumerate(rows):
        w = WORD.findall((t or "").translate(lower))
        sets[k] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize("cell", [128, 3])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash_dedup, "CELL", cell)
    rng = random.Random(8)
    base = [f"w{rng.randrange(50)}" for _ in range(80)]
    rows = texts()
    for _ in range(40):  # a large group whose members are linked by chains
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(80)] = f"v{rng.randrange(1000)}"
        rows.append(" ".join(own))
    found = minhash_dedup.near_duplicates(documents(spark, rows), words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_near_duplicates_in_a_long_chain(spark):
    """A version history: each text is a window of words moved on, linked to its neighbours only."""
    words = [f"w{k}" for k in range(1000)]
    rows = [" ".join(words[8 * k : 8 * k + 100]) for k in range(110)]
    found = minhash_dedup.near_duplicates(documents(spark, rows), words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)
    assert {r["component_id"] for r in found} == {0}


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    rows = [(3, "a b c d e"), (3, "f g h i j"), (None, "f g h i j"), (None, "k l m n o"), (5, "A b c d e"), (3, "f g h i j")]
    df = frame(spark, rows, "doc_id long, text string").withColumns({"key": F.lit(1), "text2": F.lit(2), "copies": F.lit(3)})
    found = sorted((str(r["doc_id"]), r["component_id"] or -1) for r in minhash_dedup.near_duplicates(df).collect())
    assert found == [("3", 3), ("3", 3), ("3", 3), ("5", 3), ("None", -1), ("None", 3)]


def test_near_duplicates_edges(spark):
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    df = frame(spark, [(None, "a b c d e"), (4, "A b c d e"), (4, "a b c d e"), (9, None)], "doc_id long, text string").withColumn("rep", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [("4", 1, 4), ("4", 1, 4), ("9", 0, 9), ("None", 1, 4)]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    rows = texts(n=120)
    df = documents(spark, rows)
    found = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(rows)
    assert all(r["size"] == len(WORD.findall(rows[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken, target = collections.Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_spreads_repeated_ids(spark, monkeypatch):
    """Rows of one doc_id, and of none, are documents of their own and don't meet in one group."""
    monkeypatch.setattr(mixing, "GROUP", 16)
    rows = [(7 if k % 2 else None, "w " * (3 + k % 9), "en", "a" if k % 3 else None, 1) for k in range(200)]
    found = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(found) == 200 and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken, target = collections.Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_targets_cap_and_reshare():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 20.0, "b": pytest.approx(196.6666667), None: pytest.approx(98.3333333)}
    assert mixing.targets({}) == {}


def test_mixing_is_unbiased(spark):
    p = np.zeros(30)
    import pandas as pd

    rows = pd.DataFrame({"doc_id": range(30), "row": range(30), "source": "s", "size": [5 + k % 7 for k in range(30)], "whole": 0, "fraction": 0.3, "salt": 0})
    for seed in range(400):
        out = mixing._pivot(seed, 0, True)(rows)
        p += out.sort_values("doc_id")["fraction"].to_numpy()
        assert abs((out["fraction"] * out["size"]).sum() - (rows["fraction"] * rows["size"]).sum()) < 1e-6
        assert ((out["fraction"] > 1e-12) & (out["fraction"] < 1 - 1e-12)).sum() <= 1
    assert np.abs(p / 400 - 0.3).max() < 0.1


def test_media_round_trip(spark):
    rows = ["", None, "abc", "ü" * 400, "abc"]
    found = {r["doc_id"]: r for r in media.media_columns(documents(spark, rows)).collect()}
    for k, t in enumerate(rows):
        body = (t or "").encode()
        payload = media.read_back(bytes(found[k]["media"]))
        assert payload.rstrip(b"\xff")[: len(body)] == body and len(payload) % 576 == 0 and found[k]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert found[2]["feature"] == found[4]["feature"] != found[3]["feature"] and found[0]["feature"] == found[1]["feature"]


def test_landmarks_find_tones():
    t = np.arange(576 * 4)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / 576)).astype(np.uint8).tobytes()
    codes = media.landmarks(tone)
    assert 40 in set((codes >> 24) & 0xFFFF) and len(codes) == len(set(codes.tolist()))


def brute_landmarks(samples):
    """Peak pairs window by window, with a plain transform of each."""
    x = [v - 128.0 for v in samples]
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / 575) for k in range(576)]
    peaks = []
    for a in range(0, len(x) - 575, 288):
        power = np.abs(np.fft.fft([v * h for v, h in zip(x[a : a + 576], hann)])[:289])
        found = [(power[b], b) for b in range(2, 288) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] > 1e-3]
        peaks.append([b for _, b in sorted(found, key=lambda f: -f[0])[:3]])
    if len(peaks) == 1:
        return {(0, b, 0, 0) for b in peaks[0]}
    return {(t, a, b, step) for t in range(len(peaks)) for step in (1, 2) if t + step < len(peaks) for a in peaks[t] for b in peaks[t + step]}


@pytest.mark.parametrize("size", [576, 576 * 2, 576 * 5])
def test_landmarks_match_brute_force(size):
    samples = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    codes = media.landmarks(samples)
    assert {(c >> 40, (c >> 24) & 0xFFFF, (c >> 8) & 0xFFFF, c & 0xFF) for c in codes.tolist()} == brute_landmarks(samples)
    assert not len(media.landmarks(bytes([128]) * 1152))  # silence


def test_bpe_equals_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from sextant.llm import bpe_codec

    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rng = random.Random(3)
    rows = [*texts(), "don't <|endoftext|>we'LL ΣΑΣ İ 日本\x85x́", *("".join(rng.choices("ab'<|>Σéß 1٣\n😀", k=40)) for _ in range(200))]
    coded = bpe_codec.bpe_encode(documents(spark, rows), public.path("word_bpe_49k.json")).cache()
    back = {r["doc_id"]: r["text"] for r in bpe_codec.bpe_decode(coded, public.path("word_bpe_49k.json")).collect()}
    for r in coded.collect():
        ids = library.encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
        assert back[r["doc_id"]] == library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(back[r["doc_id"]].encode()).hexdigest()


def test_bpe_pieces_change_nothing(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from sextant.llm import bpe_codec

    with open(public.path("word_bpe_49k.json"), "rb") as f:
        codec = bpe_codec.WordCodec(f.read())
    text = "\n".join(t for t in texts() if t) + "<|startoftext|> tail"
    whole = b"".join(p[1] for p in codec.pieces(text))
    monkeypatch.setattr(bpe_codec, "PIECE_CHARS", 50)
    assert b"".join(p[1] for p in codec.pieces(text)) == whole


def test_fingerprints(spark):
    rows = [t for t in texts()] + ["Café  X", "CAFÉ x", "café\nx "]
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, rows)).collect()}
    canon = lambda t: re.sub(r"[ \t-\r\x85\xa0]+", " ", unicodedata.normalize("NFC", t).lower()).strip(" ")

    def mark(t):
        b = canon(t).encode()
        return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(bytes([1, 0, 0, 0]), 42)):016x}"

    for k, t in enumerate(rows):
        t, other = t or "", rows[k - 1] or ""
        share = len(t) // 3
        edited = t[: len(t) - share] + other[:share]
        r = found[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), mark(t), mark(edited))
        assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(other)))
    assert fingerprints.fingerprints(documents(spark, []).limit(0)).count() == 0
    alone = fingerprints.fingerprints(frame(spark, [(None, "abc")], "doc_id long, text string")).collect()[0]
    assert alone["doc_id"] is None and alone["near_next"] == 1.0


def test_licence_scan(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nmore"), (2, "a/b/c.py", "print()"), (3, "a/b/d.py", "x\nLicensed under the Apache License, Version 2.0."), (4, "z/q.py", None), (5, None, ""),
        (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/e.py", "mit licence of sorts"), (2, "a/b/c.py", "print()"),
    ]
    df = frame(spark, rows, "file_id long, path string, text string").withColumn("dir", F.lit("clash"))
    found = sorted((r["file_id"], r["licence"], r["origin"], r["from_dir"]) for r in license_scan.scan_licences(df).collect() if r["licence"])
    assert found == [(1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b"), (2, "GPL-3.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (6, "GPL-3.0", "own", None), (7, "MIT", "inherited", "a")]
    assert license_scan.scan_licences(df).count() == len(rows) and license_scan.scan_licences(df.limit(0)).count() == 0


def test_licence_files_and_wrapped_headers(spark):
    full = {k: t.replace("<year>", "2020").replace("<name of author>", "A. Writer") for k, t in license_scan.FULL.items()}
    wrapped = {
        "Apache-2.0": "# Copyright 2020 A. Writer\n#\n# Licensed under the Apache\n# License, Version\n# 2.0.\n\nimport os",
        "GPL-3.0": "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * No warranty.\n */\nint x;",
        "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/.\n\nlet x;",
    }
    titles = {"MIT": "The MIT License (MIT)\n\nCopyright (c) 2020 A. Writer\n", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "MPL-2.0": "Mozilla Public License Version 2.0\n====\n"}
    cases = [(k, f"full/{k}/LICENSE", t) for k, t in full.items()] + [(k, f"wrapped/{k}/x.py", t) for k, t in wrapped.items()] + [(k, f"title/{k}/COPYING", t) for k, t in titles.items()]
    below = [(k, f"full/{k}/src/y.py", "y = 1") for k in full]
    plain = [(None, "p/LICENSE", "All the words of the house and of the work that you may use in this or that way. " * 30)]
    rows = [(i, path, t) for i, (_, path, t) in enumerate(cases + below + plain)]
    found = {r["path"]: r["licence"] for r in license_scan.scan_licences(frame(spark, rows, "file_id long, path string, text string")).collect()}
    assert found == {path: k for k, path, _ in cases + below + plain}


def test_licence_cosine_matches_brute_force(spark):
    rng = random.Random(4)
    vectors, unknown = license_scan.weights(license_scan.TEMPLATES)
    idf = {}
    for c in vectors.values():
        for x in c:
            idf[x] = float(np.log(1 + len(vectors) / sum(x in d for d in vectors.values())))
    words = sorted(idf) + ["zzz", "qqq"]
    rows = []
    for k in range(60):
        w = re.findall(license_scan.TERM, rng.choice(list(license_scan.TEMPLATES.values())).lower())
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(words))
        rows.append((k, " ".join(w)))
    wanted = {}
    for k, t in rows:
        c = collections.Counter(re.findall(license_scan.TERM, t))
        mine = {x: n * idf.get(x, unknown) for x, n in c.items()}
        size = sum(v * v for v in mine.values()) ** 0.5
        best = max((round(sum(mine.get(x, 0) * w for x, w in v.items()) / size / sum(w * w for w in v.values()) ** 0.5, 6), n) for n, v in vectors.items())
        if best[0] >= 0.8:
            wanted[k] = (best[1], best[0])
    found = license_scan.own_licences(frame(spark, rows, "k long, text string"), "k", license_scan.TEMPLATES, 0.8).collect()
    assert {r["k"]: (r["licence"], pytest.approx(r["similarity"], abs=2e-6)) for r in found} == wanted


def test_chat_links(spark):
    calls = frame(spark, [(1, "a", 1, "reply", '{"turn":"x","zz":1}'), (1, "b", 2, "nope", "{}"), (1, None, 2, "reply", "[]"), (1, "c", 3, "reply", None), (None, "a", 1, "reply", '{"turn":3,"role":"r","prompt":"é\\"\\n","n":null}')], "conv_id long, call_id string, turn int, name string, arguments string")
    results = frame(spark, [(1, "a", 0, "ok"), (1, "a", 5, "late"), (9, "q", 1, None)], "conv_id long, call_id string, turn int, content string")
    found = {(r["conv_id"], r["call_id"], r["kind"]): r for r in chat_format.link_calls(calls, results, chat_format.REPLY).collect()}
    assert len(found) == 6
    a, answer = found[1, "a", "call"], found[1, "a", "result"]
    assert (a["linked"], a["problems"]) == (True, ["prompt: missing", "role: missing", "turn: not integer", "zz: unknown"])
    assert (answer["major"], answer["minor"], answer["repeats"], answer["json"]) == (1, 1, 2, '{"call_id":"a","content":"ok"}')
    assert (answer["major"], answer["minor"]) > (a["major"], a["minor"])
    assert found[9, "q", "result"]["problems"] == ["no call"] and found[1, "c", "call"]["problems"] == ["not an object"]
    assert found[None, "a", "call"]["json"] == '{"arguments":{"prompt":"é\\"\\n","role":"r","turn":3},"id":"a","name":"reply"}'
    assert chat_format.link_calls(calls.limit(0), results.limit(0), chat_format.REPLY).count() == 0


def test_chat_order_is_topological(spark):
    """References against the order of turns, chains of them, a cycle, an unknown one; each against a plain check of all edges."""
    ref = lambda *ids: "{" + ",".join(f'"a{k}":{{"$result": "{i}"}}' for k, i in enumerate(ids)) + "}"
    calls = [(1, "a", 5, "t", "{}"), (1, "b", 1, "t", ref("a")), (1, "c", 1, "t", ref("b")), (1, "d", 9, "t", ref("c", "a")), (1, "x", 2, "t", ref("y")), (1, "y", 2, "t", ref("x")), (1, "z", 3, "t", ref("gone")), (None, "a", 0, "t", ref("a2")), (None, "a2", 4, "t", "{}"), (1, "q", 1, "t", '{"s":"\\"$result\\":\\"a\\""}')]
    results = [(1, "a", 6, "r"), (1, "b", 2, "r"), (1, "c", 2, "r"), (None, "a2", 8, "r")]
    out = chat_format.link_calls(frame(spark, calls, "conv_id long, call_id string, turn int, name string, arguments string"), frame(spark, results, "conv_id long, call_id string, turn int, content string"), {"t": {}}).collect()
    at = {(r["conv_id"], r["call_id"], r["kind"]): (r["major"], r["minor"]) for r in out}
    assert len(out) == len(calls) + len(results)
    for call, on in (("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")):
        assert at[1, call, "call"] > at[1, on, "result"] > at[1, on, "call"]
    assert at[None, "a", "call"] > at[None, "a2", "result"] == (8, 1) and at[1, "q", "call"] == (1, 0) and at[1, "d", "call"] == (9, 0)
    said = {(r["conv_id"], r["call_id"]): r["problems"] for r in out if r["kind"] == "call"}
    assert "gone: no such call" in said[1, "z"] and any("in a cycle of references" in said[1, k] for k in "xy") and not any("cycle" in p for k in "abcd" for p in said[1, k])


def test_op7_query(spark, folder):
    """Against a plain version of the query: who answers whom, and in what order."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    calls = {(r["conv_id"], r["turn"]) for r in turns if r["role"] != "assistant"}
    answers = {(r["conv_id"], r["turn"] - 1) for r in turns if r["role"] == "assistant"}
    found = {(r["conv_id"], r["call_id"], r["kind"]): r for r in chat_format.op7_chat_tool_links(spark, folder).collect()}
    wanted = {(c, f"{c}-{t}", "call"): (c, t) in answers for c, t in calls} | {(c, f"{c}-{t}", "result"): (c, t) in calls for c, t in answers}
    assert {k: r["linked"] for k, r in found.items()} == wanted
    for (c, t), n in ((k, found[k[0], f"{k[0]}-{k[1]}", "call"]) for k in calls):
        if (c, t) in answers:
            r = found[c, f"{c}-{t}", "result"]
            assert (r["major"], r["minor"]) > (n["major"], n["minor"])
        if t >= 2 and (c, t - 2) in calls and (c, t - 2) in answers:
            r = found[c, f"{c}-{t - 2}", "result"]
            assert (n["major"], n["minor"]) > (r["major"], r["minor"])


def labelled(spark, n=500):
    rng = random.Random(6)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        bad, poor = rng.random() < 0.3, rng.random() < 0.3
        words = rng.choices(common, k=rng.randint(30, 120))
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "nastything", "grimstuff"])
        if poor:
            words = [w + "$$$" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not poor), int(bad)))
    return frame(spark, rows, "doc_id long, text string"), frame(spark, labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").select("score", column).collect()
    return np.mean([(r["score"] >= 0.5) == bool(r[column]) for r in rows])


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 > 0"))
    assert accuracy(model.score(docs.where("doc_id % 3 = 0")), labels, "toxic") > 0.9
    edge = model.score(frame(spark, [(1, None), (2, ""), (2, "")], "doc_id long, text string")).collect()
    assert len(edge) == 3 and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.fit_toxicity(docs, labels.limit(0)).score(docs).agg(F.max("score")).collect()[0][0] == 0.0
    assert model.keep(docs, 0.5).columns == docs.columns


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels.where("doc_id % 3 > 0"))
    assert model.rules and accuracy(model.score(docs.where("doc_id % 3 = 0")), labels, "quality") > 0.95
    edge = model.score(frame(spark, [(1, None), (2, ""), (2, "\n")], "doc_id long, text string")).collect()
    assert len(edge) == 3 and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.fit_quality(docs, labels.limit(0)).score(docs.limit(1)).collect()[0]["score"] == 0.5


def test_quality_without_rules_and_with_repeated_ids(spark):
    docs = frame(spark, [(k, "same words here") for k in range(60)] + [(1, "another row")] * 5, "doc_id long, text string")
    labels = frame(spark, [(k, k % 2) for k in range(60)] + [(3, 0)] * 4, "doc_id long, quality int")
    scored = quality.fit_quality(docs, labels).score(docs).collect()
    assert len(scored) == 65 and all(0.3 < r["score"] < 0.7 for r in scored)


def test_toxicity_windows_match_plain_compression(spark):
    """Gains of a text are those of compressing each of its windows by itself."""
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    text = "vileword abc def " * 30
    distance = toxicity.Distance(model.toxic, model.ordinary)
    padded = b" " + text.encode() + b" "
    lengths = []
    for content in (model.ordinary, model.toxic):
        plain = toxicity.zs.ZstdCompressor(compression_params=toxicity.PARAMETERS, dict_data=toxicity.zs.ZstdCompressionDict(content, dict_type=toxicity.zs.DICT_TYPE_RAWCONTENT))
        lengths.append([len(plain.compress(toxicity.PRIMER + padded[max(0, k - toxicity.OVERLAP) : k + toxicity.WINDOW])) for k in range(0, len(padded), toxicity.WINDOW)])
    gains = distance.gains(text.encode())
    assert len(gains) == len(lengths[0]) and np.corrcoef(gains, np.subtract(*lengths))[0, 1] > 0.5 and gains.mean() > 0
    assert model.cut in toxicity.CUTS and len(model.toxic) == len(model.ordinary)


def test_compiled_rules_equal_the_model(spark):
    docs, labels = labelled(spark, 200)
    model = quality.fit_quality(docs, labels)
    rows = quality.measured(docs).withColumn("score", model.column()).collect()
    x = np.array([[r[s] for s in quality.STATISTICS] for r in rows])
    z = model.constant + sum(w * quality.holds(rule, x) for rule, w in model.rules)
    assert np.allclose(1 / (1 + np.exp(-z)), [r["score"] for r in rows])


def test_word_hashes_do_not_depend_on_pieces(small_pieces):
    rows = [t or "" for t in texts()]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in rows])])
    hashes, first = bytescan.word_hashes(data, offsets)
    names = {}
    for k, t in enumerate(rows):
        words = WORD.findall(t.lower())
        assert first[k + 1] - first[k] == len(words)
        for h, w in zip(hashes[first[k] : first[k + 1]], words, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
