"""Fingerprints where doc_ids repeat or are null: one and the same row is the next document."""

import hashlib
import random
import unicodedata

from sextant.llm.fingerprints import fingerprints


def plain_form(text):
    return " ".join(unicodedata.normalize("NFC", text).lower().split())


def test_rows_of_one_id(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 2, 3, 9]), rng.choice([None, "", "Ab cd ef", "ab  CD ef", "x y z w", "longer text " * 3, "é" * 7])) for _ in range(80)]
    rows += [(None, f"null {k}") for k in range(40)]
    found = [r.asDict() for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(found) == len(rows)
    low = -(2**63)
    keys = sorted({low if i is None else i for i, _ in rows}, reverse=True)
    following = dict(zip(keys, [*keys[1:], keys[0]], strict=True))
    texts = {}
    for i, t in rows:
        texts.setdefault(low if i is None else i, []).append(t or "")
    by_print = {}
    for r in found:
        by_print.setdefault(r["fingerprint"], set()).add((r["doc_id"], r["n_chars"]))
    edits = {}
    for r in found:
        key = low if r["doc_id"] is None else r["doc_id"]
        edits.setdefault((key, r["n_chars"]), set()).add((r["edited_sha256"], r["near_next"], r["fingerprint"]))
    for i, t in rows:
        key, text = low if i is None else i, t or ""
        share = len(text) // 3
        heads = {}  # of what the next document may be: its form -> the beginnings
        for other in texts[following[key]]:
            heads.setdefault(plain_form(other), set()).add(other[:share])
        wanted = {(hashlib.sha256((text[: len(text) - share] + h).encode()).hexdigest(), float(plain_form(text) == f)) for f, hs in heads.items() for h in hs}
        mine = {(sha, near) for sha, near, _ in edits[key, len(text)]}
        assert mine & wanted
    for key, rest in {(low if r["doc_id"] is None else r["doc_id"]): 0 for r in found}.items():
        nears = {(r["fingerprint"], r["near_next"]) for r in found if (low if r["doc_id"] is None else r["doc_id"]) == key}
        assert sum(near for _, near in nears) <= 1  # one form is the next one's, whichever row asks
