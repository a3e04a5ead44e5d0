"""Queries that SQL can't express well, against plain Python over the whole tables."""

import re
import struct

import pyarrow.parquet as pq
import xxhash

from sextant.plans.registry import QUERIES


def documents(folder):
    t = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True)), dict(zip(t["doc_id"], t["n_chars"], strict=True))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_text_likeness(spark, folder):
    texts, _ = documents(folder)
    found = {r["doc_id"]: r["similarity"] for r in QUERIES["text_likeness"](spark, folder).collect()}
    assert set(found) == {k for k in texts if k - 1 in texts}
    for k in sorted(found)[:25]:
        a, b = texts[k], texts[k - 1]
        long = max(len(a), len(b)) > 2000
        size = 2000 if long else max(len(a), len(b))
        assert found[k] == round(1 - edits(a[:2000], b[:2000]) / size, 6) if size else 1


def test_section_batches(spark, folder):
    texts, _ = documents(folder)
    wanted = {}
    for k, text in texts.items():
        done, held, size = [], [], 0
        for part in re.split("\n+", text):
            if len(part.strip(" ")) < 30:
                continue
            if held and size + len(part) > 3500:
                done.append(held)
                held = [held[-1]] if len(held[-1]) <= 500 else []
                size = sum(map(len, held))
            held, size = [*held, part], size + len(part)
        done += [held] if held else []
        wanted[k] = len(done), max((len("\n".join(b)) for b in done), default=0)
    assert {r["doc_id"]: (r["batches"], r["largest"]) for r in QUERIES["section_batches"](spark, folder).collect()} == wanted


def test_stratified_sample(spark, folder):
    _, sizes = documents(folder)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    place = lambda k: signed(xxhash.xxh64_intdigest(struct.pack("<i", 7), xxhash.xxh64_intdigest(struct.pack("<q", k), 42)))
    strata = {"long": [k for k, n in sizes.items() if n > 3000], "short": [k for k, n in sizes.items() if n < 500], "middle": [k for k, n in sizes.items() if 500 <= n <= 3000]}
    wanted = {(k, s) for s, n in (("long", 60), ("middle", 30), ("short", 10)) for k in sorted(strata[s], key=lambda k: (place(k), k))[:n]}
    assert {(r["doc_id"], r["stratum"]) for r in QUERIES["stratified_sample"](spark, folder).collect()} == wanted


def plain_cut(text):
    """Scans back from the end for a sentence end; walks the text before it once to see whether a formula is open."""
    tail = text.rstrip()
    while tail.endswith("}") and "\\end{" in tail and re.fullmatch(r"\\end\{[^}]+\}", tail[tail.rindex("\\end{") :]):
        tail = tail[: tail.rindex("\\end{")].rstrip()
    if not text or (tail and tail[-1] in ".!?:;)"):
        return text
    for at in range(len(text), max(0, len(text) - 300), -1):
        if text[at - 1] in ".!?" and (at == len(text) or text[at].isspace()):
            dollars = sum(1 for k, c in enumerate(text[:at]) if c == "$" and (k == 0 or text[k - 1] != "\\"))
            word = re.split(r"[^A-Za-z.\s]", text[max(0, at - 8) : at - 1])[-1]
            short = any(word.lower().endswith(a) for a in ("fig", "eq", "ref", "sec", "tab", "vol", "vs", "i.e", "e.g", "approx", "resp", "et al")) or word.lower().endswith("al")
            if dollars % 2 == 0 and text[:at].count("\\[") <= text[:at].count("\\]") and not short:
                return text[:at].rstrip() if len(text[:at].rstrip()) >= 80 else text
    return text


def test_boundary_fixes(spark, folder):
    texts, _ = documents(folder)
    lines = {(k, p): line for k, text in texts.items() for p, line in enumerate(re.split("\n+", text))}
    wanted = {(k, p, len(line), len(plain_cut(line))) for (k, p), line in lines.items() if len(plain_cut(line)) < len(line)}
    assert {(r["doc_id"], r["position"], r["n"], r["kept"]) for r in QUERIES["boundary_fixes"](spark, folder).collect()} == wanted and len(wanted) >= 3
