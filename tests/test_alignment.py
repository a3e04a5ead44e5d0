"""Alignment, markers and section borders against plain versions."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import alignment as L

rng = random.Random(11)

GAPS = {
    "": True, "  \n": True, r"\section{Introduction}": True, "[figure: Some caption words]": True, "[Table 3]": True, r"\iffalse lost words here": True, r"\cite{a,b} \ref{c}": True, "{a {b {c words}}}": True, "a b of": True, "12 - 34": True,
    "[see other]": True, "some words stay": False, r"\emph{gone} but this stays": False, "figure: without brackets": False, r"x \\ word": False, "café noir": False,
}
FILES = {
    "notation.tex": True, "settings.tex": True, "definitions.tex": True, "sections/intro": True, "sections/intro.tex": True, "chapters/figuring.tex": True, "body/text": True, "": True, "performance_summary.tex": False, "abstract.tex": False,
    "figures/teaser.png": False, "teaser.pdf_tex": False, r"\filename.title": False, "a/Tables/x.tex": False, "macros-main": False, "header.tex": False, "eval_results": False, "plot.settings": False, "fig_2": False, "tikzfile": False,
}


def test_droppable_gaps(spark):
    rows = spark.createDataFrame([(g,) for g in GAPS], "g string").select("g", T.droppable(F.col("g")).alias("d")).collect()
    assert {r["g"]: r["d"] for r in rows} == GAPS == {g: T.droppable_text(g) for g in GAPS}


def test_body_files(spark):
    rows = spark.createDataFrame([(p,) for p in FILES], "p string").select("p", T.body_include(F.col("p")).alias("b")).collect()
    assert {r["p"]: r["b"] for r in rows} == FILES


def words(n, m):
    return [rng.choice("abcdefghij"[:m]) for _ in range(n)]


def test_places_of_runs():
    for m in (1, 2, 5, 10):
        source, piece = words(60, m), words(30, m)
        places = L.Places(" ".join(source), [" ".join(piece)])
        for level, (j0, j1) in ((v, w) for v in range(4) for w in ((0, 60), (13, 41))):
            width = 1 << level
            lo, hi = places.occurrences(0, level, 0, 30, j0, j1)
            for i in range(30 - width + 1):
                plain = [j for j in range(j0, j1 - width + 1) if source[j : j + width] == piece[i : i + width]]
                assert places.order[level][lo[i] : hi[i]].tolist() == plain


def test_chains_are_longest():
    for _ in range(200):
        pairs = sorted(((rng.randrange(6), rng.randrange(8)) for _ in range(rng.randrange(9))), key=lambda p: (p[0], -p[1]))
        best = max((len(c) for n in range(len(pairs) + 1) for c in combinations(pairs, n) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        found = L.increasing(pairs)
        assert len(found) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:])) and set(found) <= set(pairs)


def test_blocks_are_common_words_in_order():
    for m in (2, 5, 10):
        for _ in range(60):
            source = words(80, m)
            piece = source[rng.randrange(40) :][: rng.randrange(1, 40)]
            for _ in range(rng.randrange(4)):
                piece[rng.randrange(len(piece))] = rng.choice("xyz")
            blocks = L.Places(" ".join(source), [" ".join(piece)]).blocks(0, 0)
            at_i = at_j = 0
            for i, j, n in blocks:
                assert n > 0 and i >= at_i and j >= at_j and source[j : j + n] == piece[i : i + n]
                at_i, at_j = i + n, j + n


def test_changed_pieces_are_recovered():
    said = [f"w{rng.randrange(400)}" for _ in range(3000)]
    source = " ".join(said)
    pieces, wanted = [], []
    for k in range(0, 3000, 60):
        own = said[k : k + 60]
        for _ in range(4):
            own[rng.randrange(10, 50)] = "other"
        pieces.append(" ".join(own).upper())
        wanted.append(" ".join(said[k : k + 60]))
    found = L.recovered_sequence(pieces, source)
    assert [r[0] for r in found] == ["recovered"] * 50 and [r[4] for r in found] == wanted


def test_long_documents_take_time_in_proportion():
    said = [f"w{rng.randrange(3000)}" for _ in range(200_000)]
    began = time.time()
    found = L.recovered_sequence([" ".join(said[k : k + 500]) for k in range(0, 200_000, 500)], " ".join(said))
    assert all(r[0] == "recovered" for r in found) and time.time() - began < 30


def plain_anchored(pairs, source):
    """Markers that stand in the source as they are: every choice of places for the starts, the longest first."""
    own = source.split()
    stands = lambda marker: [j for j in range(len(own) - len(marker.split()) + 1) if own[j : j + len(marker.split())] == marker.split()]
    chain = {}

    def grow(k, last):
        if k == len(pairs):
            return {}
        best = grow(k + 1, last)
        for j in stands(pairs[k][0]):
            if j > last:
                rest = grow(k + 1, j)
                if len(rest) + 1 > len(best):
                    best = {k: j} | rest
        return best

    chain = grow(0, -1)
    return len(chain)


def test_markers_against_a_plain_version():
    for _ in range(40):
        said = [f"w{rng.randrange(30)}" for _ in range(120)]
        cuts = sorted(rng.sample(range(0, 120), 5))
        parts = [said[a:b] for a, b in zip(cuts, cuts[1:]) if b - a >= 4]
        pairs = [(" ".join(p[:3]), " ".join(p[-3:])) for p in parts]
        found = L.anchored_sequence(pairs, " ".join(said))
        assert sum(r[0] == "recovered" for r in found) == plain_anchored(pairs, " ".join(said)) == len(pairs)
        if len({" ".join(said[k : k + 3]) for k in range(118)}) == 118:  # each run once: the passages are the parts and touch
            for r, p, after in zip(found, parts, [*parts[1:], None]):
                assert r[4].split()[: len(p)] == p and (after is None or r[3] < " ".join(said).index(" ".join(after[:3]) + " ") + 1 or len(r[4].split()) >= len(p))


def test_markers_meet_and_snap():
    said = " ".join(f"word{k}" for k in range(2000))
    at = lambda a, b: said[said.index(f"word{a} ") : said.index(f"word{b}") + len(f"word{b}")]
    pairs = [("word30 word31 word32", "word97 word98 word99"), ("word120 word121", "word150 word151"), ("none at all", "x"), ("word148 word149 word150", "word300 word301"), ("word900 word901", "word1990 word1991"), (None, None), ("word1900 word1901", "word1969 word1970")]
    found = L.anchored_sequence(pairs, said)
    assert [r[1] for r in found] == ["anchors", "anchors", "no-start-anchor", "anchors", "no-end-anchor", "no-start-anchor", "anchors"]
    assert found[0][4] == at(0, 119)  # the beginning within 40 words, and the gap to the next, are content
    assert found[1][4] == at(120, 147)  # the overlap goes to the later one
    assert found[3][4] == at(148, 1899) and found[6][4].split()[0] == "word1900" and found[6][4].endswith("word1999")
    tagged = "\\section{One} alpha beta gamma delta \\label{x} epsilon zeta eta theta"
    first, last = L.anchored_sequence([("alpha beta", "gamma delta"), ("epsilon zeta", "eta theta")], tagged)
    assert (first[4], last[4]) == ("alpha beta gamma delta", "epsilon zeta eta theta")  # markup between and before is no content


def test_anchored_tables(spark):
    markers = spark.createDataFrame([(1, 0, "one two", "three four"), (1, 1, None, None), (2, 0, "x", "y"), (None, 0, "x", "y")], "doc_id long, position int, first string, last string")
    sources = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "left out")], "doc_id long, text string")
    found = {(r["doc_id"], r["position"]): (r["status"], r["text"]) for r in L.anchored(markers, sources).collect()}
    assert found == {(1, 0): ("recovered", "one two three four"), (1, 1): ("FAILED", None), (2, 0): ("FAILED", None)}
    assert L.anchored(markers.limit(0), sources).count() == 0


def test_near_places(spark):
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "."
    sections = [(d, k, text(300)) for d in range(3) for k in range(3)]
    probes, wanted = [], set()
    for n, (d, k, content) in enumerate(sections):
        for edits in (0, 3, 6):
            probe = list(content[100:180])
            for _ in range(edits):
                p = rng.randrange(len(probe))
                probe[p : p + 1] = rng.choice([[], ["#"], [probe[p], "#"]])
            probes.append((d, 10 * n + edits, "".join(probe)))
            wanted.add((d, 10 * n + edits, k))
    probes += [(0, 999, text(80)), (1, 998, None), (1, 997, "abc")]
    found = {(r["doc_id"], r["chunk"], r["section"]) for r in L.near_places(spark.createDataFrame(probes, "doc_id long, chunk int, probe string"), spark.createDataFrame(sections, "doc_id long, section int, content string")).collect()}
    assert found == wanted  # random texts are some 60 edits apart


def test_chunks_end_where_their_section_does(spark):
    one = " ".join(f"alpha{k}" for k in range(40))
    two = " ".join(f"beta{k}" for k in range(40))
    three = one[:90] + " " + " ".join(f"gamma{k}" for k in range(30))  # begins as the first does
    sections = [(1, "A", one), (1, "B", two), (1, "C", three), (2, "A", one), (3, "A", None)]
    over = one + "\n " + two[:200]
    chunks = [(1, 0, "A", over), (1, 1, "A", one), (1, 2, "B", two), (1, 3, "Z", over), (2, 0, "A", over), (1, 4, "A", one + " short"), (1, 5, "A", None), (1, 6, "A", "")]
    found = sorted((r["doc_id"], r["chunk"], r["part"], r["section"], r["content"], r["split"]) for r in L.bounded_by_sections(spark.createDataFrame(chunks, "doc_id long, chunk int, section string, content string"), spark.createDataFrame(sections, "doc_id long, section string, content string")).collect())
    assert found == [(1, 0, 0, "A", one, True), (1, 0, 1, "B", two[:200].strip(), True), (1, 1, 0, "A", one, False), (1, 2, 0, "B", two, False), (1, 3, 0, "Z", over, False), (1, 4, 0, "A", one + " short", False), (2, 0, 0, "A", over, False)]


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 99])
def test_held_prefix(spark, n):
    own = "".join(chr(97 + k % 26) for k in range(n))
    row = spark.createDataFrame([(own + "#rest" * 20, "xx" + own + "yy")], "c string, s string").select(L.held_prefix(F.col("c"), F.col("s")).alias("n")).collect()
    assert row[0]["n"] == n


def test_missing_includes(spark):
    from sextant.sources.readers import missing_includes

    main = r"\input{intro} \include{parts/method.tex} \input{figures/plot} % \input{commented}" + "\n" + r"\input{data\_set} \input{macros-a} \input{\jobname}"
    files = spark.createDataFrame([(1, "main.tex", main), (1, "a/intro.tex", "x"), (2, "main.tex", r"\input{intro}"), (3, "x.tex", None)], "doc_id long, path string, text string")
    assert {(r["doc_id"], r["include"]) for r in missing_includes(files).collect()} == {(1, "parts/method.tex"), (1, "data_set"), (2, "intro")}


def test_exact_pieces_need_no_names_of_runs(monkeypatch):
    said = words(300, 10)
    source, lines = " ".join(said), [said[k : k + 12] for k in range(0, 300, 12)]
    monkeypatch.setattr(L.np, "unique", lambda *a, **k: pytest.fail("runs are named"))
    assert [r[4] for r in L.recovered_sequence([" ".join(x) for x in lines], source)] == [" ".join(x) for x in lines]
    assert {r[0] for r in L.anchored_sequence([(" ".join(x[:4]), " ".join(x[-4:])) for x in lines], source)} == {"recovered"}


def test_documents_are_streamed_in_order(spark):
    """One exchange, no group of its own a document; null positions and pieces come last, null ids are one document, of several texts the smallest counts."""
    pieces = spark.createDataFrame([(1, 1, "c d"), (1, 0, "a b"), (1, None, "e"), (1, 1, None), (None, 0, "x y"), (2, 0, "z"), (4, 0, "q")], "doc_id long, position int, content string")
    sources = spark.createDataFrame([(1, "b a"), (1, "a b c d e"), (1, None), (None, "x y"), (3, "z"), (4, None)], "doc_id long, text string")
    rows = L.recovered(pieces, sources)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CoGroup" not in plan
    found = [(r["doc_id"], r["position"], r["status"], r["text"]) for r in rows.collect()]
    assert [x for x in found if x[0] == 1] == [(1, 0, "recovered", "a b"), (1, 1, "recovered", "c d"), (1, 1, "FAILED", None), (1, None, "recovered", "e")]
    assert sorted((x for x in found if x[0] != 1), key=str) == [(4, 0, "FAILED", None), (None, 0, "recovered", "x y")]
