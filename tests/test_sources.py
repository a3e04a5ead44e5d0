"""Readers and sinks on small files."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from sextant.sources import readers as R
from sextant.sources import sinks


def pages(day):
    return [(f"{day}-{n}", day, "x") for n in range(3)]


def test_atom(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n  title</title><summary> s </summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author>'
        '<category term="cs.CL"/><link href="u" title="pdf"/></entry><entry><id>http://arxiv.org/abs/2401.00002</id><title>t</title><author><name>D</name></author></entry></feed>'
    )
    rows = {r["arxiv_id"]: r for r in R.atom_feed(spark, str(tmp_path / "f.xml")).collect()}
    assert rows["2401.00001"]["title"] == "A title" and rows["2401.00001"]["authors"] == ["A B", "C"] and rows["2401.00001"]["pdf"] == "u" and str(rows["2401.00001"]["day"]) == "2024-01-02"
    assert rows["2401.00002"]["pdf"] is None


def test_markdown(spark):
    df = spark.createDataFrame([("p", "intro\n# One\nabc\n## 1.2.3 Deep\nx\n##### no heading"), ("q", "")], "path string, text string")
    rows = [(r["path"], r["level"], r["heading"], r["content"]) for r in R.markdown_sections(df).orderBy("path", "position").collect()]
    assert rows == [("p", 0, "", "intro"), ("p", 1, "One", "abc"), ("p", 3, "1.2.3 Deep", "x\n##### no heading")]


def test_latex(spark):
    files = [(1, "a/main.tex", "\\documentclass{x}\n\\begin{document}\n\\section{A} one % c\n\\input{parts/b}\n\\end{document}"), (1, "a/parts/b.tex", "\\subsection{B} two \\include{c}"), (1, "a/c.tex", "\\textbf{three}"), (1, "a/z.bib", "no")]
    df = spark.createDataFrame(files, "doc_id int, path string, text string")
    rows = [(r["level"], r["heading"], r["content"]) for r in R.latex_sections(R.latex_resolved(df)).orderBy("position").collect()]
    assert rows == [(1, "A", "one"), (2, "B", "two three")]


def test_tei(spark):
    x = '<TEI xmlns="u"><teiHeader><titleStmt><title>T</title></titleStmt><abstract><p>ab</p></abstract></teiHeader><text><body><div><head>H</head><p>p1</p></div></body><listBibl><idno type="DOI">10.1/x</idno></listBibl></text></TEI>'
    r = R.tei_documents(spark.createDataFrame([("a", x)], "path string, text string")).collect()[0]
    assert (r["title"], r["abstract"], r["headings"], r["paragraphs"], r["dois"]) == ("T", "ab", ["H"], ["p1"], ["10.1/x"])


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.tex", "hello")
        f.writestr("../evil", "x")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("b.tex")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    df = spark.createDataFrame([("z", bytearray(z.getvalue())), ("t", bytearray(t.getvalue())), ("bad", bytearray(b"??"))], "path string, content binary")
    rows = {(r["path"], r["member"]): (r["text"], r["problem"]) for r in R.archive_members(df).collect()}
    assert rows["z", "a.tex"] == ("hello", None) and rows["z", "../evil"] == (None, "unsafe name") and rows["t", "b.tex"] == ("hi", None) and rows["bad", None][1].startswith("unreadable")
    assert {r["path"]: r["k"] for r in df.select("path", R.file_kind(F.col("content")).alias("k")).collect()} == {"z": "zip", "t": "gzip", "bad": "unknown"}


def test_folder_and_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"arxiv_id":"","paper_url":"https://arxiv.org/abs/2401.12345v1","repo_url":"r"},{"arxiv_id":"1","paper_url":null,"repo_url":null}]')
    links = R.code_links(R.json_archive(spark, str(tmp_path / "a.json"), "arxiv_id string, paper_url string, repo_url string"))
    assert [tuple(r) for r in links.collect()] == [("2401.12345", "r")]
    assert R.whole_texts(spark, str(tmp_path), "*.json").count() == 1


def test_paged_source(spark):
    spark.dataSource.register(R.PagedSource)
    df = spark.read.format("paged").options(pages="tests.test_sources:pages", first="2024-01-01", last="2024-01-04").load()
    assert df.count() == 12 and df.select("day").distinct().count() == 4


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "pending"), (2, "b", "done")], "id int, v string, status string").write.parquet(path)
    sinks.write_upsert(path, spark.createDataFrame([(2, "B", "done"), (3, "c", "pending")], "id int, v string, status string"), ["id"])
    assert {(r["id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert sinks.append_new(path, spark.createDataFrame([(3, "zz", "x"), (4, "a", "x"), (5, "q", "x"), (6, "q", "x")], "id int, v string, status string"), [["id"], ["v"]], "id") == 1
    moved = sinks.transition(spark.read.parquet(path), "status", {"pending": "embedded"})
    assert {r["status"] for r in moved.collect()} == {"embedded", "done", "x"}
    assert sinks.verified_write(moved, str(tmp_path / "u")) == 4
    spare = sinks.logged(moved.withColumn("log", F.lit(None).cast("array<string>")), "log", F.lit("e"))
    assert spare.select("log").distinct().collect()[0][0] == ["e"]
