"""Readers of feeds, archives and document formats. Each takes a path or a DataFrame of files and returns rows."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sextant.functions import text as T


def whole_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of each file of a folder."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def json_archive(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """JSON arrays or JSON lines, by a given schema: no pass over the data to infer one."""
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)


def code_links(archive: DataFrame) -> DataFrame:
    """archive(arxiv_id, paper_url, repo_url) -> by preprint id, taken from the field or from the URL."""
    found = F.regexp_extract("paper_url", r"(\d{4}\.\d{4,5})", 1)
    return archive.select(F.coalesce(F.nullif("arxiv_id", F.lit("")), F.nullif(found, F.lit(""))).alias("arxiv_id"), "repo_url").where("arxiv_id is not null and repo_url is not null").distinct()


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


ATOM = "id string, title string, summary string, published string, author array<struct<name string>>, category array<struct<_term string>>, link array<struct<_href string, _title string>>"


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: id, title, abstract, authors, categories, day, PDF link."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    pdf = F.filter("link", lambda x: x["_title"] == "pdf")
    return e.select(
        F.regexp_extract("id", r"abs/(.+?)(?:v\d+)?$", 1).alias("arxiv_id"), collapsed(F.col("title")).alias("title"), collapsed(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"), F.try_to_timestamp("published").cast("date").alias("day"), F.get(F.transform(pdf, lambda x: x["_href"]), F.lit(0)).alias("pdf"),
    )


def markdown_sections(files: DataFrame, key: str = "path") -> DataFrame:
    """files(key, text) -> (key, position, level, heading, content): headings of up to four levels; a numbered heading's depth is that of its number."""
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=#{1,4} )")
    rows = files.select(key, F.posexplode(parts).alias("position", "part"))
    marks, head = F.regexp_extract("part", r"^(#{1,4}) ", 1), F.trim(F.regexp_extract("part", r"^#{1,4} ([^\n]*)", 1))
    number = F.regexp_extract(head, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    level = F.when(number != "", F.size(F.split(number, r"\."))).otherwise(F.length(marks))
    content = F.when(marks == "", F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return rows.select(key, "position", F.when(marks == "", 0).otherwise(level).cast("int").alias("level"), head.alias("heading"), F.regexp_replace(content, r"^\s+|\s+$", "").alias("content")).where("level > 0 or content <> ''")


def latex_root(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """files(key, path, text) -> the main file of each document: it has a document class, begins a document, bears a usual name, is long."""
    score = 100 * F.col("text").contains("\\documentclass").cast("int") + 50 * F.col("text").contains("\\begin{document}").cast("int") + 10 * F.lower("path").rlike(r"(^|/)(main|paper|ms|article)\.tex$").cast("int")
    best = files.where(F.lower("path").endswith(".tex")).groupBy(key).agg(F.max(F.struct(score.alias("score"), F.length("text").alias("n"), (F.col("path")).alias("path"), "text")).alias("x"))
    return best.where("x.score >= 50").select(key, "x.path", "x.text")


def latex_resolved(files: DataFrame, key: str = "doc_id", depth: int = 5) -> DataFrame:
    """The main file with its includes put in, up to `depth` levels: per level the includes are joined by name, and each stands in its place."""
    bare = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.tex$", "")
    parts = files.select(key, bare.alias("name"), F.col("text").alias("body")).dropDuplicates([key, "name"])
    rows = latex_root(files, key).select(key, F.regexp_replace("text", r"(?<!\\)%[^\n]*", "").alias("text"))
    pattern = r"\\(?:input|include)\s*\{([^}]*)\}"
    for _ in range(depth):
        pieces = F.split("text", r"\\(?:input|include)\s*\{[^}]*\}")
        names = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.regexp_replace(F.regexp_replace(F.trim(n), r"^.*/", ""), r"\.tex$", ""))
        spread = rows.select(key, F.posexplode(F.arrays_zip(pieces.alias("piece"), names.alias("name"))).alias("i", "z")).select(key, "i", "z.piece", "z.name")
        filled = spread.join(parts, [key, "name"], "left").select(key, F.struct("i", F.concat(F.coalesce("piece", F.lit("")), F.coalesce(F.regexp_replace("body", r"(?<!\\)%[^\n]*", ""), F.lit(""))).alias("t")).alias("x"))
        rows = filled.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("text"))
    return rows


def missing_includes(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, include): files that a source includes, may hold body text and are not among its files. Escaped signs in names are read as the signs."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.tex$", "")
    found = F.regexp_extract_all(F.regexp_replace("text", r"(?<!\\)%[^\n]*", ""), F.lit(r"\\(?:input|include)\s*\{([^}]*)\}"), F.lit(1))
    asked = files.select(key, F.explode(found).alias("include")).select(key, F.regexp_replace(F.trim("include"), r"\\([_#&])", "$1").alias("include"))
    asked = asked.where(T.body_include(F.col("include"))).distinct().withColumn("name", bare(F.col("include")))
    return asked.join(files.select(key, bare(F.col("path")).alias("name")).distinct(), [key, "name"], "left_anti").select(key, "include")


def latex_sections(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, position, level, heading, content) of the body; 'Content' where it has no sections; the bibliography goes."""
    body = T.latex_body(F.col("text"))
    marked = texts.select(key, F.regexp_replace(body, r"(?s)\\begin\{thebibliography\}.*", "").alias("text"))
    rows = marked.select(key, F.posexplode(F.split("text", r"(?=\\(?:section|subsection|subsubsection)\*?\{)")).alias("position", "part"))
    mark = r"^\\(section|subsection|subsubsection)\*?\{([^}]*)\}"
    kind, head = F.regexp_extract("part", mark, 1), F.regexp_extract("part", mark, 2)
    level = F.when(kind == "section", 1).when(kind == "subsection", 2).when(kind == "subsubsection", 3).otherwise(0)
    rows = rows.select(key, "position", level.alias("level"), F.when(kind == "", "Content").otherwise(head).alias("heading"), T.without_latex(F.regexp_replace("part", mark, "")).alias("content"))
    return rows.where("content <> '' and not lower(heading) in ('references', 'bibliography')")


def tei_documents(files: DataFrame, key: str = "path") -> DataFrame:
    """TEI texts: title, abstract, headings, paragraphs, DOIs of the references."""
    x = F.regexp_replace("text", r' xmlns(:\w+)?="[^"]*"', "")
    rows = files.select(key, x.alias("x"))
    first = lambda p: F.trim(F.get(F.xpath("x", F.lit(p)), F.lit(0)))
    return rows.select(key, first("//titleStmt/title/text()").alias("title"), first("//abstract//p/text()").alias("abstract"), F.xpath("x", F.lit("//body/div/head/text()")).alias("headings"), F.xpath("x", F.lit("//body//p/text()")).alias("paragraphs"), F.xpath("x", F.lit("//listBibl//idno[@type='DOI']/text()")).alias("dois"))


def file_kind(content: Column) -> Column:
    """By the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("1F8B"), "gzip").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").otherwise("unknown")


def archive_members(files: DataFrame, most_bytes: int = 200 << 20, most_members: int = 2000) -> DataFrame:
    """files(path, content) of tar, tar.gz and zip -> (path, member, size, text, problem). Unsafe names, and archives over the limits, give a row with
    the problem instead of a text. One archive at a time is open."""
    def members(path: str, content: bytes) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
        if content[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, lambda i=i: z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for m in t:
                    if m.isfile() or m.issym() or m.islnk():
                        yield m.name, m.size, lambda m=m: (t.extractfile(m).read() if m.isfile() else b"")

    def read(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = 0
                try:
                    for n, (name, size, body) in enumerate(members(path, content)):
                        total += size
                        if n >= most_members or total > most_bytes:
                            rows.append((path, name, size, None, "over the limit"))
                            break
                        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/"):
                            rows.append((path, name, size, None, "unsafe name"))
                        else:
                            rows.append((path, name, size, body().decode("utf-8", "replace"), None))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
                    rows.append((path, None, None, None, f"unreadable: {type(e).__name__}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "member", "size", "text", "problem"])

    return files.select("path", "content").mapInArrow(read, "path string, member string, size long, text string, problem string")


class PagedSource(DataSource):
    """A paged record service as a batch source: option `pages` names a module:function(day) that yields the records (id, day, body) of a day over all its
    pages; options `first` and `last` span the days, each of which is a partition."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, day string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        import datetime

        day, last = (datetime.date.fromisoformat(self.options[k]) for k in ("first", "last"))
        out = []
        while day <= last:
            out.append(InputPartition(day.isoformat()))
            day += datetime.timedelta(days=1)
        return out

    def read(self, partition):
        import importlib

        module, _, function = self.options["pages"].partition(":")
        for record in getattr(importlib.import_module(module), function)(partition.value):
            yield tuple(record)


def locations(*sources: DataFrame) -> DataFrame:
    """Open-access locations(doc_id, source, url, version) of several services as one; preprint-server URLs go, the first service of a URL wins."""
    rows = None
    for rank, s in enumerate(sources):
        one = s.select("doc_id", "source", "url", "version", F.lit(rank).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    kept = rows.where(~F.lower("url").contains("arxiv.org"))
    return kept.groupBy("doc_id", F.lower("url").alias("u")).agg(F.min(F.struct("rank", "source", "url", "version")).alias("x")).select("doc_id", "x.source", "x.url", "x.version")
