"""Stemmed full text: an inverted index written once, and a reader that touches its terms' buckets only.

Postings lie in folders by bucket (a hash of the term). A row holds a term's postings in one cell, a hash part of about CELL documents, with the largest
share of a score that one of them can have (block maximum). A term that all documents hold is so many rows, never one. Words are lower-case ASCII letters and digits
without the stop words, stemmed by Porter's algorithm (1980), whose steps are CASE expressions over fixed suffix lists; `stem_sql` gives
the same steps for other SQL engines.

A query names its terms' buckets as constants, so other folders are never listed. All terms must occur. Cells in which one is missing fall away by the
block rows alone; of the others the FIRST most promising are scored, and then only those whose bound reaches the k-th score found so far.

Nulls: a null text has no words and counts as a document of length 0; a null key is indexed like any other. Rows that share a key count as one document with the words of all.
An empty table gives an index without terms; a query of stop words only, or with a term that no document holds, gives no rows.
"""

from __future__ import annotations

import atexit
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.operators.shared import remove, shared_dir

BUCKET_DOCS, MOST_BUCKETS, CELL, FIRST = 20_000, 1024, 4096, 8
LANES, PARTS, SLICE = 64, 8, 1 << 14  # lanes of cells, files of a bucket, rows of a batch that leaves a task
K1, B = 1.2, 0.75

# The English stop words of the Snowball list, and the suffixes of Porter's steps.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
# end of fixed values

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONE = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"  # at least one vowel-consonant pair, anything after it
TWO = ONE + VOWELS + CONSONANTS
JUST_ONE = f"{ONE}(?:{VOWELS})?$"
HAS_VOWEL = "^(?:[^aeiou][^aeiouy]*)?[aeiouy]"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLED = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def _steps(match: str, ending: str) -> list[str]:
    """Expressions over the word w, one after the other. match, ending: the engine's names for a test by a regular expression, and of a word's end."""
    base = lambda n: f"left(w, length(w) - {n})"
    test = lambda value, pattern: f"{match}({value}, '{pattern}')"
    ends = lambda s: f"{ending}(w, '{s}')"

    def table(suffixes: dict[str, str], condition: str) -> str:
        cases = [f"WHEN {ends(s)} THEN CASE WHEN {test(base(len(s)), condition)} THEN concat({base(len(s))}, '{r}') ELSE w END" for s, r in sorted(suffixes.items(), key=lambda x: -len(x[0]))]
        return f"CASE {' '.join(cases)} ELSE w END"

    cut = table({s: "" for s in STEP_4}, TWO)
    ion = " ".join(f"WHEN {ends(s)} THEN CASE WHEN {test(base(3), TWO)} THEN {base(3)} ELSE w END" for s in ("sion", "tion"))
    return [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {base(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {base(1)} ELSE w END",
        # what lost its -ed or -ing is marked by a final dot until the next step
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {test(base(3), ONE)} THEN {base(1)} ELSE w END WHEN {ends('ed')} AND {test(base(2), HAS_VOWEL)} THEN concat({base(2)}, '.') WHEN {ends('ing')} AND {test(base(3), HAS_VOWEL)} THEN concat({base(3)}, '.') ELSE w END",
        f"CASE WHEN NOT {ends('.')} THEN w WHEN {ends('at.')} OR {ends('bl.')} OR {ends('iz.')} OR {test(base(1), SHORT)} THEN concat({base(1)}, 'e') WHEN {test(base(1), DOUBLED)} THEN {base(2)} ELSE {base(1)} END",
        f"CASE WHEN {ends('y')} AND {test(base(1), HAS_VOWEL)} THEN concat({base(1)}, 'i') ELSE w END",
        table(STEP_2, ONE),
        table(STEP_3, ONE),
        cut.replace("CASE ", f"CASE {ion} ", 1),
        f"CASE WHEN {ends('e')} AND ({test(base(1), TWO)} OR ({test(base(1), JUST_ONE)} AND NOT {test(base(1), SHORT)})) THEN {base(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {test('w', TWO)} THEN {base(1)} ELSE w END",
    ]


def with_stem(rows: DataFrame, word: str, into: str) -> DataFrame:
    """rows with the stem of a lower-case word; words of one or two characters stay. The steps are lambdas over an array of one word: as plain columns they make one method too long for the JVM to compile."""
    held = f"array(`{word}`)"
    for step in _steps("regexp_like", "endswith"):
        held = f"transform({held}, w -> {step})"
    return rows.withColumn(into, F.when(F.length(word) > 2, F.expr(held)[0]).otherwise(F.col(word)))


def stem_sql(words: str) -> str:
    """SQL for engines with regexp_matches: (word, stem) of the rows of a query that gives `word`."""
    query = f"SELECT word, word AS w FROM ({words})"
    for step in _steps("regexp_matches", "ends_with"):
        query = f"SELECT word, {step} AS w FROM ({query})"
    return f"SELECT word, CASE WHEN length(word) > 2 THEN w ELSE word END AS stem FROM ({query})"


def _words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    key: str
    docs: int
    mean: float
    buckets: int

    schemas: dict[str, StructType]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def terms_of(self, query: str) -> list[str]:
        """The stems of a query, in order; the words of one query are stemmed by the same plan as the texts."""
        one = self.spark.range(1).select(F.explode(_words(F.lit(query))).alias("word"))
        return sorted({r["t"] for r in with_stem(one, "word", "t").select("t").collect()})

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        buckets = [_bucket(F.lit(t), self.buckets) for t in terms]  # constants, folded before the folders are chosen
        return self.read(name).where(F.col("bucket").isin(*buckets) & F.col("term").isin(terms))

    def weights(self, terms: list[str]) -> dict[str, float]:
        found = self._of("terms", terms).select("term", "df").collect()  # one row for each term of the query
        return {r["term"]: math.log(1 + (self.docs - r["df"] + 0.5) / (r["df"] + 0.5)) for r in found}

    def _scored(self, blocks: DataFrame, weights: dict[str, float]) -> DataFrame:
        idf = F.create_map(*(F.lit(x) for t, w in weights.items() for x in (t, w)))
        posts = blocks.select("term", F.inline("posts"))
        share = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(self.mean)))
        return posts.groupBy(self.key).agg(F.sum(share).alias("bm25"), F.count(F.lit(1)).alias("held")).where(F.col("held") == len(weights)).drop("held")

    def matches(self, query: str) -> DataFrame:
        """(key, bm25) of all documents that hold all terms."""
        terms = self.terms_of(query)
        weights = self.weights(terms) if terms else {}
        if not terms or len(weights) < len(terms):
            return self._scored(self.read("postings").limit(0), {"": 0.0})
        return self._scored(self._of("postings", terms), weights)

    def top(self, query: str, k: int) -> DataFrame:
        """The k best of matches(), ties by key."""
        terms = self.terms_of(query)
        weights = self.weights(terms) if terms else {}
        best = lambda rows: rows.orderBy(F.desc("bm25"), self.key).limit(k)
        if not terms or len(weights) < len(terms):
            return self.matches(query)
        blocks = self._of("postings", terms)
        cells = self.bounds(blocks, weights)
        first = [r["cell"] for r in cells.orderBy(F.desc("bound"), "cell").limit(FIRST).collect()]
        found = best(self._scored(blocks.where(F.col("cell").isin(first)), weights))
        edge = found.agg(F.count(F.lit(1)).alias("n"), F.min("bm25").alias("least")).collect()[0]  # one row
        rest = cells.where(~F.col("cell").isin(first))
        if edge["n"] == k:
            rest = rest.where(F.col("bound") >= F.lit(edge["least"] * (1 - 1e-9)))
        others = self._scored(blocks.join(rest.select("cell"), "cell", "left_semi"), weights)
        return best(found.unionByName(others))

    def bounds(self, blocks: DataFrame, weights: dict[str, float]) -> DataFrame:
        """(cell, bound) of the cells that hold all terms: no document of the cell scores more. Reads the block rows, not the postings."""
        idf = F.create_map(*(F.lit(x) for t, w in weights.items() for x in (t, w)))
        return blocks.groupBy("cell").agg(F.sum(idf[F.col("term")] * F.col("most")).alias("bound"), F.count(F.lit(1)).alias("held")).where(F.col("held") == len(weights)).drop("held")


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _starts(*columns) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _lists(starts, n: int, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, n].astype(np.int32)), values)


def _posted(key: str):
    """Rows (key, cell, n, words) -> (word, blocks): a batch's documents that hold a word, by lane. Words are counted within their row."""

    def post(batches):
        for batch in batches:
            names = batch.column("words").flatten().dictionary_encode()
            if not len(names):
                continue
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("words")).to_numpy())
            held, tf = np.unique(names.indices.to_numpy().astype(np.int64) * len(batch) + row, return_counts=True)  # by word, then row
            word, row = np.divmod(held, len(batch))
            lane = batch.column("cell").to_numpy()[row] % LANES
            order = np.lexsort((lane, word))
            word, lane, row, tf = word[order], lane[order], row[order], tf[order]
            at = pa.array(row)
            posts = pa.StructArray.from_arrays([batch.column(key).take(at), batch.column("cell").take(at), pa.array(tf.astype(np.int32)), batch.column("n").take(at)], names=[key, "cell", "tf", "n"])
            one = _starts(word, lane)
            blocks = pa.StructArray.from_arrays([pa.array(lane[one].astype(np.int32)), _lists(one, len(row), posts)], names=["lane", "posts"])
            own = _starts(word[one])
            out = pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(word[one][own])), _lists(own, len(one), blocks)], names=["word", "blocks"])
            yield from (out.slice(k, SLICE) for k in range(0, len(out), SLICE))

    return post


def _merged(key: str, mean: float):
    """Rows (bucket, term, lane, posts), equal terms and lanes together -> the rows of an index: a document's words of one stem are added up, and posts go by cell."""

    def blocks(rows):
        names = rows.column("term").dictionary_encode()
        posts = rows.column("posts").flatten().flatten()
        term = np.repeat(names.indices.to_numpy(), pc.list_value_length(rows.column("posts")).to_numpy())
        keys, cell, tf, n = posts[0], *(p.to_numpy() for p in posts[1:])
        name = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
        order = np.lexsort((name, cell, term))
        term, cell, name = term[order], cell[order], name[order]
        one = _starts(term, cell, name)
        tf, n = np.add.reduceat(tf[order], one).astype(np.int32), np.maximum.reduceat(n[order], one)
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
        term, cell = term[one], cell[one]
        own = _starts(term, cell)
        held = pa.StructArray.from_arrays([keys.take(pa.array(order[one])), pa.array(tf), pa.array(n)], names=[key, "tf", "n"])
        first = pa.array(_starts(names.indices.to_numpy())[term[own]])
        columns = [names.dictionary.take(pa.array(term[own])), pa.array(cell[own]), pa.array(np.maximum.reduceat(share, own)), pa.array(np.diff(np.r_[own, len(one)])), _lists(own, len(one), held), rows.column("bucket").take(first)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "cell", "most", "df", "posts", "bucket"])

    def merge(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            last = pc.and_(pc.equal(rows.column("term"), rows.column("term")[-1]), pc.equal(rows.column("lane"), rows.column("lane")[-1]))
            cut = len(rows) - pc.sum(last).as_py()
            kept = rows.slice(cut)
            if cut:
                yield blocks(rows.slice(0, cut))
        if kept is not None:
            yield blocks(kept)

    return merge


def write_index(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> TextIndex:
    """Words are counted within their row and stemmed once a batch of rows; a word's postings leave the batch as one row a lane (a few cells), are exchanged once, by bucket and part (a few lanes), and
    merged lane by lane in the order of terms. Tasks grow with the documents; cells hold CELL documents on average, whatever the term."""
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/sextant/{uuid.uuid4().hex}"
    rows = documents.select(F.col(key), _words(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    sizes = rows.groupBy(key).agg(F.sum(F.size("words")).cast("long").alias("n"), F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), F.max("rows").alias("rows")).collect()[0]  # one row
    docs, mean = total["docs"], float(total["mean"] or 0) or 1.0
    cells, buckets = max(1, math.ceil(docs / CELL)), min(MOST_BUCKETS, max(4, math.ceil(docs / BUCKET_DOCS)))
    sized = rows.withColumn("n", F.size("words").cast("long"))
    if (total["rows"] or 0) > 1:  # a document of several rows: its length is known only from all of them
        sized = rows.alias("p").join(sizes.alias("s"), F.col(f"p.{key}").eqNullSafe(F.col(f"s.{key}"))).select("p.*", "n")
    own = f"`{key}`: {documents.schema[key].dataType.simpleString()}"
    sized = sized.select(key, F.pmod(F.xxhash64(key), F.lit(cells)).cast("int").alias("cell"), "n", "words")
    held = sized.mapInArrow(_posted(key), f"word string, blocks array<struct<lane: int, posts: array<struct<{own}, cell: int, tf: int, n: bigint>>>>")
    stemmed = with_stem(held, "word", "term").withColumn("bucket", _bucket(F.col("term"), buckets)).select("bucket", "term", F.inline("blocks"))
    # a bucket's rows are dealt by cell too: a folder has several files, sorted by term, whose statistics prune further
    dealt = stemmed.repartition(buckets * PARTS, "bucket", F.expr(f"lane % {PARTS}")).sortWithinPartitions("term", "lane")
    blocks = dealt.mapInArrow(_merged(key, mean), f"term string, cell int, most double, df bigint, posts array<struct<{own}, tf: int, n: bigint>>, bucket int")
    blocks.sortWithinPartitions("bucket", "term", "cell").write.partitionBy("bucket").parquet(f"{path}/postings")
    terms = spark.read.schema(blocks.schema).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    return TextIndex(spark, path, key, docs, mean, buckets, {"postings": blocks.schema, "terms": terms.schema})


_kept: dict[tuple, TextIndex] = {}


@atexit.register
def forget() -> None:
    """Delete the session's indexes."""
    while _kept:
        index = _kept.popitem()[1]
        remove(index.spark, index.path)


def index_of(documents: DataFrame, key: str = "doc_id", text: str = "text") -> TextIndex:
    """The session's index of a table read from files: written at the first call, and again once the table's files, their sizes or times are others."""
    spark = documents.sparkSession
    files = documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*files.columns)).alias("mark")).collect()[0]  # one row
    name = (spark.sparkContext.applicationId, shared_dir(spark), key, text, mark["n"], mark["mark"])
    if name not in _kept:
        _kept[name] = write_index(documents, key, text)
    return _kept[name]
