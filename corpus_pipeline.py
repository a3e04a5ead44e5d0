"""A training-data pipeline over `documents`: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.bpe_codec import bpe_encode
from sextant.llm.minhash_dedup import linked
from sextant.llm.mixing import IDENTITY, identified, mix_sources
from sextant.llm.shared import materialize, row_keys
from sextant.llm.suffix_dedup import suffix_dedup
from sextant.llm.toxicity import fit_toxicity, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at THRESHOLD or more go. The classifier learns from the labels of its training fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(4, 2))
    model = fit_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return model.keep(docs, THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest doc_id stays, null last; documents without words all stay.
    Rows that share a doc_id are documents of their own where their texts differ; of rows equal in both one stays."""
    rows, names = row_keys(docs, "lang", "source", "n_chars")
    texts = rows.select("key", "text")
    if names is not None:
        texts = materialize(texts.groupBy("key").agg(F.min("text").alias("text")))
    found = linked(texts, 5, 80)
    kept = rows.join(found.where("n > 0 and key <> root").select("key"), "key", "left_anti")
    if names is None:
        return kept.select(*COLUMNS)
    again = names.where("copies > 1").join(found.where("n > 0").select("key"), "key").select("key")
    once = kept.join(again, "key").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(again, "key", "left_anti").select(*COLUMNS).unionByName(once)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier too are cut out; a character cut in two goes as well. Documents with nothing left of their text go.
    Rows that share a doc_id are documents of their own where their texts differ."""
    kept = suffix_dedup(docs, extra=["lang", "source"])
    # what was cut out may leave part of a character at either end
    text = F.regexp_replace(F.try_validate_utf8(F.col("kept").cast("string")), "�", "")
    text = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    kept = kept.where("n_removed < n_bytes or n_bytes = 0").withColumn("text", F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(text))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once or twice); the one document of a source of which the mix takes a part
    comes with that many of its words. Documents without words stay once. Rows equal in all columns can't be told apart: what the mix takes of them is added up."""
    key, beside = [*IDENTITY, "doc_id", "source"], ("lang", "n_chars")
    taken = mix_sources(docs, beside=beside).where("size > 0")
    plan = taken.groupBy(*key).agg(F.sum(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("copies"), F.sum(F.col("taken") % F.col("size")).alias("rest"), F.count(F.lit(1)).alias("rows"))
    plan = materialize(plan)
    rows = identified(docs, *beside)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = rows.where(worded)
    if not plan.where("rows > 1").isEmpty():
        once = once.dropDuplicates(key)
    mixed = once.alias("d").join(plan.where("copies > 0 or rest > 0").alias("p"), reduce(and_, (F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key))).select("d.*", "copies", "rest")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("rest").cast("int")), " ")
    texts = F.concat(F.array_repeat("text", F.col("copies")), F.when(F.col("rest") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    mixed = mixed.withColumn("text", F.explode(texts)).withColumn("n_chars", F.char_length("text").cast("long"))
    return mixed.select(*COLUMNS).unionByName(rows.where(~worded).select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that came through."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("passages", passages), ("mixing", mixing), ("tokens", tokens)]
#: None: no stage but the first two could be put into SQL; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
