"""Canonical exact digests with DataFrame functions only.

A text's canonical form is NFC-normalised (ICU, in the JVM), lower-cased, with each run of blanks as one space and none
at the ends. Its fingerprint is 128 bits of xxhash over that form. Hashes are counted first; only forms in buckets of several
documents travel on, and are compared byte by byte as a set (merged in each task before the exchange, so copies never meet
as rows). Where a bucket holds different forms the fingerprint gets the form's SHA-256 as well. Texts are exchanged once, by
doc_id, for both the edited text and the comparison.

Null text counts as empty, a null doc_id as the smallest (so does the smallest long, which comes back as null). The next document is the one with the next smaller
doc_id, after the last the first; of several rows with that doc_id the one with the smallest hash of its form, for both the edited text and the likeness. A doc_id, or null, that
many rows share is dealt over tasks by text. A single document is its own next. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.shared import join_counted, materialize

LOWEST = -(2**63)


def canonical(text: Column) -> Column:
    nfc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.trim(F.regexp_replace(F.lower(nfc), r"\p{IsWhite_Space}+", " "))


def wide_hash(form: Column) -> Column:
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(form)), part(F.xxhash64(F.lit(1), form)))


def following(keys: DataFrame) -> DataFrame:
    """keys(key, n), distinct -> (key, n, next): the next smaller key, for the smallest the largest. No window holds all rows: each
    range of keys is sorted by itself, and only the ranges' largest keys are compared as a whole."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keys.repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()))
    tops = ranged.groupBy("range").agg(F.max("key").alias("top"))  # one row per partition
    order = Window.orderBy("range")
    tops = tops.select("range", F.coalesce(F.lag("top").over(order), F.max("top").over(Window.partitionBy())).alias("before"))
    inside = ranged.withColumn("below", F.lag("key").over(Window.partitionBy("range").orderBy("key")))
    return inside.join(F.broadcast(tops), "range").select("key", "n", F.coalesce("below", "before").alias("next"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document row.

    Likeness of exact digests is 1 where the canonical forms are equal and 0 elsewhere.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    base = documents.select(key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    forms = base.select("key", F.char_length("text").alias("n"), canonical(F.col("text")).alias("form"))
    known = materialize(forms.select("key", "n", wide_hash(F.col("form")).alias("h"), F.sha2("form", 256).alias("s")))
    several = materialize(known.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("several", F.lit(True)))
    marks = materialize(known.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c"), F.min(F.struct("h", "s")).alias("of")))
    chain = materialize(following(marks.select("key", "n")))
    asked = chain.select(F.col("next").alias("key"), F.col("key").alias("asker"), F.floor(F.col("n") / 3).cast("int").alias("share")).join(marks.select("key", "c", "of"), "key")
    # of several rows of the next doc_id the one with the smallest hash; one row has no need of it
    form = canonical(F.col("text"))
    order = F.when(F.col("c") > 1, F.struct(wide_hash(form).alias("h"), F.sha2(form, 256).alias("s")))
    given = join_counted(base, asked, "key", "c", "text", marks).select(F.col("asker").alias("key"), F.struct(order.alias("order"), F.left("text", F.col("share")).alias("head"), "of").alias("given"))
    given = given.groupBy("key").agg(F.min("given").alias("given"))
    flagged = join_counted(known.select("key", "h"), several, "h", "c", "key").select("key", "several").distinct()
    given = given.join(marks.select("key", "c"), "key").join(flagged, "key", "left")
    n, share = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = join_counted(base, given, "key", "c", "text", marks)
    edited = edited.select("key", "text", n.alias("n_chars"), "given", "several", F.concat(F.left("text", n - share), F.left("given.head", share)).alias("edited"))
    forms = edited.select("key", "n_chars", "given", "several", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"))
    digest = lambda c: (wide_hash(F.col(c)), F.sha2(c, 256))
    (h, s), (eh, es) = digest("form"), digest("edited_form")
    prints = forms.select("key", "n_chars", "edited_sha256", h.alias("h"), s.alias("s"), eh.alias("eh"), es.alias("es"), (F.col("form") == F.col("edited_form")).alias("same"), F.col("given.of.h").alias("nh"), F.col("given.of.s").alias("ns"), F.when(F.col("several"), F.col("form")).alias("form"))
    prints = materialize(prints)
    # byte comparison inside equal buckets
    clashes = materialize(prints.where("form is not null").groupBy("h").agg(F.collect_set("form").alias("forms")).where(F.size("forms") > 1).select("h"))
    prints = prints.drop("form")
    full = lambda hash_, sha: F.col(hash_)
    if not clashes.isEmpty():
        prints = prints.join(clashes.select("h", F.lit(True).alias("clash")), "h", "left").join(clashes.select(F.col("h").alias("eh"), F.lit(True).alias("eclash")), "eh", "left")
        full = lambda hash_, sha: F.when(F.col("clash" if hash_ == "h" else "eclash"), F.concat(hash_, F.lit("-"), sha)).otherwise(F.col(hash_))
    flag = lambda c: c.cast("double")
    return prints.select(
        F.when(F.col("key") != LOWEST, F.col("key")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        full("h", "s").alias("fingerprint"), full("eh", "es").alias("edited_fingerprint"),
        flag(F.col("same")).alias("near_edited"), flag((F.col("h") == F.col("nh")) & (F.col("s") == F.col("ns"))).alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
