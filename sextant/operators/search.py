"""Retrieval: chunks, keyword ranking, exact nearest neighbours, hybrid merging, soft filters, diversification, facets, paging."""

from __future__ import annotations

import base64
import datetime
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import vector as V


def chunks(documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, position, content): a document's paragraphs in order."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n+")).alias("position", "content"))
    return rows.select(F.concat_ws("-", "doc_id", "position").alias("chunk_id"), "doc_id", "position", "content")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def keyword_search(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) of rows that hold all the terms of the query.

    Only the query's terms leave the scan: per row one array of counts, no postings of other terms. The corpus statistics are one
    aggregate row; nothing but matching rows is kept.
    """
    terms = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    rows = documents.select(key, tokens(F.col(text)).alias("t"))
    count = lambda term: F.size(F.filter("t", lambda x: x == term))
    counts = [count(term) for term in terms]
    rows = rows.select(key, F.size("t").alias("n"), F.array(*counts).alias("tf"))
    stats = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col("tf")[i] > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))
    hits = rows.where(F.forall("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col("tf")[i]
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hits.select(key, score.alias("bm25"))


def page_normalised(page: DataFrame, score: str, limit: int, key: str) -> DataFrame:
    """The best `limit` rows, their score divided by the page's largest."""
    best = page.orderBy(F.desc(score), key).limit(limit)
    return best.withColumn(score, F.col(score) / F.max(score).over(Window.partitionBy()))  # at most limit rows


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", not_same: str | None = None) -> DataFrame:
    """Exact k nearest neighbours by cosine: (query, key, similarity, rank), ties by key.

    queries(query, vector[, not_same]) are a stated set: they are collected (a few at a time is meant) and shipped to each task, where one
    matrix product per Arrow batch scores them and only the best k a batch leave. The exchange moves k rows a query and batch.
    """
    asked = queries.collect()
    if not asked:
        return vectors.sparkSession.createDataFrame([], f"query long, {key} long, similarity double, rank int")
    names = [r["query"] for r in asked]
    matrix = np.array([r["vector"] for r in asked], np.float64)
    sizes = np.linalg.norm(matrix, axis=1)
    theirs = [r[not_same] for r in asked] if not_same else None

    def score(batches):
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            if not len(ids) or not names:
                continue
            x = np.asarray(values.flatten(), np.float64).reshape(len(values), -1)
            found = matrix @ x.T
            size = np.outer(sizes, np.linalg.norm(x, axis=1))
            found = np.where(size > 0, found / np.where(size > 0, size, 1), -np.inf)
            own = np.array(ids.to_pylist())
            other = np.array(batch.column(2).to_pylist(), object) if theirs else None
            out = ([], [], [])
            for q in range(len(names)):
                row = found[q].copy()
                if theirs:
                    row[other == theirs[q]] = -np.inf
                edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                some = np.flatnonzero(row >= edge)  # the best k, and what ties with the last
                best = some[np.lexsort((own[some], -row[some]))][:k]
                best = best[np.isfinite(row[best])]
                out[0].extend([names[q]] * len(best))
                out[1].extend(own[best].tolist())
                out[2].extend(row[best].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query", key, "similarity"])

    columns = [F.col(key).cast("long").alias(key), column] + ([not_same] if not_same else [])
    found = vectors.select(*columns).where(F.col(column).isNotNull()).mapInArrow(score, f"query long, {key} long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def merged(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """Full outer merge of (key, similarity) and (key, bm25); a missing score is 0."""
    both = vector_hits.select(key, "similarity").join(keyword_hits.select(key, "bm25"), key, "full_outer")
    both = both.select(key, F.coalesce("similarity", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25", F.lit(0.0)).alias("keyword_score"))
    return both.withColumn("score", V.hybrid(F.col("vector_score"), F.col("keyword_score"), share))


def soft_tier(value: Column, wanted: list[str]) -> Column:
    """2 matched, 1 unknown, 0 mismatch."""
    return F.when(value.isNull() | (F.trim(value) == ""), 1).when(F.lower(value).isin([w.lower() for w in wanted]), 2).otherwise(0)


def soft_filtered(rows: DataFrame, **wanted: tuple[Column, list[str]]) -> DataFrame:
    """Mismatches go; `tier` is 2 where all filters match and 1 where one is unknown."""
    tier = F.least(*(soft_tier(c, w) for c, w in wanted.values()), F.lit(2))
    return rows.withColumn("tier", tier).where("tier > 0")


def diversified(rows: DataFrame, key: str, most: int, order: list[Column]) -> DataFrame:
    """The first `most` of each key in order; rows without a key all stay."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where((F.col("place") <= most) | F.col(key).isNull()).drop("place")


def facets(rows: DataFrame, kind: str, entities: str, rank: str, top: int = 10) -> DataFrame:
    """(facet, value, n): all values of `kind`, and the `top` most frequent entities, the first seen first among equals."""
    kinds = rows.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    seen = rows.select(F.explode(entities).alias("value"), rank).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    best = seen.orderBy(F.desc("n"), "first", "value").limit(top)
    return kinds.select(F.lit("kind").alias("facet"), "value", "n").unionAll(best.select(F.lit("entity").alias("facet"), "value", "n"))


def searched(
    near: DataFrame, words: DataFrame, documents: DataFrame, key: str, limit: int, soft: dict[str, list[str]] | None = None, hard: Column | None = None, rerank: Callable[[Column], Column] | None = None,
    content: str = "text", reranked: int = 15, diversify: str | None = None, most: int = 3, share: float = 0.6,
) -> tuple[DataFrame, DataFrame]:
    """(page, pool) of a search as a whole. near(key, similarity) and words(key, bm25) are the pools of both kinds, as wide as `maintenance.pool_size` says.

    They are merged, and soft filters over columns of documents (what matches first, what is unknown after it, mismatches gone) come before the rerank, which scores the best `reranked` by `rerank` of their
    content and leaves out the rest. hard, a condition over documents, comes after it, then at most `most` rows of each `diversify`, and the first `limit`. pool is what was there before diversifying: pages
    after the first are made of it. Only rows of the pool meet their documents: the pool is as wide as its page asks, so it goes to the tasks that read documents, and no text is exchanged.
    """
    columns = [key, *dict.fromkeys([*(soft or {}), content, *([diversify] if diversify else [])])]
    rows = merged(near, words, key, share).withColumn("score", F.round("score", 6))
    met = documents.where(hard) if hard is not None and not rerank else documents
    rows = met.select(*columns).join(F.broadcast(rows), key)  # the pool's rows
    rows = soft_filtered(rows, **{c: (F.col(c), w) for c, w in soft.items()}) if soft else rows.withColumn("tier", F.lit(2))
    order = [F.desc("tier"), F.desc("score"), F.asc(key)]
    if rerank:
        best = rows.orderBy(*order).limit(reranked)
        rows = best.withColumns({"score": rerank(F.col(content)), "tier": F.lit(2)})
        if hard is not None:
            rows = rows.join(documents.where(hard).select(key), key, "left_semi")
    pool = rows.select(key, "score", "tier", "vector_score", "keyword_score", *([diversify] if diversify else []))
    few = diversified(pool, diversify, most, order) if diversify else pool
    place = F.row_number().over(Window.partitionBy().orderBy(*order))  # limit rows
    return few.orderBy(*order).limit(limit).withColumn("place", place), pool


def mentioning(chunks: DataFrame, documents: DataFrame, key: str, test: Column, newest: str, limit: int) -> DataFrame:
    """(key, chunks): the documents with the most chunks that pass the test, of equals the newest first, then by key."""
    found = chunks.where(test).groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))
    return found.join(documents.select(key, newest), key).orderBy(F.desc("chunks"), F.desc(newest), key).limit(limit).select(key, "chunks")


def names_entity(entities: str, entity: str) -> Column:
    """One of a chunk's entities is this one, whatever the case; a chunk without entities names none."""
    return F.coalesce(F.exists(entities, lambda e: F.lower(e) == entity.lower()), F.lit(False))


def holds_concept(concept_column: str, concept: str) -> Column:
    return F.coalesce(F.contains(F.lower(concept_column), F.lit(concept.lower())), F.lit(False))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def after_cursor(rows: DataFrame, columns: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """Keyset page, newest first: rows before the cursor, and one more than the limit, which tells whether a page follows."""
    if cursor is not None:
        where, equal = F.lit(False), F.lit(True)
        for c, v in zip(columns, cursor, strict=True):
            where, equal = where | (equal & (F.col(c) < F.lit(v))), equal & (F.col(c) == F.lit(v))
        rows = rows.where(where)
    return rows.orderBy(*(F.desc(c) for c in columns)).limit(limit + 1)


def cursor_column(when: Column, key: Column) -> Column:
    """An opaque cursor of a row: time and key, base64url without padding, made in the plan."""
    plain = F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("|"), key.cast("string"))
    return F.regexp_replace(F.translate(F.base64(F.encode(plain, "utf-8")), "+/", "-_"), "[=\\s]", "")


def opened_cursor(text: str | None, key_pattern: str = r"\S+") -> tuple[str, str] | None:
    """(time, key) of a cursor; None, which means a start from the beginning, where it is none."""
    try:
        plain = base64.b64decode((text or "").translate(str.maketrans("-_", "+/")) + "=" * (-len(text or "") % 4), validate=True).decode()
        when, bar, key = plain.rpartition("|")
        datetime.datetime.fromisoformat(when.replace("Z", "+00:00"))
    except ValueError:
        return None
    return (when, key) if bar and re.fullmatch(key_pattern, key) else None


def cursor_page(rows: DataFrame, when: str, key: str, cursor: str | None, limit: int, key_pattern: str = r"\S+") -> DataFrame:
    """The newest `limit` rows before an opaque cursor, with `cursor` of each row, and `more`: whether rows follow the page. Times count to the millisecond, as the cursor holds them; rows
    without time or key are on no page. A cursor that can't be read starts from the beginning."""
    told = opened_cursor(cursor, key_pattern)
    kept = rows.where(F.col(when).isNotNull() & F.col(key).isNotNull()).withColumn("_at", F.date_trunc("millisecond", F.col(when).cast("timestamp")))
    if told:
        at, last = F.lit(told[0]).cast("timestamp"), F.lit(told[1]).cast(rows.schema[key].dataType)
        kept = kept.where((F.col("_at") < at) | ((F.col("_at") == at) & (F.col(key) < last)))
    best = kept.orderBy(F.desc("_at"), F.desc(key)).limit(limit + 1)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("_at"), F.desc(key)))  # limit + 1 rows
    best = best.withColumns({"_place": place, "more": F.count(F.lit(1)).over(Window.partitionBy()) > limit, "cursor": cursor_column(F.col("_at"), F.col(key))})
    return best.where(F.col("_place") <= limit).drop("_place", "_at")


def evidence_groups(claim: DataFrame, support: DataFrame, contradict: DataFrame, key: str, most: int) -> DataFrame:
    """Three pools of (key, similarity), outer-merged, classed, and the best `most` of each relation."""
    tagged = [p.select(key, F.lit(t).alias("pool"), "similarity") for t, p in (("claim", claim), ("support", support), ("contradict", contradict))]
    pools = tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).groupBy(key).agg(*(F.max(F.when(F.col("pool") == t, F.col("similarity"))).alias(t) for t in ("claim", "support", "contradict")))
    found = pools.withColumn("e", V.evidence(F.col("claim"), F.col("support"), F.col("contradict"))).select(key, "e.*")
    place = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc(F.col("confidence") * F.col("score")), key))
    return found.withColumn("place", place).where(F.col("place") <= most)
