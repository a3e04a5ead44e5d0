"""Search and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import vector as V
from sextant.operators import aggregates as A
from sextant.operators import fulltext
from sextant.operators import neighbours as N
from sextant.operators import relations as R
from sextant.operators import search as S
from sextant.plans.tables import table

WORDS = "the tions eding"  # a stop word, and words whose stems are tion and ed
SCANNED = "the and thnd"


def _vector(s, d, vec_id):
    return table(s, d, "embeddings").where(F.col("vec_id").isin(vec_id)).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _keyword_page(s, d, limit):
    """The best `limit` by the index of documents, scores divided by the page's best."""
    return S.page_normalised(fulltext.index_of(table(s, d, "documents")).top(WORDS, limit), "bm25", limit, "doc_id")


def keyword_search(s, d):
    return _keyword_page(s, d, 30).select("doc_id", F.round("bm25", 6).alias("bm25"))


def keyword_scan(s, d):
    """Unstemmed words without an index: one pass over the texts."""
    hits = S.keyword_search(table(s, d, "documents"), SCANNED)
    return S.page_normalised(hits, "bm25", 30, "doc_id").select("doc_id", F.round("bm25", 6).alias("bm25"))


def semantic_search(s, d):
    return S.nearest(table(s, d, "embeddings"), _vector(s, d, [7]), 20).select("vec_id", F.round("similarity", 4).alias("similarity"))


def hybrid_search(s, d):
    """Keyword and vector pools merged, languages softly filtered, at most two of a source, best ten."""
    docs = table(s, d, "documents")
    words = _keyword_page(s, d, 50)
    near = S.nearest(table(s, d, "embeddings"), _vector(s, d, [7]), 50).select(F.col("vec_id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))
    pool = docs.select("doc_id", "lang", "source").join(F.broadcast(S.merged(near, words.withColumn("bm25", F.round("bm25", 6)), "doc_id")), "doc_id")  # 100 rows at most
    pool = S.soft_filtered(pool, lang=(F.col("lang"), ["en", "fr"])).withColumn("score", F.round("score", 4))
    order = [F.desc("score"), F.asc("doc_id")]
    return S.diversified(pool, "source", 2, order).orderBy(*order).limit(10).select("doc_id", "source", "score")


def search_facets(s, d):
    pool = table(s, d, "documents").select("doc_id", "lang", "source").join(F.broadcast(_keyword_page(s, d, 50)), "doc_id")  # 50 rows
    return S.facets(pool.withColumn("entities", F.array("source")), "lang", "entities", "doc_id", 5)


def paginate(s, d):
    pool = _keyword_page(s, d, 50).withColumn("bm25", F.round("bm25", 6))
    return S.page(pool, [F.desc("bm25"), F.asc("doc_id")], 10, 10)


def find_related(s, d):
    e = table(s, d, "embeddings")
    return S.nearest(e, _vector(s, d, [3]), 11).where("vec_id <> query").join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.max(F.round("similarity", 4)).alias("best"), F.count(F.lit(1)).alias("n"))


def knn_join(s, d):
    """Stated queries against all rows, those of the query's own label aside."""
    e = table(s, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "label")
    return N.nearest_of_all(e, queries, 5, not_same="label").select("query", "vec_id", F.round("similarity", 4).alias("similarity"), "rank")


def evidence_groups(s, d):
    e = table(s, d, "embeddings")
    pools = [S.nearest(e, _vector(s, d, [q]), 20).select("vec_id", F.round("similarity", 4).alias("similarity")) for q in (1, 2, 3)]
    return S.evidence_groups(*pools, "vec_id", 5).select("vec_id", "relation", F.round("confidence", 4).alias("confidence"), "score")


def topic_clusters(s, d):
    e = table(s, d, "embeddings")
    near = S.nearest(e, _vector(s, d, [11]), 100).join(e.select("vec_id", "label"), "vec_id")
    groups = near.groupBy("label").agg(F.max(F.round("similarity", 4)).alias("top"), F.count(F.lit(1)).alias("members"))
    return groups.withColumn("score", F.round(V.cluster_score(F.col("top"), F.col("members")), 4)).orderBy(F.desc("score"), "label").limit(8)


def methodology_funnel(s, d):
    pool = S.soft_filtered(table(s, d, "documents").select("doc_id", "lang", "source"), lang=(F.col("lang"), ["en"]), source=(F.col("source"), ["src1", "src2", "src3"]))
    return pool.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.countDistinct("source").alias("sources"))


def benchmark_leaderboard(s, d):
    ev = table(s, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("score"), "ts")
    rows = ev.where(F.col("event_type").rlike("(?i)^(click|view)$") & ~F.col("event_type").rlike("(?i)view"))
    return rows.orderBy(F.desc_nulls_last("score"), F.desc("ts"), "event_id").limit(20).select("event_id", "event_type", "score")


def best_scores_by_year(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return A.best_per_year(rows, F.year("o_orderdate"), "o_totalprice", "o_orderkey", "o_orderkey")


def code_assets(s, d):
    links = F.transform(F.filter(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda x: F.length(x) > 3), F.lower)
    return table(s, d, "pages").select("page_id", F.size(links).alias("n"), F.array_join(F.slice(F.array_sort(F.array_distinct(links)), 1, 3), " ").alias("top"))


def chunk_listing(s, d):
    rows = S.chunks(table(s, d, "documents").where("doc_id = 5"))
    hit = F.col("content").contains("the")
    return rows.orderBy(hit.desc(), "position").select("position", F.length("content").alias("n"), hit.alias("hit"))


def compare_papers(s, d):
    words = table(s, d, "documents").where("doc_id in (1, 2, 6)").select("doc_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("word"))
    return R.set_compare(words, "doc_id", "word", [1, 2, 6]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def novelty(s, d):
    """Samples of a label's vectors against the other labels' vectors; those with an even id count as cited."""
    e = table(s, d, "embeddings")
    asked = R.stride_sample(e.select("vec_id", "label", "embedding"), "label", "vec_id", 100)
    queries = asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "label")
    near = N.nearest_of_all(e, queries, 5, not_same="label").join(asked.select(F.col("vec_id").alias("query"), F.col("label").alias("doc")), "query")
    rows = near.select("doc", F.col("query").alias("sample"), F.col("vec_id").alias("other"), F.round("similarity", 4).alias("similarity"), (F.col("vec_id") % 2 == 0).alias("cited"))
    return A.novelty(rows, "cited")


def source_overlap(s, d):
    """Benchmark items that stand in a document as they are, over line ends too."""
    return N.contained(table(s, d, "benchmark"), table(s, d, "documents"), "item_id", "doc_id")


QUERIES = {f.__name__: f for f in (
    keyword_search, keyword_scan, semantic_search, hybrid_search, search_facets, paginate, find_related, knn_join, evidence_groups, topic_clusters, methodology_funnel, benchmark_leaderboard, best_scores_by_year, code_assets,
    chunk_listing, compare_papers, novelty, source_overlap,
)}

SCAN_BM25 = """t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
    c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'and')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b, len(list_filter(t, lambda x: x = 'thnd')) AS c FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db, sum((c > 0)::INT) AS dc FROM c),
    h AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))
        + ln(1 + (docs - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) AS bm25 FROM c, s WHERE a > 0 AND b > 0 AND c > 0),
    page AS (SELECT doc_id, bm25 / max(bm25) OVER () AS bm25 FROM (SELECT * FROM h ORDER BY bm25 DESC, doc_id LIMIT {n}))"""
STOPPED = "', '".join(fulltext.STOP_WORDS)
BM25 = f"""w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('{STOPPED}'))) AS word FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), k AS (SELECT count(DISTINCT doc_id) AS docs, (SELECT count(*) FROM w) / count(DISTINCT doc_id) AS mean FROM documents),
    st AS ({fulltext.stem_sql("SELECT DISTINCT word FROM w")}), f AS (SELECT doc_id, stem, count(*) AS tf FROM w JOIN st USING (word) WHERE stem IN ('tion', 'ed') GROUP BY doc_id, stem),
    g AS (SELECT stem, count(*) AS df FROM f GROUP BY stem), h AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM f JOIN g USING (stem) JOIN n USING (doc_id), k GROUP BY doc_id HAVING count(*) = 2),
    page AS (SELECT doc_id, bm25 / max(bm25) OVER () AS bm25 FROM (SELECT * FROM h ORDER BY bm25 DESC, doc_id LIMIT {{n}}))"""
NEAR = "near AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {q})) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT {k})"
ORACLE_SQL = {
    "keyword_scan": f"WITH {SCAN_BM25.format(n=30)} SELECT doc_id, round(bm25, 6) AS bm25 FROM page",
    "keyword_search": f"WITH {BM25.format(n=30)} SELECT doc_id, round(bm25, 6) AS bm25 FROM page",
    "semantic_search": f"WITH {NEAR.format(q=7, k=20)} SELECT vec_id, round(s, 4) AS similarity FROM near",
    "hybrid_search": f"""WITH {BM25.format(n=50)}, {NEAR.format(q=7, k=50)}, m AS (SELECT coalesce(p.doc_id, n.vec_id) AS doc_id, 0.6 * coalesce(round(s, 6), 0) + 0.4 * coalesce(round(bm25, 6), 0) AS score FROM page p FULL JOIN near n ON p.doc_id = n.vec_id),
        r AS (SELECT doc_id, source, round(score, 4) AS score FROM m JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr'))
        SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS p FROM r) WHERE p <= 2 ORDER BY score DESC, doc_id LIMIT 10""",
    "search_facets": f"""WITH {BM25.format(n=50)}, r AS (SELECT doc_id, lang, source FROM page JOIN documents USING (doc_id)) SELECT 'kind' AS facet, lang AS value, count(*) AS n FROM r GROUP BY lang
        UNION ALL SELECT * FROM (SELECT 'entity', source, count(*) AS n FROM r GROUP BY source ORDER BY n DESC, min(doc_id), source LIMIT 5)""",
    "paginate": f"WITH {BM25.format(n=50)} SELECT doc_id, round(bm25, 6) AS bm25 FROM page ORDER BY round(bm25, 6) DESC, doc_id LIMIT 10 OFFSET 10",
    "find_related": f"WITH {NEAR.format(q=3, k=11)} SELECT label, max(round(s, 4)) AS best, count(*) AS n FROM near WHERE vec_id <> 3 GROUP BY label",
    "knn_join": """WITH p AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.label <> b.label)
        SELECT query, vec_id, round(s, 4) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS r FROM p) WHERE r <= 5""",
    "novelty": """WITH s AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY label) / 100) AS BIGINT) AS step FROM embeddings),
        p AS (SELECT a.label AS doc, a.vec_id AS sample, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM s a JOIN embeddings b ON a.i % a.step = 0 AND a.label <> b.label),
        k AS (SELECT doc, sample, other, round(s, 4) AS similarity, other % 2 = 0 AS cited FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY s DESC, other) AS r FROM p) WHERE r <= 5),
        o AS (SELECT doc, sample, coalesce(1 - max(similarity) FILTER (WHERE NOT cited), 1) AS own FROM k GROUP BY doc, sample), n AS (SELECT doc, round(median(own), 6) AS novelty, count(*) AS samples FROM o GROUP BY doc),
        t AS (SELECT doc, other, max(similarity) AS s, max(CAST(cited AS INTEGER)) AS c FROM k GROUP BY doc, other), g AS (SELECT doc, round(avg(c), 6) AS grounding, CAST(sum(CAST(s > 0.9 AS INTEGER)) AS BIGINT) AS copies FROM t GROUP BY doc)
        SELECT n.doc, novelty, samples, grounding, copies FROM n LEFT JOIN g ON n.doc = g.doc""",
    "evidence_groups": """WITH p1 AS (SELECT vec_id, round(s, 4) AS s FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)),
        p2 AS (SELECT vec_id, round(s, 4) AS s FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 2)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)),
        p3 AS (SELECT vec_id, round(s, 4) AS s FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)),
        a AS (SELECT vec_id, max(CASE WHEN k = 1 THEN s END) AS claim, coalesce(max(CASE WHEN k = 2 THEN s END), 0) AS sup, coalesce(max(CASE WHEN k = 3 THEN s END), 0) AS con FROM (SELECT 1 AS k, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3) GROUP BY vec_id),
        e AS (SELECT vec_id, CASE WHEN abs(sup - con) < 0.03 THEN 'neutral' WHEN sup > con THEN 'supports' ELSE 'contradicts' END AS relation, CASE WHEN abs(sup - con) < 0.03 THEN 0.5 ELSE least(0.95, 0.5 + 4 * abs(sup - con)) END AS confidence, greatest(coalesce(claim, 0), sup, con) AS score FROM a)
        SELECT vec_id, relation, round(confidence, 4) AS confidence, score FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY confidence * score DESC, vec_id) AS p FROM e) WHERE p <= 5""",
    "code_assets": """WITH l AS (SELECT page_id, list_transform(list_filter(regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda x: length(x) > 3), lambda x: lower(x)) AS links FROM pages)
        SELECT page_id, CAST(len(links) AS INTEGER) AS n, array_to_string(list_sort(list_distinct(links))[1:3], ' ') AS top FROM l""",
    "topic_clusters": f"WITH {NEAR.format(q=11, k=100)}, g AS (SELECT label, max(round(s, 4)) AS top, count(*) AS members FROM near GROUP BY label) SELECT label, top, members, round(top * log2(members + 1), 4) AS score FROM g ORDER BY score DESC, label LIMIT 8",
    "methodology_funnel": "SELECT count(*) AS n, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')",
    "benchmark_leaderboard": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS score FROM events WHERE event_type = 'click' ORDER BY score DESC NULLS LAST, ts DESC, event_id LIMIT 20",
    "best_scores_by_year": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "chunk_listing": "WITH c AS (SELECT unnest(range(len(p))) AS position, unnest(p) AS content FROM (SELECT string_split_regex(text, '\\n+') AS p FROM documents WHERE doc_id = 5)) SELECT CAST(position AS INTEGER) AS position, length(content) AS n, contains(content, 'the') AS hit FROM c",
    "compare_papers": """WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM documents WHERE doc_id IN (1, 2, 6)), h AS (SELECT word, count(*) AS n FROM w GROUP BY word)
        SELECT CASE WHEN n = 3 THEN 'shared' WHEN n = 1 THEN 'unique' ELSE 'some' END AS kind, count(*) AS n FROM h GROUP BY 1""",
    "source_overlap": "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0",
}
