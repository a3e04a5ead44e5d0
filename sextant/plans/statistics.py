"""Operational statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import aggregates as A
from sextant.operators import relations as R
from sextant.operators.neighbours import nearest_of_all
from sextant.plans.tables import table


def doc_status_counts(s, d):
    return A.counts(table(s, d, "documents"), "lang").orderBy(F.desc("n"), "lang")


def category_counts(s, d):
    cats = table(s, d, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("category"))
    return A.counts(cats, "category").orderBy(F.desc("n"), "category").limit(30)


def category_overlap(s, d):
    docs = table(s, d, "documents").withColumn("categories", F.array("lang", "source"))
    return docs.where(F.arrays_overlap("categories", F.array(F.lit("fr"), F.lit("src3")))).select("doc_id")


def weekly_volume(s, d):
    return A.weekly(table(s, d, "orders"), "o_orderdate", 20)


def coverage_matrix(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.coverage(rows, ["lang", "source", "quality"])


def cost_totals(s, d):
    return table(s, d, "events").agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum(A.safe(F.col("value"))), F.lit(0.0)), 4).alias("total"))


def cost_by_task(s, d):
    return A.costs(table(s, d, "events"), ["event_type"], "value")


def cost_by_user_day(s, d):
    rows = table(s, d, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return A.costs(rows.withColumn("day", F.to_date("ts")), ["user_id", "day"], "value", 4)


def filtered_counts(s, d):
    docs = table(s, d, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 5000).alias("long"), F.count_if(F.col("n_chars") < 200).alias("short"), F.countDistinct("source").alias("sources"))


def oversized_chunks(s, d):
    from sextant.operators.search import chunks

    return A.oversized(chunks(table(s, d, "documents")), "content", "doc_id", [(r"\|", 300), (r"!!", 200)], 1500)


def nan_safe_sum(s, d):
    rows = table(s, d, "events").withColumn("v", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")))
    return A.costs(rows, ["user_id"], "v")


def distinct_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def sample_ids(s, d):
    return A.ordered_sample(table(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", 5).select("o_custkey", F.array_join("sample", ",").alias("sample"))


def demand_candidates(s, d):
    return A.demand(table(s, d, "events"), "user_id", "value", "ts", "2024-01-15", 100.0, 25)


def gap_audit(s, d):
    return A.day_gaps(table(s, d, "orders"), "o_orderdate", "1995-01-01", "1995-03-31", 10)


def system_stats(s, d):
    docs, ev = table(s, d, "documents"), table(s, d, "events")
    a = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    b = ev.agg(F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    return a.crossJoin(b)  # one row each


def cohort_summary(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id")
    return A.cohort(rows, {"quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, F.col("n_chars") < 100)


def graph_rollup(s, d):
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.rollup(rows.select("c_mktsegment", "n_name", "n_regionkey", "c_acctbal"), ["c_mktsegment", "n_name", "n_regionkey"], [F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive")])


def failure_breaker(s, d):
    rows = table(s, d, "events").withColumn("run", F.col("user_id"))
    return A.breaker(rows, "event_id", F.col("event_type") == "error", 0.3).groupBy("run").agg(F.max(F.col("open").cast("int")).alias("opened"), F.round(F.max_by("share", "event_id"), 4).alias("final_share"))


def similarity_bands(s, d):
    """Bands of the likeness between stated queries and their ten nearest."""
    e = table(s, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    rows = nearest_of_all(e, queries, 11).where("vec_id <> query").select(F.round("similarity", 4).alias("s"))
    return rows.groupBy(F.when(F.col("s") >= 0.5, "0.5").when(F.col("s") >= 0.4, "0.4").when(F.col("s") >= 0.3, "0.3").otherwise("below").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def monthly_first(s, d):
    months = table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.where("n >= 5").agg(F.min("month").alias("first_month"), F.count(F.lit(1)).alias("months"))


def enrichment_candidates(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    returned = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    heavy = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 150").select("o_orderkey")
    return o.join(returned, "o_orderkey", "left_anti").join(heavy, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def store_drift(s, d):
    left, right = table(s, d, "documents").select("source"), table(s, d, "documents").join(table(s, d, "labels").select("doc_id"), "doc_id").select("source")
    return R.drift(left, right, "source")


QUERIES = {f.__name__: f for f in (
    doc_status_counts, category_counts, category_overlap, weekly_volume, coverage_matrix, cost_totals, cost_by_task, cost_by_user_day, filtered_counts, oversized_chunks, nan_safe_sum, distinct_counts,
    sample_ids, demand_candidates, gap_audit, system_stats, cohort_summary, graph_rollup, failure_breaker, similarity_bands, monthly_first, enrichment_candidates, store_drift,
)}

CHUNKS = "chunks AS (SELECT doc_id, unnest(range(len(p))) AS position, unnest(p) AS content FROM (SELECT doc_id, string_split_regex(text, '\\n+') AS p FROM documents))"
ORACLE_SQL = {
    "doc_status_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "category_counts": "SELECT category, count(*) AS n FROM (SELECT unnest([lang, source]) AS category FROM documents) GROUP BY category ORDER BY n DESC, category LIMIT 30",
    "category_overlap": "SELECT doc_id FROM documents WHERE lang IN ('fr', 'src3') OR source IN ('fr', 'src3')",
    "weekly_volume": "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
    "coverage_matrix": """WITH r AS (SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(CAST(quality AS VARCHAR), 'none') AS quality FROM documents LEFT JOIN labels USING (doc_id))
        SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, CASE WHEN grouping(quality) = 1 THEN 'all' ELSE quality END AS quality, count(*) AS n FROM r GROUP BY CUBE (lang, source, quality)""",
    "cost_totals": "SELECT count(*) AS calls, round(coalesce(sum(value), 0.0), 4) AS total FROM events",
    "cost_by_task": "SELECT event_type, count(*) AS calls, round(coalesce(sum(value), 0.0), 4) AS total, round(avg(value), 2) AS mean FROM events GROUP BY event_type",
    "cost_by_user_day": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, round(coalesce(sum(value), 0.0), 4) AS total, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2",
    "filtered_counts": "SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 5000) AS long, count(*) FILTER (WHERE n_chars < 200) AS short, count(DISTINCT source) AS sources FROM documents",
    "oversized_chunks": f"WITH {CHUNKS}, o AS (SELECT doc_id, sum(CASE WHEN length(content) > CASE WHEN content LIKE '%|%' THEN 300 WHEN content LIKE '%!!%' THEN 200 ELSE 1500 END THEN 1 ELSE 0 END) AS oversized, count(*) AS n FROM chunks GROUP BY doc_id) SELECT doc_id, CAST(oversized AS BIGINT) AS oversized, n FROM o WHERE oversized > 0",
    "nan_safe_sum": "SELECT user_id, count(*) AS calls, round(coalesce(sum(v), 0.0), 4) AS total, round(avg(v), 2) AS mean FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events) GROUP BY user_id",
    "distinct_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type",
    "sample_ids": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY p) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p <= 5 GROUP BY o_custkey",
    "demand_candidates": "SELECT user_id, round(sum(value), 4) AS demand FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id HAVING round(sum(value), 4) >= 100 ORDER BY demand DESC, user_id LIMIT 25",
    "gap_audit": "WITH d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-03-31', INTERVAL 1 DAY)) AS DATE) AS day), a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(d.day, '%Y%m%d') AS day, coalesce(n, 0) AS actual, greatest(0, 10 - coalesce(n, 0)) AS gap FROM d LEFT JOIN a ON d.day = a.day",
    "system_stats": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS chars, (SELECT min(CAST(ts AS DATE)) FROM events) AS first_day, (SELECT max(CAST(ts AS DATE)) FROM events) AS last_day, (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_event",
    "cohort_summary": """WITH r AS (SELECT quality = 0 AS q, toxic = 1 AS t, n_chars < 100 AS s FROM labels JOIN documents USING (doc_id))
        SELECT count(*) AS rows, CAST(sum(CASE WHEN NOT s THEN 1 ELSE 0 END) AS BIGINT) AS counted, CAST(sum(CASE WHEN NOT s AND q THEN 1 ELSE 0 END) AS BIGINT) AS fail_quality, CAST(sum(CASE WHEN NOT s AND t THEN 1 ELSE 0 END) AS BIGINT) AS fail_toxic,
        round(sum(CASE WHEN NOT s AND (q OR t) THEN 1 ELSE 0 END) / sum(CASE WHEN NOT s THEN 1 ELSE 0 END), 4) AS fail_share FROM r""",
    "graph_rollup": """WITH r AS (SELECT c_mktsegment, n_name, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT dim, bucket, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS positive FROM (SELECT 'c_mktsegment' AS dim, c_mktsegment AS bucket, c_acctbal FROM r UNION ALL SELECT 'n_name', n_name, c_acctbal FROM r UNION ALL SELECT 'n_regionkey', CAST(n_regionkey AS VARCHAR), c_acctbal FROM r) GROUP BY dim, bucket""",
    "failure_breaker": """WITH w AS (SELECT user_id AS run, event_id, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER x AS share, count(*) OVER x AS n FROM events WINDOW x AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        SELECT run, CAST(max(CASE WHEN n >= 5 AND share > 0.3 THEN 1 ELSE 0 END) AS INTEGER) AS opened, round(arg_max(share, event_id), 4) AS final_share FROM w GROUP BY run""",
    "similarity_bands": """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS o, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
        k AS (SELECT round(s, 4) AS s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) AS r FROM p) WHERE r <= 11 AND q <> o)
        SELECT CASE WHEN s >= 0.5 THEN '0.5' WHEN s >= 0.4 THEN '0.4' WHEN s >= 0.3 THEN '0.3' ELSE 'below' END AS band, count(*) AS n FROM k GROUP BY 1""",
    "monthly_first": "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT min(month) AS first_month, count(*) AS months FROM m WHERE n >= 5",
    "enrichment_candidates": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)",
    "store_drift": """WITH l AS (SELECT source, count(*) AS l FROM documents GROUP BY source), r AS (SELECT source, count(*) AS r FROM documents JOIN labels USING (doc_id) GROUP BY source), x AS (SELECT source, coalesce(l, 0) - coalesce(r, 0) AS difference FROM l FULL JOIN r USING (source))
        SELECT source, difference, CASE WHEN difference > 0 THEN 'missing' ELSE 'orphan' END AS kind FROM x WHERE difference <> 0""",
}
