"""Claim-graph and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import graph as G
from sextant.operators import search as S
from sextant.plans.tables import edges, supersedes, table
from sextant.streaming.rollups import daily_costs


def claim_traverse(s, d):
    return G.traverse(edges(s, d), ["c1", "c2", "c3"], 6, "out", 200)


def claim_traverse_in(s, d):
    return G.traverse(edges(s, d), ["r1"], 2, "in", 200)


def graph_degrees(s, d):
    return G.degrees(edges(s, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def _alike(s, d):
    """Links between equal texts, each to the smallest doc_id."""
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("src")), "h").where("doc_id <> src").select("src", F.col("doc_id").alias("dst"))


def same_as_clusters(s, d):
    return G.clusters(_alike(s, d)).select("id", "cluster")


def collapsed_documents(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return G.collapsed(docs, G.clusters(_alike(s, d)), "smallest").select("cluster", "id", "members")


def supersede_heads(s, d):
    return G.heads(supersedes(s, d), 8).select("id", "head", "hops")


def superseded_stamps(s, d):
    return G.superseded(supersedes(s, d)).select("id", "newer", "ambiguous")


def run_status(s, d):
    ev = table(s, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "paused").otherwise("step").alias("event"))
    return G.run_status(ev.where("run_id % 7 <> 0 or event <> 'done'"), F.lit("2024-02-05").cast("timestamp_ntz"))


def record_validation(s, d):
    rows = table(s, d, "customer")
    bad = G.issues({"balance": F.col("c_acctbal") >= 0, "name": F.col("c_name").rlike("^Customer#"), "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})
    return rows.select("c_custkey", F.array_join(bad, ",").alias("issues"))


def related_claims(s, d):
    """Neighbours of a vector over the association floor, the anchor's own label aside."""
    e = table(s, d, "embeddings")
    anchor = e.where("vec_id = 5").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "label")
    return S.nearest(e, anchor, 15, not_same="label").select("vec_id", F.round("similarity", 4).alias("similarity"))


def projection_text(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    claims = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("text")).unionAll(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("text")))
    return G.projection_text(claims, edges(s, d).where("label = 'part_of'"))


def stream_rollup(s, d):
    """The batch twin of the streaming rollup: the same aggregation over the table at rest."""
    return daily_costs(table(s, d, "events"))


QUERIES = {f.__name__: f for f in (
    claim_traverse, claim_traverse_in, graph_degrees, same_as_clusters, collapsed_documents, supersede_heads, superseded_stamps, run_status, record_validation, related_claims, projection_text, stream_rollup,
)}

EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
SUPER = "t AS (SELECT conv_id || '-' || turn AS id, CASE WHEN EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1) THEN conv_id || '-' || (turn - 1) END AS supersedes FROM conversations a)"
ORACLE_SQL = {
    "claim_traverse": f"WITH RECURSIVE {EDGES}, w AS (SELECT dst AS id, 1 AS hops FROM edges WHERE src IN ('c1', 'c2', 'c3') UNION SELECT dst, hops + 1 FROM w JOIN edges ON src = id WHERE hops < 6) SELECT id, min(hops) AS hops FROM w GROUP BY id ORDER BY hops, id LIMIT 201",
    "claim_traverse_in": f"WITH RECURSIVE {EDGES}, w AS (SELECT src AS id, 1 AS hops FROM edges WHERE dst = 'r1' UNION SELECT src, hops + 1 FROM w JOIN edges ON dst = id WHERE hops < 2) SELECT id, min(hops) AS hops FROM w GROUP BY id ORDER BY 2, 1 LIMIT 201",
    "graph_degrees": f"WITH {EDGES}, b AS (SELECT src AS id, dst AS o FROM edges UNION SELECT dst, src FROM edges), g AS (SELECT id, count(*) AS degree FROM b GROUP BY id) SELECT degree, count(*) AS nodes FROM g GROUP BY degree",
    "same_as_clusters": "SELECT doc_id AS id, cluster FROM (SELECT doc_id, min(doc_id) OVER w AS cluster, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1",
    "collapsed_documents": "SELECT min(doc_id) AS cluster, min(doc_id) AS id, count(*) AS members FROM documents GROUP BY text",
    "supersede_heads": f"WITH RECURSIVE {SUPER}, w AS (SELECT id, id AS head, 0 AS hops FROM t UNION ALL SELECT w.id, t.id, hops + 1 FROM w JOIN t ON t.supersedes = w.head WHERE hops < 8) SELECT id, head, hops FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.supersedes = w.head)",
    "superseded_stamps": f"WITH {SUPER} SELECT a.id, (SELECT count(*) FROM t b WHERE b.supersedes = a.id) AS newer, (SELECT count(*) FROM t b WHERE b.supersedes = a.id) > 1 AS ambiguous FROM t a",
    "run_status": """WITH e AS (SELECT user_id AS run_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'paused' ELSE 'step' END AS event FROM events WHERE user_id % 7 <> 0 OR event_type <> 'purchase'),
        l AS (SELECT run_id, bool_or(event = 'done') AS done, max(ts) AS last FROM e GROUP BY run_id), x AS (SELECT l.run_id, done, last, max(event) AS event FROM l JOIN e ON e.run_id = l.run_id AND e.ts = l.last GROUP BY 1, 2, 3)
        SELECT run_id, CASE WHEN done THEN 'done' WHEN event = 'paused' THEN 'paused' WHEN date_diff('day', CAST(last AS DATE), DATE '2024-02-05') > 14 THEN 'abandoned' ELSE 'active' END AS status FROM x""",
    "record_validation": "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN NOT regexp_matches(c_name, '^Customer#') THEN 'name' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS issues FROM customer",
    "related_claims": """SELECT b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = 5 AND a.label <> b.label
        ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id LIMIT 15""",
    "projection_text": """SELECT 'n' || n_nationkey AS id, n_name || chr(10) || 'part_of: ' || r_name AS projection FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'r' || r_regionkey, r_name || coalesce(chr(10) || string_agg('by part_of: ' || n_name, chr(10) ORDER BY 'n' || n_nationkey), '') FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "stream_rollup": "SELECT CAST(ts AS DATE) AS day, event_type, user_id, count(*) AS calls, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS micro FROM events GROUP BY 1, 2, 3",
}
