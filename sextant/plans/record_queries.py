"""Queries over records and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import records as R
from sextant.plans.tables import supersedes, table


def cost_keys(s, d):
    tool = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "compare_papers").when(F.col("event_type") == "signup", "submit_document").otherwise("paginate")
    args = F.when(F.col("event_id") % 2 == 0, '{"strategy":"rerank","detail":"full","dry_run":true}').otherwise("{}")
    return table(s, d, "events").select(R.cost_key(tool, args).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def table_scores(s, d):
    """A part's row as a little results table."""
    p = table(s, d, "part")
    rows = F.array(F.array(F.col("p_brand"), F.col("p_retailprice").cast("string"), F.lit("text")), F.array(F.lit("n/a"), F.lit("95.5%"), F.lit("more")))
    tables = p.select(F.col("p_partkey").alias("table_id"), F.lit("Table 1: Parts").alias("caption"), F.array(F.lit("Dataset"), F.lit("F1 score"), F.lit("Memory")).alias("headers"), rows.alias("rows"))
    return R.table_scores(tables)


def supersede_guards(s, d):
    links = supersedes(s, d).where("supersedes is not null").select(F.col("id").alias("frm"), F.col("supersedes").alias("to"))
    t = table(s, d, "conversations")
    asked = t.where("turn = 1").select(F.concat_ws("-", "conv_id", F.lit(1)).alias("old"), F.concat_ws("-", "conv_id", F.lit(0)).alias("new"), F.lit("a").alias("owner"), F.lit("a").alias("old_owner"), F.col("role").alias("type"), F.lit("assistant").alias("old_type"))
    return R.supersede_guards(asked, links).select("old", F.array_join("violated", ",").alias("violated"))


def stage_gates(s, d):
    ev = table(s, d, "events")
    runs = ev.groupBy(F.col("user_id").alias("run_id")).agg((F.max("event_id") % 3 + 1).alias("stage"))
    marks = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), F.lit("go").alias("type"), (F.col("event_id") % 3).alias("stage"))
    return R.stage_gate(runs, marks)


def language_gates(s, d):
    return table(s, d, "documents").select("doc_id", R.language_gate(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5)).alias("stopped"))


def hash_scopes(s, d):
    rows = table(s, d, "nation").select(F.when(F.col("n_regionkey") == 0, "shared").otherwise("other").alias("relation"), F.col("n_name").alias("uri"), F.array(F.lit("z"), F.lit("a")).alias("members"), "n_nationkey")
    return rows.select("n_nationkey", R.hash_scope(["relation", "uri", "members"], keep_when=[(["uri"], "relation", "shared")], as_sets=["members"]).alias("scope"))


def local_names(s, d):
    t = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("bundle"), F.col("turn").cast("string").alias("local"), F.when(F.col("turn") > 0, F.array((F.col("turn") - 1).cast("string"))).alias("refs"), F.col("role").alias("body"))
    return R.resolved_names(t)


def boundary_fixes(s, d):
    from sextant.operators.search import chunks

    rows = chunks(table(s, d, "documents")).select("doc_id", "position", F.length("content").alias("n"), F.length(R.whole_sentences(F.col("content"))).alias("kept"))
    return rows.where("kept < n")


QUERIES = {f.__name__: f for f in (cost_keys, table_scores, supersede_guards, stage_gates, language_gates, hash_scopes, local_names, boundary_fixes)}
ORACLE_SQL = {
    "local_names": """WITH RECURSIVE w AS (SELECT conv_id, turn, sha256(role) AS id FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, sha256(c.role || chr(31) || w.id) FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
        SELECT CAST(c.conv_id AS VARCHAR) AS bundle, CAST(c.turn AS VARCHAR) AS local, w.id, CASE WHEN w.id IS NULL THEN 'unresolved' END AS problem FROM conversations c LEFT JOIN w USING (conv_id, turn)""",
    "cost_keys": """SELECT CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'search:rerank' ELSE 'search:fast' END WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'compare_papers:full' ELSE 'compare_papers' END
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'submit_document:dry_run' ELSE 'submit_document:latex' END ELSE 'paginate' END AS key, count(*) AS n FROM events GROUP BY 1""",
    "table_scores": "SELECT p_partkey AS table_id, '' AS task, p_brand AS dataset, 'F1 score' AS metric, p_retailprice AS score FROM part UNION ALL SELECT p_partkey, '', 'Parts', 'F1 score', 95.5 FROM part",
    "supersede_guards": """WITH t AS (SELECT conv_id, turn, role, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = 2) AS two FROM conversations a WHERE turn = 1)
        SELECT conv_id || '-1' AS old, array_to_string(list_filter([CASE WHEN EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.conv_id AND c.turn = 0) THEN 'cycle' END, CASE WHEN two THEN 'set-once' END, CASE WHEN role <> 'assistant' THEN 'type' END], lambda x: x IS NOT NULL), ',') AS violated FROM t""",
    "stage_gates": """WITH r AS (SELECT user_id AS run_id, max(event_id) % 3 + 1 AS stage FROM events GROUP BY user_id)
        SELECT run_id, stage, stage > 1 AND NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND user_id = run_id AND event_id % 3 = stage - 1) AS blocked FROM r""",
    "language_gates": "SELECT doc_id, lang <> 'en' AND doc_id % 2 = 0 AS stopped FROM documents",
    "hash_scopes": "SELECT n_nationkey, '{\"members\":[\"a\",\"z\"],\"relation\":\"' || CASE WHEN n_regionkey = 0 THEN 'shared\",\"uri\":\"' || n_name ELSE 'other' END || '\"}' AS scope FROM nation",
}
