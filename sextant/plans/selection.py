"""Ranking, paging, sets, versions, sampling and store maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import relations as R
from sextant.operators import search as S
from sextant.plans.tables import table


def latest_version(s, d):
    return R.latest(table(s, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")


def version_history(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("versions"), F.max("turn").alias("last"), F.sum(F.length("text")).alias("chars"))


def inherit_previous(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", "role")
    return R.inherited(rows, "conv_id", "turn", "role", "assistant")


def diversify_by_key(s, d):
    rows = table(s, d, "embeddings").withColumn("score", F.round(F.col("embedding")[0].cast("double"), 5))
    return S.diversified(rows, "label", 3, [F.desc("score"), F.asc("vec_id")]).select("vec_id", "label", "score")


def best_per_document(s, d):
    return R.best_per(table(s, d, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber")


def elections(s, d, rule="verified_degree"):
    rows = table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), (F.col("o_orderstatus") == "F").cast("int").alias("verified"), F.length("o_orderpriority").alias("degree"),
        F.col("o_totalprice").alias("strength"), F.col("o_orderdate").alias("attested_at"), F.length("o_orderpriority").alias("convergent"), F.col("o_totalprice").alias("evidence"),
    )
    return R.elected(rows, "grp", rule).select("grp", "id")


def canonical_elect(s, d):
    return elections(s, d)


def canonical_elect_earliest(s, d):
    return elections(s, d, "earliest")


def span_gaps(s, d):
    rows = table(s, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a"), (F.unix_seconds(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("long")).alias("b"))
    return R.span_gaps(rows, "user_id", "a", "b")


def stride_sample(s, d):
    return R.stride_sample(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


def keyset_page(s, d):
    rows = table(s, d, "orders").select("o_totalprice", "o_orderkey")
    return S.after_cursor(rows, ["o_totalprice", "o_orderkey"], (200000.0, 0), 25)


def offset_page(s, d):
    return S.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


def id_list_order(s, d):
    ids = [9, 3, 7, 1, 5]
    rows = table(s, d, "documents").where(F.col("doc_id").isin(ids))
    return rows.select("doc_id", F.array_position(F.array(*map(F.lit, ids)), F.col("doc_id").cast("int")).cast("long").alias("place"))


def set_compare(s, d):
    rows = table(s, d, "lineitem").select("l_suppkey", "l_partkey")
    return R.set_compare(rows, "l_suppkey", "l_partkey", [1, 2, 3])


def usage_crosscheck(s, d):
    ev = table(s, d, "events")
    rows = ev.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 20, F.col("event_type")))).alias("claimed"), F.array_sort(F.collect_set(F.when(F.hour("ts") < 12, F.col("event_type")))).alias("used"))
    return rows.select("user_id", R.crosscheck(F.col("claimed"), F.col("used")).alias("c")).select("user_id", F.array_join("c.missing", ",").alias("missing"), F.array_join("c.extra", ",").alias("extra"), "c.verdict")


def first_wins_dedup(s, d):
    return R.first_wins(table(s, d, "documents"), F.lower("text"), [F.asc("doc_id")]).select("doc_id", "source")


def toollog_window(s, d):
    ev = table(s, d, "events")
    log = ev.select(F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("run_id"), F.col("user_id").alias("credential"), F.col("ts").alias("called_at"), "event_id")
    marks = ev.where("event_type in ('purchase', 'signup')").select(F.col("user_id").alias("run_id"), F.col("user_id").alias("credential"), F.when(F.col("event_type") == "signup", "go").otherwise("step").alias("event"), "ts")
    return R.log_window(log, marks).groupBy("credential").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def stratified_sample(s, d):
    kind = F.when(F.col("n_chars") > 3000, "long").when(F.col("n_chars") < 500, "short").otherwise("middle")
    return R.stratified(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", kind, {"long": 60, "middle": 30, "short": 10}, 7)


def throttled_log(s, d):
    first = table(s, d, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))  # of events at one time
    return R.throttled(first, "user_id", "ts", 7)


def resume_states(s, d):
    rows = table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("other").alias("status"))
    return R.resume_state(rows, "o_custkey", "status")


def upsert_latest(s, d):
    part = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    new = part.where("p_size > 40").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(0).alias("p_size"))
    return R.upserted(part, new, ["p_partkey"])


def insert_ignore(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return R.insert_ignored(docs.where("doc_id < 100"), docs.where("doc_id >= 50"), [["doc_id"], ["digest"]], "doc_id")


def dangling_edges(s, d):
    from sextant.plans.tables import edges

    e = edges(s, d)
    nodes = table(s, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionAll(table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    known, lost = R.edges_with_both_ends(nodes, e)
    return known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.lit("drawn").alias("kind"), "n").unionAll(lost.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.lit("dangling").alias("kind"), "n"))


def map_merge(s, d):
    ev = table(s, d, "events")
    old, new = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")), F.create_map(F.lit("k"), F.lit("new"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return ev.select("event_id", merged["kind"].alias("kind"), merged["k"].alias("k"), (~F.map_contains_key(merged, "absent")).alias("lacks"))


def null_safe_changes(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    old, new = F.col("quality"), F.when(F.col("n_chars") > 1000, 1)
    return rows.where(~old.eqNullSafe(new)).groupBy("lang").agg(F.count(F.lit(1)).alias("changed"))


QUERIES = {f.__name__: f for f in (
    latest_version, version_history, inherit_previous, diversify_by_key, best_per_document, canonical_elect, canonical_elect_earliest, span_gaps, stride_sample, keyset_page, offset_page, id_list_order, set_compare,
    usage_crosscheck, first_wins_dedup, toollog_window, stratified_sample, throttled_log, resume_states, upsert_latest, insert_ignore, dangling_edges, map_merge, null_safe_changes,
)}

EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives_in' AS label FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"
ORACLE_SQL = {
    "latest_version": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "version_history": "SELECT conv_id, count(*) AS versions, max(turn) AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
    "inherit_previous": "SELECT conv_id, turn, role, coalesce(CASE WHEN role <> 'assistant' THEN role END, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), role) AS effective FROM conversations",
    "diversify_by_key": "SELECT vec_id, label, score FROM (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 5) AS score, row_number() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 5) DESC, vec_id) AS p FROM embeddings) WHERE p <= 3",
    "best_per_document": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1",
    "canonical_elect": "SELECT o_custkey AS grp, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, length(o_orderpriority) DESC, o_totalprice DESC, o_orderdate, o_orderkey) = 1",
    "canonical_elect_earliest": "SELECT o_custkey AS grp, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "span_gaps": """WITH r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + CAST(round(value * 1000) AS BIGINT) AS b FROM events), w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
        SELECT user_id, a, b, greatest(a - coalesce(before, 0), 0) AS gap, greatest(coalesce(before, 0) - a, 0) AS overlap FROM w""",
    "stride_sample": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY o_custkey) / 4) AS BIGINT) AS step FROM orders) WHERE i % step = 0",
    "keyset_page": "SELECT o_totalprice, o_orderkey FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey < 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 26",
    "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "id_list_order": "SELECT doc_id, CAST(list_position([9, 3, 7, 1, 5], doc_id) AS BIGINT) AS place FROM documents WHERE doc_id IN (9, 3, 7, 1, 5)",
    "set_compare": "WITH h AS (SELECT l_partkey, count(*) AS n, min(l_suppkey) AS o FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (1, 2, 3)) GROUP BY l_partkey) SELECT l_partkey, n, CASE WHEN n = 3 THEN 'shared' WHEN n = 1 THEN 'unique' ELSE 'some' END AS kind, CASE WHEN n = 1 THEN o END AS owner FROM h",
    "usage_crosscheck": """WITH k AS (SELECT DISTINCT user_id, event_type, max(value > 20) OVER w AS c, max(hour(ts) < 12) OVER w AS u FROM events WINDOW w AS (PARTITION BY user_id, event_type)),
        x AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE u AND NOT c) AS missing, string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE c AND NOT u) AS extra, count(*) FILTER (WHERE u) AS used FROM k GROUP BY user_id)
        SELECT user_id, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra, CASE WHEN used = 0 THEN 'inconclusive' WHEN extra IS NOT NULL THEN 'fabrication' WHEN missing IS NOT NULL THEN 'under_report' ELSE 'pass' END AS verdict FROM x""",
    "first_wins_dedup": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lower(text)",
    "toollog_window": """WITH m AS (SELECT user_id, coalesce(max(CASE WHEN event_type = 'signup' THEN ts END), min(ts)) AS start FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id)
        SELECT e.user_id AS credential, count(*) AS n, min(event_id) AS first FROM events e JOIN m ON e.user_id = m.user_id AND e.ts >= m.start GROUP BY e.user_id""",
    "throttled_log": """WITH RECURSIVE k AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 7 DAY) AS ts FROM k WHERE k.ts IS NOT NULL)
        SELECT user_id, ts, min(event_id) AS event_id FROM events JOIN k USING (user_id, ts) GROUP BY user_id, ts""",
    "resume_states": "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'resume' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'virgin' ELSE 'rerun' END AS state FROM orders GROUP BY o_custkey",
    "upsert_latest": "SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part",
    "insert_ignore": """WITH x AS (SELECT doc_id, source, sha256(text) AS digest FROM documents), n AS (SELECT * FROM x WHERE doc_id >= 100 AND digest NOT IN (SELECT digest FROM x WHERE doc_id < 100))
        SELECT doc_id, source, digest FROM n QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1""",
    "dangling_edges": f"""WITH {EDGES}, nodes AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'n' || n_nationkey FROM nation)
        SELECT label, CASE WHEN src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) THEN 'drawn' ELSE 'dangling' END AS kind, count(*) AS n FROM edges GROUP BY 1, 2""",
    "map_merge": "SELECT event_id, event_type AS kind, 'new' AS k, true AS lacks FROM events",
    "null_safe_changes": "SELECT lang, count(*) AS changed FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM CASE WHEN n_chars > 1000 THEN 1 END GROUP BY lang",
}
