"""Search as a whole, related documents and records, walks by class, cursors, packed vectors, rollups by changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import fulltext
from sextant.operators import graph as G
from sextant.operators import maintenance as M
from sextant.operators import runs as RUNS
from sextant.operators import search as S
from sextant.operators.alignment import numbered_lines
from sextant.operators.shared import materialize, shared_dir
from sextant.plans.retrieval import BM25, NEAR, WORDS, _vector
from sextant.plans.tables import supersedes, table
from sextant.sources.snapshots import Snapshots, refresh

SOFT, SOURCES, CURSOR = ["en", "de"], ["src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8"], "MTk5Ni0wMS0wMlQwMDowMDowMC4wMDBafDUwMDA"  # 1996-01-02T00:00:00.000Z|5000


def _pools(s, d, limit, rerank):
    size = M.pool_size(limit, True, rerank)
    near = S.nearest(table(s, d, "embeddings"), _vector(s, d, [7]), size).select(F.col("vec_id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))
    words = S.page_normalised(fulltext.index_of(table(s, d, "documents")).top(WORDS, size), "bm25", size, "doc_id").withColumn("bm25", F.round("bm25", 6))
    return near, words


def search_fast(s, d):
    page, _ = S.searched(*_pools(s, d, 10, False), table(s, d, "documents"), "doc_id", 10, soft={"lang": SOFT}, hard=F.col("source").isin(SOURCES), diversify="source", most=2)
    return page.select("doc_id", "place", F.round("score", 4).alias("score"))


def search_reranked(s, d):
    """The rerank stands for a model: the share of vowels in a text."""
    share = lambda text: F.round(F.regexp_count(text, F.lit("[aeiou]")) / F.greatest(F.length(text), F.lit(1)), 6)
    page, _ = S.searched(*_pools(s, d, 10, True), table(s, d, "documents"), "doc_id", 10, soft={"lang": SOFT}, hard=F.col("source").isin(SOURCES), rerank=share, diversify="source", most=2)
    return page.select("doc_id", "place", "score")


def _marked_lines(s, d):
    """Lines with their long words as entities and their first words as concept."""
    words = F.filter(F.split(F.lower("content"), "[^a-z]+"), lambda w: F.length(w) >= 4)
    return numbered_lines(table(s, d, "documents")).select("doc_id", F.when(F.size(words) > 0, words).alias("entities"), F.array_join(F.slice(F.split("content", " "), 1, 3), " ").alias("concept"))


def related_by_entity(s, d):
    return S.mentioning(_marked_lines(s, d), table(s, d, "documents").where("source <> 'src0'"), "doc_id", S.names_entity("entities", "Thnd"), "n_chars", 20)


def related_by_concept(s, d):
    return S.mentioning(_marked_lines(s, d), table(s, d, "documents"), "doc_id", S.holds_concept("concept", "THE "), "n_chars", 20)


def _class_edges(s, d):
    n, c, p = table(s, d, "nation"), table(s, d, "customer"), table(s, d, "supplier")
    edge = lambda df, a, x, b, y, label: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(label).alias("label"))
    parts = [
        edge(c, "c", "c_custkey", "n", "c_nationkey", "SUPPORT"), edge(n, "n", "n_nationkey", "r", "n_regionkey", "EXTEND"), edge(p, "n", "s_nationkey", "s", "s_suppkey", "QUALIFY"), edge(n, "r", "n_regionkey", "n", "n_nationkey", "REFUTE"),
        edge(c.where("c_custkey % 2 = 0"), "c", "c_custkey", "c", F.expr("c_custkey div 2"), "ENG_DEPENDS_ON"), edge(c.where("c_custkey < 40"), "c", "c_custkey", "c", F.expr("c_custkey * 2"), "ENG_SATISFIES"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def class_walk(s, d):
    return G.class_traverse(_class_edges(s, d), "c7", hops=4, least=2, most=60)


def class_walk_engineering(s, d):
    return G.class_traverse(_class_edges(s, d), "c3", "engineering", hops=4)


def class_walk_back(s, d):
    return G.class_traverse(_class_edges(s, d), "r1", direction="in", hops=2)


def related_relations(s, d):
    """Orders as relations between customers; every eleventh supersedes the one before."""
    o = table(s, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "support").when(F.col("o_orderstatus") == "O", "refute").otherwise("extend")
    ident = lambda c: F.concat(F.lit("o"), c)
    relations = o.select(
        ident(F.col("o_orderkey")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("source"), F.concat(F.when(F.col("o_orderkey") % 9 == 0, "run:").otherwise("c"), F.col("o_orderkey") % 60).alias("target"), kind.alias("relation"),
        F.when(F.col("o_orderkey") % 4 == 0, "engineering").when(F.col("o_orderkey") % 4 == 1, "epistemic").alias("relation_class"), F.when(F.col("o_orderkey") % 11 == 0, ident(F.col("o_orderkey") - 1)).alias("supersedes"),
    )
    claims = s.range(60).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("c"), F.col("id") + 1)).alias("supersedes"))
    return G.related_records(relations, claims, "c9", direction="out", latest=True)


def cursor_pages(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return S.cursor_page(rows, "at", "o_orderkey", CURSOR, 25, r"\d+").select("o_orderkey", "cursor", "more")


def packed_vectors(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding", V.packed_vector("embedding").alias("held"))
    same = V.unpacked_vector(F.col("held"), 64) == F.col("embedding").cast("array<float>")
    return rows.select("vec_id", F.length("held").alias("bytes"), same.alias("same"), V.vector_key("m", 64, F.col("vec_id").cast("string")).alias("key"))


def rollup_by_changes(s, d):
    """A rollup of the lines shipped before 1995, then the later ones, then the returned ones taken away: as if made anew."""
    kept = Snapshots(s, f"{shared_dir(s)}/sextant/{uuid.uuid4().hex}")
    lines = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("quantity"), F.to_date("l_shipdate").alias("day"))
    early, late = lines.where("day < date'1995-01-01'"), lines.where("day >= date'1995-01-01'")
    changes = (early.withColumn("sign", F.lit(1)), late.withColumn("sign", F.lit(1)), lines.where("l_returnflag = 'R' and quantity > 25").withColumn("sign", F.lit(-1)))
    for n, rows in enumerate(changes):
        refresh(kept, rows, ["l_returnflag", "l_linestatus"], ["quantity"], str(n))
    return materialize(kept.read()).select("l_returnflag", "l_linestatus", "n", "quantity")


def supersede_all_heads(s, d):
    """Chains of any length."""
    return G.heads(supersedes(s, d), None)


def run_doses(s, d):
    """What events call for, by cycle and stage written in several ways."""
    cells = table(s, d, "nation").select(F.col("n_regionkey").alias("cycle"), (F.col("n_nationkey") % 5).alias("stage"), F.array("n_name").alias("operations"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("b"))).alias("beacons"), *(F.lit(None).cast("array<string>").alias(c) for c in ("counters", "expected_artifacts")))
    asked = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id") % 7)).when(F.col("event_id") % 3 == 1, F.lit("1.5")).otherwise((F.col("event_id") % 5).cast("string")).alias("cycle"), (F.col("user_id") % 6).alias("stage"))
    found = RUNS.doses(asked, cells)
    return found.select("event_id", "found", "dose_stage", F.array_join("operations", ",").alias("operations"), F.size("beacons").alias("beacons"), F.size("counters").alias("counters"))


def run_routes(s, d):
    """Turns as intents: the state names a run for some, the payload signals publication by a digest or a word."""
    t, n = table(s, d, "conversations"), F.col("turn")
    state = F.when(n % 4 == 0, F.lit("{}")).when(n % 4 == 1, F.concat(F.lit('{"run_id": "r'), F.col("conv_id"), F.lit('"}'))).when(n % 4 == 2, F.lit('{"error": "none", "status": "x"}')).otherwise(F.lit('{"stage": null}'))
    payload = F.to_json(F.struct(F.struct(F.when(F.col("role") == "user", F.lit("  ")).otherwise(F.left("text", F.lit(3))).alias("hash")).alias("handin"), F.when(F.length("text") % 2 == 0, "publish").otherwise("draft").alias("action"), F.lit(False).alias("sure")))
    where = RUNS.route(state, payload, [("handin.hash", None), ("action", "publish"), ("sure", None)])
    return t.select("conv_id", "turn", where.alias("route"))


def escalation_log(s, d):
    """Errors as escalations of their users, twice raised, on top of a log of the even ones."""
    e = table(s, d, "events").where("event_type in ('error', 'click')").select(F.concat(F.lit("u"), "user_id").alias("credential_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("review_run_id"), F.col("event_type").alias("issue"), F.lit("k").alias("class"), F.col("ts").cast("timestamp").alias("at"))
    old = e.where("review_run_id is not null").withColumns({"ticket": RUNS.ticket(F.col("credential_id"), F.col("review_run_id"), F.col("issue"), F.col("class")), "status": F.lit("resolved")})
    return RUNS.escalated(old, e.unionAll(e)).select("ticket", "credential_id", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def checkpoint_answers(s, d):
    """Orders as hand-ins: the ones of each hundredth customer were stored before; a hand-in seen again gets the first answer."""
    o = table(s, d, "orders").select(F.md5(F.concat_ws("|", F.col("o_custkey") % 50, "o_orderstatus")).alias("handin_hash"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("response"), (F.col("o_orderstatus") == "F").alias("go"))
    stored = o.where("response % 100 = 0").groupBy("handin_hash").agg(F.min_by(F.struct("at", "response", "go"), F.struct("at", "response")).alias("r")).select("handin_hash", "r.*")
    _, answers = RUNS.recorded(stored, o.where("response % 100 <> 0"))
    return answers.groupBy("handin_hash").agg(F.count(F.lit(1)).alias("asked"), F.min("response").alias("response"), F.max("response").alias("same"), F.count_if("created").alias("created"))


def ids_by_precedence(s, d):
    """Labels ask for documents by one or two ids; of two kinds the first that finds a visible document counts."""
    docs, n = table(s, d, "documents"), F.col("doc_id")
    forms = [("short", F.concat(F.lit("d"), n)), ("arxiv", F.concat(F.lit("2401."), n)), ("doi", F.concat(F.lit("10.1/"), n)), ("dblp", F.concat(F.lit("db/"), n % 50))]
    rows = table(s, d, "labels").select(F.col("doc_id").alias("ask"))
    a = F.col("ask")
    doi = F.when(a % 4 == 0, F.concat(F.lit("10.48550/arXiv.2401."), a + 1)).when(a % 4 == 1, F.concat(F.lit("10.1/"), a))
    asked = RUNS.asked_ids(rows, short=F.when(a % 5 == 0, F.concat(F.lit("d"), a)), doi=doi, dblp=F.when(a % 3 == 0, F.concat(F.lit("db/"), a % 50)))
    return RUNS.by_precedence(asked, docs, forms, n % 7 != 3)


def giant_sections(s, d):
    """Documents as sections of paragraphs, split beyond 800 characters."""
    one = F.array(F.struct(F.col("source").alias("name"), F.concat(F.lit("Top > "), "source").alias("path"), F.regexp_replace("text", "\n", "\n\n").alias("content")))
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.giants_split(one, 800)).alias("part", "x"))
    return rows.select("doc_id", "part", F.col("x.path").alias("path"), F.md5("x.content").alias("digest"))


QUERIES = {f.__name__: f for f in (
    search_fast, search_reranked, related_by_entity, related_by_concept, class_walk, class_walk_engineering, class_walk_back, related_relations, cursor_pages, packed_vectors, rollup_by_changes, supersede_all_heads,
    run_doses, run_routes, escalation_log, checkpoint_answers, ids_by_precedence, giant_sections,
)}

LIST = "', '".join
MERGED = f"""{BM25.format(n='{n}')}, {NEAR.format(q=7, k='{n}')}, m AS (SELECT coalesce(p.doc_id, n.vec_id) AS doc_id, round(0.6 * coalesce(round(s, 6), 0) + 0.4 * coalesce(round(bm25, 6), 0), 6) AS score FROM page p FULL JOIN near n ON p.doc_id = n.vec_id),
    r AS (SELECT doc_id, source, text, score, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1 ELSE 2 END AS tier FROM m JOIN documents USING (doc_id) WHERE lang IS NULL OR trim(lang) = '' OR lower(lang) IN ('{LIST(SOFT)}'))"""
TOP = "SELECT doc_id, CAST(row_number() OVER (ORDER BY tier DESC, score DESC, doc_id) AS INTEGER) AS place, {score} AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier DESC, score DESC, doc_id) AS p FROM {rows}) WHERE p <= 2 ORDER BY place LIMIT 10"
LINES = r"l AS (SELECT doc_id, unnest(string_split_regex(text, '\n+')) AS content FROM documents), k AS (SELECT * FROM l WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> '')"
CLASS_EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'SUPPORT' AS label FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'EXTEND' FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'QUALIFY' FROM supplier
    UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'REFUTE' FROM nation UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey // 2), 'ENG_DEPENDS_ON' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey * 2), 'ENG_SATISFIES' FROM customer WHERE c_custkey < 40)"""
WALK = "w AS (SELECT {b} AS id, 1 AS hops FROM edges WHERE {a} = '{start}' AND {labels} UNION SELECT {b}, hops + 1 FROM w JOIN edges ON {a} = id WHERE hops < {hops} AND {labels})"
REACHED = "SELECT id, hops, {cycle} AS cycle_detected, n > {most} AS truncated FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY hops, id) AS p FROM (SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w WHERE id <> '{start}' GROUP BY id HAVING min(hops) >= {least})) WHERE p <= {most}"
EPISTEMIC, ENGINEERING = "label NOT LIKE 'ENG%'", "label LIKE 'ENG%'"
ORACLE_SQL = {
    "search_fast": f"WITH {MERGED.format(n=50)}, f2 AS (SELECT * FROM r WHERE source IN ('{LIST(SOURCES)}')) {TOP.format(rows='f2', score='round(score, 4)')}",
    "search_reranked": f"""WITH {MERGED.format(n=50)}, b AS (SELECT doc_id, source, 2 AS tier, round(len(regexp_extract_all(text, '[aeiou]')) / greatest(length(text), 1), 6) AS score FROM (SELECT * FROM r ORDER BY tier DESC, score DESC, doc_id LIMIT 15)),
        f2 AS (SELECT * FROM b WHERE source IN ('{LIST(SOURCES)}')) {TOP.format(rows='f2', score='score')}""",
    "related_by_entity": f"""WITH {LINES}, e AS (SELECT doc_id, count(*) AS chunks FROM k WHERE list_contains(list_filter(string_split_regex(lower(content), '[^a-z]+'), lambda x: length(x) >= 4), 'thnd') GROUP BY doc_id)
        SELECT doc_id, chunks FROM e JOIN documents USING (doc_id) WHERE source <> 'src0' ORDER BY chunks DESC, n_chars DESC, doc_id LIMIT 20""",
    "related_by_concept": f"""WITH {LINES}, e AS (SELECT doc_id, count(*) AS chunks FROM k WHERE contains(lower(array_to_string(string_split(content, ' ')[1:3], ' ')), 'the ') GROUP BY doc_id)
        SELECT doc_id, chunks FROM e JOIN documents USING (doc_id) ORDER BY chunks DESC, n_chars DESC, doc_id LIMIT 20""",
    "class_walk": f"WITH RECURSIVE {CLASS_EDGES}, {WALK.format(a='src', b='dst', start='c7', hops=4, labels=EPISTEMIC)} {REACHED.format(cycle='false', most=60, start='c7', least=2)}",
    "class_walk_engineering": f"WITH RECURSIVE {CLASS_EDGES}, {WALK.format(a='src', b='dst', start='c3', hops=4, labels=ENGINEERING)} {REACHED.format(cycle='EXISTS (SELECT 1 FROM w WHERE id = ' + chr(39) + 'c3' + chr(39) + ')', most=200, start='c3', least=1)}",
    "class_walk_back": f"WITH RECURSIVE {CLASS_EDGES}, {WALK.format(a='dst', b='src', start='r1', hops=2, labels=EPISTEMIC)} {REACHED.format(cycle='false', most=200, start='r1', least=1)}",
    "related_relations": """WITH o AS (SELECT 'o' || o_orderkey AS id, 'c' || (o_custkey % 40) AS source, CASE WHEN o_orderkey % 9 = 0 THEN 'run:' ELSE 'c' END || (o_orderkey % 60) AS target, CASE o_orderstatus WHEN 'F' THEN 'support' WHEN 'O' THEN 'refute' ELSE 'extend' END AS relation,
            CASE o_orderkey % 4 WHEN 0 THEN 'engineering' WHEN 1 THEN 'epistemic' END AS class, CASE WHEN o_orderkey % 11 = 0 THEN 'o' || (o_orderkey - 1) END AS older FROM orders),
        a AS (SELECT *, count(*) OVER () > 500 AS truncated, row_number() OVER (ORDER BY id) AS p FROM o WHERE (source = 'c9' OR target = 'c9') AND coalesce(class, 'epistemic') = 'epistemic'), b AS (SELECT * FROM a WHERE p <= 500 AND source = 'c9')
        SELECT 'relation' AS kind, id, relation, target AS other, false AS superseded, 1 AS members, truncated FROM b WHERE id NOT IN (SELECT older FROM o WHERE older IS NOT NULL)
        UNION ALL SELECT DISTINCT 'claim', target, NULL, NULL, false, 1, truncated FROM b WHERE target NOT LIKE 'run:%' AND CAST(target[2:] AS INTEGER) % 7 <> 1""",
    "cursor_pages": """WITH k AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders), p AS (SELECT * FROM k WHERE ts < TIMESTAMP '1996-01-02' OR (ts = TIMESTAMP '1996-01-02' AND o_orderkey < 5000) ORDER BY ts DESC, o_orderkey DESC LIMIT 26)
        SELECT o_orderkey, replace(replace(replace(to_base64(CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '|' || o_orderkey AS BLOB)), '+', '-'), '/', '_'), '=', '') AS cursor, (SELECT count(*) FROM p) > 25 AS more FROM (SELECT * FROM p ORDER BY ts DESC, o_orderkey DESC LIMIT 25)""",
    "packed_vectors": "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, true AS same, 'emb:m:64:' || sha256(CAST(vec_id AS VARCHAR)) AS key FROM embeddings",
    "rollup_by_changes": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE NOT (l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) > 25) GROUP BY 1, 2",
    "supersede_all_heads": """WITH RECURSIVE t AS (SELECT conv_id || '-' || turn AS id, CASE WHEN EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1) THEN conv_id || '-' || (turn - 1) END AS supersedes FROM conversations a),
        w AS (SELECT id, id AS head, 0 AS hops FROM t UNION ALL SELECT w.id, t.id, hops + 1 FROM w JOIN t ON t.supersedes = w.head) SELECT id, head, hops FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.supersedes = w.head)""",
    "run_doses": """WITH c AS (SELECT n_regionkey AS cycle, n_nationkey % 5 AS stage, min((n_name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END)) AS m FROM nation GROUP BY 1, 2),
        e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 7 WHEN 1 THEN NULL ELSE event_id % 5 END AS cycle, user_id % 6 AS stage FROM events)
        SELECT event_id, c.cycle IS NOT NULL AS found, CAST(c.stage AS BIGINT) AS dose_stage, m[1] AS operations, CAST(m[2] AS INTEGER) AS beacons, CASE WHEN c.cycle IS NOT NULL THEN 0 END AS counters FROM e LEFT JOIN c USING (cycle, stage)""",
    "run_routes": r"""SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 2) THEN 'diagnose' WHEN length(text) % 2 = 0 OR (role IS DISTINCT FROM 'user' AND regexp_matches(left(text, 3), '[^\s]')) THEN 'checkpoint' ELSE 'ask' END AS route FROM conversations""",
    "escalation_log": """WITH e AS (SELECT 'u' || user_id AS credential_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS review, event_type AS issue, ts FROM events WHERE event_type IN ('error', 'click')),
        t AS (SELECT *, 'esc_' || left(sha256(credential_id || '|' || coalesce(review, '') || '|' || issue || '|k'), 20) AS ticket FROM e)
        SELECT ticket, credential_id, CASE WHEN review IS NULL THEN 'open' ELSE 'resolved' END AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS at FROM t GROUP BY 1, 2, 3""",
    "checkpoint_answers": """WITH o AS (SELECT md5((o_custkey % 50) || '|' || o_orderstatus) AS h, o_orderdate AS d, o_orderkey AS r FROM orders), s AS (SELECT h, arg_min(r, (d, r)) AS r FROM o WHERE r % 100 = 0 GROUP BY h), n AS (SELECT h, count(*) AS asked, arg_min(r, (d, r)) AS first FROM o WHERE r % 100 <> 0 GROUP BY h)
        SELECT h AS handin_hash, asked, coalesce(s.r, first) AS response, coalesce(s.r, first) AS same, CASE WHEN s.r IS NULL THEN 1 ELSE 0 END AS created FROM n LEFT JOIN s USING (h)""",
    "ids_by_precedence": """WITH v AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3), a AS (SELECT doc_id AS ask FROM labels),
        m AS (SELECT ask, doc_id, 0 AS p, 'short' AS kind FROM a JOIN v ON ask % 5 = 0 AND doc_id = ask UNION ALL SELECT ask, doc_id, 1, 'arxiv' FROM a JOIN v ON ask % 4 = 0 AND doc_id = ask + 1
            UNION ALL SELECT ask, doc_id, 2, 'doi' FROM a JOIN v ON ask % 4 = 1 AND doc_id = ask UNION ALL SELECT ask, doc_id, 3, 'dblp' FROM a JOIN v ON ask % 3 = 0 AND doc_id % 50 = ask % 50)
        SELECT ask, doc_id, kind FROM m QUALIFY row_number() OVER (PARTITION BY ask ORDER BY p, doc_id) = 1""",
}
