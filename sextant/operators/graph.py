"""Claim-graph operators: traversal, equivalence clusters, supersede chains, run status, record checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sextant.operators.relations import elected
from sextant.operators.shared import connected_components, materialize


def traverse(edges: DataFrame, start: list, hops: int = 6, direction: str = "out", most: int = 200) -> DataFrame:
    """edges(src, dst) -> (id, hops) reachable, nearest first, at most `most` and one more, which tells that there were more.

    A frontier join per hop. Nodes leave the frontier once reached, so cycles end and hot nodes are expanded once.
    """
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("id")).distinct()
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    front = spark.createDataFrame([(s,) for s in start], StructType([StructField("id", kind)]))
    seen = front.select("id", F.lit(0).alias("hops"))
    for h in range(1, hops + 1):
        front = front.join(step, front["id"] == step["at"]).select(step["id"]).distinct().join(seen.select("id"), "id", "left_anti")
        front = materialize(front, files=8)
        if front.isEmpty():
            break
        seen = seen.unionAll(front.select("id", F.lit(h).alias("hops")))
    return seen.where("hops > 0").orderBy("hops", "id").limit(most + 1)


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, loops aside."""
    both = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("other")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other")))
    return both.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def clusters(edges: DataFrame) -> DataFrame:
    """(id, cluster): equivalence clusters of two or more; the cluster is its smallest member."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.select(F.col("node").alias("id"), F.col("root").alias("cluster"))


def collapsed(records: DataFrame, member: DataFrame, rule: str) -> DataFrame:
    """One record a cluster by an election rule, with the cluster's size; records of no cluster stand alone."""
    rows = records.join(member, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return elected(rows, "cluster", rule).join(size, "cluster")


def superseded(records: DataFrame) -> DataFrame:
    """records(id, supersedes) -> (id, newer, ambiguous): by how many and whether more than one newer record names it."""
    newer = records.where("supersedes is not null").groupBy(F.col("supersedes").alias("old")).agg(F.count(F.lit(1)).alias("newer"), F.min("id").alias("first"))
    return records.join(newer, records["id"] == newer["old"], "left").select("id", F.coalesce("newer", F.lit(0)).cast("long").alias("newer"), "first", (F.coalesce("newer", F.lit(0)) > 1).alias("ambiguous"))


def heads(records: DataFrame, hops: int | None = 8) -> DataFrame:
    """(id, head, hops): the records at the end of each record's chain of newer ones, forks giving several; up to `hops` newer ones away, None: any number.

    A record names at most one older one, so seen from its heads a tree is a set of paths. Older records 1, 2, 4, ... steps away are found by joining each such table with itself;
    a head then meets each record of its path once, by the powers of two that make up the distance. So there are as many joins as the longest chain has binary digits, and rows
    as there are in the result. A record on a cycle, and one whose newer ones all lead into it, has no head.
    """
    older = records.where("supersedes is not null").select(F.col("id").alias("node"), F.col("supersedes").alias("to")).distinct()
    known = records.select("id").distinct()
    newest = known.join(older.select(F.col("to").alias("id")).distinct(), "id", "left_anti")
    if hops is None:
        around = on_cycles(older)
        known = known.join(around, "id", "left_anti")
        older = older.join(around.withColumnRenamed("id", "node"), "node", "left_anti")
    tables = jumps(older, None if hops is None else hops.bit_length())
    walk = newest.select(F.col("id").alias("head"), F.col("id").alias("at"), F.lit(0).alias("hops"))
    for k in range(len(tables) - 1, -1, -1):
        far = walk.join(tables[k].withColumnRenamed("node", "at"), "at").select("head", F.col("to").alias("at"), (F.col("hops") + (1 << k)).alias("hops"))
        walk = materialize(walk.unionAll(far if hops is None else far.where(F.col("hops") <= hops)))
    return walk.join(known.withColumnRenamed("id", "at"), "at").select(F.col("at").alias("id"), "head", "hops").distinct()


def jumps(step: DataFrame, most: int | None = None) -> list[DataFrame]:
    """step(node, to) -> tables of what lies 1, 2, 4, ... steps away, until one is empty or there are `most`. Without `most` there must be no cycle."""
    out = []
    while most is None or len(out) < most:
        step = materialize(step)
        if step.isEmpty():
            break
        out.append(step)
        step = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")).distinct()
    return out


def on_cycles(step: DataFrame) -> DataFrame:
    """step(node, to), one `to` for each node -> (id) of the nodes on cycles. After as many steps as there are nodes, only cycles are left to stand on, and all of their nodes are stood on;
    so many steps take as many joins as their number has binary digits."""
    step = materialize(step.select("node", "to").distinct())
    for _ in range(step.count().bit_length()):
        step = materialize(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
        if step.isEmpty():
            break
    return step.select(F.col("to").alias("id")).distinct()


def in_reach(asked: DataFrame, step: DataFrame) -> DataFrame:
    """asked(a, b), step(node, to) -> (a, b) of the pairs where one or more steps lead from a to b, however many.

    Where each node has one `to`, by doubling: cycles are cut at their smallest node, depths and roots of the trees that remain are found in logarithmic rounds, and a pair climbs the difference
    of its depths by powers of two; a way through the cut is a second climb from behind it. Where nodes fork, sets of what is reached grow step by step until nothing is new, for the asked nodes only.
    """
    pairs = materialize(asked.select("a", "b").where("a is not null and b is not null").distinct())
    step = materialize(step.select("node", "to").where("node is not null and to is not null").distinct())
    if not step.groupBy("node").count().where("count > 1").isEmpty():
        return _reached_by_sets(pairs, step)
    around = step.join(on_cycles(step).withColumnRenamed("id", "node"), "node", "left_semi")
    cut = materialize(_smallest_around(around))
    tree = materialize(step.join(cut.select(F.col("rep").alias("node")), "node", "left_anti"))
    tables, place = jumps(tree), _depths(tree)
    climbed = lambda p: _climbed(p, tables, place)
    # a way that passes the cut: from a to its tree's root, over the cut edge, and up again to b
    over = pairs.join(place.select(F.col("node").alias("a"), F.col("root").alias("rep")), "a", "left").withColumn("rep", F.coalesce("rep", "a")).join(cut, "rep")
    again = over.select("a", "b", F.col("behind").alias("c"))
    from_cut = climbed(again.select(F.col("c").alias("a"), "b").distinct()).select(F.col("a").alias("c"), "b")
    return climbed(pairs).unionAll(again.join(from_cut, ["c", "b"]).select("a", "b")).unionAll(again.where("c = b").select("a", "b")).distinct()


def _reached_by_sets(pairs: DataFrame, step: DataFrame) -> DataFrame:
    front = seen = pairs.select("a", F.col("a").alias("at")).distinct()
    found = None
    while True:
        met = front.join(step.withColumnRenamed("node", "at"), "at").select("a", F.col("to").alias("at")).distinct()
        found = met if found is None else found.unionAll(met)
        front = materialize(met.join(seen, ["a", "at"], "left_anti"))
        if front.isEmpty():
            return pairs.join(found.withColumnRenamed("at", "b").distinct(), ["a", "b"])
        seen = seen.unionAll(front)


def _smallest_around(around: DataFrame) -> DataFrame:
    """The edges of cycles -> (rep, behind): each cycle's smallest node, and where its edge leads."""
    far, rounds = around.withColumn("least", F.least("node", "to")), around.count().bit_length()
    for _ in range(rounds):
        next_ = far.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("least").alias("more"))
        far = materialize(far.join(next_, "to").select("node", F.col("far").alias("to"), F.least("least", "more").alias("least")))
    return far.where("node = least").select(F.col("node").alias("rep")).join(around.select(F.col("node").alias("rep"), F.col("to").alias("behind")), "rep")


def _depths(tree: DataFrame) -> DataFrame:
    """(node, root, depth) of the nodes that have a step, by looking up twice as far each round."""
    far = tree.select("node", F.col("to").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = far.select(F.col("node").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        far = materialize(far.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")))
        if far.where("moved").isEmpty():
            return far.select("node", "root", "depth")
        far = far.drop("moved")


def _climbed(pairs: DataFrame, tables: list[DataFrame], place: DataFrame) -> DataFrame:
    """The pairs where b stands above a in a tree."""
    depth = lambda c: place.select(F.col("node").alias(c), F.col("depth").alias(f"d{c}"))
    rows = pairs.join(depth("a"), "a").join(depth("b"), "b", "left").withColumn("left", F.col("da") - F.coalesce("db", F.lit(0))).where("left > 0")
    rows = rows.select("a", "b", "left", F.col("a").alias("at"))
    for k, table in enumerate(tables):
        bit = F.expr(f"(left >> {k}) & 1 = 1")
        moved = rows.where(bit).join(table.withColumnRenamed("node", "at"), "at").select("a", "b", "left", F.col("to").alias("at"))
        rows = materialize(rows.where(~bit).unionAll(moved))
    return rows.where("at = b").select("a", "b")


# The relations of each class, the caps of reads, and what a process record's id begins with.
CLASS_LABELS = {"epistemic": ("SUPPORT", "EXTEND", "QUALIFY", "REFUTE", "BACKGROUND", "SHARED_EVIDENCE", "SAME_AS"), "engineering": ("ENG_DEPENDS_ON", "ENG_SATISFIES")}
MOST_HOPS, MOST_REACHED, MOST_READ, PROCESS = 6, 200, 500, r"^(run|intent|decision|journal):"
# end of fixed values


def class_labels(relation_class: str, subtype: str | None = None) -> tuple[str, ...]:
    """The labels of a class, or the one of a subtype if it belongs to the class."""
    if subtype is None:
        return CLASS_LABELS[relation_class]
    core = re.sub(r"^_+|_+$", "", re.sub("[^A-Z0-9_]", "_", subtype.upper())) or "RELATED"
    label = f"ENG_{core}" if relation_class == "engineering" else core
    return tuple(x for x in (label,) if x in CLASS_LABELS[relation_class])


def class_traverse(edges: DataFrame, start: str, relation_class: str = "epistemic", direction: str = "out", hops: int = 3, subtype: str | None = None, least: int = 1, most: int = MOST_REACHED) -> DataFrame:
    """edges(src, dst, label) -> (id, hops, cycle_detected, truncated): what `least` to `hops` hops over relations of one class lead to, by the fewest hops.

    The walk is one frontier join per hop, of which there are MOST_HOPS at most; a node leaves the frontier once reached, so hot nodes are expanded once and cycles end. (Recursion in SQL has UNION ALL
    only, which follows every path.) cycle_detected: an engineering walk comes back to its start; truncated: more than `most` were reached. Labels of different classes never mix. A process record, or a subtype of another class, reaches nothing.
    """
    labels = class_labels(relation_class, subtype)
    schema = "id string, hops int, cycle_detected boolean, truncated boolean"
    if not labels or re.match(PROCESS, start):
        return edges.sparkSession.createDataFrame([], schema)
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    step = edges.where(F.col("label").isin(*labels)).select(F.col(a).alias("at"), F.col(b).alias("id")).distinct()
    front = edges.sparkSession.createDataFrame([(start,)], "id string")
    seen, home = front.select("id", F.lit(0).alias("hops")), F.lit(False)
    for h in range(1, max(1, min(MOST_HOPS, hops)) + 1):
        met = front.join(step, front["id"] == step["at"]).select(step["id"]).distinct()
        met = materialize(met)
        if relation_class == "engineering" and not met.where(F.col("id") == start).isEmpty():
            home = F.lit(True)
        front = materialize(met.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionAll(front.select("id", F.lit(h).alias("hops")))
    best = seen.where(F.col("hops") >= F.lit(max(1, least))).orderBy("hops", "id").limit(most + 1)
    place = F.row_number().over(Window.partitionBy().orderBy("hops", "id"))  # most + 1 rows
    best = best.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy()), "place": place}).where(F.col("place") <= most)
    return best.select("id", F.col("hops").cast("int").alias("hops"), home.alias("cycle_detected"), (F.col("n") > most).alias("truncated"))


def related_records(relations: DataFrame, claims: DataFrame, start: str, relation_class: str = "epistemic", direction: str | None = None, subtype: str | None = None, latest: bool = False, member: DataFrame | None = None, most: int = MOST_READ) -> DataFrame:
    """relations(id, source, target, relation, relation_class, supersedes), claims(id, supersedes) -> (kind, id, relation, other, superseded, members, truncated): the relations at a
    claim and the claims at their other ends.

    A relation without a class is epistemic; 'all' takes every class. Of the relations of the class the first `most` by id are read, and truncated tells that there were more; direction and subtype choose among
    these. Ends that are process records are left out. superseded is derived from what names a record as the one before it; latest leaves such records out. With member(id, cluster), equal claims are one: the smallest
    id stands for them and members counts those met.
    """
    around = relations.where((F.col("source") == start) | (F.col("target") == start))
    if relation_class != "all":
        around = around.where(F.coalesce("relation_class", F.lit("epistemic")) == relation_class)
    if re.match(PROCESS, start):
        around = around.limit(0)
    read = around.orderBy("id").limit(most + 1)
    order = Window.partitionBy().orderBy("id")  # most + 1 rows
    read = read.withColumns({"place": F.row_number().over(order), "truncated": F.count(F.lit(1)).over(Window.partitionBy()) > most}).where(F.col("place") <= most)
    if direction:
        read = read.where(F.col("source" if direction == "out" else "target") == start)
    if subtype:
        read = read.where(F.col("relation") == subtype)
    read = read.withColumn("other", F.when(F.col("source") == start, F.col("target")).otherwise(F.col("source")))
    newer = lambda rows: rows.where("supersedes is not null").select(F.col("supersedes").alias("id"), F.lit(True).alias("superseded")).distinct()
    edges = read.select("id", "relation", "other", "truncated").join(newer(relations), "id", "left")
    ends = read.where(~F.col("other").rlike(PROCESS)).select(F.col("other").alias("id"), "truncated").distinct()
    ends = ends.join(claims.select("id"), "id", "left_semi").join(newer(claims), "id", "left")
    flag = F.coalesce("superseded", F.lit(False)).alias("superseded")
    edges, ends = edges.select("id", "relation", "other", flag, "truncated"), ends.select("id", flag, "truncated")
    if latest:
        edges, ends = edges.where("not superseded"), ends.where("not superseded")
    count = F.lit(1).cast("long").alias("members")
    if member is not None:
        named = ends.join(member, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
        ends = named.groupBy("cluster").agg(F.min(F.struct("id", "superseded", "truncated")).alias("r"), F.count(F.lit(1)).alias("members")).select("r.*", "members")
    else:
        ends = ends.withColumn("members", count)
    nothing = F.lit(None).cast("string")
    return edges.select(F.lit("relation").alias("kind"), "id", "relation", "other", "superseded", count, "truncated").unionByName(ends.select(F.lit("claim").alias("kind"), "id", nothing.alias("relation"), nothing.alias("other"), "superseded", "members", "truncated"))


def run_status(events: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Of each run's last event: done, then paused, then abandoned after `days` without one, else active."""
    last = events.groupBy("run_id").agg(F.max(F.struct("ts", "event")).alias("x"), F.max((F.col("event") == "done").cast("int")).alias("done"))
    idle = F.datediff(now, F.col("x.ts")) > days
    return last.select("run_id", F.when(F.col("done") == 1, "done").when(F.col("x.event") == "paused", "paused").when(idle, "abandoned").otherwise("active").alias("status"))


def issues(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules a record breaks; a rule that can't be told counts as broken."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))))


def projection_text(claims: DataFrame, edges: DataFrame, most: int = 160) -> DataFrame:
    """A claim's text with a line for each related claim, in order of direction, relation and id."""
    short = lambda c: F.left(c, F.lit(most))
    texts = claims.select("id", "text")
    out = edges.join(texts.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.lit(0).alias("d"), "label", F.col("dst").alias("o"), F.concat(F.col("label"), F.lit(": "), short(F.col("text"))).alias("line"))
    into = edges.join(texts.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.lit(1).alias("d"), "label", F.col("src").alias("o"), F.concat(F.lit("by "), F.col("label"), F.lit(": "), short(F.col("text"))).alias("line"))
    lines = out.unionAll(into).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "label", "o", "line"))), lambda x: x["line"]), "\n").alias("around"))
    return claims.join(lines, "id", "left").select("id", F.concat_ws("\n", short(F.col("text")), "around").alias("projection"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def cycles_through(edges: DataFrame, start: DataFrame, hops: int = 6) -> DataFrame:
    """start(id) -> (id, cycle_hops): the least number of hops from which a walk from the node comes back to it, null if none of up to `hops` does."""
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    walk, found = start.select(F.col("id").alias("start"), F.col("id").alias("at")), None
    for h in range(1, hops + 1):
        walk = materialize(walk.join(step, "at").select("start", F.col("to").alias("at")).distinct())
        back = walk.where("start = at").select("start", F.lit(h).alias("h"))
        found = back if found is None else found.unionAll(back)
        walk = walk.where("start <> at")
    return start.join(found.groupBy(F.col("start").alias("id")).agg(F.min("h").alias("cycle_hops")), "id", "left")


def corrected_by(relations: DataFrame) -> DataFrame:
    """relations(source, target, correction) -> (id, corrected_by): the sources of correcting relations to a claim, process records left out."""
    kept = relations.where(F.col("correction") & ~F.col("source").rlike("^(run|intent|decision|journal):"))
    return kept.groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_set("source")).alias("corrected_by"))


def record_view(records: DataFrame, ids: DataFrame, corrections: DataFrame, heads: DataFrame) -> DataFrame:
    """Scientific records by id(id), with who corrected them and what superseded them (id, superseded_by)."""
    found = records.where(F.col("record_type").isin("claim", "relation", "activity", "metric", "bundle")).join(ids.select("id").distinct(), "id", "left_semi")
    claim = F.col("record_type") == "claim"
    out = found.join(corrections, "id", "left").join(heads.groupBy("id").agg(F.sort_array(F.collect_set("superseded_by")).alias("superseded_by")), "id", "left")
    return out.withColumns({"corrected_by": F.when(claim, F.col("corrected_by")), "superseded_by": F.when(claim, F.col("superseded_by"))})


def latest_only(records: DataFrame, superseded: DataFrame) -> DataFrame:
    return records.join(superseded.select("id"), "id", "left_anti")


def convergence(run_a: Column, run_b: Column) -> Column:
    """Two records of one run are an erratum, of two runs convergent."""
    return F.when(run_a.eqNullSafe(run_b), "erratum").otherwise("convergent")
