"""Chat formatting with DataFrame functions only: tool-call linking, ordering, argument checks, canonical JSON.

Input are calls (conv_id, call_id, turn, name, arguments as JSON) and results (conv_id, call_id, turn, content). Calls and
results are hash-joined on (conv_id, call_id); each side has one row per identifier first (the earliest
turn, then the smallest content, wins; the number of rows is kept as `repeats`), so a repeated identifier can't multiply rows.

Arguments may refer to results, as {"$result": identifier}, anywhere in them. Order is topological: a call stands after all results it refers to, a result
after its call. Each call starts at (its turn, 0); rounds of joins move calls behind the results they refer to until nothing
moves, so there are as many rounds as the longest chain of references against the order of turns is long, one where there is none, and no window
over a conversation: conversations of any length spread over tasks. Calls in a cycle of references are named as such and keep the place they have; references to no call are named too.
Arguments are checked against the tool's schema (required fields, types), canonical JSON has sorted keys, no blanks, and
no null members. Null identifiers never link; null conv_id or turn are kept as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.shared import materialize

REFERENCE = r'"\$result"\s*:\s*"([^"\\]*)"'
#: Tool -> field -> (JSON type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]
JSON_TYPES = {"string": r'^"', "integer": r"^-?\d+$", "number": r"^-?\d", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\["}


def parsed(arguments: Column) -> Column:
    """The members of a JSON object as map<string, variant-as-JSON>; null if it is none."""
    members = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string, variant>")
    return F.transform_values(members, lambda _, v: F.to_json(v))


def canonical_object(members: Column) -> Column:
    """A map of JSON texts as an object with sorted keys; members that are null go."""
    kept = F.map_filter(members, lambda _, v: v.isNotNull() & (v != "null"))
    pairs = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(quoted(k), F.lit(":"), kept[k]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string literal."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def problems(name: Column, members: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments, as a sorted array of texts."""
    unknown = F.array(F.lit("unknown tool"))
    found = F.when(F.lit(False), unknown)
    for tool, fields in sorted(schemas.items()):
        tests = [F.when(members.isNull(), F.lit("not an object"))]
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_element_at(members, F.lit(field))
            missing = value.isNull() | (value == "null")
            if required:
                tests.append(F.when(members.isNotNull() & missing, F.lit(f"{field}: missing")))
            tests.append(F.when(~missing & ~value.rlike(JSON_TYPES[kind]), F.lit(f"{field}: not {kind}")))
        extra = F.transform(F.filter(F.coalesce(F.map_keys(members), F.array().cast("array<string>")), lambda k: ~k.isin(*fields)), lambda k: F.concat(k, F.lit(": unknown")))
        found = found.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*tests)), extra)))
    return found.otherwise(unknown)


def placed(both: DataFrame) -> DataFrame:
    """both(conv_id, call_id, turn, result_turn, refs) -> (conv, call, major, minor, cyclic, unknown): each call's place behind the results it
    refers to, and the references to no call. Only calls that moved in a round can move others in the next."""
    edges = materialize(both.where("size(refs) > 0").select("conv_id", "call_id", F.explode("refs").alias("ref")))
    at = both.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("call"), F.col("turn").alias("major"), F.lit(0).alias("minor"), F.lit(False).alias("cyclic"), F.array().cast("array<string>").alias("unknown"))
    if edges.isEmpty():
        return at
    ends = both.select("conv_id", F.col("call_id").alias("ref"), "result_turn")
    missing = edges.alias("e").join(ends.alias("t"), F.expr("e.conv_id <=> t.conv_id and e.ref = t.ref"), "left_anti")
    unknown = missing.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("ref")).alias("none"))
    state = materialize(both.select("conv_id", "call_id", "result_turn", F.col("turn").alias("major"), F.lit(0).alias("minor"), F.lit(False).alias("cyclic"), F.array().cast("array<string>").alias("path")))
    fresh = state
    while True:
        # a result stands at its own turn, or right behind its call
        late = F.col("result_turn") > F.col("major")
        given = fresh.where("not cyclic").select(F.col("conv_id").alias("c"), F.col("call_id").alias("r"), F.when(late, F.col("result_turn")).otherwise(F.col("major")).alias("m"), F.when(late, 1).otherwise(F.col("minor") + 1).alias("n"), F.array_append("path", F.col("call_id")).alias("p"))
        bound = edges.join(given.hint("shuffle_hash"), F.expr("conv_id <=> c and ref = r")).groupBy("conv_id", "call_id").agg(F.max(F.struct("m", F.expr("n + 1").alias("n"), "p")).alias("to"))
        bound = bound.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "to")
        moves = state.join(bound.hint("shuffle_hash"), F.expr("conv_id <=> c and call_id = i")).where("not cyclic and (to.m > major or (to.m = major and to.n > minor))")
        moved = materialize(moves.select("conv_id", "call_id", "result_turn", F.expr("array_contains(to.p, call_id)").alias("cyclic"), F.col("to.m").alias("major"), F.col("to.n").alias("minor"), F.col("to.p").alias("path")))
        if moved.isEmpty():
            break
        kept = state.alias("s").join(moved.alias("m"), F.expr("s.conv_id <=> m.conv_id and s.call_id = m.call_id"), "left_anti")
        state, fresh = materialize(kept.unionByName(moved)), moved
    out = state.alias("s").join(unknown.alias("u"), F.expr("s.conv_id <=> u.conv_id and s.call_id = u.call_id"), "left")
    return out.select(F.col("s.conv_id").alias("conv"), F.col("s.call_id").alias("call"), "major", "minor", "cyclic", F.coalesce("none", F.array().cast("array<string>")).alias("unknown"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, major, minor, kind, linked, repeats, problems, json), a row per identifier and side; by (conv_id, major, minor, call_id) the
    rows stand in topological order."""
    first = lambda df, *rest: df.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *rest)).alias("x"), F.count(F.lit(1)).alias("repeats"))
    asked = first(calls.where("call_id is not null"), "name", "arguments").select("conv_id", "call_id", F.col("x.turn").alias("turn"), F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"), "repeats")
    given = first(results.where("call_id is not null"), "content").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("x.turn").alias("result_turn"), F.col("x.content").alias("content"), F.col("repeats").alias("result_repeats"))
    both = asked.join(given.hint("shuffle_hash"), F.expr("conv_id <=> c and call_id = i"), "full_outer")
    members = parsed(F.col("arguments"))
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(REFERENCE), F.lit(1)))
    both = both.select(F.coalesce("conv_id", "c").alias("conv_id"), F.coalesce("call_id", "i").alias("call_id"), "turn", "name", members.alias("members"), "repeats", "result_turn", "content", "result_repeats", F.col("call_id").isNotNull().alias("called"), F.col("i").isNotNull().alias("answered"), refs.alias("refs"))
    both = materialize(both)  # read for the places and for the rows
    places = placed(both.where("called").select("conv_id", "call_id", "turn", "result_turn", "refs"))
    both = both.join(places.hint("shuffle_hash"), F.expr("conv_id <=> conv and call_id = call"), "left")
    wrong = F.concat(problems(F.col("name"), F.col("members"), schemas), F.transform("unknown", lambda r: F.concat(r, F.lit(": no such call"))), F.when(F.col("cyclic"), F.array(F.lit("in a cycle of references"))).otherwise(F.array().cast("array<string>")))
    late = F.col("result_turn") > F.col("major")
    member = lambda k, v: (F.lit(k), v)
    call_json = canonical_object(F.create_map(*member("id", quoted(F.col("call_id"))), *member("name", F.coalesce(quoted(F.col("name")), F.lit("null"))), *member("arguments", F.coalesce(canonical_object(F.col("members")), F.lit("null")))))
    result_json = canonical_object(F.create_map(*member("call_id", quoted(F.col("call_id"))), *member("content", F.coalesce(quoted(F.col("content")), F.lit("null")))))
    none = F.array().cast("array<string>")
    sides = F.array_compact(F.array(
        F.when(F.col("called"), F.struct(F.col("major").alias("major"), F.col("minor").alias("minor"), F.lit("call").alias("kind"), F.col("answered").alias("linked"), F.col("repeats").alias("repeats"), wrong.alias("problems"), call_json.alias("json"))),
        F.when(F.col("answered"), F.struct(F.when(late | F.col("major").isNull(), F.col("result_turn")).otherwise(F.col("major")).alias("major"), F.when(late | F.col("major").isNull(), 1).otherwise(F.col("minor") + 1).alias("minor"), F.lit("result").alias("kind"), F.col("called").alias("linked"), F.col("result_repeats").alias("repeats"), F.when(F.col("called"), none).otherwise(F.array(F.lit("no call"))).alias("problems"), result_json.alias("json"))),
    ))
    return both.select("conv_id", "call_id", F.explode(sides).alias("s")).select("conv_id", "call_id", "s.*")


#: What the query's calls must look like.
REPLY: Schemas = {"reply": {"after": ("object", False), "prompt": ("string", True), "role": ("string", True), "turn": ("integer", True)}}


def op7_chat_tool_links(spark, sf_dir):
    """Each turn but the assistant's is a call of `reply` on its text; the assistant's turn after it is the result with the same identifier. From the third turn of
    a conversation (they count from 0) on, a call refers to the result two turns before. A null turn or conversation is one like any other."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ident = lambda turn: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("~")), F.lit("-"), F.coalesce(turn.cast("string"), F.lit("~")))
    asked = turns.where("not role <=> 'assistant'")
    after = F.when(F.col("turn") >= 2, F.struct(ident(F.col("turn") - 2).alias("$result")))
    args = F.to_json(F.struct(F.col("turn"), F.col("role"), F.col("text").alias("prompt"), after.alias("after")))
    calls = asked.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), args.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    found = link_calls(calls, results, REPLY)
    return found.withColumns({"problems": F.array_join("problems", "; "), "json_sha256": F.sha2("json", 256)})
