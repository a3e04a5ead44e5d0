"""Records: hash scopes, local names, guards, gates, result tables, chunk boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sextant.operators.graph import in_reach

Condition = tuple[list[str], str, str]  # (fields, field, value)


def hash_scope(columns: list[str], keep_when: list[Condition] = (), drop_when: list[Condition] = (), as_sets: list[str] = ()) -> Column:
    """The members of a record that identify it, as JSON text with sorted keys: absent ones go, some stay only when another field has a value, arrays
    that are sets are sorted. All columns as JSON values: strings, numbers, arrays of strings."""
    members = []
    for c in sorted(columns):
        value = F.array_sort(F.col(c)) if c in as_sets else F.col(c)
        gone = F.lit(False)
        for fields, other, wanted in keep_when:
            if c in fields:
                gone = gone | ~F.col(other).eqNullSafe(F.lit(wanted))
        for fields, other, wanted in drop_when:
            if c in fields:
                gone = gone | F.col(other).eqNullSafe(F.lit(wanted))
        members.append(F.when(~gone, value).alias(c))
    return F.to_json(F.struct(*members))  # null members are left out


def resolved_names(records: DataFrame) -> DataFrame:
    """records(bundle, local, refs array<string>, body) -> (bundle, local, id, problem): each record's id is a hash of its body and its references' ids, so
    references come first. Duplicates, unknown names and cycles are problems. A bundle is one author's submission, so it is one small group."""

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        known: dict[str, tuple[list[str], str]] = {}
        problem: dict[str, str] = {}
        for r in rows.itertuples():
            if r.local in known:
                problem[r.local] = "duplicate"
            known[r.local] = ([] if r.refs is None else list(r.refs), r.body or "")
        for name, (refs, _) in known.items():
            if any(x not in known for x in refs):
                problem.setdefault(name, "unresolved")
        ids: dict[str, str] = {}
        left = {n for n in known if n not in problem}
        while left:
            ready = sorted(n for n in left if all(x in ids for x in known[n][0]))
            if not ready:
                break
            for n in ready:
                refs, body = known[n]
                ids[n] = hashlib.sha256("\x1f".join([body, *(ids[x] for x in refs)]).encode()).hexdigest()
            left -= set(ready)
        for n in left:
            problem[n] = "cycle" if all(x in left or x in ids for x in known[n][0]) else "depends on a problem"
        names = sorted(known)
        return pd.DataFrame({"bundle": rows["bundle"].iloc[0], "local": names, "id": [ids.get(n) for n in names], "problem": [problem.get(n) for n in names]})

    return records.groupBy("bundle").applyInPandas(resolve, "bundle string, local string, id string, problem string")


def supersede_guards(asked: DataFrame, links: DataFrame) -> DataFrame:
    """asked(old, new, owner, old_owner, type, old_type), links(frm, to) -> asked with the sorted names of the guards it breaks. A cycle may have any length."""
    taken = links.select(F.col("to").alias("old")).distinct().withColumn("taken", F.lit(True))
    pairs = asked.select(F.col("old").alias("a"), F.col("new").alias("b")).distinct()
    loops = pairs.where("a = b").unionAll(in_reach(pairs, links.select(F.col("frm").alias("node"), "to")))
    loops = loops.select(F.col("a").alias("old"), F.col("b").alias("new")).distinct().withColumn("loop", F.lit(True))
    rows = asked.join(taken, "old", "left").join(loops, ["old", "new"], "left")
    broken = {"cycle": F.col("loop"), "ownership": ~F.col("owner").eqNullSafe(F.col("old_owner")), "set-once": F.col("taken"), "type": ~F.col("type").eqNullSafe(F.col("old_type"))}
    return rows.withColumn("violated", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())))).drop("taken", "loop")


def stage_gate(runs: DataFrame, events: DataFrame) -> DataFrame:
    """runs(run_id, stage), events(run_id, type, stage): which runs wait for the go of the stage before theirs."""
    go = events.where("type = 'go'").select("run_id", (F.col("stage") + 1).alias("stage"), F.lit(True).alias("go")).distinct()
    return runs.join(go, ["run_id", "stage"], "left").select("run_id", "stage", ((F.col("stage") > 1) & F.col("go").isNull()).alias("blocked"))


def language_gate(lang: Column, confidence: Column, least: float = 0.7) -> Column:
    """True where a text is surely in another language than English."""
    return F.coalesce(~lang.isin("en", "und") & (confidence >= least), F.lit(False))


def cost_key(tool: Column, args: Column) -> Column:
    """The price list's key of a call: tool, and what its price depends on. args is JSON text."""
    arg = lambda name, default: F.coalesce(F.get_json_object(args, f"$.{name}"), F.lit(default))
    dry = F.coalesce(F.get_json_object(args, "$.dry_run") == "true", F.lit(False))
    detail = F.get_json_object(args, "$.detail")
    with_ = lambda suffix: F.concat(tool, F.lit(":"), suffix)
    return (
        F.when(tool.isin("search", "search_semantic"), with_(arg("strategy", "fast"))).when(tool.isin("submit_document", "create_new_version") & dry, with_(F.lit("dry_run")))
        .when(tool == "submit_document", with_(arg("content_format", "latex"))).when(tool == "find_evidence", with_(arg("mode", "fast")))
        .when((tool == "compare_papers") & detail.eqNullSafe(F.lit("full")), with_(F.lit("full"))).when((tool == "find_methodology") & detail.eqNullSafe(F.lit("minimal")), with_(F.lit("minimal"))).otherwise(tool)
    )


#: Names of metrics in table headers.
METRICS = ["accuracy", "acc", "top-1", "top-5", "f1", "bleu", "rouge", "rouge-l", "map", "em", "exact match", "perplexity", "ppl", "auc", "precision", "recall", "wer", "cer", "meteor", "cider", "spice", "fid", "is", "ssim", "psnr"]
METRIC = r"(?i)(?<![a-z0-9])(?:" + "|".join(m.replace(" ", r"\s+") for m in sorted(METRICS, key=len, reverse=True)) + r")(?![a-z0-9])"
#: Fixed value: what stands for no dataset name.
STUB = r"(?i)^(?:table\s*\d*\s*[:.]?|not\s*specified|n\.?/?a\.?|unknown|none|[-–—]+)$"


def names_nothing(dataset: Column) -> Column:
    return (dataset == "") | dataset.rlike(STUB)


def score(cell: Column) -> Column:
    """The number that a cell begins with, once marks and commas go; null without one."""
    first = F.get(F.split(F.trim(F.regexp_replace(cell, "[*%±,]", "")), r"\s+"), F.lit(0))
    return F.nullif(F.regexp_extract(first, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def table_scores(tables: DataFrame, key: str = "table_id") -> DataFrame:
    """tables(key, caption, headers, rows) -> (key, task, dataset, metric, score): columns with a metric's name that hold numbers in half their cells or more."""
    found = lambda words: F.coalesce(F.nullif(F.array_position(F.transform("headers", lambda h: F.lower(h).rlike("|".join(words))), F.lit(True)), F.lit(0)), F.lit(0))
    t = tables.where((F.size("headers") >= 2) & (F.size("rows") > 0)).withColumns({"d": found(["dataset", "benchmark", "corpus", "data"]), "t": found(["task"])})
    t = t.withColumn("said", F.trim(F.regexp_replace(F.coalesce("caption", F.lit("")), r"(?i)^\s*table\s*\d*\s*[:.]?\s*", "")))
    cols = t.select("*", F.posexplode("headers").alias("i", "metric")).where((F.col("i") + 1 != F.col("d")) & (F.col("i") + 1 != F.col("t")) & F.col("metric").rlike(METRIC))
    cells = F.filter(F.transform("rows", lambda r: F.get(r, F.col("i"))), lambda c: c.isNotNull() & (F.trim(c) != ""))
    cols = cols.where((F.size(cells) > 0) & (F.size(F.filter(cells, lambda c: score(c).isNotNull())) >= 0.5 * F.size(cells)))
    out = cols.select(key, "i", F.trim("metric").alias("metric"), "d", "t", "said", F.posexplode("rows").alias("r", "row"))
    own = F.trim(F.coalesce(F.get("row", F.col("d") - 1), F.lit("")))
    dataset = F.when((F.col("d") > 0) & ~names_nothing(own), own).otherwise(F.col("said"))
    task = F.trim(F.coalesce(F.when(F.col("t") > 0, F.get("row", F.col("t") - 1)), F.lit("")))
    return out.select(key, task.alias("task"), dataset.alias("dataset"), "metric", score(F.get("row", F.col("i"))).alias("score")).where(F.col("score").isNotNull() & ~names_nothing(F.col("dataset")))


# What ends a sentence or a chunk, abbreviations that do not, how far back an end is looked for and how much must stay.
ABBREVIATION = r"(?i)(?:et\sal|Fig|Eq|Ref|Sec|Tab|Vol|vs|i\.e|e\.g|al|approx|resp)$"
SENTENCE_END, CHUNK_END, CLOSINGS = r"[.!?](?:\s|$)", r"[.!?:;)]\s*$", r"(\s*\\end\{[^}]+\}\s*)*$"
LOOK_BACK, LEAST_KEPT, ABBREVIATION_REACH = 300, 80, 8
# end of fixed values


def whole_part(text: str) -> str:
    """A text up to its last sentence end, where that leaves enough. Formula signs are placed once; how many stand before an end tells whether a formula is open there."""
    if re.search(CHUNK_END, re.sub(CLOSINGS, "", text).rstrip()):
        return text
    signs = {sign: [m.start() for m in re.finditer(sign, text)] for sign in (r"(?<!\\)\$", r"\\\[", r"\\\]")}
    dollars, opened, closed = signs.values()
    first = max(0, len(text) - LOOK_BACK)
    for end in reversed([first + m.start() + 1 for m in re.finditer(SENTENCE_END, text[first:])]):
        inside = bisect_left(dollars, end) % 2 or bisect_left(opened, end - 1) > bisect_left(closed, end - 1)
        if not inside and not re.search(ABBREVIATION, text[max(0, end - ABBREVIATION_REACH) : end - 1]):
            kept = text[:end].rstrip()
            return kept if len(kept) >= LEAST_KEPT else text
    return text


@F.pandas_udf(StringType())
def whole_sentences(content: pd.Series) -> pd.Series:
    """A chunk that ends within a sentence is cut after the last one that ends near its end, if enough stays; ends after abbreviations and within formulas don't count.
    Whether a formula is open depends on all the text before, hence Python."""
    return content.map(lambda text: whole_part(text) if text else text)


@F.pandas_udf(StringType())
def schema_issue(record: pd.Series, schema: pd.Series) -> pd.Series:
    """The first fault of a JSON record under a small JSON schema (type, required, properties, enum), or null."""
    import json

    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int}

    def fault(v, s, at="$"):
        kind = s.get("type")
        if kind and (not isinstance(v, kinds[kind]) or (kind in ("number", "integer") and isinstance(v, bool))):
            return f"{at}: not {kind}"
        if "enum" in s and v not in s["enum"]:
            return f"{at}: not allowed"
        if isinstance(v, dict):
            for name in s.get("required", []):
                if name not in v:
                    return f"{at}.{name}: missing"
            for name, inner in s.get("properties", {}).items():
                if name in v and (f := fault(v[name], inner, f"{at}.{name}")):
                    return f
        return None

    def one(r, s):
        try:
            return fault(json.loads(r), json.loads(s))
        except (ValueError, TypeError):
            return "$: no JSON"

    return pd.Series([one(r, s) for r, s in zip(record, schema, strict=True)], dtype=object)
