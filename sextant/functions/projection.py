"""What a read shows: visibility, filters over nested values, levels of detail, projected and redacted records."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import truncated

#: Keys and labels of process records, which scientific reads never show.
PROCESS_KEYS = {"run_id", "intent_id", "decision_id", "stage_id", "track_note"}
PROCESS_LABELS = ("run:", "intent:", "decision:", "journal:")


def visible(deleted_at: Column, status: Column) -> Column:
    """Neither deleted nor only listed."""
    return deleted_at.isNull() & (F.coalesce(status, F.lit("")) != "listed")


def section_starts(prefix: str, *paths: Column) -> Column:
    """One of the paths begins with the prefix, whatever the case."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(p).startswith(prefix.lower()), F.lit(False)) for p in paths))


def any_like(items: Column, part: str, *fields: str) -> Column:
    """A field of one of the structs contains the part, whatever the case."""
    return F.coalesce(F.exists(items, lambda i: F.lower(F.coalesce(*(i[f].cast("string") for f in fields), F.lit(""))).contains(part.lower())), F.lit(False))


def has_any_id(ids: Column, **wanted: str | None) -> Column:
    """The map holds one of the ids asked for."""
    tests = [F.coalesce(F.try_element_at(ids, F.lit(k)) == v, F.lit(False)) for k, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def date_bounds(start: str | None, end: str | None, backward: bool) -> tuple[str | None, str | None]:
    """(lower, upper): two dates are a range; one is an anchor, from which the direction walks."""
    if start and end:
        return start, end
    anchor = start or end
    return (None, anchor) if backward else (anchor, None)


#: Level -> columns beside the snippet.
LEVELS = {"minimal": ["title", "score", "summary"], "standard": ["title", "score", "summary", "authors", "published_at", "category", "license", "section_path", "position"]}
LEVELS["full"] = [*LEVELS["standard"], "licenses", "tier", "external_ids", "vector_score", "bm25_score", "entities", "total_chunks"]


def detail(level: str, content: Column, known: list[str]) -> list[Column]:
    """The columns that a level of detail shows of those known, and the snippet: 800 characters, of which minimal shows 300."""
    snippet = truncated(content)
    return [F.col(c) for c in LEVELS[level] if c in known] + [(F.left(snippet, F.lit(300)) if level == "minimal" else snippet).alias("snippet")]


def _projected(value):
    if isinstance(value, dict):
        kept = {k: v for k, v in value.items() if k not in PROCESS_KEYS and not k.endswith("_run_id") and not _process(v)}
        return {k: _projected(v) for k, v in kept.items()}
    if isinstance(value, list):
        return [_projected(v) for v in value if not _process(v)]
    return value


def _process(value) -> bool:
    return isinstance(value, str) and value.startswith(PROCESS_LABELS)


def _marker(value):
    if isinstance(value, str):
        return f"[prose omitted: {len(value)} chars]"
    if isinstance(value, list):
        return f"[omitted: {len(value)} items]"
    return "[object omitted]" if isinstance(value, dict) else value


def _redacted(value, path: list[str]):
    if not path:
        return {k: _marker(v) for k, v in value.items()} if isinstance(value, dict) else _marker(value)
    key, every = path[0].removesuffix("[]"), path[0].endswith("[]")
    if not isinstance(value, dict) or key not in value or (every and not isinstance(value[key], list)):
        return value
    return value | {key: [_redacted(v, path[1:]) for v in value[key]] if every else _redacted(value[key], path[1:])}


def _each(change):
    """A function over JSON texts, batch by batch; null where there is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(change(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run


def scientific(record: Column) -> Column:
    """A JSON record without keys and values that point at process records, at any depth."""
    return _each(_projected)(record)


def redacted(record: Column, *paths: str) -> Column:
    """A JSON record in which the values at the paths (a.b, a[].b) are markers that give their size; an absent path changes nothing."""
    split = [[p for p in path.split(".") if p] for path in paths]
    return _each(lambda value: reduce(_redacted, split, value))(record)


def read_schema(record: Column, hidden: list[str], pointer: str | None = None, distributable: Column | None = None) -> Column:
    """A struct without the hidden fields; where it may not be distributed, its content is a pointer."""
    kept = record.dropFields(*hidden) if hidden else record
    if pointer is None or distributable is None:
        return kept
    return F.when(distributable, kept).otherwise(kept.withField("content", F.lit(pointer)))


def lenient_json(text: Column, shape: dict[str, str]) -> Column:
    """Codes of what keeps a text from being the JSON object expected: empty where nothing does. shape: field -> type as schema_of_variant() names it."""
    value = F.try_parse_json(text)
    field = lambda k: F.try_variant_get(value, f"$.{k}", "variant")
    codes = [F.when(field(k).isNull(), F.lit(f"{k}:missing")).when(~F.schema_of_variant(field(k)).startswith(kind), F.lit(f"{k}:not_{kind.lower()}")) for k, kind in sorted(shape.items())]
    found = F.array_compact(F.array(*codes))
    return F.when(value.isNull(), F.array(F.lit("not_json"))).when(~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("not_object"))).otherwise(found)
