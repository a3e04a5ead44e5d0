"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a named condition under which a text fails. On a bounded sample each rule is timed by itself, less the time of a pass without rules (cost),
and one pass counts which rules fail together (selectivity). The cascade puts the rule with the most rejections per cost first, then the one with the
most rejections per cost among rows that the rules before it left, and so on; it is one CASE expression, so a row that fails a rule never
computes the later ones. Which documents pass does not depend on the order, only the work does: timings differ from run to run, verdicts don't.

The statistics of the query are whole-text counts. Repeated word windows are found inside the row: windows are sorted with their places, equal
neighbours are marked, and the words that marked windows cover are counted, so no word leaves its row and no group of rows meets in a task.

Sample: the rows with the smallest hashes of doc_id and text, max_rows at most (SAMPLE_ROWS), of texts up to SAMPLE_CHARS; only the order of rules comes from it.
Null texts count as empty: no words, every count 0, base_failed. Rows are independent: null and repeated doc_ids are judged row by row; an empty table gives an empty result.
Other columns are not read by the query; the operator keeps them (it adds `first_failed` and replaces it if the table has one).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.shared import materialize

BLANK, SYMBOL = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"  # fixed by the contract
SAMPLE_ROWS, SAMPLE_CHARS, LEAST_SECONDS = 2000, 20_000, 0.002
FEWEST_WORDS, MOST_REPEATED, PLACE = 50, 50, 24


@dataclass(frozen=True)
class Rule:
    """fails: a SQL condition over the columns of the table."""

    name: str
    fails: str


def with_counts(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.expr(r"btrim(text, ' \t\n\u000b\f\r')")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = text.withColumns({"words": words, "lines": lines}).select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"), F.char_length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return repeated_words(counted, "words", "n_repeat_words").drop("words")


def repeated_words(rows: DataFrame, words: str, into: str, width: int = 3) -> DataFrame:
    """How many of an array's words lie in a window of `width` words that the array holds twice or more.

    A window is one long, 40 bits of hash above its place, so sorting plain longs brings equal windows together. Neighbours of one hash are compared word by
    word; a row in which two of them differ, or with more places than PLACE bits hold, sorts its windows by the words themselves.
    """
    n, last = F.size(words), F.lit((1 << PLACE) - 1)
    top = lambda x: F.shiftright(x, PLACE)
    place = lambda x: x.bitwiseAND(last).cast("int")
    word = lambda i, k: F.get(words, i + k)
    no_longs = F.array().cast("array<bigint>")
    packed = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.shiftleft(F.xxhash64(*(word(i, k) for k in range(width))), PLACE).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_windows", F.when((n >= width) & (n <= 1 << PLACE), F.sort_array(packed)).otherwise(no_longs))
    beside = lambda x, i: F.coalesce(top(x) == top(F.get("_windows", i)), F.lit(False))
    rows = rows.withColumn("_windows", F.filter("_windows", lambda x, i: beside(x, i - 1) | beside(x, i + 1)))
    equal = lambda x, y: F.forall(F.array(*(word(place(x), k) == word(place(y), k) for k in range(width))), lambda e: e)
    pair = lambda i: (top(F.get("_windows", i)) != top(F.get("_windows", i - 1))) | equal(F.get("_windows", i), F.get("_windows", i - 1))
    sure = (n <= 1 << PLACE) & ((F.size("_windows") < 2) | F.forall(F.sequence(F.lit(1), F.greatest(F.size("_windows") - 1, F.lit(1))), pair))
    rows = rows.withColumn("_places", F.when(sure, F.sort_array(F.transform("_windows", place))).otherwise(repeated_places(words, width)))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-width).alias("last"))
    step = lambda acc, x: F.struct((acc["covered"] + F.least(F.lit(width), x - acc["last"])).alias("covered"), x.alias("last"))
    return rows.withColumn(into, F.aggregate("_places", start, step, lambda acc: acc["covered"].cast("long"))).drop("_windows", "_places")


def repeated_places(words: str, width: int) -> Column:
    """Places of the windows that the array holds twice or more, by sorting the windows themselves."""
    own = [f"w{k}" for k in range(width)]
    shifted = F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words) - (width - 1), F.lit(0))).alias(c) for k, c in enumerate(own)))
    ordered_windows = F.sort_array(F.transform(shifted, lambda x, i: F.struct(*(x[c].alias(c) for c in own), i.alias("at"))))
    same = lambda x, y: F.forall(F.array(*(F.coalesce(x[c] == y[c], F.lit(False)) for c in own)), lambda e: e)
    beside = lambda held, x, i: same(x, F.get(held, i - 1)) | same(x, F.get(held, i + 1))
    marked = F.transform(F.array(ordered_windows), lambda held: F.filter(held, lambda x, i: beside(held, x, i)))  # an array of one, so that the sorted windows have a name
    return F.sort_array(F.transform(F.get(marked, F.lit(0)), lambda x: x["at"]))


#: Over the columns of with_counts: a text with one of these fails.
RULES = [
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("shouting", "100 * regexp_count(text, '[A-Z]') > 30 * word_chars"),
    Rule("digits", "100 * regexp_count(text, '[0-9]') > 40 * word_chars"),
    Rule("few_letters", r"100 * regexp_count(text, r'\p{L}[^\x20\x09-\x0D]*') < 60 * n_words"),  # a word from its first letter on
    Rule("bullets", r"100 * regexp_count(text, r'(?m)^[\x20\x09]*[-*•‣]') > 90 * n_lines"),
    Rule("trailing_dots", r"100 * regexp_count(text, r'(?m)(?:\.\.\.|…)[\x20\x09]*$') > 30 * n_lines"),
]


def sampled(rows: DataFrame, max_rows: int) -> DataFrame:
    """max_rows rows at most, the first by a hash; written, so that timing a rule reads them and nothing else."""
    return materialize(rows.where(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(max_rows))


def measured(sample: DataFrame, rules: list[Rule]) -> tuple[dict[str, float], dict[int, int]]:
    """(seconds by rule, rows by the set of failed rules as bits): one short job per rule and one for all."""
    def seconds(condition: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).collect()  # one row
            best = min(best, time.perf_counter() - began)
        return best

    if not rules:
        return {}, {}
    plain = seconds(F.length("text") >= 0)
    cost = {r.name: max(LEAST_SECONDS, seconds(_failing(r)) - plain) for r in rules}
    bits = sum((F.when(_failing(r), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    return cost, {r["bits"]: r["count"] for r in sample.groupBy(bits.alias("bits")).count().collect()}  # max_rows rows at most


def _failing(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.fails), F.lit(False))


def ordered(rules: list[Rule], cost: dict[str, float], failed: dict[int, int]) -> list[Rule]:
    """Most rejections per cost first, each counted on the rows that the rules before it left."""
    rest, left, out = list(enumerate(rules)), dict(failed), []
    while rest:
        rejected = lambda k: sum(n for bits, n in left.items() if bits >> k & 1)  # noqa: E731, B023
        k, best = max(rest, key=lambda r: (rejected(r[0]) / cost[r[1].name], -cost[r[1].name], -r[0]))
        out.append(best)
        rest.remove((k, best))
        left = {bits: n for bits, n in left.items() if not bits >> k & 1}
    return out


def cascade(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with `first_failed`, the first of the rules (in this order) that a row fails, or null. A condition that is null doesn't fail."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(_failing(rule), F.lit(rule.name)).otherwise(verdict)
    return rows.withColumn("first_failed", verdict)


def short_circuit(rows: DataFrame, rules: list[Rule], sample: DataFrame | None = None, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rows(doc_id, text, ...) with `first_failed`, rules in the order that a sample of the rows (or the one given) calls for."""
    sample = sampled(rows, max_rows) if sample is None else sample
    return cascade(rows, ordered(rules, *measured(sample, rules)))


def quality_rules(documents: DataFrame, rules: list[Rule] = RULES, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """with_counts' columns, base_failed, first_failed and kept."""
    # the sample is chosen before anything is counted, so counting stays with the rows that are kept
    few = with_counts(sampled(documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), max_rows))
    found = short_circuit(with_counts(documents), rules, materialize(few))
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", base)
    return found.withColumn("first_failed", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.col("first_failed"))).withColumn("kept", F.col("first_failed").isNull())


def op12_rule_cascade(spark, sf_dir):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*columns)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
s AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS win FROM g),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM s),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words
        OR 100 * len(regexp_extract_all(text, '[A-Z]')) > 30 * word_chars OR 100 * len(regexp_extract_all(text, '[0-9]')) > 40 * word_chars
        OR 100 * len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) < 60 * n_words
        OR 100 * len(regexp_extract_all(text, '(?m)^[\x20\x09]*[-*•‣]')) > 90 * n_lines
        OR 100 * len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)[\x20\x09]*$')) > 30 * n_lines) AS kept
FROM f
"""
