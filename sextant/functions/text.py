"""Text expressions: normalisation, similarity, filters, extraction, screening. All are Columns, evaluated in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def no_strings() -> Column:
    return F.array().cast("array<string>")


def normalize_title(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def edit_similarity(a: Column, b: Column, size: Column | None = None, distance=F.levenshtein) -> Column:
    longest = F.greatest(F.length(a), F.length(b)) if size is None else size
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance(a, b) / longest)


def title_similarity(a: Column, b: Column) -> Column:
    return edit_similarity(normalize_title(a), normalize_title(b))


def text_similarity(a: Column, b: Column, most: int = 2000, distance=None) -> Column:
    """Over `most` characters only the beginnings are compared, and the denominator is `most`. distance: another function than levenshtein(), evaluated once a row."""
    long = F.greatest(F.length(a), F.length(b)) > most
    if distance is not None:
        size = F.when(long, F.lit(most)).otherwise(F.greatest(F.length(a), F.length(b)))
        return edit_similarity(F.left(a, F.lit(most)), F.left(b, F.lit(most)), size, distance)
    return F.when(long, edit_similarity(F.left(a, F.lit(most)), F.left(b, F.lit(most)), F.lit(most))).otherwise(edit_similarity(a, b))


def text_like(a: Column, b: Column, least: float, most: int | None = 2000) -> Column:
    """text_similarity() is at least `least`; the distance is computed within the band of edits that this allows, and not at all where the lengths differ by more. most=None: of whole texts."""
    longest = F.greatest(F.length(a), F.length(b))
    size = longest if most is None else F.least(longest, F.lit(most))
    x, y = (a, b) if most is None else (F.left(a, F.lit(most)), F.left(b, F.lit(most)))
    band = (F.ceil(size * (1 - least)) + 1).cast("int")
    d = F.call_function("levenshtein", x, y, band).bitwiseAND(2**31 - 1)  # more edits are told by -1, which becomes the largest number
    return F.when(size == 0, F.lit(True)).when(F.abs(F.length(x) - F.length(y)) > band, F.lit(False)).otherwise(F.lit(1.0) - d / size >= least)


def first_sentence(text: Column, most: int = 200) -> Column:
    found = F.regexp_extract(text, r"(?s)^(.*?[.?!])(?=\s|$)", 1)
    sentence = F.when(found != "", found).otherwise(text)
    return F.when(F.length(sentence) > most, F.concat(F.left(sentence, F.lit(most)), F.lit("..."))).otherwise(sentence)


def paragraphs(text: Column, more_than: int = 50) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n+"), F.trim), lambda p: F.length(p) > more_than)


#: LaTeX commands and environments that begin a new part.
LATEX_PARTS = r"(?=\\(?:section|subsection|subsubsection|paragraph|chapter)\*?\{)|(?=\\begin\{(?:thebibliography|longtable|table|figure|algorithm|theorem|lemma|proof|corollary|definition|example|remark)\*?\})|(?=\\bibitem[\s\[])"


def packed_lines(text: Column, most: int) -> Column:
    """Lines over 30 characters, joined while they stay within `most`; a pack of 50 or fewer characters takes the next line whatever its length, and goes if it is the last."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda l: F.length(l) > 30)
    start = F.struct(no_strings().alias("done"), F.lit("").alias("open"))

    def add(state: Column, line: Column) -> Column:
        done, held = state["done"], state["open"]
        full = (F.length(held) + F.length(line) + 1 > most) & (F.length(held) > 50)
        return F.struct(F.when(full, F.concat(done, F.array(F.trim(held)))).otherwise(done).alias("done"), F.when(full | (held == ""), line).otherwise(F.concat(held, F.lit("\n"), line)).alias("open"))

    return F.aggregate(lines, start, add, lambda s: F.when(F.length(F.trim(s["open"])) > 50, F.concat(s["done"], F.array(F.trim(s["open"])))).otherwise(s["done"]))


def latex_parts(text: Column, most: int = 5000) -> Column:
    """Parts of over 50 characters; one of more than `most` becomes its paragraphs if all of several fit, else packs of lines."""
    long = lambda parts: F.filter(F.transform(parts, F.trim), lambda p: F.length(p) > 50)

    def smaller(part: Column) -> Column:
        paras = long(F.split(part, "\n\n+"))
        return F.when(F.length(part) <= most, F.array(part)).when((F.size(paras) > 1) & F.forall(paras, lambda p: F.length(p) <= most), paras).otherwise(packed_lines(part, most))

    return F.flatten(F.transform(long(F.split(text, LATEX_PARTS)), smaller))


GIANT = 130_000  # fixed value: longer sections are split by paragraphs


def giants_split(sections: Column, most: int = GIANT) -> Column:
    """array<struct<name, path, content>>: a section of more than `most` characters becomes parts of whole paragraphs, as many as fit, numbered in name and path; a paragraph longer than
    that is a part by itself, and a section that stays in one part keeps its name. Null contents are empty."""
    kind = "array<struct<name: string, path: string, content: string>>"
    start = F.struct(no_strings().alias("done"), F.lit("").alias("held"))

    def add(state: Column, para: Column) -> Column:
        full = (F.length(state["held"]) + F.length(para) > most) & (state["held"] != "")
        grown = F.when(full | (state["held"] == ""), para).otherwise(F.concat(state["held"], F.lit("\n\n"), para))
        return F.struct(F.when(full, F.array_append(state["done"], state["held"])).otherwise(state["done"]).alias("done"), grown.alias("held"))

    blank = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    cut = lambda text: F.aggregate(F.split(text, "\n\n+"), start, add, lambda s: F.filter(F.transform(F.array_append(s["done"], s["held"]), blank), lambda p: p != ""))

    def parts(section: Column) -> Column:
        held = cut(section["content"])
        mark = lambda k: F.concat(F.lit(" [part "), (k + 1).cast("string"), F.lit("]"))
        named = F.transform(held, lambda p, k: F.struct(F.concat(section["name"], mark(k)).alias("name"), F.concat(section["path"], mark(k)).alias("path"), p.alias("content")))
        only = F.transform(held, lambda p: F.struct(section["name"].alias("name"), section["path"].alias("path"), p.alias("content")))
        own = F.struct(section["name"].alias("name"), section["path"].alias("path"), F.coalesce(section["content"], F.lit("")).alias("content"))
        return F.when(F.coalesce(F.length(section["content"]), F.lit(0)) <= most, F.array(own)).when(F.size(held) > 1, named).otherwise(only)

    return F.flatten(F.transform(sections, lambda x: parts(x).cast(kind)))


def section_batches(sections: Column, most: int = 3500, least: int = 30, carried: int = 500) -> Column:
    """array<array<string>>: sections of `least` or more characters in batches of up to `most`; a batch begins with the last section of the one before, if that has `carried` characters or fewer."""
    kept = F.filter(sections, lambda s: F.length(F.trim(s)) >= least)
    empty = F.array().cast("array<array<string>>")
    start = F.struct(empty.alias("done"), no_strings().alias("open"), F.lit(0).alias("size"))

    def add(state: Column, part: Column) -> Column:
        held, last = state["open"], F.try_element_at(state["open"], F.lit(-1))
        full = (state["size"] + F.length(part) > most) & (F.size(held) > 0)
        carry = F.when(F.length(last) <= carried, F.array(last)).otherwise(no_strings())
        before = F.when(full, carry).otherwise(held)
        size = F.when(full, F.when(F.length(last) <= carried, F.length(last)).otherwise(0)).otherwise(state["size"])
        return F.struct(F.when(full, F.concat(state["done"], F.array(held))).otherwise(state["done"]).alias("done"), F.concat(before, F.array(part)).alias("open"), (size + F.length(part)).alias("size"))

    return F.aggregate(kept, start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def border_repeats_dropped(batches: Column, least: float = 0.85, near: int = 2) -> Column:
    """array<array<string>> of the same batches without near-duplicates at their borders: the last `near` parts of a batch against the first `near` of the next, the shorter
    of a like pair goes, of equal lengths the later. Whole parts are compared. A part that went at one border takes no part at the next. Null parts are like none, a null batch is empty."""
    parts = F.transform(batches, lambda b, k: F.transform(F.coalesce(b, no_strings()), lambda c, i: F.struct((F.shiftleft(k.cast("long"), 32) + i).alias("at"), c.alias("c"))))

    def border(gone: Column, k: Column) -> Column:
        earlier, later = F.get(parts, k), F.get(parts, k + 1)
        tail = F.filter(F.slice(earlier, F.greatest(F.size(earlier) - near + 1, F.lit(1)), F.lit(near)), lambda x: ~F.array_contains(gone, x["at"]))
        pairs = F.flatten(F.transform(tail, lambda a: F.transform(F.slice(later, F.lit(1), F.lit(near)), lambda b: F.struct(a.alias("a"), b.alias("b")))))

        def compared(out: Column, x: Column) -> Column:
            a, b = x["a"], x["b"]
            loser = F.when(F.length(a["c"]) >= F.length(b["c"]), b["at"]).otherwise(a["at"])
            return F.when(~F.array_contains(out, b["at"]) & text_like(a["c"], b["c"], least, None), F.array_append(out, loser)).otherwise(out)

        return F.aggregate(pairs, gone, compared)

    borders = F.when(F.size(batches) > 1, F.sequence(F.lit(0), F.size(batches) - 2)).otherwise(F.array().cast("array<int>"))
    # as the last step of the fold, so that the fold is evaluated once and not for each part
    kept = lambda gone: F.transform(parts, lambda b: F.transform(F.filter(b, lambda x: ~F.array_contains(gone, x["at"])), lambda x: x["c"]))
    return F.aggregate(borders, F.array().cast("array<long>"), border, kept)


def section_paths(names: Column, depths: Column) -> Column:
    """Each section's path from the root, depth-first: names and depths are arrays in the order of the document, the root's depth is 1."""
    start = F.struct(no_strings().alias("paths"), no_strings().alias("stack"))

    def add(state: Column, item: Column) -> Column:
        stack = F.concat(F.slice(state["stack"], F.lit(1), F.greatest(item["d"] - 1, F.lit(0))), F.array(item["n"]))
        return F.struct(F.concat(state["paths"], F.array(F.array_join(stack, " > "))).alias("paths"), stack.alias("stack"))

    return F.aggregate(F.arrays_zip(names.alias("n"), depths.alias("d")), start, add, lambda s: s["paths"])


def is_garbage(text: Column, least: int = 50, letters: float = 0.4) -> Column:
    share = F.length(F.regexp_replace(text, "[^a-zA-Z0-9]", "")) / F.length(text)
    return (F.length(text) < least) | (share < letters)


def embed_text(title: Column, section: Column, concept: Column, summary: Column, content: Column) -> Column:
    head = F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    note = F.concat_ws(" ", F.concat(F.lit("["), F.nullif(concept, F.lit("")), F.lit("]")), F.nullif(summary, F.lit("")))
    return F.concat_ws("\n", F.nullif(F.concat_ws(" ", F.nullif(head, F.lit("")), F.nullif(note, F.lit(""))), F.lit("")), content)


def capped(text: Column, tokens: int) -> Column:
    """At most four characters a token; Spark cuts between code points."""
    return F.left(text, F.lit(4 * tokens))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def repaired_json(text: Column) -> Column:
    """A backslash that begins no JSON escape is doubled; null where it still is no JSON."""
    fixed = F.regexp_replace(text, r'(\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})|(\\)', "$1$2$2")  # escapes as they are, lone backslashes twice
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fixed))


def truncated(text: Column, most: int = 800) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def section_leaf(path: Column) -> Column:
    return F.trim(F.element_at(F.split(path, " > "), -1))


def section_label(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"^\s*\d+(\.\d+)*\.?\s+", ""), r"\s+", " ")))


#: First path parts of a code host that are no account names.
# Repository addresses, and first path parts that are no account.
REPOSITORY = r"(https?://github\.com/[\w.-]+/[\w.-]+)"
NOT_ACCOUNTS = ["topics", "orgs", "settings", "issues", "pulls", "marketplace", "explore", "notifications", "sponsors", "features", "pricing", "login", "signup", "join"]


def distinct_ignoring_case(values: Column) -> Column:
    """The first of each, in order."""
    return F.aggregate(values, no_strings(), lambda seen, v: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(v)), seen).otherwise(F.concat(seen, F.array(v))))


def repository_urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(REPOSITORY), F.lit(1))
    part = lambda u, n: F.element_at(F.split(u, "/"), n)
    kept = F.filter(found, lambda u: ~F.lower(part(u, 4)).isin(NOT_ACCOUNTS))
    return distinct_ignoring_case(F.transform(kept, lambda u: F.concat(F.lit("https://github.com/"), part(u, 4), F.lit("/"), F.regexp_replace(part(u, 5), r"[.),:;]+$", ""))))


#: Patterns of identifiers and of reference sections.
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
PREPRINT = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*)(\d{4}\.\d{4,5})(?:v\d+)?"
OLD_PREPRINT = r"(?i)arxiv\.org/(?:abs|pdf)/([a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?"
REFERENCES = r"(?im)^[#>\s]*(?:references|bibliography|works\s+cited)\s*:?\s*$"
REFERENCE_LINE = r"(?m)^\s*\[\d{1,4}\]\s+\S"


def identifiers(text: Column) -> dict[str, Column]:
    """Sorted distinct DOIs and preprint numbers of a text."""
    every = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)
    new = every(PREPRINT)
    old = every(OLD_PREPRINT)
    doi = F.filter(F.transform(every(DOI), lambda d: F.regexp_replace(d, r"[.,;:)\]]+$", "")), lambda d: d.contains("/"))
    return {"dois": F.array_sort(F.array_distinct(doi)), "arxiv_ids": F.array_sort(F.array_distinct(F.concat(new, old)))}


def doi_to_preprint(doi: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(doi), r"10\.48550/arxiv\.(\d{4}\.\d{4,5}|[a-z-]+/\d{7})", 1), F.lit(""))


def has_references(text: Column) -> Column:
    heading = text.rlike(REFERENCES)
    return heading | (F.regexp_count(text, F.lit(REFERENCE_LINE)) >= 3)


#: Dataset names and the patterns that find them.
DATASETS = {
    "ImageNet": r"(?i)\bImageNet\b", "CIFAR-10": r"(?i)\bCIFAR[- ]?10\b", "CIFAR-100": r"(?i)\bCIFAR[- ]?100\b", "MS-COCO": r"(?i)\bMS[- ]?COCO\b", "COCO": r"\bCOCO\b",
    "WMT": r"(?i)\bWMT[- ]?\d{2,4}\b", "SQuAD 2.0": r"\bSQuAD\s*2\.0\b", "SQuAD 1.1": r"\bSQuAD\s*1\.[01]\b", "SQuAD": r"\bSQuAD\b", "SuperGLUE": r"\bSuperGLUE\b",
    "GLUE": r"\bGLUE\b", "MNIST": r"\bMNIST\b", "Fashion-MNIST": r"(?i)\bFashion[- ]?MNIST\b", "Penn Treebank": r"(?i)\bPenn Treebank\b", "PTB": r"\bPTB\b",
    "WikiText-103": r"(?i)\bWikiText[- ]?103\b", "WikiText-2": r"(?i)\bWikiText[- ]?2\b", "LAMBADA": r"\bLAMBADA\b", "Pascal VOC": r"\bVOC\s*20(?:07|12)\b", "ADE20K": r"(?i)\bADE20K\b",
    "Cityscapes": r"(?i)\bCityscapes\b", "OpenImages": r"(?i)\bOpenImages\b", "LibriSpeech": r"(?i)\bLibriSpeech\b", "CommonCrawl": r"(?i)\bCommonCrawl\b", "BookCorpus": r"(?i)\bBookCorpus\b",
    "HellaSwag": r"(?i)\bHellaSwag\b", "WinoGrande": r"(?i)\bWinoGrande?\b", "ARC-Challenge": r"(?i)\bARC[- ]?Challenge\b", "MMLU": r"\bMMLU\b", "TriviaQA": r"(?i)\bTriviaQA\b",
    "Natural Questions": r"(?i)\bNatural Questions\b", "HumanEval": r"(?i)\bHumanEval\b", "MBPP": r"\bMBPP\b", "GSM8K": r"(?i)\bGSM8K\b", "MATH": r"\bMATH\b",
}


def dataset_names(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in DATASETS.items())))


#: Score sentences as (pattern, group of the metric, group of the score, group of the dataset).
SCORE_SENTENCES = [
    (r"(?i)achieves?\s+([\d.]+)\s*%?\s+(\w[\w\s-]*?)\s+on\s+([\w][\w\s.-]*\w)", 2, 1, 3),
    (r"(?i)([\d.]+)\s*%\s+(accuracy|top-[15]|F1|BLEU|ROUGE-?L?|mAP|EM|exact match)\s+on\s+([\w][\w\s.-]*\w)", 2, 1, 3),
    (r"(?i)([\d.]+)\s+(BLEU|ROUGE-?L?|mAP|perplexity)\s+on\s+([\w][\w\s.-]*\w)", 2, 1, 3),
    (r"(?i)(accuracy|top-[15]|F1|BLEU|ROUGE-?L?|mAP|EM)\s+(?:of|score of)\s+([\d.]+)\s*%?\s+on\s+([\w][\w\s.-]*\w)", 1, 2, 3),
    (r"(?i)(F1|BLEU|ROUGE-?L?|EM|accuracy)\s+score\s+of\s+([\d.]+)\s*%?\s+on\s+([\w][\w\s.-]*\w)", 1, 2, 3),
]


def score_sentences(text: Column) -> Column:
    """array<struct<metric, score, dataset>> of all patterns."""
    each = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    found = [F.transform(F.arrays_zip(each(p, m).alias("m"), each(p, s).alias("s"), each(p, d).alias("d")), lambda z: F.struct(F.lower(z["m"]).alias("metric"), z["s"].alias("score"), z["d"].alias("dataset"))) for p, m, s, d in SCORE_SENTENCES]
    return F.array_distinct(reduce(F.concat, found))


def repetitive(body: Column) -> Column:
    """The first 5, 10, 20 or 40 characters cover over 60 % of a body of 200 or more."""
    low = F.lower(body)

    def covers(n: int) -> Column:
        sample = F.left(low, F.lit(n))
        return (F.length(F.trim(sample)) >= n) & (F.length(low) - F.length(F.replace(low, sample, F.lit(""))) > 0.6 * F.length(body))

    return (F.length(body) >= 200) & reduce(lambda a, b: a | b, map(covers, (5, 10, 20, 40)))


def mostly_upper(body: Column) -> Column:
    part = F.substring(body, 201, 1800)
    upper, lower = (F.regexp_count(part, F.lit(p)) for p in ("[A-Z]", "[a-z]"))
    return (upper + lower >= 100) & (upper > 0.6 * (upper + lower))


def spam_screen(body: Column, abstract: Column) -> Column:
    """The deterministic verdict: a code, or null."""
    body, abstract = F.trim(F.coalesce(body, F.lit(""))), F.trim(F.coalesce(abstract, F.lit("")))
    return (
        F.when(F.length(body) == 0, "EMPTY_BODY").when(F.length(body) < 100, "BELOW_MIN_LENGTH").when(repetitive(body), "REPETITIVE_CONTENT")
        .when((F.length(abstract) > 0) & (F.length(abstract) < 100), "ABSTRACT_TOO_SHORT")
    )


def spam_verdict(hard: Column, soft: Column, model_spam: Column, confidence: Column, least: float = 0.6) -> Column:
    """hard: code or null; soft: number of soft signals; the model's verdict counts from a confidence of `least`."""
    sure = F.coalesce(confidence >= least, F.lit(False))
    return F.when(hard.isNotNull(), "rejected").when(sure & model_spam, "rejected").when(sure & ~model_spam, "accepted").when(soft >= 2, "review").otherwise("accepted")


def without_latex(text: Column) -> Column:
    """Ordered rewrites; braces may nest to depth two."""
    arg = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
    rules = [
        (r"(?<!\\)%[^\n]*", ""), (r"\\(?:cite|citep|citet|ref|eqref|label|pageref)\*?(?:\[[^\]]*\])*" + arg, ""), (r"\\(?:begin|end)" + arg, ""),
        (r"\\(?:textbf|textit|emph|texttt|underline|mathrm|text|section|subsection|subsubsection|paragraph|caption|footnote)\*?" + arg, "$1"),
        (r"\\(?:includegraphics|input|include|usepackage|documentclass)(?:\[[^\]]*\])*" + arg, ""), (r"\\item\b", "- "), (r"\\\\", " "), (r"~", " "), (r"\\([%&#_$])", "$1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", ""), (r"[{}]", ""), (r"[ \t]+", " "),
    ]
    return F.regexp_replace(reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text), r"^\s+|\s+$", "")


def latex_body(text: Column) -> Column:
    """What stands between the begin and end of the document, without comments."""
    inner = F.regexp_extract(text, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|$)", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"(?<!\\)%[^\n]*", "")


def formulas(text: Column) -> Column:
    forms = (r"(?s)\$\$(.+?)\$\$", r"(?s)\\\[(.+?)\\\]", r"(?s)\\begin\{(?:equation|align)\*?\}(.+?)\\end\{(?:equation|align)\*?\}", r"(?s)(?<!\$)\$([^$\n]+)\$(?!\$)")
    return F.transform(reduce(F.concat, (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in forms)), F.trim)


# What a gap may consist of without being content, and which files that a source includes hold no body text.
BRACED, COMMANDS, OPTIONS, SKIPPED, FIGURE = r"\{[^{}]*\}", r"\\[a-zA-Z@]+\*?", r"\[[^\]]*\]", r"\iffalse", r"(?i)^\[(?:figure|table)[\s:\]]"
NESTED, LEAST_LETTERS = 6, 3
ASSET_SUFFIXES = "bbl out aux toc lof lot fls fdb_latexmk log nav snm vrb pgf tikz tikzstyles settings title author abs pacs body pdf_tex pdf svg eps ps png jpg jpeg gif".split()
ASSET_FOLDERS = "figures figure figs fig tables table plots plot graphics graphic diagrams diagram tikz pgf images image img imgs pics pic".split()
ASSET_NAMES = (
    r"^figure[-_]", r"^fig[-_]\d", r"^figs?\b", r"^plot[-_]", r"^chart[-_]", r"^diagram", r"^table[-_]", r"^tab[-_]\d", r"tabletest", r"^test[-_]?table", r"^tikz", r"^styles?tikz", r"tikz(?:graph|fig|plot|style)",
    r"^macros?[-_]", r"^preamble", r"^header$", r"^commands", r"^author$", r"^title$", r"^abstract$", r"^keywords$", r"_summary$", r"_results?$", r"_cor(?:_|$)", r"_range$", r"evalres", r"^results?_[a-z]",
)
# end of fixed values


def droppable(gap: Column) -> Column:
    """A gap that is no loss: blank, skipped source, a figure's or table's mark, or markup in which no word of LEAST_LETTERS letters is left once braced arguments, commands and options are gone."""
    whole = F.regexp_replace(gap, r"^\s+|\s+$", "")
    bare = reduce(lambda t, p: F.regexp_replace(t, p, " "), [BRACED] * NESTED + [COMMANDS, OPTIONS], whole)
    return (whole == "") | F.startswith(whole, F.lit(SKIPPED)) | whole.rlike(FIGURE) | ~bare.rlike(f"[A-Za-z]{{{LEAST_LETTERS},}}")


def droppable_text(gap: str) -> bool:
    """droppable() for helpers that hold one text."""
    whole = gap.strip()
    if not whole or whole.startswith(SKIPPED) or re.search(FIGURE, whole):
        return True
    bare = reduce(lambda t, p: re.sub(p, " ", t), [BRACED] * NESTED + [COMMANDS, OPTIONS], whole)
    return re.search(f"[A-Za-z]{{{LEAST_LETTERS},}}", bare) is None


def body_include(path: Column) -> Column:
    """Whether an included file may hold body text: no macro in its path, no folder, suffix or name of figures, tables, styles and results."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    suffix = F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise("")
    name = F.when(suffix != "", F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    folders = F.filter(F.split(low, "/"), lambda x: x != "")
    inside = F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: x.isin(ASSET_FOLDERS))
    return ~(path.contains("\\") | inside | suffix.isin(ASSET_SUFFIXES) | reduce(lambda a, b: a | b, (name.rlike(p) for p in ASSET_NAMES)))


def parse_failure(chunks: Column, chars: Column, first: Column) -> Column:
    """Classes in order of priority."""
    return (
        F.when(chunks == 0, "no_chunks").when(chars == 0, "empty").when(chars < 500, "too_short").when(first.rlike(r"^%PDF|^PK\x03"), "binary").when(first.rlike(r"(?i)^\s*<(!doctype|html)"), "markup")
        .when(is_garbage(first), "garbage").when((chunks == 1) & (chars > 20000), "unsplit").otherwise("ok")
    )


def relation_label(name: Column, engineering: Column) -> Column:
    label = F.regexp_replace(F.upper(name), "[^A-Z0-9_]", "_")
    return F.when(engineering, F.concat(F.lit("ENG_"), label)).otherwise(label)


def cycle_label(label: Column, names: dict[str, int]) -> Column:
    number = F.coalesce(F.try_to_number(F.when(F.trim(label).rlike(r"^\d+$"), F.trim(label)), F.lit("999999")).cast("int"), F.expr("null").cast("int"))
    cycle = F.regexp_extract(label, r"(?i)^\s*cycle\s+(\d+)", 1)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(number, F.when(cycle != "", cycle.cast("int")), F.try_element_at(known, F.lower(F.trim(label))))
