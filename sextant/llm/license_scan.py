"""Licence scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

Four comparisons, each with its own templates: lines and, in blocks of several lines, sentences with one-line notices (so it does not matter where a header is wrapped); blocks with
notices of several lines; in files that give their licence, lines and sentences with titles; in these also the whole text with whole licence texts (`licences/`). Terms are lower-case runs of letters, digits, dots and dashes; a term's weight is its inverse frequency over the templates, terms of
no template weigh as much as the rarest. These units of a text are compared by cosine; below, each is called a line. A line can reach the threshold
against a template only if it has one of the template's key terms: terms without which the rest of the template's norm falls short.
Lines without a key term, and lines whose shared terms together weigh too little, are dropped before they are taken apart, which loses nothing.

A file's own licence is its best line's (similarity, then template name). Files whose name marks them as licence files give theirs to
their directory. A file without its own takes that of the nearest ancestor directory that has one: each path is spread into its ancestors
(their number is the path's depth, not the corpus's), and joined with one row per directory.

Null and empty texts have no licence of their own; a null path is the root directory. Rows are kept as they are: repeated rows are repeated in the result.
A caller's own templates are compared with lines and sentences only. The templates are fixed tables, the largest of some ten thousand terms. Only path, text and the named key column are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.shared import join_counted, materialize

# Fixed values from here to LOOKED_UP: wording that the licences themselves prescribe.
#: Licence -> header.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: Notices of several lines; what stands before a slash is the licence.
HEADERS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0/2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-2.0": _GPL.format("", 2), "GPL-3.0": _GPL.format("", 3), "LGPL-2.1": _GPL.format("Lesser ", 2.1), "LGPL-3.0": _GPL.format("Lesser ", 3),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: First lines of licence files.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004", "BSD-3-Clause": "BSD 3-Clause License", "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License", "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "GPL-2.0": "GNU General Public License Version 2, June 1991", "GPL-3.0": "GNU General Public License Version 3, 29 June 2007", "LGPL-2.1": "GNU Lesser General Public License Version 2.1, February 1999", "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT": "The MIT License (MIT)", "MIT/2": "MIT License", "MPL-2.0": "Mozilla Public License Version 2.0",
}
#: Whole licence texts, read by the driver only.
FULL = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
#: Terms of a template that the filters look up at most; the others are taken as shared.
LOOKED_UP, MARKER = 40, r"[ \t\r#/*;%!-]*"
#: Words of most English texts, used as key terms last.
COMMON = {"a", "and", "are", "by", "for", "in", "is", "of", "or", "the", "this", "to", "under", "use", "with"}
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def weights(templates: dict[str, str]) -> tuple[dict[str, dict[str, float]], float]:
    """(template -> term -> tf * idf, idf of a term of no template)."""
    terms = {k: Counter(re.findall(TERM, t.lower())) for k, t in templates.items()}
    known = Counter(x for c in terms.values() for x in c)
    top = math.log(1 + len(templates))
    idf = {x: math.log(1 + len(templates) / n) for x, n in known.items()}
    return {k: {x: n * idf[x] for x, n in c.items()} for k, c in terms.items()}, top


def key_terms(templates: dict[str, str], threshold: float) -> list[str]:
    found: set[str] = set()
    for vector in weights(templates)[0].values():
        norm, rest = math.sqrt(sum(v * v for v in vector.values())), dict(vector)
        for term in sorted(vector, key=lambda x: (x in COMMON, -len(x), x)):  # long terms are in few lines
            if math.sqrt(sum(v * v for v in rest.values())) < threshold * norm:
                break
            found.add(term)
            del rest[term]
    return sorted(found)


def covers(text: Column, vector: dict[str, float], threshold: float) -> Column:
    """The terms that a line may share with a template weigh enough: by the Cauchy-Schwarz inequality no line without this reaches the threshold.
    Terms are looked up as substrings, which finds them all and perhaps some more."""
    looked = sorted(sorted(vector.items(), key=lambda x: (-x[1], x[0]))[:LOOKED_UP])
    others = sum(w * w for w in vector.values()) - sum(w * w for _, w in looked)
    shared = reduce(lambda a, b: a + b, (F.when(text.contains(t), w * w).otherwise(0.0) for t, w in looked), F.lit(others))
    return shared >= threshold * threshold * sum(w * w for w in vector.values()) - 1e-9


def blocks(text: Column) -> Column:
    """Runs of lines between lines that are empty or hold comment marks only."""
    return F.split(text, rf"\n(?:{MARKER}(?:\n|$))+")


def lines_and_sentences(text: Column) -> Column:
    """The lines, then the sentences of blocks of several lines, wherever these break."""
    flat = F.transform(F.filter(blocks(text), lambda b: b.contains("\n")), lambda b: F.regexp_replace(b, rf"\s*\n{MARKER}", " "))
    return F.concat(F.split(text, "\n"), F.flatten(F.transform(flat, lambda b: F.split(b, r"(?<=[.!?])\s+(?=[A-Z])"))))


def lines_and_whole(text: Column) -> Column:
    return F.concat(F.split(text, "\n"), F.array(text))


def own_licences(files: DataFrame, key: str, templates: dict[str, str], threshold: float, units: Callable[[Column], Column] = lines_and_sentences) -> DataFrame:
    """(key, licence, similarity, line) of each text's best unit at or over the threshold; texts without one are left out. line: the place among the units."""
    vectors, unknown = weights(templates)
    heavy = key_terms(templates, threshold)
    # long templates have too many key terms for a filter
    some = lambda text: reduce(lambda a, b: a | b, (text.contains(t) for t in heavy), F.lit(False)) if len(heavy) <= 150 else F.lit(True)
    # lower case is made once a text and once a unit: a plain filter would repeat it for every term
    lines = files.select(key, "text").where(F.exists(F.array(F.lower("text")), some))
    lines = lines.select(key, F.posexplode(F.transform(units(F.col("text")), lambda u: F.lower(u))).alias("line", "text")).where(some(F.col("text")))
    lines = lines.where(reduce(lambda a, b: a | b, (covers(F.col("text"), v, threshold) for v in vectors.values()), F.lit(False)))
    lines = materialize(lines)  # few are left; both sums below read them
    terms = lines.select(key, "line", F.explode(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    terms = terms.groupBy(key, "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    spark = files.sparkSession
    idf = {x: math.log(1 + len(templates) / sum(x in c for c in vectors.values())) for c in vectors.values() for x in c}
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    terms = materialize(terms.join(known, "term", "left").select(key, "line", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w")))  # exchanged once for both sums
    theirs = [(x, k, float(w), math.sqrt(sum(v * v for v in c.values()))) for k, c in vectors.items() for x, w in c.items()]
    theirs = F.broadcast(spark.createDataFrame(theirs, "term string, licence string, weight double, size double"))
    norms = terms.groupBy(key, "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(theirs, "term").groupBy(key, "line", "licence", "size").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(norms, [key, "line"]).withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).where(F.col("similarity") >= threshold)
    found = near.groupBy(key).agg(F.max(F.struct("similarity", "licence", (-F.col("line")).alias("line"))).alias("b"))
    return found.select(key, "b.licence", "b.similarity", (-F.col("b.line")).alias("line"))


def ancestors(path: Column) -> Column:
    """The directories of a path, the nearest first, the root ('') last."""
    parts = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", ""), "/+")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licences(files: DataFrame, key: str = "file_id", templates: dict[str, str] | None = None, threshold: float = 0.8, licence_file: Column | None = None) -> DataFrame:
    """files(key, path, text) -> (key, path, licence, origin own/inherited/null, similarity, from_dir), a row per row.

    licence_file: which files give their licence to their directory; by default those named LICENSE, COPYING or NOTICE.
    """
    templates = TEMPLATES if templates is None else templates
    rows = files.select(key, "path", "text", (F.col("path").rlike(LICENCE_FILE) if licence_file is None else licence_file).alias("gives"))
    found = own_licences(rows, key, templates, threshold)
    if templates is TEMPLATES:
        giving = rows.where("gives")
        found = found.unionAll(own_licences(rows, key, HEADERS, threshold, blocks)).unionAll(own_licences(giving, key, TITLES, threshold)).unionAll(own_licences(giving, key, FULL, threshold, lines_and_whole))
        best = found.groupBy(key).agg(F.max(F.struct("similarity", F.element_at(F.split("licence", "/"), 1).alias("licence"), (-F.col("line")).alias("line"))).alias("b"))
        found = best.select(key, "b.licence", "b.similarity", (-F.col("b.line")).alias("line"))
    named = materialize(rows.select(key, "path", "gives").join(found, key, "left"))  # read for what is given, for directories and for the rows
    given = named.where("gives and licence is not null").groupBy(ancestors(F.col("path"))[0].alias("dir")).agg(F.max(F.struct("similarity", "licence")).alias("given"))
    # directories are looked up once each, however many files they hold; a directory above many others, the root above all, is dealt over tasks
    asking = named.where("licence is null").withColumn("own_dir", ancestors(F.col("path"))[0])
    dirs = materialize(asking.groupBy("own_dir").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path")))
    climb = dirs.select("own_dir", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    above = materialize(climb.groupBy("dir").agg(F.count(F.lit(1)).alias("below")).join(given, "dir"))
    got = join_counted(climb, above, "dir", "below", "own_dir").groupBy("own_dir").agg(F.min(F.struct("up", "dir", "given")).alias("x"))
    got = materialize(dirs.select("own_dir", "files").join(got, "own_dir", "left"))
    inherited = join_counted(asking.drop("licence", "similarity"), got, "own_dir", "files", key).select(key, "path", F.col("x.given.licence").alias("licence"), F.when(F.col("x").isNotNull(), "inherited").alias("origin"), F.col("x.given.similarity").alias("similarity"), F.col("x.dir").alias("from_dir"))
    return named.where("licence is not null").select(key, "path", "licence", F.lit("own").alias("origin"), "similarity", F.lit(None).cast("string").alias("from_dir")).unionByName(inherited)


def op5_license_scan(spark, sf_dir):
    """Documents as files source/lang/doc_id; texts under 1000 characters that carry a licence line stand as their directory's licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    files = docs.select("doc_id", "text", F.concat_ws("/", name("source"), name("lang"), name("doc_id")).alias("path"))
    return scan_licences(files, "doc_id", licence_file=F.length("text") < 1000)
