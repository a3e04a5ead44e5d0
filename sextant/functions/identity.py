"""Identifiers, canonical JSON and licences."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(16)))


def point_id(key: Column) -> Column:
    """SHA-256 in the form of a UUID."""
    h = F.sha2(key, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def record_id(scope: Column, kind: Column, local: Column) -> Column:
    return F.concat_ws(":", scope, kind, local)


def record_parts(record: Column) -> Column:
    """scope, kind and local name; the last two parts are the latter."""
    parts = F.split(record, ":")
    n = F.size(parts)
    return F.struct(F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), ":").alias("scope"), F.try_element_at(parts, n - 1).alias("kind"), F.try_element_at(parts, n).alias("local"))


def _number(x: float | int) -> str:
    """The shortest decimal form that reads back, as ECMAScript writes it."""
    if isinstance(x, int) or (float(x).is_integer() and abs(x) < 1e21):
        return str(int(x))
    text = repr(float(x))
    mantissa, _, exponent = text.partition("e")
    if exponent:
        n = int(exponent)
        if -7 < n < 0:
            digits = mantissa.replace(".", "").replace("-", "")
            return ("-" if x < 0 else "") + "0." + "0" * (-n - 1) + digits
        return f"{mantissa}e{'+' if n > 0 else '-'}{abs(n)}"
    return text


def canonical(value: object) -> str:
    """Canonical JSON: members sorted by UTF-16 code units, no blanks, numbers in their shortest form."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int | float):
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("not a JSON number")
        return _number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    members = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in members) + "}"


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Null for null and for what is no JSON. Number and string forms differ from to_json, hence Python."""
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


#: Attributes of Creative Commons licences and their order in an identifier.
CC_FORMS = {"by": "BY", "by-sa": "BY-SA", "by-nd": "BY-ND", "by-nc": "BY-NC", "by-nc-nd": "BY-NC-ND", "by-nd-nc": "BY-NC-ND", "by-nc-sa": "BY-NC-SA", "by-sa-nc": "BY-NC-SA"}
#: Other names and their identifiers.
LICENCE_NAMES = {"cc0": "CC0-1.0", "cc0-1.0": "CC0-1.0", "cc-zero": "CC0-1.0", "public-domain": "CC-PDDC", "pd": "CC-PDDC", "mit": "MIT", "apache-2.0": "Apache-2.0", "bsd": "BSD-3-Clause", "bsd-3-clause": "BSD-3-Clause"}
#: Sources of licences, the most trusted first.
LICENCE_SOURCES = ["portal", "arxiv_oai", "crossref", "openalex", "unpaywall", "core", "pmc"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def licence(raw: Column) -> Column:
    """Identifier of a URL, an identifier in any case, or a name; NOASSERTION for all else."""
    low = F.lower(F.trim(raw))
    compact = F.replace(F.regexp_replace(low, r"\s+", "-"), F.lit("_"), F.lit("-"))
    url = r"creativecommons\.org/licenses/([a-z-]+)/(\d+\.\d+)"
    cc = lambda kind, version: F.concat(F.lit("CC-"), _lookup(CC_FORMS, kind), F.lit("-"), version)
    spdx = r"^cc-([a-z-]+?)-?(\d+\.\d+)?$"
    version = F.regexp_extract(compact, spdx, 2)
    found = (
        F.when(low.contains("arxiv.org/licenses/nonexclusive-distrib"), "LicenseRef-arxiv-nonexclusive")
        .when(low.contains("arxiv.org/licenses/assumed-1991-2003"), "LicenseRef-arxiv-assumed")
        .when(low.contains("creativecommons.org/publicdomain/zero"), "CC0-1.0")
        .when(low.contains("creativecommons.org/publicdomain/mark"), "CC-PDDC")
        .when(low.rlike(url), cc(F.regexp_extract(low, url, 1), F.regexp_extract(low, url, 2)))
        .when(_lookup(LICENCE_NAMES, compact).isNotNull(), _lookup(LICENCE_NAMES, compact))
        .when(compact.rlike(spdx), cc(F.regexp_extract(compact, spdx, 1), F.when(version == "", "4.0").otherwise(version)))
    )
    return F.coalesce(found, F.lit("NOASSERTION"))


def is_open(spdx: Column) -> Column:
    return spdx.isin("NOASSERTION", "CC0-1.0", "CC-PDDC", "MIT", "Apache-2.0", "BSD-3-Clause") | spdx.rlike(r"^CC-BY(-SA)?-\d+\.\d+$")


def effective_licence(by_source: Column) -> Column:
    """Of a map source -> identifier: the first open one by source, else the first."""
    value = [F.try_element_at(by_source, F.lit(s)) for s in LICENCE_SOURCES]
    return F.coalesce(*(F.when(is_open(v), v) for v in value), *value, F.lit("NOASSERTION"))


def merged_licences(prior: Column, incoming: Column) -> Column:
    """By source: the prior one stays unless the incoming one is open and it is not."""
    return F.map_zip_with(prior, incoming, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).when(is_open(b) & ~is_open(a), b).otherwise(a))


def tier(spdx: Column, has_text: Column) -> Column:
    return F.when(is_open(spdx) & has_text, "full").when(has_text, "abstract").otherwise("listed")


def accessibility(tier_: Column, spdx: Column) -> Column:
    reason = F.when(tier_ == "full", F.lit(None)).when(~is_open(spdx), F.lit("closed licence")).otherwise("no full text")
    return F.struct((tier_ == "full").alias("readable"), reason.cast("string").alias("reason"))
