"""Runs and their records: doses by cycle and stage, routes of intents, replay keys, checkpoints, escalations; documents by one of several ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOSE = ["operations", "beacons", "counters", "expected_artifacts"]
# What makes a run state one of an active run, and the routes.
RUN_FIELDS = ["run_id", "current_stage", "stage", "status", "cycle", "dose"]
NO_RUN, PUBLISH, ELSE = "diagnose", "checkpoint", "ask"
TICKET, TICKET_DIGITS = "esc_", 20
# end of fixed values


def whole_number(value: Column) -> Column:
    """A whole number of zero or more, given as a number or as digits with blanks around them; null for anything else."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d+$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))


def doses(runs: DataFrame, table: DataFrame, cycle: str = "cycle", stage: str = "stage") -> DataFrame:
    """runs with found, dose_stage and DOSE of table(cycle, stage, DOSE): what a run at this cycle and stage is given. A part that a cell lacks is an empty array; a run without a
    cell, or with a cycle or stage that is no whole number, is not found and has null for all of them. Of several cells for one place the one with the smallest values counts."""
    cells = table.select(whole_number(F.col("cycle")).alias("_c"), whole_number(F.col("stage")).alias("_s"), F.struct(*(F.coalesce(F.col(x), F.array().cast("array<string>")).alias(x) for x in DOSE)).alias("_dose"))
    cells = cells.where("_c is not null and _s is not null").groupBy("_c", "_s").agg(F.min("_dose").alias("_dose"))
    rows = runs.withColumns({"_c": whole_number(F.col(cycle)), "_s": whole_number(F.col(stage))}).join(cells, ["_c", "_s"], "left")
    found = F.col("_dose").isNotNull()
    return rows.withColumns({"found": found, "dose_stage": F.when(found, F.col("_s")), **{x: F.col(f"_dose.{x}") for x in DOSE}}).drop("_c", "_s", "_dose")


def route(run_state: Column, payload: Column, signals: list[tuple[str, str | None]]) -> Column:
    """Where an intent goes. run_state and payload are JSON texts. NO_RUN: the state is no object, names an error, or has none of RUN_FIELDS. PUBLISH: one of the signals is in the payload, a dotted path
    with the text it must equal, or with None for anything but null, false and blank text. ELSE otherwise; without signals nothing is ever published."""
    keys = F.json_object_keys(run_state)
    active = keys.isNotNull() & ~F.array_contains(keys, "error") & F.arrays_overlap(keys, F.array(*map(F.lit, RUN_FIELDS)))
    value = F.try_parse_json(payload)

    def given(path: str, equals: str | None) -> Column:
        at = F.try_variant_get(value, f"$.{path}", "variant")
        kind, text = F.schema_of_variant(at), F.try_variant_get(value, f"$.{path}", "string")
        if equals is not None:
            return (kind == "STRING") & (text == equals)
        return F.when(kind == "STRING", F.trim(F.regexp_replace(text, r"\s", " ")) != "").when(kind == "BOOLEAN", text == "true").otherwise(kind != "VOID")

    told = F.lit(False)
    for path, equals in signals:
        told = told | F.coalesce(given(path, equals), F.lit(False))
    return F.when(~F.coalesce(active, F.lit(False)), NO_RUN).when(told, PUBLISH).otherwise(ELSE)


def replay_key(scope: Column, run: Column, stage: Column, digest: Column) -> Column:
    """The key of a hand-in: scope or else run, stage, digest; parts that are absent are left out, and without scope and run the stage is too."""
    owner = F.nullif(F.coalesce(scope, run), F.lit(""))
    return F.when(owner.isNull(), digest).otherwise(F.concat_ws(":", owner, stage.cast("string"), digest))


def recorded(stored: DataFrame, incoming: DataFrame, key: str = "handin_hash", order: str = "at") -> tuple[DataFrame, DataFrame]:
    """(records, answers): stored records with the first of each new hand-in, and for each incoming row the record that counts, with `created`: whether it is this row's own. A hand-in that was
    seen before gets the answer it got then. Rows without a hand-in are left out."""
    first = Window.partitionBy(key).orderBy(order, *sorted(c for c in incoming.columns if c not in (key, order)))
    asked = incoming.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first))
    new = asked.where("_n = 1").drop("_n").join(stored.select(key), key, "left_anti")
    records = stored.unionByName(new)
    known = stored.select(F.col(key), F.lit(True).alias("_old"))
    rest = [c for c in records.columns if c != key]
    answers = asked.select(key, "_n", F.col(order).alias("asked_at")).join(records.select(key, *rest), key).join(known, key, "left")
    return records, answers.withColumn("created", F.col("_old").isNull() & (F.col("_n") == 1)).drop("_old", "_n")


def stages_passed(checkpoints: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(credential_id, stage) -> with `passed`: a go was recorded for this very stage."""
    go = checkpoints.where("go").select("credential_id", "stage").distinct().withColumn("passed", F.lit(True))
    return asked.join(go, ["credential_id", "stage"], "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def ticket(credential: Column, review: Column, issue: Column, kind: Column) -> Column:
    """The same escalation always has the same ticket."""
    return F.concat(F.lit(TICKET), F.left(F.sha2(F.concat(credential, F.lit("|"), F.coalesce(review, F.lit("")), F.lit("|"), issue, F.lit("|"), kind), 256), F.lit(TICKET_DIGITS)))


def escalated(stored: DataFrame, raised: DataFrame) -> DataFrame:
    """stored(ticket, credential_id, review_run_id, issue, class, status, at) and raised(credential_id, review_run_id, issue, class, at): new ones are open, known ones stay as they are."""
    rows = raised.withColumns({"ticket": ticket(F.col("credential_id"), F.col("review_run_id"), F.col("issue"), F.col("class")), "status": F.lit("open")})
    new = rows.where("ticket is not null").groupBy("ticket").agg(F.min_by(F.struct("credential_id", "review_run_id", "issue", "class", "status", "at"), "at").alias("r")).select("ticket", "r.*")
    return stored.unionByName(new.join(stored.select("ticket"), "ticket", "left_anti"))


def escalations_of(stored: DataFrame, credential: str) -> DataFrame:
    return stored.where(F.col("credential_id") == credential).orderBy(F.desc("at"), "ticket")


def by_precedence(asked: DataFrame, documents: DataFrame, forms: list[tuple[str, Column]], visible: Column) -> DataFrame:
    """asked(ask, kind, id), documents with doc_id -> (ask, doc_id, kind): the visible document by the first of the forms (kind, column) that finds one; of several the smallest doc_id. What is
    deleted or only listed is not found, like what never was."""
    order = F.create_map(*(F.lit(x) for k, (kind, _) in enumerate(forms) for x in (kind, k)))
    ids = F.array(*(F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("id")) for kind, c in forms))
    known = documents.where(F.coalesce(visible, F.lit(False))).select("doc_id", F.inline(ids)).where("id is not null")
    known = known.groupBy("kind", "id").agg(F.min("doc_id").alias("doc_id"))  # an id that many documents share meets each ask once
    met = asked.where(F.col("id").isNotNull()).join(known, ["kind", "id"]).groupBy("ask").agg(F.min(F.struct(order[F.col("kind")].alias("place"), "doc_id", "kind")).alias("r"))
    return met.select("ask", "r.doc_id", "r.kind")


def asked_ids(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows(ask, ...) -> (ask, kind, id) of the ids that were given, by kind; a DOI that a preprint server gave is read as the preprint's own id."""
    doi = columns.get("doi", F.lit(None).cast("string"))
    own = F.nullif(F.regexp_extract(F.trim(doi), r"(?i)^10\.48550/arXiv\.(\S+)$", 1), F.lit(""))
    columns = columns | {"doi": F.when(own.isNull(), doi), "arxiv": F.coalesce(columns.get("arxiv", F.lit(None).cast("string")), own)}
    given = F.array(*(F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("id")) for kind, c in columns.items()))
    return rows.select("ask", F.inline(given)).where("id is not null")
