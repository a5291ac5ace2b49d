"""Field values of sheets: merging of sources, caps, the flat row, the result document, evidence boxes.

fields: sheet_id, name, verbatim, corrected, basis, confidence, status, reason, notes (array), source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import text as X

# The fields in the order of the flat row, and what is said of a scale that names none.
FIELDS = ("project_name", "drawing_title", "architect", "draughtsperson", "drawing_number", "date", "scale", "drawing_type")
VAGUE_NOTE = "The sheet-level scale is non-specific and must not be inherited by figures"
PARTS = ("verbatim", "corrected", "correction_basis", "conf", "status", "reason")


def shown_value(verbatim: str = "verbatim", corrected: str = "corrected") -> Column:
    """The correction, else what was read; null for neither (an empty text is none)."""
    return F.coalesce(F.nullif(corrected, F.lit("")), F.nullif(verbatim, F.lit("")))


def merge_sources(rules: DataFrame, model: DataFrame, note: str = "model: ") -> DataFrame:
    """(sheet_id, name, value, source, notes): a rule's value stands; a model's for the same field is only noted."""
    r = rules.select("sheet_id", "name", F.col("value").alias("r"), F.lit(True).alias("has"))
    m = model.select("sheet_id", "name", F.col("value").alias("m"), F.lit(True).alias("had"))
    both = r.join(m, ["sheet_id", "name"], "full")
    noted = F.when(F.col("has") & F.col("had"), F.array(F.concat(F.lit(note), F.coalesce("m", F.lit(""))))).otherwise(F.array().cast("array<string>"))
    return both.select("sheet_id", "name", F.when(F.col("has"), F.col("r")).otherwise(F.col("m")).alias("value"), F.when(F.col("has"), "rule").otherwise("model").alias("source"), noted.alias("notes"))


def degraded(fields: DataFrame, sheets: DataFrame, low: float = 0.45, least: float = 0.5) -> DataFrame:
    """fields with the sheet's caps: an uncertain region, or any reason in `reasons`, caps the confidence at `low`, sends
    the field to review and adds the reasons to its notes. sheets: sheet_id, method, method_conf, reasons (array)."""
    unsure = F.col("method_conf") < least
    told = F.when(unsure & (F.col("method") != "fallback"), F.array(F.concat(F.lit("Localization method "), "method", F.lit(" has confidence of only "), F.col("method_conf").cast("string")))).otherwise(F.array().cast("array<string>"))
    s = sheets.select("sheet_id", unsure.alias("__unsure"), F.concat("reasons", told).alias("__told"))
    vague = F.when((F.col("name") == "scale") & F.coalesce(X.is_vague_scale(F.col("verbatim")), F.lit(False)), F.array(F.lit(VAGUE_NOTE))).otherwise(F.array().cast("array<string>"))
    out = fields.join(s, "sheet_id")
    cap = F.col("__unsure") | (F.size("__told") > 0)
    return out.withColumns({"confidence": F.when(cap, F.least("confidence", F.lit(low))).otherwise(F.col("confidence")), "status": F.when(cap, "needs_review").otherwise(F.col("status")), "notes": F.concat("notes", vague, "__told")}).drop("__unsure", "__told")


def flat_rows(sheets: DataFrame, fields: DataFrame) -> DataFrame:
    """A row for each sheet: its own columns (sheet_id, method, method_conf, error), seven columns of each field ('' where
    the field is missing), the processing status and the review status: `auto_accept` only if all fields that are there
    are, and nothing failed."""
    text = lambda c: F.coalesce(c, F.lit(""))
    of = {"": shown_value(), "_verbatim": F.col("verbatim"), "_corrected": F.col("corrected"), "_correction_basis": F.col("basis"), "_conf": F.round("confidence", 6).cast("string"), "_status": F.col("status"), "_reason": F.col("reason")}
    one = [F.max(F.when(F.col("name") == f, text(c))).alias(f"{f}{k}") for f in FIELDS for k, c in of.items()]
    wide = fields.filter(F.col("name").isin(*FIELDS)).groupBy("sheet_id").agg(*one, F.max((F.col("status") != "auto_accept").cast("int")).alias("__open"))
    names = [f"{f}{k}" for f in FIELDS for k in of]
    out = sheets.join(wide, "sheet_id", "left")
    failed = text(F.col("error")) != ""
    review = F.when(failed | (F.coalesce("__open", F.lit(0)) == 1), "needs_review").otherwise("auto_accept")
    return out.select("sheet_id", *[text(F.col(n)).alias(n) for n in names], F.col("method").alias("localization_method"), F.col("method_conf").alias("localization_conf"), F.when(failed, "failed").otherwise("success").alias("processing_status"), text(F.col("error")).alias("processing_error"), review.alias("review_status"))


def result_fields(fields: DataFrame) -> DataFrame:
    """The result document, a row for each field: value, conf to three places, the reason that is one of the fixed
    reasons, and the other notes."""
    every = F.concat(F.array("reason"), "notes")
    return fields.select("sheet_id", "name", shown_value().alias("value"), "verbatim", "corrected", F.col("basis").alias("correction_basis"), F.round("confidence", 3).alias("conf"), F.nullif("source", F.lit("")).alias("source"), X.reason_of(every).alias("reason"), X.other_notes(every).alias("notes"), F.col("status").alias("review_status"))


def result_documents(fields: DataFrame) -> DataFrame:
    """The same nested: a row for each sheet with a struct for each field that is there (null for the others)."""
    own = result_fields(fields)
    parts = F.struct(*[c for c in own.columns if c not in ("sheet_id", "name")])
    return own.groupBy("sheet_id").agg(*[F.max_by(F.when(F.col("name") == f, parts), F.col("name") == f).alias(f) for f in FIELDS])


def run_totals(rows: DataFrame) -> DataFrame:
    """Sheets, how many failed, and the exit code of a run."""
    failed = F.count_if(F.col("processing_status") == "failed")
    return rows.agg(F.count("*").alias("n"), failed.alias("failed"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"))


def token_boxes(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """The box around the tokens that each field names (column `tids`); ids that the sheet lacks are left out, and a
    field without any has null."""
    named = fields.select("sheet_id", "name", F.explode_outer(F.array_distinct("tids")).alias("tid"))
    found = named.join(tokens.select("sheet_id", "tid", "x0", "y0", "x1", "y1"), ["sheet_id", "tid"], "left")
    return found.groupBy("sheet_id", "name").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def evidence_box(regions: Column, total: Column) -> Column:
    """The box around the regions (arrays of four) that have an extent; else the total box if it has one; else null."""
    whole = lambda b: (F.size(b) == 4) & (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3))
    good = F.filter(F.coalesce(regions, F.array().cast("array<array<double>>")), whole)
    side = lambda k, f: f(F.transform(good, lambda b: F.get(b, k).cast("int")))
    own = F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
    return F.when(F.size(good) > 0, own).when(whole(total), F.transform(total, lambda v: v.cast("int")))


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row for all calls of the model that tell their tokens (prompt_tokens, completion_tokens, total_tokens of some
    size): their number, sums, whole averages, and tokens for a thousand images; averages are null without calls."""
    told = calls.filter(F.coalesce("total_tokens", F.lit(0)) > 0)
    n, pin, pout = F.count("*"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)), F.coalesce(F.sum("completion_tokens"), F.lit(0))
    sums = told.agg(n.alias("calls"), pin.alias("prompt"), pout.alias("completion"))
    per = lambda e: F.expr(f"try_divide({e} - pmod({e}, calls), calls)").cast("bigint")
    return sums.select("calls", "prompt", "completion", per("prompt").alias("prompt_each"), per("completion").alias("completion_each"), per("((prompt + completion) * 1000)").alias("per_thousand"))
