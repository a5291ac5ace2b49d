"""The text that asks a model for the fields which rules left open, as an expression over a sheet's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.operators.records import FIELDS

#: What each field is, as the model is told.
DESCRIPTIONS = {
    "project_name": "what is built, for whom, and where, with its address",
    "drawing_title": "what this drawing shows, not the project it is of",
    "architect": "the person or practice that drew or issued it; the name alone",
    "draughtsperson": "who drew it, mostly initials, right of the label or below it",
    "drawing_number": "such as 12/A3 or A-1234; null rather than a forced value",
    "date": "of the drawing, not of a revision",
    "scale": "of the whole sheet",
    "drawing_type": "plan, elevation, section, perspective, detail or mixed, judged by the title and the text; cite no tokens",
}
TASK = "Reply with one JSON object, by field: tokens (ids of the index), verbatim (their texts, joined by blanks), corrected, correction_basis, confidence (high, medium, low), reason (if null), note. Every text must come from the index."


def _lines(pairs: Column, mark: str) -> Column:
    """A line for each struct of two texts."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("  "), p["k"], F.lit(mark), F.coalesce(p["v"], F.lit("")))), "\n")


def prompts(views: DataFrame, fields: DataFrame, descriptions: dict[str, str] | None = None, task: str = TASK) -> DataFrame:
    """(sheet_id, pending, prompt). views: sheet_id, grid, index. fields: sheet_id, name, locked, verbatim, and rejected (why
    a claim was turned down), a row at most for each field. Sheets with nothing pending have a null prompt; fields that have
    no description are not asked for."""
    told = DESCRIPTIONS if descriptions is None else descriptions
    pair = lambda v: F.struct(F.col("name").alias("k"), v.alias("v"))
    own = fields.filter(F.col("name").isin(*FIELDS)).groupBy("sheet_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("locked"), pair(F.col("verbatim"))))).alias("known"),
        F.sort_array(F.collect_list(F.when(~F.col("locked") & F.col("rejected").isNotNull(), pair(F.col("rejected"))))).alias("doubted"),
    )
    none = lambda c: F.coalesce(c, F.array().cast("array<struct<k:string,v:string>>"))
    at = views.join(own, "sheet_id", "left").withColumns({"known": none("known"), "doubted": none("doubted")})
    every = F.array(*[F.struct(F.lit(f).alias("k"), F.lit(told[f]).alias("v")) for f in FIELDS if f in told])
    open_ = F.filter(every, lambda p: ~F.exists("known", lambda q: q["k"] == p["k"]))
    at = at.withColumn("wanted", open_)
    doubts = F.when(F.size("doubted") > 0, F.concat(F.lit("\nThe rules weren't sure of these:\n"), _lines(F.col("doubted"), ": "), F.lit("\n"))).otherwise("")
    known = F.when(F.size("known") > 0, _lines(F.col("known"), " = ")).otherwise("  (none)")
    whole = F.concat(F.lit("GRID\n"), F.coalesce("grid", F.lit("")), F.lit("\n\nINDEX\n"), F.coalesce("index", F.lit("")), F.lit("\n\nAlready known:\n"), known, F.lit("\n\nWanted:\n"), _lines(F.col("wanted"), ": "), F.lit("\n"), doubts, F.lit("\n" + task))
    return at.select("sheet_id", F.col("wanted")["k"].alias("pending"), F.when(F.size("wanted") > 0, whole).alias("prompt"))
