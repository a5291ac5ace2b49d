"""Quality of images: verdicts, and their summary by series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmill.functions import text as X


def summary(rows: DataFrame) -> DataFrame:
    """By series: count, median height (missing counts as 0), verdicts, and the share that is unrecoverable."""
    v = lambda k: F.count_if(F.col("verdict") == k)
    return rows.groupBy(F.coalesce("series", F.lit("unknown")).alias("series")).agg(F.count("*").alias("n"), F.round(F.median(F.coalesce("height", F.lit(0.0))), 4).alias("median_height"), v("reliable").alias("reliable"), v("marginal").alias("marginal"), v("unrecoverable").alias("unrecoverable"), F.round(v("unrecoverable") * 100.0 / F.count("*"), 1).alias("pct_unrecoverable"))


def noise(tokens: DataFrame) -> DataFrame:
    """Share of a sheet's readings of at most three characters without a digit."""
    junk = (F.length(F.trim("text")) <= 3) & ~F.col("text").rlike("[0-9]")
    return tokens.groupBy("sheet_id").agg(F.round(F.avg(junk.cast("int")), 6).alias("noise"))


def probe(tokens: DataFrame) -> DataFrame:
    """How many of the usual title-block words a sheet's texts have, joined in order; each counts once."""
    joined = tokens.groupBy("sheet_id").agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")).alias("all"))
    return joined.select("sheet_id", sum((F.col("all").contains(w).cast("int") for w in X.PROBE_WORDS), F.lit(0)).alias("probes"))
