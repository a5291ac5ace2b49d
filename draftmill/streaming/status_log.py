"""The status log as a stream: the last state of each key so far, and late rows by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(log: DataFrame, key: str, at: str) -> DataFrame:
    """For a streaming log: the state of each key, updated with each batch (output mode update or complete)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, *[f"r.{c}" for c in rest])


def activity(log: DataFrame, at: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by status in windows of time; rows later than `late` are left out."""
    return log.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "status").agg(F.count("*").alias("n")).select("w.start", "status", "n")
