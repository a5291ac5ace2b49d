"""Box expressions. A box is four integer columns x0, y0, x1, y1 (with a prefix), y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    return ((F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))).cast("double")


def overlap(p: str, q: str) -> Column:
    """Shared area; boxes that only touch share none."""
    w = F.least(f"{p}x1", f"{q}x1") - F.greatest(f"{p}x0", f"{q}x0")
    h = F.least(f"{p}y1", f"{q}y1") - F.greatest(f"{p}y0", f"{q}y0")
    return F.when((w > 0) & (h > 0), (w * h).cast("double")).otherwise(F.lit(0.0))


def iou(p: str, q: str) -> Column:
    shared = overlap(p, q)
    return shared / F.greatest(area(p) + area(q) - shared, F.lit(1.0))


def io_min(p: str, q: str) -> Column:
    """Shared area over the smaller box."""
    return overlap(p, q) / F.greatest(F.least(area(p), area(q)), F.lit(1.0))


def contains(outer: str, inner: str, ratio: float = 0.7) -> Column:
    return overlap(outer, inner) / F.greatest(area(inner), F.lit(1.0)) >= ratio


def centre_inside(p: str, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    cx, cy = (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2, (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2
    return cx.between(x0, x1) & cy.between(y0, y1)


def union_box(df: DataFrame, *by: str) -> DataFrame:
    """The least box around all of a group."""
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def scaled_back(factor: float | Column, p: str = "") -> list[Column]:
    """A box read from an enlarged image, on the original: mins rounded down, maxes up."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return [F.floor(F.col(f"{p}{c}") / f).cast("int").alias(f"{p}{c}") for c in ("x0", "y0")] + [F.ceil(F.col(f"{p}{c}") / f).cast("int").alias(f"{p}{c}") for c in ("x1", "y1")]


def enlargement(width: Column, height: Column, wanted: Column, longest: int = 4000) -> Column:
    """The wanted factor, less if the long side would pass `longest` pixels, at least 0.1."""
    return F.greatest(F.least(wanted, F.lit(float(longest)) / F.greatest(width, height)), F.lit(0.1))
