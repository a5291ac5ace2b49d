"""Joins of intervals and points within a key, by bins of the coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(spans: DataFrame, points: DataFrame, key: str, low: Column, high: Column, point: Column, bin_width: tuple[Column, Column], keep: Column | None = None) -> DataFrame:
    """Each span with the points of its key that lie in it, both ends included. low and high are of spans, point of points;
    bin_width: the width of a bin, as a column of either. A span goes to the bins that it touches and a point to its own,
    so only those of a bin meet (an equi-join, then the exact condition and `keep`); spans should be some bins wide. The
    columns of both but for the key must have different names. Null ends or points meet nothing."""
    mine, other = bin_width
    first, last = F.floor(low / mine), F.floor(high / mine)
    wide = spans.withColumns({"__low": low, "__high": high, "__bin": F.explode(F.when(first <= last, F.sequence(first, last)))})
    near = points.withColumns({"__point": point, "__its_bin": F.floor(point / other), "__its_key": F.col(key)}).drop(key)
    on = (F.col(key) == F.col("__its_key")) & (F.col("__bin") == F.col("__its_bin")) & F.col("__point").between(F.col("__low"), F.col("__high"))
    met = wide.join(near, on if keep is None else on & keep)
    return met.drop("__low", "__high", "__bin", "__point", "__its_bin", "__its_key")


def box_pairs(boxes: DataFrame, key: str, order: str, carry: tuple[str, ...] = (), cell: int = 64) -> DataFrame:
    """Pairs of boxes of a key that share some area, the one of the lesser `order` as a_, the other as b_ (a_x0, ..., and the
    columns to carry). A box goes to the cells of a grid that it touches; two boxes meet in one cell only, the first that both
    touch, so each pair comes once. Null sides meet nothing."""
    sides = ("x0", "y0", "x1", "y1")
    at = lambda c: F.floor(F.col(c) / cell)
    over = lambda lo, hi: F.explode(F.when(F.col(lo) <= F.col(hi), F.sequence(at(lo), at(hi))))

    def side(p: str) -> DataFrame:
        own = boxes.select(F.col(key), *[F.col(c).alias(f"{p}{c}") for c in dict.fromkeys((order, *sides, *carry))])
        own = own.withColumns({f"{p}cx": at(f"{p}x0"), f"{p}cy": at(f"{p}y0")})
        return own.withColumn("__cx", over(f"{p}x0", f"{p}x1")).withColumn("__cy", over(f"{p}y0", f"{p}y1"))

    first = (F.col("__cx") == F.greatest("a_cx", "b_cx")) & (F.col("__cy") == F.greatest("a_cy", "b_cy"))
    meet = (F.least("a_x1", "b_x1") > F.greatest("a_x0", "b_x0")) & (F.least("a_y1", "b_y1") > F.greatest("a_y0", "b_y0"))
    both = side("a_").join(side("b_"), [key, "__cx", "__cy"])
    return both.filter((F.col(f"a_{order}") < F.col(f"b_{order}")) & first & meet).drop("__cx", "__cy", "a_cx", "a_cy", "b_cx", "b_cy")
