"""Rows, ids, rotation and density of tokens."""

from __future__ import annotations

import statistics
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.operators.folding import folded, gathered, numbers


def rotated(tokens: DataFrame) -> DataFrame:
    """Adds rotated: twice as high as wide, and 1.8 times the sheet's median height (20 where that is 0)."""
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    median = F.coalesce(F.nullif(F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy("sheet_id")), F.lit(0.0)), F.lit(20.0))
    return tokens.withColumn("rotated", (h >= 2 * w) & (h >= 1.8 * median))


def rows(tokens: DataFrame, y_tol: float = 0.5, x_gap: float = 6.0) -> DataFrame:
    """Adds row_no, from 1 by the rows' tops. A token joins the row that is open if it lies near the running median of
    the row's centres and near its right end, so it is a fold over each sheet."""

    def fold(given: list[tuple]) -> list[int]:
        out = [0] * len(given)
        for n, (_, _, row) in enumerate(_rows(given, y_tol, x_gap), 1):
            for k in row:
                out[k] = n
        return out

    return folded(tokens, "sheet_id", [_reading(), "x0", "seq"], ["x0", "y0", "x1", "y1"], fold, "row_no")


def _reading() -> Column:
    return F.bround((F.col("y0") + F.col("y1")) / 8)


def _rows(given: list[tuple], y_tol: float, x_gap: float) -> list[tuple]:
    """The rows (top, left, places of the tokens) of upright tokens in reading order, by their tops."""
    if not given:
        return []
    height = max(float(statistics.median(y1 - y0 for _, y0, _, y1 in given)), 1.0)
    found: list[list[tuple]] = []
    for k, (x0, y0, x1, y1) in enumerate(given):
        y = (y0 + y1) / 2
        if found and abs(y - statistics.median(t[1] for t in found[-1])) <= height * y_tol and x0 - max(t[2] for t in found[-1]) < height * x_gap:
            found[-1].append((k, y, x1, y0, x0))
        else:
            found.append([(k, y, x1, y0, x0)])
    return sorted(((min(t[3] for t in row), min(t[4] for t in row), [t[0] for t in row]) for row in found), key=lambda row: row[:2])


def in_lines(tokens: DataFrame, y_tol: float = 0.5, x_gap: float = 6.0) -> DataFrame:
    """(sheet_id, tid, t): t has a token's columns and row_no, the place of its line from the top, from 1; tid is its own place
    from 0, line by line from the left. Upright tokens form rows, a rotated one is a line of its own. All in a sheet's row."""

    def lines_of(given: list[tuple]) -> list[int]:
        usual = 1.8 * (float(statistics.median(y1 - y0 for _, y0, _, y1, _ in given)) or 20.0)
        turned = [max(y1 - y0, 1) >= 2 * max(x1 - x0, 1) and max(y1 - y0, 1) >= usual for x0, y0, x1, y1, _ in given]
        upright = [k for k, alone in enumerate(turned) if not alone]
        found = [(y, x, 0, n, [upright[k] for k in row]) for n, (y, x, row) in enumerate(_rows([given[k][:4] for k in upright], y_tol, x_gap))]
        found += [(given[k][1], given[k][0], 1, given[k][4], [k]) for k, alone in enumerate(turned) if alone]
        out = [0] * len(given)
        for n, line in enumerate(sorted(found), 1):
            for k in line[4]:
                out[k] = n
        return out

    def fold(sizes: np.ndarray, *columns: pa.Array) -> list[int]:
        given = list(zip(*(c.to_pylist() for c in columns), strict=True))
        return [n for a, b in pairwise([0, *np.cumsum(sizes).tolist()]) if a < b for n in lines_of(given[a:b])]

    of_sheet = gathered(tokens, "sheet_id", [_reading(), F.col("x0"), F.col("seq")], [c for c in tokens.columns if c != "sheet_id"])
    g = F.col("g")
    of_sheet = of_sheet.withColumn("n", numbers(fold, *[g[c] for c in ("x0", "y0", "x1", "y1", "seq")]))
    line = lambda t, i: F.get(F.col("n"), i).alias("row_no")
    placed = F.array_sort(F.transform(g, lambda t, i: F.struct(line(t, i), t["x0"].alias("__x"), t["seq"].alias("__seq"), t.alias("t"))))
    return of_sheet.select("sheet_id", F.posexplode(placed).alias("tid", "p")).select("sheet_id", "tid", F.struct("p.t.*", "p.row_no").alias("t"))


def token_ids(tokens: DataFrame, *order: str) -> DataFrame:
    """Adds tid, dense from 0 in each sheet."""
    return tokens.withColumn("tid", F.row_number().over(Window.partitionBy("sheet_id").orderBy(*order)) - 1)


def density(tokens: DataFrame, width: int, height: int, bins: int = 48) -> DataFrame:
    """Area of the tokens whose centres lie in each bin of a grid over the sheet."""
    at = lambda a, b, n: F.least(F.floor((F.col(a) + F.col(b)) / 2 / n * bins), F.lit(bins - 1)).cast("int")
    return tokens.groupBy("sheet_id", at("x0", "x1", width).alias("bx"), at("y0", "y1", height).alias("by")).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("ink"))


def peaks(df: DataFrame, key: str, at: str, gap: int = 6) -> DataFrame:
    """Runs of places at most `gap` apart, each as its integer mean."""
    w = Window.partitionBy(key).orderBy(at)
    # equal places follow one another where a key is sorted: no table of distinct ones is held before the shuffle
    first = F.row_number().over(w) == 1
    step = df.select(key, at).withColumns({"__before": F.lag(at).over(w), "__first": first})
    step = step.filter(F.col("__first") | ~F.col(at).eqNullSafe(F.col("__before")))
    new = (F.col(at) - F.col("__before") > gap).cast("int")
    runs = step.withColumn("__new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(key, "run").agg(F.floor(F.avg(at)).cast("bigint").alias("peak"), F.count("*").alias("n"))
