"""Boxes of lines, columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import geometry as G

# What a title block's labels and headers look like.
LABELS = {"drawn": r"^DRAWN\b", "checked": r"^(?:CHECK(?:ED)?|CHKD)\b", "scale": r"^SCALES?\b", "date": r"^(?:DATE|D4TE|DA7E|DAT3|0ATE)\b", "number": r"^(?:DRG|DWG|DRAWING)\W*(?:NO\b|NUMBER\b)", "approved": r"^APPROVED\b"}


def measures(tokens: DataFrame) -> DataFrame:
    """Adds w, h, cx, cy."""
    return tokens.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def shifted(tokens: DataFrame, x: Column, y: Column) -> DataFrame:
    """Boxes of a crop on the sheet it was cut from."""
    return tokens.withColumns({c: F.col(c) + (x if c[0] == "x" else y) for c in ("x0", "y0", "x1", "y1")})


def across(p: str, q: str) -> Column:
    """Shared width over the smaller width."""
    shared = F.least(f"{p}x1", f"{q}x1") - F.greatest(f"{p}x0", f"{q}x0")
    return F.when(shared <= 0, 0.0).otherwise(shared / F.greatest(F.least(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{q}x1") - F.col(f"{q}x0")), F.lit(1)))


def gap(p: str, q: str, vertical: float = 0.6) -> Column:
    """Distance of two boxes, with less weight on the vertical."""
    side = lambda c: F.greatest(F.lit(0), F.col(f"{p}{c}0") - F.col(f"{q}{c}1"), F.col(f"{q}{c}0") - F.col(f"{p}{c}1"))
    return F.sqrt(F.pow(side("x"), F.lit(2)) + F.pow(vertical * side("y"), F.lit(2)))


def compactness(lines: DataFrame, *by: str) -> DataFrame:
    """Of each group of lines the share of its box that lines cover, 1 at most, and the box's area."""
    box = (F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))
    ink = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return lines.groupBy(*by).agg(F.least(ink / F.greatest(box, F.lit(1)), F.lit(1.0)).alias("compactness"), box.alias("area"))


def in_column(p: str, x0: Column, y0: Column, x1: Column, y1: Column, least: float = 0.8) -> Column:
    """Is the token's centre in the column's height, and enough of its width in the column?"""
    cy = (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2
    inside = F.greatest(F.lit(0), F.least(F.col(f"{p}x1"), x1) - F.greatest(F.col(f"{p}x0"), x0))
    return cy.between(y0, y1) & (inside >= least * F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(1)))


def coverage(boxes: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Of each box (key, x0 to y1) the share of its members' centres that lie in it; 1 without members."""
    b = boxes.select(key, *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = G.centre_inside("", F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1")).cast("int")
    return b.join(members, key, "left").groupBy(key).agg(F.coalesce(F.avg(hit), F.lit(1.0)).alias("coverage"))


def snapped(box: str, xs: str, ys: str, width: Column, height: Column, share: float = 0.06, least: int = 20) -> list[Column]:
    """Each side of a box moved to the nearest line (arrays xs, ys; the first of equally near ones) that is within a share
    of the page, clamped to the page; the old box if less than `least` pixels would be left on a side."""
    def near(side: Column, lines: str, most: Column) -> Column:
        by = F.transform(F.col(lines), lambda v, i: F.struct(F.abs(v - side).alias("d"), i.alias("i"), v.alias("v")))
        return F.coalesce(F.array_min(F.filter(by, lambda c: c["d"] <= most))["v"], side)

    old = {c: F.col(f"{box}{c}") for c in ("x0", "y0", "x1", "y1")}
    new = {c: near(v, xs if c[0] == "x" else ys, (width if c[0] == "x" else height) * share) for c, v in old.items()}
    new = {"x0": F.greatest(F.lit(0), new["x0"]), "y0": F.greatest(F.lit(0), new["y0"]), "x1": F.least(width, new["x1"]), "y1": F.least(height, new["y1"])}
    small = (new["x1"] - new["x0"] < least) | (new["y1"] - new["y0"] < least)
    return [F.when(small, old[c]).otherwise(new[c]).cast("int").alias(c) for c in old]


def labels_of(tokens: DataFrame) -> DataFrame:
    """(sheet_id, labels): the title block's labels that a sheet has, in order."""
    t = F.regexp_replace(F.upper("text"), r"^[ .:,;]+|[ .:,;]+$", "")
    found = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in LABELS.items()]))
    return tokens.groupBy("sheet_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(found)))).alias("labels"))


def is_header(s: Column) -> Column:
    letters = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    return F.upper(F.trim(s)).rlike(r"^TITLE\b") | letters.contains("ARCHITECTS") | letters.contains("PTYLTD")


def scales(height: Column, long_side: Column, wanted: float, least: float, most: float, longest: int = 4000) -> Column:
    """The enlargement of a crop whose characters have this height (0: unknown)."""
    up = F.when(height > 0, F.least(F.greatest(wanted / F.nullif(height, F.lit(0.0)), F.lit(least)), F.lit(most))).otherwise(F.lit(least))
    return F.greatest(F.least(up, longest / long_side), F.lit(0.1))


def coarse_scale(height: Column, long_side: Column, wanted: float = 26.0, without: float = 2.0, longest: int = 4000) -> Column:
    """The enlargement of a whole page for its first reading: by the height of its characters, or `without` that; bounded
    only by the longest side."""
    up = F.when(height > 0, wanted / F.nullif(height, F.lit(0.0))).otherwise(F.lit(without))
    return F.when(up * long_side > longest, longest / long_side).otherwise(up)
