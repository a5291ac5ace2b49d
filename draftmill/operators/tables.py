"""The title block's table on a sheet, from its ruled lines and its tokens.

pages: sheet_id, w, h. lines: sheet_id, horizontal, seq, x0, y0, x1, y1 (of one orientation from left to right or from top to
bottom). tokens: sheet_id, tid, text, x0, y0, x1, y1. boxes: sheet_id, cid, x0, y0, x1, y1. All shares are of the page's
width or height.

A sheet's lines and tokens meet in one row (`ruled`, `contents`; one shuffle by sheet), and what is decided for a pair of
lines or a box is expressions over that row's arrays; a sheet has some hundred lines, of which the longest are taken, and the
tokens of a page. Growing upward is a fixpoint of twelve rounds at most, folded in the
plan.

Defined results: sheets without a page, lines or tokens have no boxes of the kinds that need them; null texts are empty;
ties go to the first by seq, tid or cid.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.functions import text as X
from draftmill.functions.staging import let, stage
from draftmill.operators.folding import gathered, numbers
from draftmill.operators.regions import LABELS, is_header

# The labels that speak for a title block, those of its working group, and headings of lists.
OPERATORS = ("drawn", "checked", "scale", "number", "approved")
WORKING = ("drawn", "checked", "scale", "approved")
LIST_HEADER = r"^(?:ITEM|DESCRIPTION|NO\.?\s*REQ\.?|MATL\.?|MATERIAL|REVISIONS?)$"
LIST_TOP = r"^(?:REVISION[S]?|ITEM|DESCRIPTION|NO\.?\s*REQ\.?)$"
SIDE_LABEL = r"TITLE|ITLE|DRG\W*NO"

#: Lines that are merged: at most so many of an orientation, the longest.
LONGEST = 240
#: Rounds of growing upward.
ROUNDS = 12
SIDES = ("x0", "y0", "x1", "y1")


def _box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(k) for k, c in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def _own(b: Column | None = None) -> Column:
    return _box(*[F.col(k) if b is None else b[k] for k in SIDES])


def _around(box: Column, tokens: Column) -> Column:
    """The box around a box and tokens."""
    def of(ts: Column) -> Column:
        low = lambda k: F.least(box[k], F.array_min(F.transform(ts, lambda t: t[k])))
        high = lambda k: F.greatest(box[k], F.array_max(F.transform(ts, lambda t: t[k])))
        return _box(low("x0"), low("y0"), high("x1"), high("y1"))

    return let(tokens, of)


def merged_lines(lines: DataFrame, pages: DataFrame, most: int = LONGEST) -> DataFrame:
    """The longest lines of each sheet and orientation, those that continue one another made one, in groups numbered by
    seq. The longest lines come first; a line joins the first group whose longest line has its angle (2 degrees) and
    passes its middle, if a line of the group ends near enough. A group runs from its first start to its last end."""
    across = F.col("horizontal")
    flat = lines.join(pages, "sheet_id")
    # along and across the orientation
    u0, v0, u1, v1 = (F.when(across, F.col(a)).otherwise(F.col(b)).cast("double") for a, b in (("x0", "y0"), ("y0", "x0"), ("x1", "y1"), ("y1", "x1")))
    back = u1 < u0
    flat = flat.select("sheet_id", "horizontal", "seq", *[F.when(back, b).otherwise(a).alias(k) for k, a, b in (("u0", u0, u1), ("v0", v0, v1), ("u1", u1, u0), ("v1", v1, v0))], F.when(across, F.col("w") * 0.05).otherwise(F.col("h") * 0.035).cast("double").alias("gap"), F.greatest(F.lit(4.0), F.when(across, F.col("h") * 0.006).otherwise(F.col("w") * 0.003)).cast("double").alias("off"))
    # the longest first; what has no length comes last
    length = F.sqrt((F.col("u1") - F.col("u0")) ** 2 + (F.col("v1") - F.col("v0")) ** 2)
    rank = F.when(F.isnan(length), float("-inf")).otherwise(F.coalesce(-length, F.lit(float("inf"))))
    used = ["u0", "v0", "u1", "v1", "gap", "off"]
    of_sheet = gathered(flat, ("sheet_id", "horizontal"), [rank, F.col("seq")], used)
    of_sheet = of_sheet.select("sheet_id", "horizontal", F.filter(F.slice("g", 1, most), lambda t: t["u1"] - t["u0"] >= 1).alias("g"))

    def groups_of(rows: list[tuple]) -> list[int]:
        groups: list[list[tuple]] = []
        out = [0] * len(rows)
        for place in sorted(range(len(rows)), key=lambda k: rows[k][0] - rows[k][2]):
            u0, v0, u1, v1, gap, off = rows[place]
            slope = (v1 - v0) / (u1 - u0)

            def joins(group, u0=u0, u1=u1, middle=(v0 + v1) / 2, slope=slope, gap=gap, off=off) -> bool:
                a0, b0, a1, b1 = group[0]
                steep = (b1 - b0) / (a1 - a0)
                if abs(middle - (b0 + steep * ((u0 + u1) / 2 - a0))) > off or (slope != steep and abs(math.degrees(math.atan(slope) - math.atan(steep))) > 2):
                    return False
                return min(max(0, u0 - g[2], g[0] - u1) for g in group) <= gap

            at = next((k for k, g in enumerate(groups) if joins(g)), len(groups))
            groups[at:] = groups[at:] or [[]]
            groups[at].append((u0, v0, u1, v1))
            out[place] = at
        return out

    def fold(sizes: np.ndarray, *columns: pa.Array) -> list[int]:
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        ends = np.cumsum(sizes).tolist()
        return [n for a, b in pairwise([0, *ends]) for n in groups_of(rows[a:b])]

    of_sheet = of_sheet.withColumn("n", numbers(fold, *[F.col("g")[c] for c in used]))
    g, n = F.col("g"), F.col("n")

    def ends(k: Column) -> Column:
        # of equal starts and ends the longest line's
        own = F.filter(g, lambda _, i: F.get(n, i) == k)
        at = lambda o, u, v: F.array_min(F.transform(o, lambda t, i: F.struct(u(t).alias("u"), (t["u0"] - t["u1"]).alias("p"), i.alias("i"), t[v].alias("v"))))
        return let(own, lambda o: F.struct(k.alias("seq"), at(o, lambda t: t["u0"], "v0").alias("a"), at(o, lambda t: -t["u1"], "v1").alias("b")))

    found = F.transform(F.sequence(F.lit(0), F.coalesce(F.array_max(n), F.lit(0))), ends)
    out = of_sheet.filter(F.size("g") > 0).select("sheet_id", "horizontal", F.inline(found))
    along = {"x0": ("a.u", "a.v"), "y0": ("a.v", "a.u"), "x1": ("b.u", "b.v"), "y1": ("b.v", "b.u")}
    side = {k: [-F.col(c) if c == "b.u" else F.col(c) for c in v] for k, v in along.items()}
    return out.select("sheet_id", "horizontal", "seq", *[F.when(across, a).otherwise(b).alias(k) for k, (a, b) in side.items()])


def ruled(lines: DataFrame) -> DataFrame:
    """(sheet_id, hs, vs): a sheet's level and upright lines, by seq."""
    line = F.struct("seq", *[F.col(k).cast("double").alias(k) for k in SIDES])
    return lines.groupBy("sheet_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("horizontal") == across, line))).alias(k) for k, across in (("hs", True), ("vs", False))])


def _sized(pages: DataFrame) -> DataFrame:
    return pages.select("sheet_id", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))


def frames(hs: Column, vs: Column) -> Column:
    """The boxes between two verticals, or two horizontals, of a sheet (w, h) that lie as a title block may: an array of
    horizontal, a, b (the lines' seq), x0 to y1."""
    w, h = F.col("w"), F.col("h")

    def pairs(across: bool, firsts: Column, seconds: Column, fits, box) -> Column:
        made = lambda a, b: F.struct(F.lit(across).alias("horizontal"), a["seq"].alias("a"), b["seq"].alias("b"), *[c.alias(k) for k, c in zip(SIDES, box(a, b), strict=True)])
        return F.flatten(F.transform(firsts, lambda a: F.transform(F.filter(seconds, lambda b: fits(*box(a, b))), lambda b: made(a, b))))

    def stands(left: Column, top: Column, right: Column, bottom: Column) -> Column:
        wide = right - left
        return right.between(left + w * 0.055, left + w * 0.30) & (wide >= w * 0.055) & (wide <= w * 0.30) & (bottom - top >= h * 0.13) & (bottom - top <= h * 0.65) & (bottom >= h * 0.80)

    def lies(left: Column, top: Column, right: Column, bottom: Column) -> Column:
        high = bottom - top
        return bottom.between(top + h * 0.035, top + h * 0.24) & (high >= h * 0.035) & (high <= h * 0.24) & (right - left >= w * 0.23) & (right - left <= w * 0.72) & (right >= w * 0.85)

    standing = lambda a, b: (F.least(a["x0"], a["x1"]), F.greatest(a["y0"], b["y0"]), F.greatest(b["x0"], b["x1"]), F.least(a["y1"], b["y1"]))
    lying = lambda a, b: (F.greatest(a["x0"], b["x0"]), F.least(a["y0"], a["y1"]), F.least(a["x1"], b["x1"]), F.greatest(b["y0"], b["y1"]))
    # what one line alone must fulfil comes first
    low, far = lambda a: a["y1"] >= h * 0.80, lambda a: a["x1"] >= w * 0.85
    upright = pairs(False, F.filter(vs, lambda a: (F.least(a["x0"], a["x1"]) >= w * 0.55) & low(a)), F.filter(vs, low), stands, standing)
    level = pairs(True, F.filter(hs, lambda a: (F.least(a["y0"], a["y1"]) >= h * 0.72) & far(a)), F.filter(hs, far), lies, lying)
    return F.concat(upright, level)


def frame_candidates(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """frames of each sheet as rows: sheet_id, horizontal, a, b, x0 to y1."""
    return _sized(pages).join(ruled(lines), "sheet_id").select("sheet_id", F.inline(frames(F.col("hs"), F.col("vs"))))


def borne(box: Column, hs: Column, vs: Column) -> Column:
    """The sides of a box along which a line lies near enough and covers 60 % of the side: an array of side and at, the
    position of the nearest such line; of equally near ones the lesser."""

    def side(name: str, edge: Column, low: Column, high: Column, lines: Column, u: str, v: str, near: Column) -> Column:
        at = lambda a: (a[f"{v}0"] + a[f"{v}1"]) / 2
        shared = lambda a: F.greatest(F.lit(0.0), F.least(a[f"{u}1"], high) - F.greatest(a[f"{u}0"], low)) / F.greatest(high - low, F.lit(1.0))
        along = F.filter(lines, lambda a: (F.abs(at(a) - edge) <= near) & (shared(a) >= 0.60))
        found = F.array_min(F.transform(along, lambda a: F.struct(F.abs(at(a) - edge).alias("d"), at(a).alias("at"))))
        return F.struct(F.lit(name).alias("side"), found["at"].alias("at"))

    y, x = F.col("h") * 0.025, F.col("w") * 0.02
    level = [side(k, box[e], box["x0"], box["x1"], hs, "x", "y", y) for k, e in (("top", "y0"), ("bottom", "y1"))]
    upright = [side(k, box[e], box["y0"], box["y1"], vs, "y", "x", x) for k, e in (("left", "x0"), ("right", "x1"))]
    return F.filter(F.array(*level, *upright), lambda s: s["at"].isNotNull())


def supports(boxes: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(sheet_id, cid, side, at): what `borne` says of each box."""
    own = boxes.select("sheet_id", "cid", _own().alias("box")).join(_sized(pages).join(ruled(lines), "sheet_id"), "sheet_id")
    return own.select("sheet_id", "cid", F.inline(borne(F.col("box"), F.col("hs"), F.col("vs"))))


def contents(pages: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """(sheet_id, w, h, toks, hs, vs): a page with its tokens (by tid) and its lines (by seq) as arrays."""
    up = F.upper(F.coalesce("text", F.lit("")))
    bare = F.regexp_replace(up, r"^[ .:,;]+|[ .:,;]+$", "")
    labels = F.array_compact(F.array(*[F.when(bare.rlike(p), F.lit(k)) for k, p in LABELS.items()]))
    listed = F.trim(up)
    side = {k: F.col(k).cast("double").alias(k) for k in SIDES}
    tok = F.struct("tid", *side.values(), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.coalesce("text", F.lit("")).alias("text"), labels.alias("labels"), is_header(F.coalesce("text", F.lit(""))).alias("header"), X.is_drawing_number(F.coalesce("text", F.lit(""))).alias("number"), listed.rlike(LIST_HEADER).alias("listed"), listed.rlike(LIST_TOP).alias("list_top"), up.rlike(SIDE_LABEL).alias("side_label"))
    toks = tokens.groupBy("sheet_id").agg(F.sort_array(F.collect_list(tok)).alias("toks"))
    out = _sized(pages).join(toks, "sheet_id", "left").join(ruled(lines), "sheet_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: none(c) for c in ("toks", "hs", "vs")})



#: Each label, and all together, as a text may begin with them.
_BITS = {k: 1 << n for n, k in enumerate(LABELS)}
_ANY_LABEL = r"^[ .:,;]*(?:" + "|".join(p.removeprefix("^") for p in LABELS.values()) + ")"


def of_blocks(tokens: DataFrame) -> DataFrame:
    """The tokens of sheets that have a title block's labels at all (three, two of them its own), with __bits, the labels of
    each. Other sheets are left out before anything of theirs is gathered."""
    up = F.upper(F.coalesce("text", F.lit("")))
    bare = F.regexp_replace(up, r"^[ .:,;]+|[ .:,;]+$", "")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(bare.rlike(p), F.lit(_BITS[k])).otherwise(F.lit(0)) for k, p in LABELS.items()])
    t = tokens.withColumn("__bits", F.when(up.rlike(_ANY_LABEL), bits).otherwise(F.lit(0)))
    t = t.withColumn("__every", F.bit_or("__bits").over(Window.partitionBy("sheet_id")))
    own = F.lit(sum(_BITS[k] for k in OPERATORS))
    return t.filter((F.bit_count("__every") >= 3) & (F.bit_count(F.col("__every").bitwiseAND(own)) >= 2)).drop("__every")


def labelled(tokens: DataFrame) -> DataFrame:
    """(sheet_id, toks): the tokens, by tid, of sheets that have a title block's labels, as far as text_candidates needs them."""
    labels = F.array_compact(F.array(*[F.when(F.col("__bits").bitwiseAND(F.lit(b)) != 0, F.lit(k)) for k, b in _BITS.items()]))
    side = [F.col(k).cast("double").alias(k) for k in SIDES]
    tok = F.struct("tid", *side, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), labels.alias("labels"))
    return of_blocks(tokens).groupBy("sheet_id").agg(F.sort_array(F.collect_list(tok)).alias("toks"))


def inside(tokens: Column, box: Column) -> Column:
    return F.filter(tokens, lambda t: t["cx"].between(box["x0"], box["x1"]) & t["cy"].between(box["y0"], box["y1"]))


def label_groups(tokens: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: t["labels"])))


def _has(labels: Column, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(labels, F.array(*[F.lit(x) for x in wanted])))


def in_column(tokens: Column, column: Column) -> Column:
    """Tokens whose middle is in the column's height and of whose width 80 % is in the column."""
    return F.filter(tokens, lambda t: t["cy"].between(column["y0"], column["y1"]) & (F.greatest(F.lit(0.0), F.least(t["x1"], column["x1"]) - F.greatest(t["x0"], column["x0"])) >= 0.80 * F.greatest(t["x1"] - t["x0"], F.lit(1.0))))


def _is_seed(t: Column) -> Column:
    return (t["cy"] >= F.col("h") * 0.70) & (_has(t["labels"], WORKING) > 0)


def label_core(tokens: Column) -> Column:
    """The box of the band of working labels in the lowest 30 % that has most labels, and lies lowest; null for bands of one
    label."""
    seeds = F.filter(tokens, _is_seed)

    def band(s: Column, i: Column) -> Column:
        own = F.filter(seeds, lambda t: (F.abs(t["cx"] - s["cx"]) <= F.col("w") * 0.09) & (F.abs(t["cy"] - s["cy"]) <= F.col("h") * 0.07))
        low = lambda b, k: F.array_min(F.transform(b, lambda t: t[k]))
        high = lambda b, k: F.array_max(F.transform(b, lambda t: t[k]))
        mean = lambda b: F.aggregate(b, F.lit(0.0), lambda a, t: a + t["cy"]) / F.size(b)
        return let(own, lambda b: F.struct(F.size(label_groups(b)).alias("n"), mean(b).alias("y"), (-i).alias("i"), _box(low(b, "x0"), low(b, "y0"), high(b, "x1"), high(b, "y1")).alias("box")))

    return F.array_max(F.filter(F.transform(seeds, band), lambda b: b["n"] >= 2))["box"]


def core_column(core: Column, vs: Column) -> Column:
    """The column between two verticals around the core: of those about as narrow as the narrowest the highest."""
    left = lambda a: F.least(a["x0"], a["x1"])
    right = lambda b: F.greatest(b["x0"], b["x1"])
    lefts = F.filter(vs, lambda a: left(a).between(core["x0"] - F.col("w") * 0.08, core["x0"] + F.col("w") * 0.012))
    rights = F.filter(vs, lambda b: right(b).between(core["x1"] - F.col("w") * 0.012, core["x1"] + F.col("w") * 0.08))

    def choice(a: Column, b: Column, i: Column, j: Column) -> Column:
        top, bottom = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
        return F.struct((top - bottom).alias("d"), (right(b) - left(a)).alias("wide"), i.alias("i"), j.alias("j"), _box(left(a), top, right(b), bottom).alias("box"))

    every = F.flatten(F.transform(lefts, lambda a, i: F.transform(rights, lambda b, j: choice(a, b, i, j))))
    fits = F.filter(every, lambda c: c["wide"].between(F.col("w") * 0.05, F.col("w") * 0.22) & (-c["d"] >= F.col("h") * 0.16) & (c["box"]["y0"] <= core["y0"] + F.col("h") * 0.01) & (c["box"]["y1"] >= core["y1"] - F.col("h") * 0.01))
    near = lambda cs: F.filter(cs, lambda c: c["wide"] <= F.array_min(F.transform(cs, lambda d: d["wide"])) * 1.12)
    return F.when(core.isNotNull(), F.array_min(let(fits, near))["box"])


def grown_up(box: Column, tokens: Column) -> Column:
    """The box with the text above it up to a heading, if one is reached within ROUNDS rounds of touching text; else as it
    is, as also if it has a heading in its upper part. The fold's state: where the text taken begins, whether a heading has
    been met, and what was taken."""
    within = inside(tokens, box)
    headed = F.exists(within, lambda t: t["header"] & (t["cy"] <= box["y0"] + 0.4 * (box["y1"] - box["y0"])))
    high = lambda t: t["y1"] - t["y0"]
    heights = F.sort_array(F.transform(F.filter(within, lambda t: (high(t) > 0) & (high(t) < F.col("h") * 0.04)), high))
    median = let(heights, lambda x: F.when(F.size(x) > 0, (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2))
    letters = lambda t: F.length(F.regexp_replace(t["text"], "[^A-Za-z]", ""))

    def grow(unit: Column) -> Column:
        limit = box["y0"] - F.least(F.col("h") * 0.10, F.greatest(F.col("h") * 0.045, 8 * unit))
        above = F.filter(tokens, lambda t: (t["y0"] >= limit) & (t["y0"] < box["y0"]) & t["cx"].between(box["x0"] - F.col("w") * 0.012, box["x1"] + F.col("w") * 0.012) & (F.greatest(F.lit(0.0), F.least(t["x1"], box["x1"]) - F.greatest(t["x0"], box["x0"])) >= 0.8 * F.greatest(t["x1"] - t["x0"], F.lit(1.0))) & (letters(t) >= 3))

        def fixpoint(eligible: Column) -> Column:
            start = F.struct(box["y0"].alias("at"), F.lit(False).alias("done"), F.filter(eligible, lambda _: F.lit(False)).alias("taken"))

            def step(s: Column, _: Column) -> Column:
                band = F.filter(eligible, lambda t: (t["y1"] >= s["at"] - 2.5 * unit) & (t["y0"] < s["at"]))

                def take(b: Column) -> Column:
                    heading = F.array_min(F.transform(F.filter(b, lambda t: t["header"]), lambda t: t["y0"]))
                    rest = F.filter(eligible, lambda t: t["y0"] >= heading - unit)
                    more = F.concat(s["taken"], b, F.when(heading.isNotNull(), rest).otherwise(F.filter(b, lambda _: F.lit(False))))
                    next_ = F.struct(F.array_min(F.transform(b, lambda t: t["y0"])).alias("at"), heading.isNotNull().alias("done"), more.alias("taken"))
                    return F.when(s["done"] | (F.size(b) == 0), F.struct(s["at"].alias("at"), F.lit(True).alias("done"), s["taken"].alias("taken"))).otherwise(next_)

                return let(band, take)

            taken = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)["taken"]
            return let(taken, lambda x: F.when(F.exists(x, lambda t: t["header"]), _around(box, x)).otherwise(box))

        return let(above, fixpoint)

    return F.when(headed, box).otherwise(let(F.coalesce(median, F.col("h") * 0.008), grow))


def completed_frame(box: Column, hs: Column, vs: Column) -> Column:
    """A wide box widened to the ends of rules along its upper and lower side, where verticals meet these ends."""
    wide, tall = box["x1"] - box["x0"], box["y1"] - box["y0"]
    near = lambda a: F.least(F.abs((a["y0"] + a["y1"]) / 2 - box["y0"]), F.abs((a["y0"] + a["y1"]) / 2 - box["y1"]))
    along = F.filter(hs, lambda a: (a["x1"] - a["x0"]).between(F.col("w") * 0.22, F.col("w") * 0.72) & (F.greatest(F.lit(0.0), F.least(a["x1"], box["x1"]) - F.greatest(a["x0"], box["x0"])) >= 0.65 * wide) & (near(a) <= F.col("h") * 0.025) & (a["x1"] - a["x0"] <= 1.5 * wide))
    posts = F.filter(vs, lambda v: (v["y1"] > v["y0"]) & (F.greatest(F.lit(0.0), F.least(v["y1"], box["y1"]) - F.greatest(v["y0"], box["y0"])) >= 0.60 * tall))
    at = lambda v, y: v["x0"] + (v["x1"] - v["x0"]) * (y - v["y0"]) / (v["y1"] - v["y0"])

    # what a lambda is given is computed once, however often it is named
    def end(standing: Column, ex: Column, ey: Column, outer) -> Column:
        met = F.get(F.filter(standing, lambda v: ey.between(v["y0"] - F.col("h") * 0.012, v["y1"] + F.col("h") * 0.012) & (F.abs(at(v, ey) - ex) <= F.col("w") * 0.012)), 0)
        return let(met, lambda m: F.when(m.isNotNull(), outer(ex, at(m, box["y0"]), at(m, box["y1"]))))

    ends = let(posts, lambda ps: F.transform(along, lambda a: F.struct(end(ps, a["x0"], a["y0"], F.least).alias("l"), end(ps, a["x1"], a["y1"], F.greatest).alias("r"), F.least(a["y0"], a["y1"]).alias("t"), F.greatest(a["y0"], a["y1"]).alias("b"))))

    def wider(e: Column) -> Column:
        both = F.filter(e, lambda x: x["l"].isNotNull() & x["r"].isNotNull())
        lowest = lambda xs: F.array_min(xs)
        left = lowest(F.transform(F.filter(e, lambda x: x["l"].between(box["x0"] - F.col("w") * 0.08, box["x0"])), lambda x: x["l"]))
        right = F.array_max(F.transform(F.filter(e, lambda x: x["r"].between(box["x1"], box["x1"] + F.col("w") * 0.08)), lambda x: x["r"]))
        return _box(F.least(box["x0"], left), F.least(box["y0"], lowest(F.transform(both, lambda x: x["t"]))), F.greatest(box["x1"], right), F.greatest(box["y1"], F.array_max(F.transform(both, lambda x: x["b"]))))

    return F.when(wide < 1.5 * tall, box).otherwise(let(ends, wider))


def protected(box: Column, tokens: Column) -> Column:
    """The box around its tokens, a number below it, a list's heading above it and upright labels beside it, with a margin,
    on the page."""
    between = lambda t: t["cx"].between(box["x0"], box["x1"])
    number = lambda t: between(t) & (t["y1"] >= box["y1"]) & t["y0"].between(box["y1"] - F.col("h") * 0.035, box["y1"] + F.col("h") * 0.035) & t["number"]
    heading = lambda t: between(t) & (t["y0"] >= box["y0"] - F.col("h") * 0.035) & (t["y0"] < box["y0"]) & t["list_top"]
    upright = lambda t: t["side_label"] & (t["y1"] - t["y0"] > 2 * F.greatest(t["x1"] - t["x0"], F.lit(1.0))) & t["cy"].between(box["y0"], box["y1"]) & t["cx"].between(box["x0"] - F.col("w") * 0.025, box["x1"] + F.col("w") * 0.025)
    pad = F.greatest(F.lit(2.0), F.col("h") * 0.002)
    whole = _around(box, F.concat(inside(tokens, box), F.filter(tokens, lambda t: number(t) | heading(t) | upright(t))))
    return let(whole, lambda b: _box(F.greatest(F.lit(0.0), b["x0"] - pad), F.greatest(F.lit(0.0), b["y0"] - pad), F.least(F.col("w"), b["x1"] + pad), F.least(F.col("h"), b["y1"] + pad)))


def boundary_issues(box: Column, tokens: Column, hs: Column) -> Column:
    """What speaks against a box's sides, sorted: `outside: ` and a label or list heading that lies near and not in it;
    `rules go on: left` or `right` where rules of different heights run on beyond a wide box."""
    near = lambda t: t["cx"].between(box["x0"] - F.col("w") * 0.035, box["x1"] + F.col("w") * 0.035) & t["cy"].between(box["y0"] - F.col("h") * 0.025, box["y1"] + F.col("h") * 0.025)
    whole = lambda t: (t["x0"] >= box["x0"]) & (t["x1"] <= box["x1"]) & (t["y0"] >= box["y0"]) & (t["y1"] <= box["y1"])
    cut = F.filter(tokens, lambda t: ((F.size(t["labels"]) > 0) | t["listed"]) & near(t) & ~whole(t))
    wide, tall = box["x1"] - box["x0"], box["y1"] - box["y0"]
    middle = lambda a: (a["y0"] + a["y1"]) / 2

    def goes_on(side: str) -> Column:
        past = (lambda a: (a["x0"] >= box["x0"] - F.col("w") * 0.10) & (a["x0"] < box["x0"] - F.col("w") * 0.008)) if side == "left" else (lambda a: (a["x1"] > box["x1"] + F.col("w") * 0.008) & (a["x1"] <= box["x1"] + F.col("w") * 0.10))
        levels = F.transform(F.filter(hs, lambda a: past(a) & (F.greatest(F.lit(0.0), F.least(a["x1"], box["x1"]) - F.greatest(a["x0"], box["x0"])) >= 0.60 * wide) & middle(a).between(box["y0"] - F.col("h") * 0.008, box["y1"] + F.col("h") * 0.008) & (a["x1"] - a["x0"] <= F.col("w") * 0.72)), middle)
        return F.when((wide > 1.5 * tall) & let(levels, lambda x: F.array_max(x) - F.array_min(x) > 0.30 * tall), F.lit(f"rules go on: {side}"))

    return F.sort_array(F.array_distinct(F.concat(F.transform(cut, lambda t: F.concat(F.lit("outside: "), t["text"])), F.array_compact(F.array(goes_on("left"), goes_on("right"))))))


def text_candidates(sheets: DataFrame) -> DataFrame:
    """Boxes of bands of labels in the lowest 28 % with what stands around them (sheet_id, x0 to y1, k: the first seed by
    its place): three labels, two of them a title block's own. sheets: contents(), or labelled() with the page's w and h."""
    labels = F.filter("toks", lambda t: (t["cy"] >= F.col("h") * 0.72) & (F.size(t["labels"]) > 0))
    seeds = stage(sheets, labels=labels).select("sheet_id", "w", "h", "toks", "labels", F.posexplode("labels").alias("k", "s"))
    band = F.filter("labels", lambda t: (F.abs(t["cy"] - F.col("s")["cy"]) <= F.col("h") * 0.11) & (F.abs(t["cx"] - F.col("s")["cx"]) <= F.col("w") * 0.40))
    bands = stage(stage(seeds, band=band), groups=label_groups(F.col("band"))).filter((F.size("groups") >= 3) & (_has(F.col("groups"), OPERATORS) >= 2))
    boxes = stage(bands, box=_around(_own(F.get("band", 0)), F.col("band")))
    b = F.col("box")
    nearby = inside(F.col("toks"), _box(b["x0"] - F.col("w") * 0.10, b["y0"] - F.col("h") * 0.018, b["x1"] + F.col("w") * 0.16, b["y1"] + F.col("h") * 0.025))
    boxes = stage(stage(boxes, nearby=nearby), box=_around(b, F.col("nearby"))).filter((b["x1"] - b["x0"] >= F.col("w") * 0.22) & (b["y1"] - b["y0"] <= F.col("h") * 0.22))
    return boxes.groupBy("sheet_id", "box").agg(F.min("k").alias("k")).select("sheet_id", "box.*", "k")


def reduced(pages: DataFrame, tokens: DataFrame, widest: int = 2400) -> tuple[DataFrame, DataFrame]:
    """Pages no wider than `widest`, with their old size as full_w, full_h, and the tokens on them."""
    scale = F.least(widest / F.col("w"), F.lit(1.0))
    small = pages.select("sheet_id", F.bround(F.col("w") * scale).cast("double").alias("w"), F.bround(F.col("h") * scale).cast("double").alias("h"), F.col("w").cast("double").alias("full_w"), F.col("h").cast("double").alias("full_h"))
    by = {k: F.col(k) * (F.col("w") / F.col("full_w") if k[0] == "x" else F.col("h") / F.col("full_h")) for k in SIDES}
    return small, tokens.join(small, "sheet_id").withColumns(by).select(*tokens.columns)


def judged_candidates(pages: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """All candidates that have a title block's labels, with what was found about them: box, source, groups, column, support
    (the sides), reliable, coverage, score, rank on their sheet, protected and problems (null unless reliable)."""
    every = label_groups(F.col("toks"))
    # a box can't have more labels than its sheet
    sheets = contents(pages, of_blocks(tokens), lines).filter((F.size(every) >= 3) & (_has(every, OPERATORS) >= 2))
    found = lambda o, a, b, box, source: F.struct(o.cast("int").alias("o"), a.cast("int").alias("a"), b.cast("int").alias("b"), box.alias("box"), F.lit(source).alias("source"))
    texts = text_candidates(sheets).groupBy("sheet_id").agg(F.collect_list(found(F.lit(2), F.col("k"), F.lit(0), _own(), "text_layout")).alias("texts"))
    framed = F.transform(frames(F.col("hs"), F.col("vs")), lambda f: found(f["horizontal"], f["a"], f["b"], _own(f), "local_frame"))
    # the tokens that may be seeds of a core are looked for once a sheet
    sheets = sheets.withColumn("working", F.filter("toks", lambda t: _is_seed(t)))
    every = F.sort_array(F.concat(framed, F.coalesce("texts", F.array().cast(texts.schema["texts"].dataType))))
    c = sheets.join(texts, "sheet_id", "left").select("sheet_id", "w", "h", "toks", "hs", "vs", "working", F.posexplode(every).alias("cid", "c")).select("*", "c.box", "c.source").drop("c")
    box, toks, column = F.col("box"), F.col("toks"), F.col("column")
    c = stage(stage(c, core=label_core(inside(F.col("working"), box))), column=core_column(F.col("core"), F.col("vs"))).drop("working")
    # a box that reaches far beyond the labels' own column belongs to something else
    foreign = (box["x1"] - box["x0"] > 1.6 * (column["x1"] - column["x0"]) + F.col("w") * 0.02) | (box["x0"] < column["x0"] - F.col("w") * 0.04)
    c = c.filter(~F.coalesce(foreign, F.lit(False)))
    c = stage(c, box=completed_frame(box, F.col("hs"), F.col("vs")))
    c = stage(c, box=F.when(column.isNull() & (box["x1"] - box["x0"] > 1.5 * (box["y1"] - box["y0"])), grown_up(box, toks)).otherwise(box))
    members = F.col("members")
    c = stage(stage(c, members=inside(toks, box)), groups=F.sort_array(label_groups(F.when(column.isNotNull(), in_column(members, column)).otherwise(members)))).drop("members")
    c = c.filter((F.size("groups") >= 3) & (_has(F.col("groups"), OPERATORS) >= 2))
    c = stage(c, support=F.sort_array(borne(box, F.col("hs"), F.col("vs"))["side"]))
    pair = lambda *sides: reduce(lambda a, b: a & b, [F.array_contains("support", s) for s in sides])
    reference = F.when(column.isNotNull(), in_column(toks, column)).otherwise(F.filter(toks, lambda _: F.lit(False)))
    c = stage(c, reliable=pair("top", "bottom") | pair("left", "right"), reference=reference)
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) / (F.col("w") * F.col("h"))
    c = stage(c, coverage=F.when(F.size("reference") == 0, 1.0).otherwise(F.size(inside(F.col("reference"), box)) / F.size("reference")), score=F.size("groups") * 2 - 4 * area)
    rank = Window.partitionBy("sheet_id").orderBy(F.desc("reliable"), F.desc("coverage"), F.desc("score"), "cid")
    c = stage(c.withColumn("rank", F.row_number().over(rank)), protected=F.when(F.col("reliable"), protected(box, toks)))
    p = F.col("protected")
    omitted = F.exists("reference", lambda t: t["header"] & ((t["cy"] < p["y0"]) | (t["cy"] > p["y1"])))
    c = stage(c, grown=F.when(F.col("reliable") & column.isNull(), grown_up(p, toks)))
    above = F.col("grown")["y0"] < p["y0"] - F.col("h") * 0.005
    size = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    more = F.array_compact(F.array(F.when(omitted, F.lit("a heading of the column is left out")), F.when(above, F.lit("text of a title or company goes on above")), F.when(size(p) > 1.5 * size(box), F.lit("protecting the content takes too much"))))
    c = stage(c, problems=F.when(F.col("reliable"), F.concat(boundary_issues(p, toks, F.col("hs")), more)))
    return c.select("sheet_id", "cid", "source", "box", "groups", "column", "support", "reliable", "coverage", "score", "rank", "protected", "problems")


def find_tables(pages: DataFrame, tokens: DataFrame, lines: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """(sheet_id, x0, y0, x1, y1, source, groups, support, coverage): the best candidate without problems of each sheet
    that has one. With full (sheet_id, full_w, full_h), boxes are given on pages of that size."""
    ok = judged_candidates(pages, tokens, lines).filter("reliable AND size(problems) = 0")
    first = ok.withColumn("__k", F.row_number().over(Window.partitionBy("sheet_id").orderBy("rank"))).filter("__k = 1").join(pages.select("sheet_id", "w", "h"), "sheet_id")
    first = first.withColumns({"full_w": F.col("w"), "full_h": F.col("h")}) if full is None else first.join(full.select("sheet_id", "full_w", "full_h"), "sheet_id")
    p, sx, sy = F.col("protected"), F.col("w") / F.col("full_w"), F.col("h") / F.col("full_h")
    sides = (F.floor(p["x0"] / sx), F.floor(p["y0"] / sy), F.least(F.col("full_w"), F.ceil(p["x1"] / sx)), F.least(F.col("full_h"), F.ceil(p["y1"] / sy)))
    return first.select("sheet_id", *[c.cast("int").alias(k) for k, c in zip(SIDES, sides, strict=True)], "source", "groups", "support", "coverage")
