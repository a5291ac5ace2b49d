"""Where a sheet's title block is: by its table, by anchor words, by ruled cells, by the density of text, or by default.

pages: sheet_id, w, h. tokens: sheet_id, tid, text, x0, y0, x1, y1. lines as in tables.py. Each way is a relation with a row
for the sheets where it succeeds (sheet_id, x0, y0, x1, y1, confidence, detail as JSON); `located` takes the first of them.

Texts are classified where they lie, once for each of a batch. Cells are the faces of the grid that a sheet's lines span: elementary
cells are joined to those beside them where no line lies between (a union of sets, for the pages of a batch at once). Density is a
separable stencil over the bins that hold text, as sums of what each bin gives to its neighbours.

Defined results: sheets without tokens are located by default; null texts are empty; ties go to the earlier token (by tid)
or to the cell or bin further up, then further left. The density's sums are doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmill.functions.staging import let, stage
from draftmill.operators import layout, triage
from draftmill.operators.rules import partial_ratio

# Words of title blocks, those that speak for themselves and those that need company.
STRONG = ("YUNCKEN FREEMAN", "BATES SMART", "ARCHITECTS", "DRAWING NO", "DRAWING NUMBER", "DWG NO", "DRG NO")
WEAK = ("SCALE", "DRAWN", "CHECKED", "DATE", "TRACED", "APPROVED", "JOB NO", "SHEET NO", "TITLE", "REVISION")
# The smoothing kernel of five bins.
KERNEL = (0.0625, 0.25, 0.375, 0.25, 0.0625)

SIDES = ("x0", "y0", "x1", "y1")
BINS = 48
FOUND = ("sheet_id", *SIDES, "confidence", "detail")


def _likeness(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def is_hit(text: str, word: str, least: float) -> bool:
    """Does a text hold a word, or something as like it? Texts much shorter than the word don't."""
    if len(text) < max(len(word) / 2, 4):
        return False
    if word in text:
        return True
    # of all that is alike, the common part is no more than the equal letters, at best without anything else
    shared = sum(min(text.count(c), word.count(c)) for c in set(word))
    if 200.0 * shared / (len(word) + shared) < least - 1e-9:
        return False
    # a common subsequence is no longer than the shorter text
    if 200.0 * min(len(text), len(word)) / (len(text) + len(word)) >= least and _likeness(word, text) >= least:
        return True
    return len(text) >= len(word) and partial_ratio(word, text, least) >= least


@lru_cache(4)
def _kind(least: float, strong: tuple[str, ...], weak: tuple[str, ...]) -> Callable[[str], int]:
    """What tells 2 for texts like a strong word, 1 for those like a weak one, else 0; a worker keeps what it was asked last."""

    @lru_cache(1 << 16)
    def of(text: str) -> int:
        return 2 if any(is_hit(text, w, least) for w in strong) else 1 if any(is_hit(text, w, least) for w in weak) else 0

    return of


def keyword_hits(tokens: DataFrame, least: float = 85.0, strong: tuple[str, ...] = STRONG, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """The tokens that are like a word of a title block, with the column strong."""

    @F.arrow_udf("int")
    def kind(texts: pa.Array) -> pa.Array:
        of = _kind(least, strong, weak)
        coded = texts.dictionary_encode()
        return pa.array([of(t) for t in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)

    bare = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), r"^[ .:,;]+|[ .:,;]+$", "")
    own = tokens.withColumn("__up", bare).filter((F.length("__up") >= 4) & F.col("__up").rlike(r"\p{L}"))
    # texts are looked at where they lie: a title block's words are the most frequent ones, so nothing is joined by text
    return own.withColumn("__kind", kind.asNondeterministic()("__up")).filter("__kind > 0").withColumn("strong", F.col("__kind") == 2).drop("__up", "__kind")


def line_places(lines: DataFrame, pages: DataFrame, covered: float = 0.25) -> DataFrame:
    """(sheet_id, xs, ys): the places of lines that are long enough, arrays in order. Lines at one place, or next to one
    another, are one (their integer mean)."""
    at = F.when(F.col("horizontal"), (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    share = F.when(F.col("horizontal"), (F.col("x1") - F.col("x0")) / F.col("w")).otherwise((F.col("y1") - F.col("y0")) / F.col("h"))
    place = lines.join(pages, "sheet_id").select("sheet_id", "horizontal", F.floor(at).alias("at"), share.alias("share"))
    long = place.groupBy("sheet_id", "horizontal", "at").agg(F.sum("share").alias("share")).filter(F.col("share") >= covered)
    keyed = long.withColumn("__key", F.struct("sheet_id", "horizontal"))
    runs = layout.peaks(keyed, "__key", "at").select("__key.sheet_id", "__key.horizontal", "peak")
    one = lambda across: F.array_sort(F.collect_list(F.when(F.col("horizontal") == across, F.col("peak"))))
    return runs.groupBy("sheet_id").agg(one(False).alias("xs"), one(True).alias("ys"))


def _snap(box: Column, xs: Column, ys: Column, w: Column, h: Column, share: float = 0.06, least: int = 20) -> Column:
    """The box with each side at the nearest line in reach, on the page, and whether any was moved; as it was if little
    would be left."""

    def near(side: Column, lines: Column, most: Column) -> Column:
        by = F.transform(lines, lambda v, i: F.struct(F.abs(v - side).alias("d"), i.alias("i"), v.alias("v")))
        return F.array_min(F.filter(by, lambda c: c["d"] <= most))["v"]

    found = F.struct(near(box["x0"], xs, w * share).alias("x0"), near(box["y0"], ys, h * share).alias("y0"), near(box["x1"], xs, w * share).alias("x1"), near(box["y1"], ys, h * share).alias("y1"))

    def moved(n: Column) -> Column:
        at = {k: F.coalesce(n[k], box[k]) for k in SIDES}
        new = F.struct(F.greatest(F.lit(0), at["x0"]).cast("int").alias("x0"), F.greatest(F.lit(0), at["y0"]).cast("int").alias("y0"), F.least(w, at["x1"]).cast("int").alias("x1"), F.least(h, at["y1"]).cast("int").alias("y1"), F.coalesce(*[n[k] for k in SIDES]).isNotNull().alias("snapped"))
        old = F.struct(*[box[k].cast("int").alias(k) for k in SIDES], F.lit(False).alias("snapped"))
        return let(new, lambda b: F.when((b["x1"] - b["x0"] < least) | (b["y1"] - b["y0"] < least), old).otherwise(b))

    return let(found, moved)


def by_anchors(tokens: DataFrame, pages: DataFrame, lines: DataFrame, least: float = 85.0, company: int = 2, margin: float = 0.03, reach: float = 0.22) -> DataFrame:
    """Around anchor words: from the one nearest to the lower right corner on, each that is in reach of one taken before is
    taken. Needs a strong word, or `company` weak ones."""
    hits = keyword_hits(tokens, least).join(pages, "sheet_id")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    far = F.hypot(cx - F.col("w"), cy - F.col("h"))
    hit = F.struct(far.alias("far"), (~F.col("strong")).alias("weak"), "tid", cx.alias("cx"), cy.alias("cy"), *SIDES, "text")
    all_ = hits.groupBy("sheet_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.sort_array(F.collect_list(hit)).alias("hits"), F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"))
    all_ = all_.filter((F.col("strong") > 0) | (F.col("weak") >= company))
    w, h = F.col("w"), F.col("h")
    close = lambda t, k: F.greatest(F.abs(t["cx"] - k["cx"]) / w, F.abs(t["cy"] - k["cy"]) / h) <= reach
    chain = F.aggregate(F.slice("hits", 2, F.size("hits")), F.slice("hits", 1, 1), lambda kept, t: F.when(F.exists(kept, lambda k: close(t, k)), F.concat(kept, F.array(t))).otherwise(kept))
    all_ = stage(all_, kept=chain).join(line_places(lines, pages), "sheet_id", "left")
    low = lambda k: F.array_min(F.col("kept")[k])
    high = lambda k: F.array_max(F.col("kept")[k])
    ex, ey = w * margin, h * margin
    box = F.struct(F.greatest(low("x0") - ex, F.lit(0)).cast("int").alias("x0"), F.greatest(low("y0") - ey, F.lit(0)).cast("int").alias("y0"), F.least(high("x1") + ex, w).cast("int").alias("x1"), F.least(high("y1") + ey, h).cast("int").alias("y1"))
    none = F.array().cast("array<bigint>")
    all_ = stage(stage(all_, box=box), box=_snap(F.col("box"), F.coalesce("xs", none), F.coalesce("ys", none), w, h))
    conf = F.least(0.55 + 0.12 * F.col("strong") + 0.05 * F.col("weak") + F.when(F.col("box.snapped"), 0.08).otherwise(0.0), F.lit(0.97))
    detail = F.to_json(F.struct("strong", "weak", F.size("kept").alias("used"), "box.snapped", F.slice(F.col("kept")["text"], 1, 8).alias("words")))
    return all_.select("sheet_id", *[f"box.{k}" for k in SIDES], F.bround(conf, 3).alias("confidence"), detail.alias("detail"))


def _faces(sheet: np.ndarray, across: np.ndarray, at: np.ndarray, p0: np.ndarray, p1: np.ndarray, w: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """The faces of some pages at once (sizes w, h) from their lines (the page's number in `sheet`): all elementary cells
    side by side by page, row and column. Cells of a row without a wall between them are one run; runs meet through what
    is open above them, and each face takes the least run's number."""
    n = len(w)

    def grid(end: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places of lines of one orientation, and of the others' ends, by page: values, first and number of each page,
        and of the lines the places of `at`, p0 and p1 in it."""
        mine, other = np.flatnonzero(along), np.flatnonzero(~along)
        # what lies off the page is moved to its border, where there is nothing to divide
        ends = [np.clip(p[other], 0.0, end[sheet[other]]) for p in (p0, p1)]
        page = np.concatenate([np.arange(n), np.arange(n), sheet[mine], sheet[other], sheet[other]])
        value = np.concatenate([np.zeros(n), end, np.clip(at[mine], 0.0, end[sheet[mine]]), *ends])
        order = np.lexsort((value, page))
        page, value = page[order], value[order]
        new = np.ones(len(page), bool)
        new[1:] = (page[1:] != page[:-1]) | (value[1:] != value[:-1])
        place = np.empty(len(page), np.int64)
        place[order] = np.cumsum(new) - 1
        count = np.bincount(page[new], minlength=n)
        first = np.cumsum(count) - count
        place = place[2 * n :]
        k, m = len(mine), len(other)
        return value[new], first, count, place[:k] - first[sheet[mine]], place[k : k + m] - first[sheet[other]], place[k + m :] - first[sheet[other]]

    gx, fx, cx, up_at, lie_0, lie_1 = grid(w, ~across)
    gy, fy, cy, lie_at, up_0, up_1 = grid(h, across)
    nx, ny = cx - 1, cy - 1

    def walls(page: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many lines lie along each side: sides of a page by row, one more than wide a row."""
        size = (rows + 1) * (wide + 1)
        first = np.cumsum(size) - size
        row = first[page] + at * (wide[page] + 1)
        total = int(size.sum())
        return np.cumsum(np.bincount(row + a, minlength=total) - np.bincount(row + b, minlength=total)), first

    lying, up = np.flatnonzero(across), np.flatnonzero(~across)
    above, above_first = walls(sheet[lying], lie_at, lie_0, lie_1, ny, nx)
    beside, beside_first = walls(sheet[up], up_at, up_0, up_1, nx, ny)
    size = nx * ny
    page = np.repeat(np.arange(n), size)
    cell = np.arange(len(page)) - np.repeat(np.cumsum(size) - size, size)
    i, j = np.divmod(cell, nx[page])
    open_up = (i > 0) & (above[above_first[page] + i * (nx[page] + 1) + j] == 0)
    open_left = (j > 0) & (beside[beside_first[page] + j * (ny[page] + 1) + i] == 0)
    run = np.cumsum(~open_left) - 1
    begin = np.flatnonzero(~open_left)
    last = np.append(begin[1:], len(page)) - 1
    joined = np.flatnonzero(open_up)
    a, b = run[joined], run[joined - nx[page[joined]]]
    face = np.arange(len(begin))
    while len(a):
        fa, fb = face[a], face[b]
        np.minimum.at(face, np.maximum(fa, fb), np.minimum(fa, fb))
        while True:
            further = face[face]
            if np.array_equal(further, face):
                break
            face = further
        apart = face[a] != face[b]
        a, b = a[apart], b[apart]
    where = page[begin]
    x0, x1 = gx[fx[where] + j[begin]], gx[fx[where] + j[last] + 1]
    y0, y1 = gy[fy[where] + i[begin]], gy[fy[where] + i[begin] + 1]
    order = np.argsort(face, kind="stable")
    start = np.flatnonzero(np.diff(face[order], prepend=-1))
    of = lambda f, v: f.reduceat(v[order], start) if len(order) else v
    root = order[start]
    return {"page": where[root], "cell": cell[begin[root]], "x0": of(np.minimum, x0), "y0": of(np.minimum, y0), "x1": of(np.maximum, x1), "y1": of(np.maximum, y1), "area": of(np.add, (x1 - x0) * (y1 - y0))}


#: Elementary cells that are handled at once: more only where one page has more.
AT_ONCE = 1 << 20


def cells(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(sheet_id, cell, x0, y0, x1, y1, area): the faces that a sheet's lines divide its page into, by their first corner.
    Lines are taken as upright or level at their middle, and as having no width; what has no place is no line, and a page
    without a size has no faces."""
    at = F.when(F.col("horizontal"), (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).cast("double")
    p0, p1 = (F.when(F.col("horizontal"), F.col(f"x{k}")).otherwise(F.col(f"y{k}")).cast("double") for k in "01")
    ruled = lines.select("sheet_id", "horizontal", at.alias("at"), F.least(p0, p1).alias("p0"), F.greatest(p0, p1).alias("p1"))
    sound = F.col("horizontal").isNotNull() & F.col("at").isNotNull() & F.col("p0").isNotNull() & ~F.isnan("at") & ~F.isnan("p0") & ~F.isnan("p1")
    parts = {"across": F.col("horizontal"), **{k: F.col(k) for k in ("at", "p0", "p1")}}
    ruled = ruled.filter(sound).groupBy("sheet_id").agg(F.collect_list(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("r"))
    base = pages.select("sheet_id", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h")).filter("w > 0 AND h > 0").join(ruled, "sheet_id", "left")
    schema = T.StructType([base.schema["sheet_id"], T.StructField("cell", T.IntegerType()), *[T.StructField(k, T.DoubleType()) for k in (*SIDES, "area")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(3)
            count = pc.fill_null(pc.list_value_length(r), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = r.flatten()
            across, *place = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            w, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            sheet, across = np.repeat(np.arange(batch.num_rows), count), across.astype(bool)
            # the most cells that a page may have
            lying = np.bincount(sheet, across, batch.num_rows).astype(np.int64)
            up = np.bincount(sheet, minlength=batch.num_rows) - lying
            most = np.cumsum((up + 2 * lying + 1) * (lying + 2 * up + 1))
            k = 0
            while k < batch.num_rows:
                end = max(k + 1, int(np.searchsorted(most, (most[k - 1] if k else 0) + AT_ONCE, "right")))
                a, b = np.searchsorted(sheet, (k, end))
                found = _faces(sheet[a:b] - k, across[a:b], *(p[a:b] for p in place), w[k:end], h[k:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found["page"] + k)), pa.array(found["cell"].astype(np.int32)), *[pa.array(found[c]) for c in (*SIDES, "area")]], names=schema.names)
                k = end

    return base.select("sheet_id", "w", "h", "r").mapInArrow(run, schema)


def _filled(boxes: DataFrame, tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """boxes (sheet_id, cell, x0 to y1, more) with the tokens whose middle lies in them: n, and their area as ink."""
    point = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("area"))
    t = tokens.groupBy("sheet_id").agg(F.collect_list(point).alias("__t"))
    b = boxes.join(pages.select("sheet_id", "w", "h"), "sheet_id").join(t, "sheet_id", "left")
    held = F.filter("__t", lambda p: p["cx"].between(F.col("x0"), F.col("x1")) & p["cy"].between(F.col("y0"), F.col("y1")))
    b = stage(stage(b, __t=F.coalesce(held, F.array().cast(b.schema["__t"].dataType))), n=F.size("__t").cast("bigint"), ink=F.aggregate(F.col("__t"), F.lit(0.0), lambda a, p: a + p["area"]))
    return b.drop("__t")


def by_cells(tokens: DataFrame, pages: DataFrame, lines: DataFrame, smallest: float = 0.01, largest: float = 0.30, gap: float = 0.02, most: float = 0.35, rounds: int = 6) -> DataFrame:
    """The ruled cell that lies, is filled and is shaped most like a title block, grown by the cells beside it that hold
    text; it stays as it was if growing would take too much of the page."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    all_ = stage(_filled(cells(lines, pages), tokens, pages), ratio=F.col("area") / (w * h), wide=F.col("x1") - F.col("x0"), tall=F.col("y1") - F.col("y0"))
    pos = (F.col("x0") + F.col("wide") / 2) / w * 0.5 + (F.col("y0") + F.col("tall") / 2) / h * 0.5
    dense = F.least(F.col("ink") / F.greatest(F.col("area"), F.lit(1.0)) * 4, F.lit(1.0))
    score = 0.45 * pos + 0.30 * dense + 0.25 * F.when(F.col("ratio").between(0.02, 0.25), 1.0).otherwise(0.4)
    fit = (F.col("ratio").between(smallest, largest)) & (F.col("wide") >= 40) & (F.col("tall") >= 40) & (F.col("n") >= 3)
    own = F.struct(score.alias("score"), (-F.col("cell")).alias("back"), *SIDES, "ratio", "n", pos.alias("pos"), dense.alias("dense"))
    cell = F.struct("cell", *SIDES)
    joins = (F.col("area") <= w * h * 0.30) & (F.col("wide") >= 20) & (F.col("tall") >= 20) & (F.col("n") >= 2)
    sheet = all_.groupBy("sheet_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.max(F.when(fit, own)).alias("best"), F.sort_array(F.collect_list(F.when(joins, cell))).alias("near")).filter("best IS NOT NULL")
    w, h, best = F.col("w").cast("double"), F.col("h").cast("double"), F.col("best")
    start = F.struct(*[best[k].alias(k) for k in SIDES], F.lit(0).alias("merged"), F.lit("go").alias("state"))
    box = lambda s, state, **new: F.struct(*[(new.get(k, s[k])).alias(k) for k in (*SIDES, "merged")], state.alias("state"))

    def add(s: Column, c: Column) -> Column:
        known = (c["x0"] >= s["x0"]) & (c["y0"] >= s["y0"]) & (c["x1"] <= s["x1"]) & (c["y1"] <= s["y1"])
        across, along = F.least(c["x1"], s["x1"]) - F.greatest(c["x0"], s["x0"]), F.least(c["y1"], s["y1"]) - F.greatest(c["y0"], s["y0"])
        beside = (along > 0) & (-across <= w * gap) | (across > 0) & (-along <= h * gap)
        grown = box(s, F.lit("grew"), x0=F.least(s["x0"], c["x0"]), y0=F.least(s["y0"], c["y0"]), x1=F.greatest(s["x1"], c["x1"]), y1=F.greatest(s["y1"], c["y1"]), merged=s["merged"] + 1)
        return F.when(~known & beside, grown).otherwise(s)

    def turn(s: Column, _: Column) -> Column:
        after = F.aggregate("near", box(s, F.lit("still")), add)
        too_much = lambda a: (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) > w * h * most
        done = lambda a: F.when(a["state"] == "still", box(a, F.lit("done"))).when(too_much(a), box(start, F.lit("done"))).otherwise(a)
        return F.when(s["state"] == "done", s).otherwise(let(after, done))

    sheet = stage(sheet, grown=F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn))
    detail = F.to_json(F.struct(F.bround(best["ratio"], 4).alias("cell_ratio"), best["n"].alias("tokens"), F.bround(best["pos"], 3).alias("pos"), F.bround(best["dense"], 3).alias("density"), F.col("grown.merged").alias("merged_cells")))
    return sheet.select("sheet_id", *[F.col(f"grown.{k}").cast("int").alias(k) for k in SIDES], F.bround(F.least(best["score"], F.lit(0.92)), 3).alias("confidence"), detail.alias("detail"))


def smoothed(grid: DataFrame, bins: int = BINS) -> DataFrame:
    """(sheet_id, bx, by, heat): the bins' ink smoothed along both axes; beyond the border the grid is mirrored at its last
    bin. Only bins near text have rows."""
    bin_ = F.struct(F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), F.col("ink").cast("double").alias("ink"))
    # one shuffle, by sheet; a bin gives to twenty-five others within its sheet's row
    sheets = grid.filter("bx IS NOT NULL AND by IS NOT NULL AND ink IS NOT NULL").select("sheet_id", bin_.alias("g")).repartition("sheet_id").groupBy("sheet_id").agg(F.collect_list("g").alias("g"))
    schema = T.StructType([sheets.schema["sheet_id"], T.StructField("bx", T.IntegerType()), T.StructField("by", T.IntegerType()), T.StructField("heat", T.DoubleType())])
    reach = len(KERNEL) // 2

    def spread(line: np.ndarray, at: np.ndarray, heat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each bin's heat given along its line, from its own place and from where both borders mirror it."""
        seen = np.stack([at, -at, 2 * (bins - 1) - at])
        first = np.stack([np.ones(len(at), bool), seen[1] != seen[0], (seen[2] != seen[0]) & (seen[2] != seen[1])])
        to = seen[:, :, None] + np.arange(-reach, reach + 1)
        on = first[:, :, None] & (to >= 0) & (to < bins)
        key, where = np.unique(np.broadcast_to(line[None, :, None] * bins, to.shape)[on] + to[on], return_inverse=True)
        total = np.bincount(where, (heat[None, :, None] * np.array(KERNEL) + np.zeros(to.shape))[on], len(key))
        return *np.divmod(key, bins), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(1)
            bx, by, ink = (g.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            sheet = np.repeat(np.arange(batch.num_rows, dtype=np.int64), pc.list_value_length(g).to_numpy(zero_copy_only=False))
            line, bx, heat = spread(sheet * bins + by, bx.astype(np.int64), ink)  # lines are rows of a sheet, then its columns
            sheet, by = np.divmod(line, bins)
            line, by, heat = spread(sheet * bins + bx, by, heat)
            sheet, bx = np.divmod(line, bins)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sheet)), pa.array(bx.astype(np.int32)), pa.array(by.astype(np.int32)), pa.array(heat)], names=schema.names)

    return sheets.mapInArrow(run, schema)


def by_density(tokens: DataFrame, pages: DataFrame, bins: int = BINS, keep: float = 0.45, fewest: int = 10, inside: int = 5) -> DataFrame:
    """Around the densest bin (of the lower right part, if it has text), as long as the mean of the bins taken stays near
    its density; up, down, left and right in turn."""
    at = lambda a, b, n: F.least(((F.col(a) + F.col(b)) / 2 / F.col(n) * bins).cast("int"), F.lit(bins - 1))
    own = tokens.join(pages, "sheet_id")
    many = own.groupBy("sheet_id").agg(F.count("*").alias("__n")).filter(F.col("__n") >= fewest)
    grid = own.join(many, "sheet_id").groupBy("sheet_id", at("x0", "x1", "w").alias("bx"), at("y0", "y1", "h").alias("by")).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("ink"))
    edge = int(bins * 0.35)
    spot = F.struct("heat", (-F.col("by")).alias("y"), (-F.col("bx")).alias("x"))
    heat = smoothed(grid, bins).groupBy("sheet_id").agg(F.collect_list(F.struct("bx", "by", "heat")).alias("heat"), F.max(F.when((F.col("bx") >= edge) & (F.col("by") >= edge) & (F.col("heat") > 0), spot)).alias("low"), F.max(spot).alias("any"))
    heat = heat.withColumn("peak", F.coalesce("low", "any")).filter("any.heat > 0").withColumns({"px": -F.col("peak.x"), "py": -F.col("peak.y"), "least": F.col("peak.heat") * keep})
    start = F.struct(F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.lit(True).alias("on"))

    def wider(s: Column, side: str) -> Column:
        step = {"x0": -1, "y0": -1, "x1": 1, "y1": 1}
        new = {k: (F.greatest(s[k] + step[k], F.lit(0)) if step[k] < 0 else F.least(s[k] + step[k], F.lit(bins - 1))) if k == side else s[k] for k in SIDES}
        total = F.aggregate(F.filter("heat", lambda b: b["bx"].between(new["x0"], new["x1"]) & b["by"].between(new["y0"], new["y1"])), F.lit(0.0), lambda a, b: a + b["heat"])
        mean = total / ((new["x1"] - new["x0"] + 1) * (new["y1"] - new["y0"] + 1))
        return F.when((new[side] != s[side]) & (mean >= F.col("least")), F.struct(*[new[k].alias(k) for k in SIDES], F.lit(True).alias("on"))).otherwise(s)

    def turn(s: Column, _: Column) -> Column:
        off = F.struct(*[s[k].alias(k) for k in SIDES], F.lit(False).alias("on"))
        after = let(let(let(let(off, lambda a: wider(a, "y0")), lambda a: wider(a, "y1")), lambda a: wider(a, "x0")), lambda a: wider(a, "x1"))
        return F.when(s["on"], after).otherwise(s)

    grown = stage(heat, grown=F.aggregate(F.sequence(F.lit(1), F.lit(2 * bins)), start, turn)).join(pages, "sheet_id")
    w, h, g = F.col("w"), F.col("h"), F.col("grown")
    boxes = stage(grown, x0=(g["x0"] / bins * w).cast("int"), y0=(g["y0"] / bins * h).cast("int"), x1=((g["x1"] + 1) / bins * w).cast("int"), y1=((g["y1"] + 1) / bins * h).cast("int")).select("sheet_id", *SIDES, "px", "py", F.lit(0).alias("cell"))
    found = _filled(boxes, tokens, pages).filter(F.col("n") >= inside)
    conf = 0.45 + 0.15 * F.least(F.col("n") / 20, F.lit(1.0))
    return found.select("sheet_id", *SIDES, F.bround(conf, 3).alias("confidence"), F.to_json(F.struct(F.col("n").alias("tokens"), F.array("px", "py").alias("peak"))).alias("detail"))


def by_default(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """The lower right of every page, as what was not found."""
    boxes = pages.select("sheet_id", (F.col("w") * 0.60).cast("int").alias("x0"), (F.col("h") * 0.55).cast("int").alias("y0"), F.col("w").cast("int").alias("x1"), F.col("h").cast("int").alias("y1"), F.lit(0).alias("cell"))
    return _filled(boxes, tokens, pages).select("sheet_id", *SIDES, F.lit(0.15).alias("confidence"), F.to_json(F.struct(F.lit(True).alias("degraded"), F.col("n").alias("tokens"))).alias("detail"))


def located(pages: DataFrame, **ways: DataFrame) -> DataFrame:
    """(sheet_id, method, x0, y0, x1, y1, confidence, detail): of each page the first of the ways that has a row for it, by
    their order; null without any."""
    every = None
    for k, (name, way) in enumerate(ways.items()):
        own = way.select("sheet_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("method"), *SIDES, F.col("confidence").cast("double").alias("confidence"), F.col("detail").cast("string").alias("detail")).alias("f"))
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("sheet_id").agg(F.min("f").alias("f"))
    return pages.select("sheet_id").join(first, "sheet_id", "left").select("sheet_id", "f.method", *[f"f.{k}" for k in SIDES], "f.confidence", "f.detail")


def locate(pages: DataFrame, tokens: DataFrame, lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """located with all ways. found: tables of sheets (tables.find_tables), if they were looked for."""
    ways = {}
    if found is not None:
        ways["local_frame"] = found.select("sheet_id", *SIDES, F.lit(0.85).alias("confidence"), F.to_json(F.struct("source", "groups", "support", "coverage")).alias("detail"))
    ways |= {"anchor": by_anchors(tokens, pages, lines), "frame": by_cells(tokens, pages, lines), "density": by_density(tokens, pages), "fallback": by_default(tokens, pages)}
    return located(pages, **ways)


def early_stops(pages: DataFrame, tokens: DataFrame, forced: DataFrame | None = None, noisy: float = 0.75) -> DataFrame:
    """(sheet_id, reason) of the pages that are not worth going on with: `no tokens`, or `noise` (too many short readings and
    none of the usual words), unless they are forced (sheet_id)."""
    seen = pages.select("sheet_id").join(triage.noise(tokens), "sheet_id", "left").join(triage.probe(tokens.withColumn("seq", F.col("tid"))), "sheet_id", "left")
    why = F.when(F.col("noise").isNull(), "no tokens").when((F.col("noise") > noisy) & (F.col("probes") == 0), "noise")
    out = seen.select("sheet_id", why.alias("reason")).filter("reason IS NOT NULL")
    return out if forced is None else out.join(forced.select("sheet_id", F.lit(True).alias("__f")), "sheet_id", "left").filter("reason = 'no tokens' OR __f IS NULL").drop("__f")
