"""Fusing what several OCR engines and passes read.

Grouping is greedy and depends on order (a box joins the first group that has a box of enough overlap, and is dropped if
that group has its engine already), so it is a fold over each sheet's boxes, after one shuffle on sheet_id. Sheets are small:
each is a row with an array of its tokens; nothing of the table gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.functions import geometry as G
from draftmill.functions.text import norm
from draftmill.functions.staging import let
from draftmill.operators.folding import by_length, gathered, numbers


def _groups(least_iou: float):
    """The fold of `overlap_groups`, for many sheets at once: the k-th boxes of all sheets are held against those before."""

    def fold(sizes: np.ndarray, *columns: pa.Array) -> np.ndarray:
        x0, y0, x1, y1 = (c.to_numpy(zero_copy_only=False).astype(float) for c in columns[:4])
        engine = columns[4].dictionary_encode().indices
        engine = pc.fill_null(engine, -1).to_numpy(zero_copy_only=False)
        area = (x1 - x0) * (y1 - y0)
        out = np.full(len(x0), -1)
        for at in by_length(sizes):
            grp = np.full(at.shape, -1)
            n = np.zeros(len(at), int)
            for k in range(at.shape[1]):
                a, b = at[:, k : k + 1], at[:, :k]
                w, h = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b]), np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
                s = np.where((w > 0) & (h > 0), w * h, 0.0)
                met = (s / np.maximum(area[a] + area[b] - s, 1.0) >= least_iou) & (grp[:, :k] >= 0)
                where = np.where(met, grp[:, :k], len(x0)).min(axis=1, initial=len(x0))
                had = ((grp[:, :k] == where[:, None]) & (engine[b] == engine[a])).any(axis=1)
                fresh = where == len(x0)
                grp[:, k] = np.where(a[:, 0] < 0, -1, np.where(fresh, n, np.where(had, -1, where)))
                n += fresh & (a[:, 0] >= 0)
            out[at[at >= 0]] = grp[at >= 0]
        return out

    return fold


_READ = ("x0", "y0", "x1", "y1", "engine")


def _grouped(tokens: DataFrame, least_iou: float, carry: list[str]) -> DataFrame:
    """(sheet_id, g, n): a sheet's readings in order, and their groups' numbers."""
    g = gathered(tokens, "sheet_id", [F.col(c) for c in ("y0", "x0", "seq")], carry)
    return g.withColumn("n", numbers(_groups(least_iou), *[F.col("g")[c] for c in _READ]))


def overlap_groups(tokens: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Adds grp (from 0 in order of their first boxes); boxes that are dropped get -1."""
    g = _grouped(tokens, least_iou, [c for c in tokens.columns if c != "sheet_id"])
    rows = g.select("sheet_id", F.inline(F.arrays_zip("g", "n")))
    return rows.select(*[F.col("sheet_id") if c == "sheet_id" else F.col("g")[c].alias(c) for c in tokens.columns], F.col("n").alias("grp"))


#: One reading of a token; source_bbox is null where it is the token's own box.
CANDIDATES = "array<struct<text:string,engine:string,conf:double,source_bbox:array<int>>>"


def fuse(tokens: DataFrame, engines: int, least_conf: float = 0.3, least_iou: float = 0.5) -> DataFrame:
    """One token for each group: text and conf of the surest reading (the first of equally sure ones), the box around all,
    the agreement (the share of readings that say the same, of all engines that ran), and all readings (candidates, by
    place)."""
    read = _grouped(tokens.filter(F.col("conf") >= least_conf), least_iou, ["x0", "y0", "x1", "y1", "engine", "seq", "conf", "text"])
    # all of a sheet's groups are made in its row
    g, n = F.col("g"), F.col("n")

    def one(k: Column) -> Column:
        def made(own: Column) -> Column:
            side = lambda c, f: f(own[c])
            sure = F.array_max(F.transform(own, lambda t, i: F.struct(t["conf"].alias("conf"), (-i).alias("back"), t["text"].alias("text"))))

            def around(best: Column) -> Column:
                same = F.transform(own, lambda t: norm(t["text"]) == norm(best["text"]))
                alike = let(same, lambda x: F.size(F.filter(x, lambda y: y)) / F.nullif(F.size(F.filter(x, lambda y: y.isNotNull())), F.lit(0)))
                size = F.size(own)
                share = alike * F.when(size < engines, size / engines).otherwise(F.lit(1.0))
                every = F.transform(own, lambda t: F.struct(t["text"].alias("text"), t["engine"].alias("engine"), t["conf"].cast("double").alias("conf"), F.lit(None).cast("array<int>").alias("source_bbox")))
                return F.struct(k.alias("grp"), F.trim(best["text"]).alias("text"), side("x0", F.array_min).alias("x0"), side("y0", F.array_min).alias("y0"), side("x1", F.array_max).alias("x1"), side("y1", F.array_max).alias("y1"), best["conf"].alias("conf"), F.bround(share, 3).alias("agreement"), size.cast("bigint").alias("readings"), every.alias("candidates"))

            return let(sure, around)

        return let(F.filter(g, lambda _, i: F.get(n, i) == k), made)

    fused = F.transform(F.sequence(F.lit(0), F.greatest(F.array_max(n), F.lit(0))), one)
    return read.select("sheet_id", F.inline(fused))


def in_order(tokens: DataFrame) -> DataFrame:
    """Adds seq, a fused token's place on its sheet: by the middle of its height, then from the left."""
    place = Window.partitionBy("sheet_id").orderBy(F.col("y0") + F.col("y1"), "x0", "grp")
    return tokens.withColumn("seq", F.row_number().over(place) - 1)


def alternatives(text: Column, candidates: Column) -> Column:
    """The candidates that read something else than the token's text."""
    return F.filter(candidates, lambda c: F.trim(c["text"]) != F.trim(text))


def pass_summary(tokens: DataFrame) -> DataFrame:
    """Of each sheet the fused tokens, and how many of them the engines don't agree on."""
    return tokens.groupBy("sheet_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("agreement") < 1).alias("disagreements"))


def covered(coarse: DataFrame, fine: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Coarse boxes that do not cover as much of any fine box of their sheet: what the fine pass has missed."""
    f = fine.select("sheet_id", *[F.col(c).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1")])
    c = coarse.select("*", *[F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")])
    on = (c["sheet_id"] == f["sheet_id"]) & G.contains("c_", "f_", ratio)
    return c.join(f, on, "left_anti").drop(*[f"c_{k}" for k in ("x0", "y0", "x1", "y1")])


def distinct_readings(tokens: DataFrame) -> DataFrame:
    """Of equal text and box the first read."""
    w = Window.partitionBy("sheet_id", "text", "x0", "y0", "x1", "y1").orderBy("seq")
    return tokens.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def engine_summary(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("engine").agg(F.count("*").alias("n_tokens"), F.countDistinct("sheet_id").alias("n_sheets"), F.round(F.avg("conf"), 6).alias("mean_conf"))


def extent(tokens: DataFrame, width: int, height: int) -> DataFrame:
    """Whether a sheet's boxes fill the image: over 1.05 of it is an error, under 0.55 a warning."""
    r = tokens.groupBy("sheet_id").agg(F.greatest(F.max("x1") / width, F.max("y1") / height).alias("reach"))
    return r.withColumn("extent", F.when(F.col("reach") > 1.05, "error").when(F.col("reach") < 0.55, "warning").otherwise("ok"))


def _alike(a: str, b: str, least: float = 70.0) -> bool:
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) >= least


#: What becomes of a coarse token: taken by a fine one, covering one, or recovered. A fine one has the place of the coarse
#: token it takes, or NONE.
COVERS, RECOVERED, NONE = -1, -2, -3


def _matches(least: float, sure: float, covering: float):
    """The fold of `matched`, for many sheets at once: arrays of the fine tokens (sides, text in capitals, seq), then of the
    coarse ones. Numbers of both come in one array, the fine ones first."""

    def fold(sizes: np.ndarray, is_fine: pa.Array, *columns: pa.Array) -> np.ndarray:
        x0, y0, x1, y1, seq = (columns[k].to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5))
        box = [c.astype(float) for c in (x0, y0, x1, y1)]
        text = columns[4]
        fine = is_fine.to_numpy(zero_copy_only=False).astype(bool)
        sheet = np.repeat(np.arange(len(sizes)), sizes)
        area = (box[2] - box[0]) * (box[3] - box[1])
        coarse = np.flatnonzero(~fine)
        many = np.bincount(sheet[coarse], minlength=len(sizes))
        first = np.cumsum(many) - many
        out = np.full(len(fine), NONE)
        covers = np.zeros(len(fine), bool)
        own = np.flatnonzero(fine)
        met: list[tuple[np.ndarray, ...]] = []
        # pairs of a sheet's fine and coarse tokens, some fine tokens at a time
        ends = np.cumsum(many[sheet[own]])
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            part = own[a:b]
            n = many[sheet[part]]
            f = np.repeat(part, n)
            c = coarse[np.repeat(first[sheet[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            w, h = np.minimum(box[2][f], box[2][c]) - np.maximum(box[0][f], box[0][c]), np.minimum(box[3][f], box[3][c]) - np.maximum(box[1][f], box[1][c])
            s = np.where((w > 0) & (h > 0), w * h, 0.0)
            covers[c[(s > 0) & (s / np.maximum(area[f], 1.0) >= covering)]] = True
            score = s / np.maximum(np.minimum(area[f], area[c]), 1.0)
            near = score >= least
            met.append((f[near], c[near], score[near]))
            a = b
        out[coarse] = np.where(covers[coarse], COVERS, RECOVERED)
        if met:
            f, c, score = (np.concatenate(x) for x in zip(*met, strict=True))
            order = np.lexsort((c, -score, f))
            f, c, score = f[order], c[order], score[order]
            said = text.take(pa.array(f)).to_pylist(), text.take(pa.array(c)).to_pylist()
            served: set[int] = set()
            for i, j, k, one, other in zip(f.tolist(), c.tolist(), score.tolist(), *said, strict=True):
                if i not in served and j not in served and (k >= sure or _alike(one, other)):
                    served |= {i, j}
                    out[i], out[j] = seq[j], seq[i]
        return out

    return fold


#: Pairs of tokens that are handled at once.
PAIRS = 1 << 20


def _met(fine: DataFrame, coarse: DataFrame, columns: list[str], least: float = 0.55, sure: float = 0.85, covering: float = 0.7) -> DataFrame:
    """(sheet_id, g, n): a sheet's tokens of both passes, the fine ones (is_fine) first, by seq, and their matches."""
    side = lambda df, own: gathered(df.withColumn("is_fine", F.lit(own)).withColumn("__norm", norm("text")), "sheet_id", [F.col("seq")], [*columns, "is_fine", "__norm"], "f" if own else "c")
    both = side(fine, True).join(side(coarse, False), "sheet_id", "full")
    none = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType))
    both = both.select("sheet_id", F.concat(none("f"), none("c")).alias("g"))
    g = F.col("g")
    return both.withColumn("n", numbers(_matches(least, sure, covering), g["is_fine"], *[g[c] for c in ("x0", "y0", "x1", "y1", "__norm", "seq")]))


def matched(fine: DataFrame, coarse: DataFrame, least: float = 0.55, sure: float = 0.85, covering: float = 0.7) -> DataFrame:
    """The tokens of both passes (column is_fine) with `match`: each fine token, in the order of seq, takes the free coarse
    token that shares most of the smaller box (at least `least`, and unless it is `sure` the texts must be alike). Who
    takes what depends on who came before, so it is a fold over a sheet. A fine token's match is the seq of what it took,
    a coarse one's that of its taker; else COVERS, RECOVERED or NONE."""
    columns = [c for c in fine.columns if c != "sheet_id"]
    rows = _met(fine, coarse, columns, least, sure, covering).select("sheet_id", F.inline(F.arrays_zip("g", "n")))
    return rows.select(*[F.col("sheet_id") if c == "sheet_id" else F.col("g")[c].alias(c) for c in (*fine.columns, "is_fine")], F.col("n").alias("match"))


def merged_passes(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """The fine tokens and the coarse ones that the fine pass missed, in the order `place` on their sheet. Where the coarse
    reading of a fine token differs, it joins the candidates (engine@coarse, with its own box), and the agreement is the
    share of all candidates that read as the token does (`conflict`); else the token stays as it is. A recovered coarse
    token's agreement is 0.5 at most, and its candidates are marked @coarse. Both: sheet_id, seq, text, box, conf, agreement,
    candidates. All of it is made in the row of a sheet."""
    names = ["seq", "text", "x0", "y0", "x1", "y1", "conf", "agreement", "candidates"]
    typed = lambda df: df.select("sheet_id", *names).withColumn("candidates", F.coalesce(F.col("candidates").cast(CANDIDATES), F.array().cast(CANDIDATES)))
    met = _met(typed(fine), typed(coarse), names)
    kind = met.schema["g"].dataType.elementType
    g, n = F.col("g"), F.col("n")
    marked = lambda e: F.concat(e, F.lit("@coarse"))

    def out(t: Column, fine_: bool, conflict: Column, agreement: Column, candidates: Column) -> Column:
        own = {c: t[c] for c in names} | {"agreement": agreement.cast(kind["agreement"].dataType), "candidates": candidates.cast(CANDIDATES)}
        return F.struct((t["y0"] + t["y1"]).alias("__y"), t["x0"].alias("__x"), F.lit(0 if fine_ else 1).alias("__late"), t["seq"].alias("__seq"), *[v.alias(k) for k, v in own.items()], F.lit(fine_).alias("is_fine"), conflict.alias("conflict"))

    def kept(t: Column, i: Column) -> Column:
        taker = F.get(F.filter(g, lambda c: ~c["is_fine"] & (c["seq"] == F.get(n, i)) & (F.get(n, i) >= 0)), 0)

        def with_(r: Column) -> Column:
            conflict = F.coalesce(r["__norm"] != t["__norm"], F.lit(False))
            box = F.array(*[r[c].cast("int") for c in ("x0", "y0", "x1", "y1")])
            reading = F.struct(r["text"].alias("text"), marked(F.coalesce(F.get(r["candidates"], 0)["engine"], F.lit("ocr"))).alias("engine"), r["conf"].alias("conf"), box.alias("source_bbox"))
            more = F.concat(t["candidates"], F.array(reading).cast(CANDIDATES))
            same = lambda x: F.bround(F.size(F.filter(x, lambda c: norm(c["text"]) == t["__norm"])) / F.size(x), 3)
            return F.when(conflict, let(more, lambda x: out(t, True, F.lit(True), same(x), x))).otherwise(out(t, True, F.lit(False), t["agreement"], t["candidates"]))

        return let(taker, with_)

    def new(t: Column) -> Column:
        lone = lambda text, engine, conf: F.struct(text.alias("text"), engine.alias("engine"), conf.alias("conf"), F.lit(None).cast("array<int>").alias("source_bbox"))
        read = F.transform(t["candidates"], lambda c: lone(c["text"], marked(c["engine"]), c["conf"])).cast(CANDIDATES)
        alone = F.array(lone(t["text"], F.lit("ocr@coarse"), t["conf"])).cast(CANDIDATES)
        return out(t, False, F.lit(False), F.least(t["agreement"], F.lit(0.5)), F.when(F.size(t["candidates"]) > 0, read).otherwise(alone))

    both = F.filter(F.transform(g, lambda t, i: F.when(t["is_fine"], kept(t, i)).when(F.get(n, i) == RECOVERED, new(t))), lambda t: t.isNotNull())
    rows = met.select("sheet_id", F.posexplode(F.array_sort(both)).alias("place", "t"))
    return rows.select("sheet_id", *[f"t.{c}" for c in (*names, "is_fine", "conflict")], "place")


def merge_summary(merged: DataFrame) -> DataFrame:
    """Of each sheet the tokens, conflicts, recovered tokens, and fine tokens without a conflict."""
    conflicts, fine = F.count_if("conflict"), F.count_if("is_fine")
    return merged.groupBy("sheet_id").agg((fine - conflicts).alias("fine_only"), conflicts.alias("conflicts"), F.count_if(~F.col("is_fine")).alias("recovered"), F.count("*").alias("n_tokens"))
