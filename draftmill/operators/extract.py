"""Finding fields: labels, values beside or below them, matches by format, confidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import text as X

# The words that label a field.
ANCHORS = {
    "scale": ["SCALE", "SCALES"],
    "date": ["DATE", "DATED"],
    "draughtsperson": ["DRAWN", "DRAWN BY", "DFTSMN", "TRACED", "TRACED BY"],
    "drawing_number": ["DRAWING NO", "DRAWING No.", "DWG NO", "DRG NO", "SHEET NO", "DRAWING NUMBER"],
    "checked": ["CHECK", "CHECKED", "APPROVED", "CHKD"],
    "job_number": ["JOB NO", "JOB NUMBER", "PROJECT NO"],
}


@lru_cache(4)
def alike_words(words: tuple[tuple[str, int, str], ...], least: float) -> Callable[[str], list[dict]]:
    """What gives the labels, variants and indel ratios of the words that a text is like enough. What texts have in common is
    no more than their equal letters, so that few pairs get to the bit-parallel programme."""
    given = []
    for label, variant, word in words:
        places: dict[str, int] = {}
        for k, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << k
        given.append((label, variant, len(word), [(c, word.count(c)) for c in places], places))

    @lru_cache(1 << 16)
    def alike(text: str) -> list[dict]:
        out = []
        for label, variant, n, letters, places in given:
            total = n + len(text)
            if 200.0 * min(n, len(text)) < least * total or 200.0 * sum(min(text.count(c), m) for c, m in letters) < least * total:
                continue
            ones = row = (1 << n) - 1
            for c in text:
                hit = row & places.get(c, 0)
                row = (row + hit) | (row - hit)
            score = 200.0 * (n - (row & ones).bit_count()) / total
            if score >= least:
                out.append({"label": label, "variant": variant, "score": score})
        return out

    return alike


def find_anchors(tokens: DataFrame, least: float = 85.0, labels: dict[str, list[str]] = ANCHORS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sheet_id, label, tid, score, and the columns to keep): of each label the token that is most like one of its words. Texts are
    held against the words, a fixed list, where they lie: labels are the most frequent texts, so nothing is joined by text."""
    words = tuple((k, i, w.upper()) for k, ws in labels.items() for i, w in enumerate(ws))

    @F.arrow_udf("array<struct<label:string,variant:int,score:double>>")
    def scored(texts: pa.Array) -> pa.Array:
        alike = alike_words(words, least)
        coded = texts.dictionary_encode()
        found = pa.array([alike(t) for t in coded.dictionary.to_pylist()], pa.list_(pa.struct({"label": pa.string(), "variant": pa.int32(), "score": pa.float64()})))
        return found.take(coded.indices)

    clean = F.regexp_replace(F.upper("text"), r"[.:]+$", "")
    longest = max((len(w) for _, _, w in words), default=0)
    # a text that is much longer than all words is like none
    near = tokens.withColumn("__clean", clean).filter(200.0 * longest >= least * (F.length("__clean") + longest))
    hits = near.select("sheet_id", "tid", *[c for c in keep if c not in ("sheet_id", "tid")], F.inline(scored.asNondeterministic()("__clean")))
    top = hits.groupBy("sheet_id", "label").agg(F.max(F.struct("score", (-F.col("tid")).alias("t"), (-F.col("variant")).alias("v"), *keep)).alias("m"))
    return top.select("sheet_id", "label", (-F.col("m.t")).cast("int").alias("tid"), F.round("m.score", 4).alias("score"), *[F.col(f"m.{c}") for c in keep])


def pair_score(a: str = "a_", t: str = "t_") -> Column:
    """How well a token lies for a label's value: right of it in its row, else below it."""
    h, w = F.greatest(F.col(f"{a}y1") - F.col(f"{a}y0"), F.lit(1)), F.greatest(F.col(f"{a}x1") - F.col(f"{a}x0"), F.lit(1))
    centre = lambda p, c: (F.col(f"{p}{c}0") + F.col(f"{p}{c}1")) / 2.0
    dx, dy = centre(t, "x") - centre(a, "x"), centre(t, "y") - centre(a, "y")
    gap = F.greatest(F.col(f"{t}x0") - F.col(f"{a}x1"), F.lit(0))
    right = (F.abs(dy) < 0.6 * h) & (F.col(f"{t}x0") >= F.col(f"{a}x1"))
    below = (F.abs(dx) < w) & (dy > 0) & (dy < 3.0 * h)
    return F.when(right, 1.0 - F.least(gap, F.lit(300)) / 300.0).when(below, 0.9 - dy / (3.0 * h)).otherwise(0.0)


def first_match(tokens: DataFrame, kind: str) -> DataFrame:
    """The first token of a sheet that reads as a scale or a date in range; of those with a drawing number the one that most
    engines agree on, of these the surest, of these the first."""
    t = F.col("text")
    if kind == "scale":
        return tokens.filter(X.is_scale(t) & ~X.is_bare_label(t)).groupBy("sheet_id").agg(F.min("tid").alias("tid"), F.min_by("text", "tid").alias("value"))
    if kind == "date":
        return tokens.filter(X.is_date(t) & X.year(t).between(1900, 2000)).groupBy("sheet_id").agg(F.min("tid").alias("tid"), F.min_by("text", "tid").alias("value"))
    best = F.struct("agreement", "conf", (-F.col("tid")).alias("t"))
    return tokens.filter(X.has_drawing_number(t)).groupBy("sheet_id").agg((-F.max(best)["t"]).cast("int").alias("tid"), F.max_by("text", best).alias("value"))


def confidence(fields: DataFrame, w_agreement: float = 0.18, w_ocr: float = 0.18, w_format: float = 0.18, w_model: float = 0.15, high: float = 0.75, low: float = 0.45, ceiling: float = 0.85) -> DataFrame:
    """Adds confidence and status: the mean of the signals that are there by their weights, then caps, then the ladder.
    fields: verbatim, corrected, reason, evidence_ok, agreement, ocr_conf, format, model_label, adjudicated, repaired."""
    agreement = F.when(F.col("adjudicated"), F.greatest("agreement", F.lit(0.85))).otherwise(F.col("agreement"))
    label = F.when(F.col("model_label") == "high", 1.0).when(F.col("model_label") == "medium", 0.7).when(F.col("model_label") == "low", 0.35).when(F.col("model_label") != "", 0.5)
    parts = [(w_agreement, agreement), (w_ocr, F.col("ocr_conf")), (w_format, F.col("format")), (w_model, label)]
    top = sum((F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    below = sum((F.when(v.isNull(), 0.0).otherwise(w) for w, v in parts), F.lit(0.0))
    mean = F.round(top / F.nullif(below, F.lit(0.0)), 3)
    mean = F.when(F.col("corrected").isNotNull(), F.least(mean, F.when(F.col("format") == 0, F.lit(low)).otherwise(F.lit(ceiling)))).otherwise(mean)
    mean = F.when(F.col("repaired"), F.least(mean, F.lit(high - 0.01))).otherwise(mean)
    ladder = F.when(mean >= high, "auto_accept").when(mean >= low, "needs_review").otherwise("rejected")
    lost, none = ~F.col("evidence_ok"), F.col("verbatim").isNull() & F.col("reason").isNotNull()
    status = F.when(lost, "needs_review").when(none & F.col("reason").isin("illegible", "low_resolution"), "rejected").when(none | mean.isNull(), "needs_review").otherwise(ladder)
    return fields.withColumn("confidence", F.when(lost | none | mean.isNull(), 0.0).otherwise(mean)).withColumn("status", status)
