"""Fields by rules: what a sheet's tokens say by their format, by a list of names, or beside their labels.

tokens: sheet_id, tid (a token's place on its sheet), text, x0, y0, x1, y1, conf, agreement, candidates (array of the texts
that were read there); other columns are not read. A null text is an empty one. Sheets without tokens have no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmill.functions import repair
from draftmill.functions import text as X
from draftmill.functions.staging import let, stage
from draftmill.operators.extract import ANCHORS, alike_words
from draftmill.operators.folding import gathered
from draftmill.operators.records import FIELDS

# Names that are known, words that end a row of values, fields of several tokens, and the scores of rules.
ARCHITECTS = ("YUNCKEN FREEMAN ARCHITECTS PTY LTD", "YUNCKEN FREEMAN", "BATES SMART MCCUTCHEON", "BATES SMART")
ROW_END = r"(?i)^\s*(DRAWN|DATE|CHECKED|APPROVED|DRAWING|DWG|JOB|SHEET)\b"
SEVERAL = ("scale", "project_name", "drawing_title", "architect")
CLEAN_SCALE, NOISY_SCALE, DATE_SCORE, AGREED_NUMBER, LONE_NUMBER, OTHER_NUMBER, TYPE_SCORE = 0.94, 0.72, 0.89, 0.88, 0.52, 0.60, 0.88
LABEL_BASE, LABEL_SHARE = 0.80, 0.15
LEAST_NAME, MOST_NAME, EXPANDED_NAME = 80.0, 0.96, 0.90
#: Least pair score of a value that a label is given; drawing numbers need less.
LEAST_PAIR, LEAST_NUMBER_PAIR = 0.35, 0.30

BOX = ("x0", "y0", "x1", "y1")
#: The widest gap in a row of values, by the height of its seed.
REACH = 1.8
TOKEN = ("sheet_id", "tid", "text", *BOX, "conf", "agreement")
FOUND = ("tids", "verbatim", "corrected", "basis", "score", "agreement", "conf")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def extended(seeds: DataFrame, tokens: DataFrame, reach: float = REACH) -> DataFrame:
    """seeds (sheet_id, name, turn, seed, alone, word, others; name and turn tell a sheet's seeds apart) with the tokens
    that go with each. With a word: all tokens that hold it. Else the seed and, unless it is alone, those to its right in
    its row up to a gap over `reach` of its height, a bare scale label or another label. Adds tids, whole (texts joined by
    blanks), agreement and conf (the least). A seed meets its sheet's tokens in one row."""
    held = _held(F.col("toks"), F.col("seed"), F.col("alone"), F.col("word"), reach)
    out = stage(seeds.join(_in_rows(tokens), "sheet_id"), __h=held).filter(F.size("__h") > 0)
    return out.select(*seeds.columns, F.col("__h.tid").alias("tids"), F.array_join(F.col("__h.text"), " ").alias("whole"), F.array_min("__h.agreement").alias("agreement"), F.array_min("__h.conf").alias("conf"))


def _in_rows(tokens: DataFrame, **more: Column) -> DataFrame:
    """(sheet_id, toks): a sheet's tokens as an array by tid, with more columns."""
    t = tokens.withColumns({"text": F.coalesce("text", F.lit("")), **more})
    one = F.struct("tid", "text", *BOX, "conf", "agreement", *more)
    return t.groupBy("sheet_id").agg(F.sort_array(F.collect_list(one)).alias("toks"))


def _held(toks: Column, seed: Column, alone: Column, word: Column, reach: float = REACH) -> Column:
    """The tokens that go with a seed (see `extended`), of its sheet's tokens by tid; none if the seed is none of them."""
    mine = F.filter(toks, lambda t: t["tid"] == seed)

    def row(s: Column) -> Column:
        h = F.greatest(s["y1"] - s["y0"], F.lit(1))
        near = lambda t: F.abs((t["y0"] + t["y1"]) / 2.0 - (s["y0"] + s["y1"]) / 2.0) <= 0.6 * h
        after = lambda t: (t["x0"] > s["x0"]) | ((t["x0"] == s["x0"]) & (t["tid"] > seed))
        # the seed comes first: it has the least (x0, tid) of what is left
        own = F.filter(toks, lambda t: (t["tid"] == seed) | (after(t) & near(t)))
        from_left = F.sort_array(F.transform(own, lambda t: F.struct(t["x0"].alias("x"), t["tid"].alias("id"), t.alias("t"))))["t"]

        def held(r: Column) -> Column:
            past = lambda t: X.is_bare_label(t["text"]) | t["text"].rlike(ROW_END)
            ends = lambda t, i: F.coalesce((t["tid"] != seed) & ((t["x0"] - F.get(r, i - 1)["x1"] > reach * h) | past(t)), F.lit(False))
            first = F.array_position(F.transform(r, ends), True)
            return let(first, lambda k: F.when(k > 0, F.slice(r, 1, k.cast("int") - 1)).otherwise(r))

        return F.when(F.size(own) > 1, let(from_left, held)).otherwise(own)

    named = F.filter(toks, lambda t: F.contains(F.upper(t["text"]), word))
    return F.when(word.isNotNull(), named).when(alone, mine).otherwise(let(F.get(mine, 0), row))


def with_scale(groups: DataFrame) -> DataFrame:
    """Adds to groups of `extended` the scale in them (null for none) and whether other text outweighs it."""
    found = F.nullif(strip(F.regexp_extract("whole", X.SCALE, 0)), F.lit(""))
    return groups.withColumn("scale", found).withColumn("noisy", F.coalesce(F.length("scale") < F.length(strip(F.col("whole"))) * 0.8, F.lit(False)))


def scale_groups(tokens: DataFrame) -> DataFrame:
    """(sheet_id, seed, tids, whole, scale, noisy, agreement, conf) of each sheet's first token that reads as a scale."""
    t = F.coalesce("text", F.lit(""))
    first = tokens.filter(X.is_scale(t) & ~X.is_bare_label(t)).groupBy("sheet_id").agg(F.min("tid").alias("seed"))
    seeds = first.select("sheet_id", F.lit("scale").alias("name"), F.lit(0).alias("turn"), "seed", F.lit(False).alias("alone"), F.lit(None).cast("string").alias("word"))
    return with_scale(extended(seeds, tokens)).drop("name", "turn", "alone", "word")


def label_values(tokens: DataFrame, labels: dict[str, list[str]] = ANCHORS, least: float = 85.0) -> DataFrame:
    """(sheet_id, label, tid, text, score): each label's value, so that the sum of the pairs' scores is the greatest and no
    token serves two labels. Tokens that are labels are no values. A label's best tokens, as many as there are labels, are
    enough for that: if it took another one, one of these would be free and no worse. All of it in the row of a sheet."""
    of_sheet = _in_rows(tokens.select(*TOKEN)).filter("sheet_id IS NOT NULL")
    each = of_sheet.withColumn("values", _values(F.col("toks"), labels, least)).filter(F.size("values") > 0)
    found = each.select("sheet_id", "toks", F.inline("values")).withColumn("t", F.get("toks", F.col("at")))
    return found.select("sheet_id", "label", "t.tid", "t.text", "score")


def _values(toks: Column, labels: dict[str, list[str]], least: float) -> Column:
    """array of struct(label, at, score): which of a sheet's tokens, by tid, are the values that its labels are given."""
    words = tuple((k, i, w.upper()) for k, ws in labels.items() for i, w in enumerate(ws))
    longest = max((len(w) for _, _, w in words), default=0)

    @F.arrow_udf("array<struct<label:string,at:int,score:double>>")
    def run(texts: pa.Array, *box: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        return _assigned(words, least, sizes, texts.flatten().dictionary_encode(), *[c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in box])

    # a text that is much longer than all words is like none
    near = lambda c: F.when(200.0 * longest >= least * (F.length(c) + longest), c)
    clean = lambda t: let(F.regexp_replace(F.upper(t["text"]), r"[.:]+$", ""), near)
    # or Spark would run it once more for each filter on what it gives
    return run.asNondeterministic()(F.transform(toks, clean), *[toks[c] for c in BOX])

def _assigned(words: tuple, least: float, sizes: np.ndarray, texts: pa.DictionaryArray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> pa.Array:
    """The values of many sheets' labels, as one list for each sheet; texts and boxes are those of all their tokens."""
    labels = sorted({w[0] for w in words})
    alike, first = alike_words(words, least), np.cumsum(sizes) - sizes
    sheet = np.repeat(np.arange(len(sizes)), sizes)
    like = [alike(t) for t in texts.dictionary.to_pylist()]
    code = pc.fill_null(texts.indices, len(like)).to_numpy(zero_copy_only=False)
    # of each label the token that is most like one of its words
    top: dict[tuple[int, str], tuple] = {}
    for at in np.flatnonzero(np.array([*map(bool, like), False])[code]).tolist():
        for hit in like[code[at]]:
            key, found = (int(sheet[at]), hit["label"]), (hit["score"], -at, -hit["variant"])
            if key not in top or found > top[key]:
                top[key] = found
    of = np.array([labels.index(label) for _, label in top], np.int64)
    anchor = np.array([-found[1] for found in top.values()], np.int64)
    no_value = np.zeros(len(sheet), bool)
    no_value[anchor] = True
    # each label with all tokens of its sheet that are no labels: `extract.pair_score` of many at once
    wide = sizes[sheet[anchor]]
    a = np.repeat(anchor, wide)
    t = np.arange(len(a)) - np.repeat(np.cumsum(wide) - wide, wide) + first[sheet[a]]
    label = np.repeat(of, wide)
    free = ~no_value[t]
    a, t, label = a[free], t[free], label[free]
    h, w = np.fmax(y1[a] - y0[a], 1), np.fmax(x1[a] - x0[a], 1)
    dx, dy = (x0[t] + x1[t]) / 2.0 - (x0[a] + x1[a]) / 2.0, (y0[t] + y1[t]) / 2.0 - (y0[a] + y1[a]) / 2.0
    gap = np.fmax(x0[t] - x1[a], 0)
    right = (np.abs(dy) < 0.6 * h) & (x0[t] >= x1[a])
    below = (np.abs(dx) < w) & (dy > 0) & (dy < 3.0 * h)
    score = np.where(right, 1.0 - np.minimum(gap, 300) / 300.0, np.where(below, 0.9 - dy / (3.0 * h), 0.0))
    some = score > 0
    t, label, score = t[some], label[some], score[some]
    # a label's best tokens, and these by token and label
    by_score = np.lexsort((t, -score, label, sheet[t]))
    t, label, score = t[by_score], label[by_score], score[by_score]
    begins = np.flatnonzero(np.append(True, (sheet[t][1:] != sheet[t][:-1]) | (label[1:] != label[:-1]))[: len(t)])
    few = np.arange(len(t)) - np.repeat(begins, np.diff(np.append(begins, len(t)))) < len(labels)
    t, label, score = t[few], label[few], score[few]
    by_token = np.lexsort((label, t))
    t, label, score = t[by_token], label[by_token], score[by_token]
    chosen = np.zeros(len(t), bool)
    begins = np.flatnonzero(np.append(True, sheet[t][1:] != sheet[t][:-1])[: len(t)])
    for b, e in zip(begins.tolist(), np.append(begins, len(t))[1:].tolist(), strict=True):
        if e - b == 1:
            chosen[b] = True
        else:
            chosen[[b + k for k in _best_total(list(zip(label[b:e].tolist(), t[b:e].tolist(), score[b:e].tolist(), strict=True)))]] = True
    number = labels.index("drawing_number") if "drawing_number" in labels else -1
    chosen &= score > np.where(label == number, LEAST_NUMBER_PAIR, LEAST_PAIR)
    t, label, score = t[chosen], label[chosen], score[chosen]
    values = pa.StructArray.from_arrays([pa.array(labels, pa.string()).take(pa.array(label)), pa.array(t - first[sheet[t]], pa.int32()), pa.array(score)], ["label", "at", "score"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(sheet[t], minlength=len(sizes)))), pa.int32()), values)


def _best_total(rows: list[tuple]) -> frozenset:
    """The places of the pairs (label, token, score; by token and label) with the greatest sum that use no label or token twice."""
    # the best total for each set of labels served by the tokens so far
    plans: dict[frozenset, tuple[float, frozenset]] = {frozenset(): (0.0, frozenset())}
    for _, offers in groupby(enumerate(rows), key=lambda kr: kr[1][1]):
        offers, before = list(offers), list(plans.items())
        for served, (total, chosen) in before:
            for k, (label, _, score) in offers:
                more = served | {label}
                if label not in served and total + score > plans.get(more, (0.0,))[0]:
                    plans[more] = (total + score, chosen | {k})
    return max(plans.values(), key=lambda plan: plan[0])[1]


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best indel ratio, in percent, of the shorter text with a stretch of the longer one that has its length, or less
    at the ends; 0 if either is empty, or if no stretch gets to `least`."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if len(a) == len(b):
        return max(_swept(a, b, least), _swept(b, a, least))
    return _swept(a, b, least)


def _swept(needle: str, hay: str, least: float) -> float:
    n = len(needle)
    ones = (1 << n) - 1
    places: dict[str, int] = {}
    for k, c in enumerate(needle):
        places[c] = places.get(c, 0) | 1 << k
    missing, shared = Counter(needle), 0
    best = 0.0
    for end in range(1, len(hay) + n):
        first = max(end - n, 0)
        # letters in common, kept up to date as the window moves, bound the common subsequence
        if end <= len(hay) and (c := hay[end - 1]) in places:
            shared += missing[c] > 0
            missing[c] -= 1
        if end > n and (c := hay[first - 1]) in places:
            missing[c] += 1
            shared -= missing[c] > 0
        window = hay[first:end]
        if 200.0 * shared / (n + len(window)) < max(best, least, 1e-9):
            continue
        row = ones
        for c in window:
            hit = row & places.get(c, 0)
            row = (row + hit) | (row - hit)
        best = max(best, 200.0 * (n - (row & ones).bit_count()) / (n + len(window)))
    return best if best >= least else 0.0


#: What lies between texts of a batch: no window of a name's length reaches from one into another.
APART = chr(0x10FFFF)


def likely_windows(texts: list[str], names: tuple[str, ...], least: float) -> list[dict[int, list[str]]]:
    """For each name the texts, by their place, that may hold something like it, and the stretches of them that may be. The
    letters that a stretch has in common with the name bound their ratio; they are counted for all texts at once. A text that
    is no longer than the name is its own only stretch."""
    least = max(least, 1e-9)
    longest = max(map(len, names), default=0)
    between = APART * longest
    codes = np.frombuffer((between + between.join(texts) + between).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = longest + np.cumsum(sizes + longest) - sizes - longest
    kind = np.uint8 if longest < 256 else np.int64  # counts of a window; their running sums may wrap
    running = {c: np.append(kind(0), np.cumsum(codes == ord(c), dtype=kind)) for c in {*"".join(names), APART}}
    out = []
    for name in names:
        n = len(name)
        found: dict[int, list[str]] = {}
        if n:
            shared, whole = np.zeros(len(codes) - n + 1, kind), np.zeros(len(texts), kind)
            for c, most in Counter(name).items():
                shared += np.minimum(running[c][n:] - running[c][:-n], kind(most))
                whole += np.minimum(running[c][starts + sizes] - running[c][starts], kind(most))
            seen = kind(n) - (running[APART][n:] - running[APART][:-n])
            enough = np.array([n + 1, *(next((k for k in range(1, n + 1) if 200.0 * k / (n + m) >= least), n + 1) for m in range(1, n + 1))])
            low = int(enough.min())
            near = np.flatnonzero(shared >= low)
            near = near[shared[near] >= enough[seen[near]]]
            of = np.searchsorted(starts, near + n - 1, side="right") - 1
            for p, i in zip((near - starts[of]).tolist(), of.tolist(), strict=True):
                if sizes[i] > n:
                    found.setdefault(i, []).append(texts[i][max(p, 0) : p + n])
            # no more than the letters in common can be in order; a little is left for rounding
            short = (sizes <= n) & (sizes > 0) & (200.0 * whole >= (least - 1e-6) * (sizes + whole))
            found |= {i: [texts[i]] for i in np.flatnonzero(short).tolist()}
        out.append(found)
    return out


@lru_cache(1 << 16)
def _whole_ratio(name: str, text: str, least: float) -> float:
    return partial_ratio(name, text, least)


@lru_cache(16)
def _in_order(name: str) -> Callable[[str], float]:
    """What gives the indel ratio of the name with a text, in percent."""
    n, places = len(name), {}
    for k, c in enumerate(name):
        places[c] = places.get(c, 0) | 1 << k
    ones = (1 << n) - 1

    @lru_cache(1 << 14)
    def ratio(window: str) -> float:
        row = ones
        for c in window:
            hit = row & places.get(c, 0)
            row = (row + hit) | (row - hit)
        return 200.0 * (n - (row & ones).bit_count()) / (n + len(window))

    return ratio


def known_name(joined: Column, names: tuple[str, ...] = ARCHITECTS, least: float = LEAST_NAME) -> Column:
    """struct(k, score): which of the names is most like a part of the text, the first of equals; null below `least`. The score
    is their `partial_ratio`."""

    @F.arrow_udf("struct<k:int,score:double>")
    def best(texts: pa.Array) -> pa.Array:
        texts = [t or "" for t in texts.to_pylist()]
        top: dict[int, tuple[float, int]] = {} if least > 0 or not names else dict.fromkeys(range(len(texts)), (0.0, 0))
        for k, (name, found) in enumerate(zip(names, likely_windows(texts, names, least), strict=True)):
            ratio = _in_order(name)
            for i, windows in found.items():
                score = max(map(ratio, windows)) if len(texts[i]) > len(name) else _whole_ratio(name, texts[i], least)
                if score >= least and score > top.get(i, (0.0,))[0]:
                    top[i] = (score, k)
        found = [top.get(i, (None, None)) for i in range(len(texts))]
        return pa.StructArray.from_arrays([pa.array([k for _, k in found], pa.int32()), pa.array([s for s, _ in found], pa.float64())], ["k", "score"])

    # or Spark would run it once more for each filter on what it gives
    return best.asNondeterministic()(joined)


def rule_fields(tokens: DataFrame, names: tuple[str, ...] = ARCHITECTS, labels: dict[str, list[str]] = ANCHORS, lock: float = 0.85, label_least: float = 85.0, first_year: int = 1900, last_year: int = 2000) -> DataFrame:
    """A row for each sheet and field: locked, and then tids, verbatim, corrected, basis, score, agreement, conf; rejected
    says why a claim was turned down: `noisy` (a scale among other text), `expansion` (most of a listed name was not read),
    `conflict` (the best drawing number is not the label's), `format`. Fields that are not locked are left to the model.

    Claims by format and by the list of names come first, then those by labels, for fields that are still open."""
    t, texts = F.coalesce("text", F.lit("")), F.col("candidates")
    texts = texts["text"] if isinstance(tokens.schema["candidates"].dataType.elementType, T.StructType) else texts
    has_number = lambda c: F.coalesce(c.rlike("[0-9]") & X.has_drawing_number(c), F.lit(False))
    dated = t.rlike("[0-9]") & X.is_date(t) & F.coalesce(X.year(t).between(first_year, last_year), F.lit(False))
    # another reading counts if no token has a number; most have none either
    other = F.when(has_number(t) | ~F.coalesce(F.exists(texts, has_number), F.lit(False)), False).otherwise(has_number(repair.first_more_complete(t, texts)))
    says = {"is_scale": X.is_scale(t) & ~X.is_bare_label(t), "is_date": dated, "is_number": has_number(t), "is_other": other}
    of_sheet = stage(_in_rows(tokens.select(*TOKEN, "candidates"), **says).filter("sheet_id IS NOT NULL"), toks=F.col("toks"))
    toks = F.col("toks")
    joined = F.array_join(F.transform(toks, lambda x: F.upper(x["text"])), " ")
    read = of_sheet.select("sheet_id", "toks", known_name(joined, names).alias("m"), _values(toks, labels, label_least).alias("values"))

    marked = lambda flag: F.filter(toks, lambda x: x[flag])
    number = F.array_max(F.transform(marked("is_number"), lambda x: F.struct(x["agreement"].alias("agreement"), x["conf"].alias("conf"), (-x["tid"]).alias("back"), x["text"].alias("text"))))
    alt = F.get(marked("is_other"), 0)
    mine = F.get(F.filter("values", lambda v: v["label"] == "drawing_number"), 0)
    share = lambda v: F.lit(LABEL_BASE) + LABEL_SHARE * v["score"]
    beside = F.filter("values", lambda v: v["label"].isin(*FIELDS) & (v["label"] != "drawing_number") & (share(v) >= lock))
    by = {"any": F.array_min(toks["tid"]), "scale": F.array_min(marked("is_scale")["tid"]), "date": F.array_min(marked("is_date")["tid"]), "n": number, "alt": alt, "mine": mine, "beside": beside}
    sheets = stage(read, by=F.struct(*[c.alias(k) for k, c in by.items()])).select("sheet_id", "toks", "m", "by.*").filter(F.col("any").isNotNull())
    sheets = stage(sheets, t=F.get(toks, F.col("mine.at")))

    def seed(name, turn, at, alone, score, why=None, word=None, listed=None):
        null = F.lit(None).cast("string")
        return F.struct(name.alias("name"), F.lit(turn).alias("turn"), at.cast("int").alias("seed"), alone.alias("alone"), score.cast("double").alias("score"), (null if why is None else why).alias("why"), (null if word is None else word).alias("word"), (null if listed is None else listed).alias("listed"))

    of_label, label_says = F.col("t.tid"), share(F.col("mine"))
    v_tid, v_text = F.coalesce(-F.col("n.back"), F.col("alt.tid")), F.coalesce("n.text", "alt.text")
    v_score = F.when(F.col("n.agreement") >= 0.99, AGREED_NUMBER).when(F.col("n").isNotNull(), LONE_NUMBER).when(F.col("alt").isNotNull(), OTHER_NUMBER)
    differ = F.when(v_tid.isNotNull() & of_label.isNotNull(), F.when(X.number_key(v_text) != X.number_key(F.col("t.text")), "conflict"))
    sheets = stage(sheets, conflict=differ, sure=F.greatest(v_score, label_says))  # of one alone, its own
    conflict, sure = F.col("conflict"), F.col("sure")
    numbered = F.when(conflict.isNotNull() | (sure >= lock), F.coalesce(of_label, v_tid))
    pick = lambda given: F.get(F.array(*[F.lit(g) for g in given]), F.col("m.k")) if given else F.lit(None).cast("string")
    yes, no = F.lit(True), F.lit(False)
    seeds = F.array(
        seed(F.lit("scale"), 0, F.col("scale"), no, F.lit(None)),
        seed(F.lit("date"), 0, F.col("date"), yes, F.lit(DATE_SCORE)),
        seed(F.lit("drawing_number"), 0, numbered, yes, F.when(of_label.isNull(), sure).otherwise(F.round(sure, 3)), conflict),
        seed(F.lit("architect"), 0, F.when(F.col("m.k").isNotNull(), F.col("any")), yes, F.least(F.col("m.score") / 100, F.lit(MOST_NAME)), None, pick([n.split()[0] for n in names]), pick([n.title() for n in names])),
    )
    beside = F.transform("beside", lambda v: seed(v["label"], 1, F.get(toks, v["at"])["tid"], ~v["label"].isin(*SEVERAL), F.round(share(v), 3)))
    # apart from the lambda, so that Spark generates code for the others
    given = stage(sheets, seeds=seeds).select("sheet_id", "toks", F.concat("seeds", beside).alias("seeds"))

    def claim(s: Column, held: Column, whole: Column, found: Column) -> Column:
        by_scale, by_name = (s["name"] == "scale") & (s["turn"] == 0), s["word"].isNotNull()
        noisy = F.coalesce(F.length(found) < F.length(strip(whole)) * 0.8, F.lit(False))
        grows = F.length(s["listed"]) / F.greatest(F.length(whole), F.lit(1))
        score = F.when(by_scale, F.when(noisy, NOISY_SCALE).otherwise(CLEAN_SCALE)).when(by_name & (grows > 1.3), F.least(s["score"], F.lit(EXPANDED_NAME))).otherwise(s["score"])
        # a value is held against its format's own years
        wrong = X.format_check(s["name"], whole) == 0
        corrected = F.when(by_scale, found).when(s["name"] == "date", whole).otherwise(s["listed"])
        basis = F.when(by_scale & found.isNotNull(), F.lit("the part of the line that is a scale")).when(by_name, F.concat(F.lit("listed name, read as "), whole))

        def told(score: Column) -> Column:
            why = F.coalesce(s["why"], F.when(by_scale & (score < lock), "noisy"), F.when(by_name & (grows > 2.0), "expansion"), F.when(wrong, "format"))
            b = F.struct(held["tid"].alias("tids"), whole.alias("verbatim"), corrected.alias("corrected"), basis.alias("basis"), score.alias("score"), F.array_min(held["agreement"]).alias("agreement"), F.array_min(held["conf"]).alias("conf"))
            # a name that is not sure is no claim
            return F.when(~(by_name & (score < lock) & (grows <= 2.0)), F.struct(s["name"].alias("name"), s["turn"].alias("turn"), why.alias("why"), b.alias("b")))

        return let(score, told)

    def claimed(s: Column) -> Column:
        found = lambda whole: F.when((s["name"] == "scale") & (s["turn"] == 0), F.nullif(strip(F.regexp_extract(whole, X.SCALE, 0)), F.lit("")))
        of = lambda held: let(F.array_join(held["text"], " "), lambda whole: let(found(whole), lambda f: claim(s, held, whole, f)))
        held = let(_held(toks, s["seed"], s["alone"], s["word"]), lambda held: F.when(F.size(held) > 0, of(held)))
        return F.when(s["seed"].isNotNull(), held)

    claims = stage(given, claims=F.transform("seeds", claimed)).select("sheet_id", "claims")
    # a field has one claim of each turn at most: those of the first turn lie at their seeds' places
    early, late = {"scale": 0, "date": 1, "drawing_number": 2, "architect": 3}, [f for f in FIELDS if f in labels and f != "drawing_number"]
    of_turn_1 = lambda f: F.get(F.filter("claims", lambda c: (c["name"] == f) & (c["turn"] == 1)), 0)
    by_label = {f"by_label_{f}": of_turn_1(f) for f in late}
    one = stage(claims, **by_label) if late else claims
    none = F.lit(None).cast(claims.schema["claims"].dataType.elementType)

    def held(f: str) -> tuple[Column, Column]:
        """What holds of a field's claims, and why one before it, or the last of all, was turned down."""
        a, b = F.get("claims", F.lit(early[f])) if f in early else none, F.col(f"by_label_{f}") if f in late else none
        good = lambda c: c.isNotNull() & c["why"].isNull()
        return F.when(good(a), a["b"]).when(good(b), b["b"]), F.when(good(a), F.lit(None)).when(good(b), a["why"]).otherwise(F.coalesce(b["why"], a["why"]))

    # the title's words tell the type
    title, _ = held("drawing_title")
    kind = X.drawing_type(title["verbatim"])
    typed = F.struct(title["tids"].alias("tids"), title["verbatim"].alias("verbatim"), kind.alias("corrected"), F.lit("type words of the title").alias("basis"), F.lit(TYPE_SCORE).alias("score"), F.lit(None).cast("double").alias("agreement"), F.lit(None).cast("double").alias("conf"))

    def field(f: str) -> Column:
        b, rejected = held(f)
        if f == "drawing_type":
            b = F.when(kind.isNotNull(), typed).otherwise(b)
        return F.struct(F.lit(f).alias("name"), b.alias("b"), rejected.alias("rejected"))

    each = one.select("sheet_id", F.inline(F.array(*[field(f) for f in FIELDS])))
    return each.select("sheet_id", "name", F.col("b").isNotNull().alias("locked"), *[F.col(f"b.{c}") for c in FOUND], "rejected")
