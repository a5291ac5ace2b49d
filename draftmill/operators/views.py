"""Text views of a sheet: a grid that keeps places, and an index of tokens.

tokens: sheet_id, row_no, tid, text, box, and alternatives (array of `engine:text`) for the index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftmill.functions import repair
from draftmill.operators import candidates, layout
from draftmill.operators.fusion import alternatives


def lines(tokens: DataFrame) -> DataFrame:
    """Rows of tokens: box, text, and the tokens from left to right. Tokens of row -1 (rotated) are lines of their own."""
    own = F.when(F.col("row_no") < 0, F.col("tid")).otherwise(F.lit(-1))
    tok = F.struct("x0", "tid", "text", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    out = tokens.groupBy("sheet_id", "row_no", own.alias("own")).agg(F.array_sort(F.collect_list(tok)).alias("toks"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.withColumn("text", F.array_join(F.col("toks")["text"], " ")).drop("own")


def grid(tokens: DataFrame, columns: int = 120, blanks: int = 2) -> DataFrame:
    """(sheet_id, grid): every line with its tokens at the columns where they lie, one column being the median width of a
    character, and up to `blanks` empty rows where lines lie apart."""
    width = F.when((F.col("y1") > F.col("y0")) & ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")) < 60), (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1)))
    sheet = tokens.groupBy("sheet_id").agg(F.greatest(F.coalesce(F.median(width), F.lit(8.0)), F.lit(1.0)).alias("unit"), F.min("x0").alias("left"))
    order = Window.partitionBy("sheet_id").orderBy("y0", "x0", "row_no")
    apart = ((F.col("y0") - F.lag("y1").over(order)) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1))).cast("int") - 1
    line = lines(tokens).join(sheet, "sheet_id").withColumn("above", F.coalesce(F.least(F.greatest(apart, F.lit(0)), F.lit(blanks)), F.lit(0)))

    def put(row, t):
        at = ((t["x0"] - F.col("left")) / F.col("unit")).cast("int")
        padded = F.when(at > F.length(row), F.rpad(row, at, F.lit(" "))).otherwise(row)
        return F.concat(padded, F.when((padded == "") | padded.endswith(" "), "").otherwise(" "), t["text"])

    shown = F.rtrim(F.substring(F.aggregate("toks", F.lit(""), put), 1, columns))
    text = F.concat(F.repeat(F.lit("\n"), F.col("above")), shown)
    place = F.struct(F.col("y0"), F.col("x0"), F.col("row_no"), text.alias("t"))
    return line.withColumn("p", place).groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["t"], "\n").alias("grid"))


def index(tokens: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(sheet_id, index): a line for each token with its id, row and text, the other readings, and the hint (sheet_id, tid,
    preferred, why) if there is one."""
    line = Window.partitionBy("sheet_id", "row_no")
    at = tokens.withColumns({f"l{c}": F.when(F.col("row_no") >= 0, F.min(f"{c}0").over(line)) for c in "xy"})
    head = F.concat(F.lit("["), F.col("tid").cast("string"), F.lit("] row "), F.col("row_no").cast("string"))
    row = F.concat(head, F.lit("  "), "text", F.when(F.size("alternatives") > 0, F.concat(F.lit("   ← alternatives "), F.array_join("alternatives", " | "))).otherwise(""))
    if hints is not None:
        at = at.join(hints, ["sheet_id", "tid"], "left")
        row = F.concat(row, F.when(F.col("preferred").isNotNull(), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(head)), F.lit("   ⚠ prefer '"), "preferred", F.lit("': "), "why")).otherwise(""))
    place = F.struct(F.coalesce("ly", "y0").alias("y"), F.coalesce("lx", "x0").alias("x"), "x0", "tid", row.alias("t"))
    return at.withColumn("p", place).groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["t"], "\n").alias("index"))


def longest(segments: DataFrame, key: str, most: int = 240) -> DataFrame:
    """The longest segments of each key."""
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    w = Window.partitionBy(key).orderBy(F.desc(size), "x0", "y0", "x1", "y1")
    return segments.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def placed(tokens: DataFrame) -> DataFrame:
    """Fused tokens (sheet_id, seq, text, box, candidates) with row_no, the place of their line from the top, from 1, and tid,
    their own place from 0, line by line from the left. Upright tokens form rows, a rotated one is a line of its own."""
    return layout.in_lines(tokens).select("sheet_id", "t.*", "tid")


def scan_hints(tokens: DataFrame) -> DataFrame:
    """(sheet_id, tid, preferred, why) of the tokens of which a candidate is more complete; the first such candidate."""
    text = F.coalesce("text", F.lit(""))
    each = tokens.select("sheet_id", "tid", text.alias("text"), F.posexplode(alternatives(text, F.col("candidates"))).alias("k", "c"))
    more = each.withColumn("extra", repair.more_complete(F.col("text"), F.col("c.text"))).filter("extra IS NOT NULL")
    first = more.groupBy("sheet_id", "tid").agg(F.min_by(F.struct("c.text", "c.engine", "extra"), "k").alias("f"))
    return first.select("sheet_id", "tid", F.col("f.text").alias("preferred"), F.concat("f.engine", F.lit(" has it whole and adds "), "f.extra").alias("why"))


def both(tokens: DataFrame, hinted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(sheet_id, grid, index) of fused tokens. hinted: what gives the hints of placed tokens (sheet_id, tid, preferred,
    why); by default the candidates that have the best reasons, or, as another way, scan_hints."""
    at = placed(tokens)
    found = candidates.view_hints(candidates.hints(at)) if hinted is None else hinted(at)
    shown = F.transform(alternatives(F.coalesce("text", F.lit("")), F.col("candidates")), lambda c: F.concat_ws(":", c["engine"], c["text"]))
    rows = at.withColumns({"alternatives": F.coalesce(shown, F.array().cast("array<string>")), "text": F.coalesce("text", F.lit(""))})
    return grid(rows).join(index(rows, found), "sheet_id")
