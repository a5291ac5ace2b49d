"""Which other reading of a token may be better than the one it has.

tokens: sheet_id, tid, text, candidates (array of structs: text, engine, conf, ...). Defined results: null texts are empty;
candidates with null text are passed over; of equally good candidates the first is preferred; tokens without a better one
have no row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import repair
from draftmill.functions import text as X
from draftmill.functions.staging import stage
from draftmill.operators.fusion import alternatives

#: The fields whose format speaks for a reading.
FORMATS = {"drawing_number": X.has_drawing_number, "scale": X.is_scale, "date": X.is_date}
#: The order in which fields are asked; the first is none.
ASKED = (None, "drawing_number", "scale", "date")


def reasons(main: Column, other: Column, field: str | None = None) -> Column:
    """What speaks for another reading (both in T1's form): `superset` if it holds the main one; `format` if it has the
    field's format and the main one has not, or else `repaired: ` and the first of its repairs that has."""
    superset = F.when((main != "") & (main != other) & F.contains(other, main), F.lit("superset"))
    if field is None:
        return F.array_compact(F.array(superset))
    has = FORMATS[field]
    repaired = F.get(F.filter(repair.variants(other, field), lambda v: has(v)), 0)
    better = F.when(has(main), None).when(has(other), F.lit("format")).otherwise(F.concat(F.lit("repaired: "), repaired))
    return F.array_compact(F.array(superset, better))


def hints(tokens: DataFrame, asked: tuple[str | None, ...] = ASKED) -> DataFrame:
    """(sheet_id, tid, field, preferred, engine, conf, reasons): of each token the candidate with most reasons for the first
    of the fields asked that has any."""
    text = F.coalesce("text", F.lit(""))
    parts = F.transform(alternatives(text, F.col("candidates")), lambda c: F.struct(c["text"].alias("preferred"), c["engine"].alias("engine"), F.bround(c["conf"], 3).alias("conf"), X.norm(c["text"]).alias("other")))
    each = tokens.select("sheet_id", "tid", X.norm(text).alias("main"), F.posexplode(parts).alias("k", "c")).select("sheet_id", "tid", "main", "k", "c.*")
    # where a candidate has reasons for a field, its token takes this field or one before, and those after it aren't looked at
    found = each
    for i, f in enumerate(asked):
        before = [F.size(f"r{k}") > 0 for k in range(i)]
        found = stage(found, **{f"r{i}": F.when(reduce(or_, before), F.array().cast("array<string>")).otherwise(reasons(F.col("main"), F.col("other"), f)) if before else reasons(F.col("main"), F.col("other"), f)})
    best = [F.max(F.when(F.size(f"r{i}") > 0, F.struct(F.size(f"r{i}").alias("n"), (-F.col("k")).alias("back"), F.lit(f).cast("string").alias("field"), "preferred", "engine", "conf", F.col(f"r{i}").alias("reasons")))).alias(f"b{i}") for i, f in enumerate(asked)]
    one = found.groupBy("sheet_id", "tid").agg(*best).withColumn("b", F.coalesce(*[f"b{i}" for i in range(len(asked))])).filter("b IS NOT NULL")
    return one.select("sheet_id", "tid", "b.field", "b.preferred", "b.engine", "b.conf", "b.reasons")


def view_hints(found: DataFrame) -> DataFrame:
    """hints as the index of a sheet shows them (sheet_id, tid, preferred, why)."""
    return found.select("sheet_id", "tid", "preferred", F.array_join("reasons", "; ").alias("why"))
