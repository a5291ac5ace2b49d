"""Ways to have large expressions computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it may name more than once."""
    return F.get(F.transform(F.array(value), body), 0)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, computed once a row by a generator of one row: the optimizer moves no condition and no
    projection through it, and so never copies their expressions into those that name them. No shuffle, nothing stored."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
