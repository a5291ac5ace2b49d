"""Order-dependent folds by key. `folded`: one pass over Arrow batches with only one key's rows held; rows that lie by key
already, or by a part of it, are sorted where they are, others are shuffled once. `gathered` and `numbers`: a key's rows as
one row's array, of which only the columns that are used go to Python, for many keys at once; what is numbered so still lies
by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gathered(df: DataFrame, key: str | tuple[str, ...], order: list[Column], carry: list[str], name: str = "g") -> DataFrame:
    """One row for each key: its rows as an array `name` of structs of the columns to carry, in order."""
    keys_ = (key,) if isinstance(key, str) else tuple(key)
    one = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*carry).alias("r"))
    return df.groupBy(*keys_).agg(F.array_sort(F.collect_list(one))["r"].alias(name))


def numbers(fold: Callable[..., np.ndarray], *columns: Column) -> Column:
    """An array of numbers for each row: fold takes the lengths of the rows' arrays (of the first column) and, of each column,
    all its arrays one after another, and gives a number for each entry of the first."""

    @F.arrow_udf("array<int>")
    def run(*arrays: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(arrays[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = fold(sizes, *[a.flatten() for a in arrays])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(out, pa.int32()))

    # or Spark would run it once more for each filter on what it gives
    return run.asNondeterministic()(*columns)


def by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The places of keys of like length (from a power of two up), as an array of keys by place of their rows; -1 is none."""
    first = np.cumsum(sizes) - sizes
    for k in np.unique(np.frexp(sizes[sizes > 0].astype(float))[1]):
        own = np.flatnonzero((sizes > 0) & (np.frexp(sizes.astype(float))[1] == k))
        # so many keys at once that their pairs of rows stay few
        wide = int(sizes[own].max())
        for part in np.array_split(own, -(-len(own) * wide * 8 // (1 << 20)) or 1):
            if len(part):
                at = np.arange(wide)
                yield np.where(at < sizes[part, None], first[part, None] + at, -1)


def folded(df: DataFrame, key: str | tuple[str, ...], order: list[Column | str], used: list[str], fold: Callable[[list[tuple]], list[int]], name: str) -> DataFrame:
    """Adds the int column `name`: fold takes the rows of a key in order, as tuples of the columns used, and gives a
    number for each. A key's rows must fit a task."""
    keys_ = (key,) if isinstance(key, str) else tuple(key)
    # a window leaves the rows of a key together and in order, and asks for a shuffle only where they don't lie by key
    placed = df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys_).orderBy(*order)))
    columns = df.columns
    places = [columns.index(c) for c in used]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = len(columns)  # __place is 1 where a key begins

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            firsts = [*np.flatnonzero(t.column(at).to_numpy() == 1).tolist(), t.num_rows]
            rows = list(zip(*(t.column(p).to_pylist() for p in places), strict=True))
            out: list[int] = []
            for a, b in pairwise(firsts):
                out += fold(rows[a:b])
            yield from t.drop_columns(["__place"]).append_column(name, pa.array(out, pa.int32())).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.flatnonzero(batch.column(at).to_numpy() == 1)
            if not len(begins):
                held.append(batch)
                continue
            cut = int(begins[-1])  # all keys but the last are whole
            if held or cut:
                yield from done([*held, batch.slice(0, cut)] if cut else held)
            held = [batch.slice(cut)]
        if held:
            yield from done(held)

    return placed.mapInArrow(run, schema)
