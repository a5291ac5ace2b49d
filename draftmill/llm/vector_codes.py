"""Vector code compression (operator 12): product codes of vectors, whose nearest entries are found by VA-file filtering.

Components become integers, and vectors are cut into parts; each part position has a codebook that a few rounds of
assignment and averaging fit to all vectors. To assign, the entries' coordinates are quantised into cells of few bits (in
each dimension, cells hold as many entries each; a cell's least and largest coordinate are kept). For each query, tables
of the least and the largest squared difference to every cell, added up over an entry's cells, give bounds of its
distance; only entries whose lower bound is at most the upper bound of the most promising one are refined with integer
distances.

The vectors stay where they are: a round is one pass over them that returns the sums of each task, and only codebooks
(entries x dimensions, whatever the number of vectors) go through the driver.

Defined results: vectors that are null or hold a null or non-finite component are left out. Vectors shorter than the
longest one, and all if its length is no multiple of the parts, are filled up with zeros; empty vectors are kept. Among
equal vec_ids, the codebooks begin with the lesser vectors; null ids come last. With fewer vectors than entries, there are
as many entries as vectors. Repeated rows each count and each get a code. Integers beyond +-2^31 count as that, as
distances to them need more than 64 bits; errors beyond 2^63 - 1 are that. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm._text import join_groups, stored, tidied

#: The contract's: what a component is multiplied by, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a cell; queries that are filtered together; the largest integer component.
BITS, BLOCK, MOST = 4, 2048, 1 << 31
MOST_ERROR = (1 << 63) - 1


class VaFile:
    """The approximation of a codebook: each entry's cells, and each cell's least and largest coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, self.largest = entries, _largest(entries)
        n, width = entries.shape
        cells = 1 << bits
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * cells // max(n, 1)
        self.low, self.high = np.empty((2, width, cells), entries.dtype)
        for j in range(width):
            for c in range(cells):
                own = entries[self.cell[:, j] == c, j]
                self.low[j, c], self.high[j, c] = (own.min(), own.max()) if len(own) else (0, 0)  # an empty cell is never asked

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each query, the nearest entry (of equally near ones the first) and the squared distance; refined pairs."""
        n, width = queries.shape
        kind = _kind(width, max(_largest(queries), self.largest))
        q, entries, low, high = (x.astype(kind, copy=False) for x in (queries.T, self.entries, self.low, self.high))
        lower = np.zeros((len(entries), n), kind)
        tables = []  # for each dimension, of the cells' differences to all queries
        for j in range(width):
            under, over = low[j][:, None] - q[j], q[j] - high[j][:, None]
            lower += (np.maximum(np.maximum(under, over), 0) ** 2)[self.cell[:, j]]
            tables.append(np.maximum(-under, -over) ** 2)
        # the upper bound of the entry whose lower bound is least is one of the nearest distance
        like, upper = lower.argmin(axis=0), np.zeros(n, kind)
        for j, most in enumerate(tables):
            upper += most[self.cell[like, j], np.arange(n)]
        row, entry = np.nonzero((lower <= upper).T)
        d = ((q.T[row] - entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        best = np.minimum.reduceat(d, first) if len(first) else d
        hit = np.flatnonzero(d == best[row])
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit
        return entry[hit], best, len(row)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def _kind(width: int, largest: int) -> type:
    """What sums of `width` squared differences of such integers fit in; Python's integers beyond 64 bits."""
    most = width * (2 * largest + 1) ** 2
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    """Integer rows of PARTS * width components."""
    n, dims = len(column), PARTS * width
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -MOST, MOST).astype(np.int64)


def _assigned(entries: list[np.ndarray], width: int, column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, part, vectors of the part, entry, distance) by blocks."""
    books = [VaFile(e) for e in entries]
    for at in range(0, len(column), BLOCK):
        block = _vectors(column.slice(at, BLOCK), width)
        for p in range(PARTS):
            v = block[:, p * width : (p + 1) * width]
            code, d, _ = books[p].nearest(v)
            yield at, p, v, code, d


def _sums(entries: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, the sums of the vectors' parts at each entry, and their number in the place after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
        for batch in batches:
            for _, p, v, code, _ in _assigned(entries, width, batch.column(0)):
                order = np.argsort(code, kind="stable")
                s = code[order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                if width:
                    total[p, s[first], :width] += np.add.reduceat(v[order], first, axis=0)
                total[p, s[first], width] += np.diff(np.r_[first, len(s)])
        flat = total.ravel()
        slot = np.flatnonzero((total[:, :, -1:] > 0).repeat(width + 1, 2).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], ["slot", "total"])

    return run


def _codes(entries: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            code, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, object)
            for at, p, v, c, d in _assigned(entries, width, batch.column(0)):
                code[at : at + len(v), p] = c
                error[at : at + len(v)] += d.astype(object)
            hexes = code.tobytes().hex()
            step = 2 * PARTS
            texts = [hexes[k : k + step] for k in range(0, n * step, step)]
            errors = pa.array([min(int(e), MOST_ERROR) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string()), errors], ["vec_id", "label", "code", "error"])

    return run


def product_codes(vectors: DataFrame, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """The stored (vec_id, label, code, error) of the kept vectors, label as string, and the final codebook of each part."""
    rows = vectors.select(F.col(embedding).cast("array<double>").alias("v"), F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & ~odd)
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    begin = _vectors(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width).astype(np.int64)
    books = [begin[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(tidied(_sums(books, width)), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(PARTS * ENTRIES * (width + 1), np.int64)
        for r in sums:
            total[r["slot"]] = r["total"]
        total = total.reshape(PARTS, ENTRIES, width + 1)
        for p, book in enumerate(books):
            used = np.flatnonzero(total[p, :, -1])
            book[used] = total[p, used, :-1] // total[p, used, -1:]
    return stored(rows.mapInArrow(tidied(_codes(books, width)), "vec_id long, label string, code string, error long"), "codes"), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and place."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def op12_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole embeddings table."""
    codes, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # a key that is never null, so that rows without label meet
    rows = codes.select("*", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("key"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_ERROR).cast("decimal(38,0)")).cast("bigint")
    groups = rows.groupBy("key").agg(F.count("*").alias("copies"), total.alias("label_error"))
    out = join_groups(rows, groups, ["key"], codes.count())
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, each assignment against all entries."""
    nearest = "SELECT p, row_no, q, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT a.p, row_no, q, e, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN {book} b ON a.p = b.p) GROUP BY ALL"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"near{k} AS MATERIALIZED ({nearest.format(book=f'book{k}')})")
        steps.append(
            f"mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT p, e, j, sum(q[j]) AS s, count(*) AS n FROM near{k}, range(1, len(q) + 1) AS t(j) GROUP BY p, e, j) GROUP BY p, e)"
        )
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))")
    last = f"book{ROUNDS}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_no, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT row_no, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS q FROM kept, range({PARTS}) AS t(p)),
book0 AS (SELECT p, row_no - 1 AS e, q AS c FROM parts WHERE row_no <= {ENTRIES}),
{", ".join(steps)},
final AS MATERIALIZED ({nearest.format(book=last)}),
codes AS (SELECT row_no, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d) AS error FROM final GROUP BY row_no),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last})
SELECT vec_id, lower(code) AS code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row_no), sha
"""


OP12_SQL = _sql()
