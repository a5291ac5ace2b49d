"""What the corpus operators share: word splitting and hashing over Arrow buffers, and the shared folder.

Words are found on the UTF-8 bytes without making Python strings: every separator of the contracts is an ASCII byte,
and no ASCII byte is part of a longer UTF-8 sequence.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: A missing doc_id sorts after every other.
NO_ID = (1 << 63) - 1

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a session of one process (as in tests)
    gets a folder of its own; a cluster is refused, as its executors could not reach a folder of this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="draftmill-")
        atexit.register(shutil.rmtree, d, True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: Paths of the stored tables that still exist, in the order they were made.
CREATED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/draftmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    CREATED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(df.sparkSession, df._stored_at)
    CREATED.remove(df._stored_at)


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes the tables stored since CREATED had `mark` entries, but for those named."""
    kept = {df._stored_at for df in keep}
    for path in [p for p in CREATED[mark:] if p not in kept]:
        _delete(spark, path)
        CREATED.remove(path)


def discard_unread(spark: SparkSession, paths: list[str], df: DataFrame) -> list[str]:
    """Deletes those of the stored tables that df doesn't read, and returns the others."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    read = " ".join(leaves.apply(k).toString() + (leaves.apply(k).relation().location().rootPaths().mkString(" ") if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" else "") for k in range(leaves.size()))
    gone = [p for p in paths if p.rsplit("/", 1)[-1] not in read]
    for path in gone:
        if path in CREATED:
            _delete(spark, path)
            CREATED.remove(path)
    return [p for p in paths if p not in gone]


#: Rows that make a group heavy: this many, and more than this share of all rows.
HEAVY_ROWS, HEAVY_SHARE = 1000, 1e-4


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the other columns of their group (null where there is none). groups: unique by keys, with the number
    of rows in `copies`, which sum to `total` at most. Groups of more than HEAVY_SHARE of all rows, of which there are
    no more than 1 / HEAVY_SHARE, are broadcast, so their rows stay where they are; only the others are shuffled. rows
    is read twice and should be stored."""
    least = max(HEAVY_ROWS, int(total * HEAVY_SHARE))
    other = F.struct(*[c for c in groups.columns if c not in (*keys, "copies")])
    packed = groups.select(*keys, "copies", other.alias("__g"))
    heavy, light = packed.filter(F.col("copies") >= least).drop("copies"), packed.filter(F.col("copies") < least).drop("copies")
    own = [*rows.columns, "__g.*"]
    at_heavy = rows.join(F.broadcast(heavy), keys).select(*own)
    at_light = rows.join(F.broadcast(heavy), keys, "left_anti").join(light, keys, "left").select(*own)
    return at_heavy.unionByName(at_light)


def ident(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NO_ID))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003 % (1 << 64))) * U64(0x9E3779B97F4A7C15)) | U64(1)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(data: np.ndarray, offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes."""
    tidy()
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def tidy() -> None:
    """Gives freed memory back: workers are used again by later stages, which find it taken otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with freed memory given back when a task is done: a worker that waits for its next one holds none."""

    def then_tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return then_tidy


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of documents, optionally with A-Z lowered."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        word = ~_WHITE[data]
        n = len(data)
        first, last = word.copy(), word.copy()
        if n:
            inner = offsets[(offsets > 0) & (offsets < n)]
            cut = ~word
            before = np.empty(n, bool)
            before[0] = True
            before[1:] = cut[:-1]
            before[inner] = True
            first &= before
            after = np.empty(n, bool)
            after[-1] = True
            after[:-1] = before[1:] | cut[1:]
            last &= after
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.lens = self.ends - self.starts
        #: words of document d: bounds[d] to bounds[d + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.bounds)
        self._body = self.data[word]

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits for each word: a multilinear hash of its bytes, then mixed."""
        if not len(self.lens):
            return np.zeros(0, U64)
        at = np.cumsum(self.lens) - self.lens
        place = np.arange(len(self._body)) - np.repeat(at, self.lens)
        terms = _table(int(self.lens.max()), seed)[place] * (self._body.astype(U64) + U64(1))
        return mix(np.add.reduceat(terms, at) + self.lens.astype(U64))


def windows(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the `size` entries from each place (unmixed sums at the end that run over are cut off): binary powers."""
    if len(h) < size:
        return np.zeros(0, U64)
    base = int(_table(1, seed)[0])
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out = power
            else:  # the part of `done` entries comes first
                k = U64(pow(base, width, 1 << 64))
                m = len(power) - done
                out = out[:m] * k + power[done : done + m]
            done += width
        if done == size:
            return mix(out[: len(h) - size + 1])
        k = U64(pow(base, width, 1 << 64))
        power = power[: len(power) - width] * k + power[width:]
        width *= 2


def whole_windows(w: Words, size: int) -> np.ndarray:
    """Which places start a window that ends in the same document."""
    n = len(w.starts)
    end = np.repeat(w.bounds[1:], w.n_words)
    return (np.arange(n) + size <= end)[: max(0, n - size + 1)]


_ASCII_WHITE = re.compile(r"[\x20\x09-\x0D]+")


def runs(text: str | None) -> list[str]:
    """The text's runs between white space. str.split() also cuts at the four separators 1C to 1F, which no tokenizer
    takes for white space; other white space outside ASCII is white space to both."""
    if not text:
        return []
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in _ASCII_WHITE.split(text) if x]
    return text.split()
