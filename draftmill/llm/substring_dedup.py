"""Removal of passages that repeat across documents (operator 2).

Documents are stored in chunks of some megabytes (compressed). Count-min prefilter: every chunk counts its windows in a
sketch, of which it sends the counters that aren't zero, by blocks of counters; a block's task merges them into counts of
chunks, saturating at two, and answers each chunk with one bit for each counter it sent. So the sketch is as wide as the input needs, no task
holds more than a block of it, and nothing is broadcast. A second pass groups exactly only the windows that are estimated
to be in two chunks or more. A sketch never estimates too low, so no repeated window is lost; a wrong estimate costs only work.

A window's words are compared by 96 bits of hash across chunks, not word by word. Of windows that repeat inside a chunk one stands for
all, so a very common passage comes once for each chunk. A chunk then takes out the windows that it knows of itself (a
smaller doc_id in the chunk has them) and those that the groups named.

Defined results: a null text has no words; a text shorter than a window loses nothing; a missing doc_id counts as the
largest; a window that repeats inside one document alone is kept; rows of equal doc_id and text get equal results, and
rows of equal doc_id don't remove one another; extra columns are ignored unless named in `carry`, whose columns may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmill.llm._text import U64, Words, buffers, ident, mix, steps, stored, tidied, whole_windows, windows

#: Words of a window; bytes of text of a chunk (a longer document is a chunk of its own).
WINDOW, CHUNK = 50, 8 << 20
#: Rows of the sketch; counters of a row for each window, as the text's bytes suggest.
DEPTH, ROOM = 2, 8
#: Counters of a block, as a power of two: at least, at most, and what is taken from the width's power between these.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 16, 26, 8
_SEEDS = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0), U64(0x082EFA98EC4E6C89))


def packed(x: np.ndarray) -> bytes:
    """Ascending distinct numbers in about 2 + log2(range / count) bits each: the low bits as they are, the rest as the
    places of ones."""
    m = len(x)
    if not m:
        return b""
    x = x.astype(np.int64)
    top = int(x[-1]) + 1
    l = max(0, (top // m).bit_length() - 1)
    low = np.packbits((x[:, None] >> np.arange(l) & 1).astype(np.uint8)) if l else np.zeros(0, np.uint8)
    ones = np.zeros(int(x[-1] >> l) + m, np.uint8)
    ones[(x >> l) + np.arange(m)] = 1
    return np.array([m, top], "<u8").tobytes() + low.tobytes() + np.packbits(ones).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    m, top = (int(v) for v in np.frombuffer(raw, "<u8", 2))
    l = max(0, (top // m).bit_length() - 1)
    size = (m * l + 7) // 8
    ones = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 + size))
    x = (np.flatnonzero(ones) - np.arange(m)) << l
    if l:
        x |= np.unpackbits(np.frombuffer(raw, np.uint8, size, 16), count=m * l).reshape(m, l) @ (1 << np.arange(l))
    return x


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(keys ^ _SEEDS[row]) >> U64(64 - width)


_CHUNK = [T.StructField("chunk", T.LongType()), T.StructField("dids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("body", T.BinaryType())]


def _chunks(most: int):
    """Rows (row, did, text) in chunks: their rows, ids, sizes in bytes (-1 for null) and texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        packer = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            sizes = np.where(batch.column(2).is_null().to_numpy(zero_copy_only=False), -1, np.diff(offsets)).astype(np.int32)
            for lo, hi in steps(data, offsets, most):
                one = lambda x, lo=lo, hi=hi: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x.slice(lo, hi - lo))
                body = packer.compress(data[offsets[lo] : offsets[hi]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), one(batch.column(1)), one(pa.array(sizes)), pa.array([body], pa.binary()), one(batch.column(0))], ["chunk", "dids", "sizes", "body", "rows"])
                n += 1

    return run


class _Chunk:
    """The texts of a chunk, and its windows: hash, place (counted in words over the whole chunk) and document."""

    def __init__(self, sizes: pa.Scalar, body: pa.Scalar):
        self.sizes = sizes.values.to_numpy()
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)
        self.offsets = np.r_[0, np.cumsum(np.maximum(self.sizes, 0), dtype=np.int64)]

    def windows(self, size: int, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The hashes by each seed, places and documents of all windows; sets bounds, the documents' first words."""
        hashes: list[list[np.ndarray]] = [[] for _ in seeds]
        places, docs, bounds, n = [], [], [np.zeros(1, np.int64)], 0
        for lo, hi in steps(self.data, self.offsets):
            w = Words(self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo], False)
            at = np.flatnonzero(whole_windows(w, size))
            for k, seed in enumerate(seeds):
                hashes[k].append(windows(w.hashes(seed), size, seed)[at])
            docs.append((np.searchsorted(w.bounds, at, "right") - 1 + lo).astype(np.int32))
            places.append((at + n).astype(np.int32))
            bounds.append(w.bounds[1:] + n)
            n += len(w.starts)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.bounds = join(bounds, np.int64)
        return [join(h, U64) for h in hashes], join(places, np.int32), join(docs, np.int32)


def _sketch(size: int, width: int, block: int):
    """Of each chunk and block: the counters that aren't zero. What repeats inside a chunk, the chunk finds by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.column(0)[k].as_py()
                (keys,), _, _ = _Chunk(batch.column(1)[k], batch.column(2)[k]).windows(size, (1,))
                for row in range(DEPTH):
                    cells = np.unique(_cells(keys, row, width))
                    blocks, first = np.unique(cells >> U64(block), return_index=True)
                    ends = [*first[1:], len(cells)]
                    inside = cells & U64((1 << block) - 1)
                    m = len(blocks)
                    if m:
                        yield pa.RecordBatch.from_arrays([pa.array([row] * m, pa.int32()), pa.array(blocks.astype(np.int64)), pa.array([chunk] * m, pa.int64()), pa.array([packed(inside[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())], ["row", "block", "chunk", "cells"])

    return run


def _merged(block: int):
    """Merges the sketches of a block, saturating at two, and answers each chunk with a bit for each of its counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answers() -> pa.RecordBatch:
            sums, out = np.zeros(1 << block, np.uint8), []
            for _, cells in held:
                sums[cells] = np.minimum(sums[cells] + np.uint8(1), 2)
            for chunk, cells in held:
                more = sums[cells] > 1
                if more.any():
                    out.append((chunk, np.packbits(more).tobytes()))
            m = len(out)
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([now[0]] * m, pa.int32()), pa.array([now[1]] * m, pa.int64()), pa.array([x for _, x in out], pa.binary())], ["chunk", "row", "block", "bits"])

        for batch in batches:
            for row, b, chunk, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, b) != now:
                    if held:
                        yield answers()
                    now, held = (row, b), []
                held.append((chunk, unpacked(cells).astype(np.uint32)))
        if held:
            yield answers()

    return run


def _estimated(keys: np.ndarray, answers: list[dict], width: int, block: int) -> np.ndarray:
    """Which of a chunk's windows all rows of the sketch estimate to be in two chunks or more."""
    ok = np.ones(len(keys), bool)
    for row in range(DEPTH):
        cells, back = np.unique(_cells(keys, row, width), return_inverse=True)
        blocks, first = np.unique(cells >> U64(block), return_index=True)
        of = {int(b): (int(f), int(t)) for b, f, t in zip(blocks, first, [*first[1:], len(cells)], strict=True)}
        more = np.zeros(len(cells), bool)
        for x in answers:
            if x["row"] == row:
                f, t = of[x["block"]]
                more[f:t] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=t - f).astype(bool)
        ok &= more[back]
    return ok


def _candidates(size: int, width: int, block: int):
    """A row for each distinct window of a chunk that is estimated repeated: its least doc_id there, and a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                answers = batch.column(4)[k].as_py()
                if not answers:
                    continue
                chunk, dids = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy()
                (a, b), places, docs = _Chunk(batch.column(2)[k], batch.column(3)[k]).windows(size, (1, 2))
                at = np.flatnonzero(_estimated(a, answers, width, block))
                did = dids[docs[at]]
                order = np.lexsort((did, b[at], a[at]))
                at, did = at[order], did[order]
                new = np.ones(len(at), bool)
                new[1:] = (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])
                at, did = at[new], did[new]
                o = np.argsort(places[at])  # in the order of the text, which packs better
                at, did = at[o], did[o]
                for f in range(0, len(at), 200_000):
                    x = at[f : f + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(a[x].view(np.int64)), pa.array((b[x] >> U64(32)).astype(np.uint32).view(np.int32)), pa.array(did[f : f + 200_000]), pa.array(np.full(len(x), chunk)), pa.array(places[x].astype(np.int32))], ["a", "b", "did", "chunk", "at"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the places that were named, in one row. Rows come sorted by chunk."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed(np.sort(np.concatenate(held)))], pa.binary())], ["chunk", "places"])

    for batch in batches:
        chunk, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
        for f, t in zip(edges, [*edges[1:], len(chunk)], strict=True):
            if chunk[f] != now:
                if held:
                    yield done()
                now, held = int(chunk[f]), []
            held.append(at[f:t])
    if held:
        yield done()


def _repeated(a: np.ndarray, b: np.ndarray, dids: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Which of a chunk's windows go: those that a smaller doc_id of the chunk has too, and all that equal a named one."""
    gone = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    s = a[order]
    again = np.r_[s[1:] == s[:-1], False]
    again[1:] |= again[:-1].copy()
    many = order[again] if len(a) else order
    many = many[np.lexsort((dids[many], b[many], a[many]))]
    if len(many):
        new = np.r_[True, (a[many][1:] != a[many][:-1]) | (b[many][1:] != b[many][:-1])]
        group = np.cumsum(new) - 1
        gone[many] = dids[many] > dids[many][new][group]
        hit = np.zeros(group[-1] + 1, bool)
        hit[group[named[many]]] = True
        gone[many] |= hit[group]
    return gone | named


def _apply(size: int, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dids = batch.column(1)[r].values.to_numpy()
                chunk = _Chunk(batch.column(2)[r], batch.column(3)[r])
                (a, b), places, docs = chunk.windows(size, (1, 2))
                named = np.zeros(len(a), bool)
                named[np.searchsorted(places, unpacked(batch.column(5)[r].as_py() or b""))] = True
                at = places[_repeated(a, b, dids[docs], named)].astype(np.int64)
                del a, b, places, docs, named
                cover = np.zeros(int(chunk.bounds[-1]) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                gone = np.cumsum(cover)[:-1] > 0
                before = np.r_[0, np.cumsum(gone)]
                n_words, n_removed = np.diff(chunk.bounds), before[chunk.bounds[1:]] - before[chunk.bounds[:-1]]
                raw, out = chunk.data.tobytes(), []
                for i, null in enumerate((chunk.sizes < 0).tolist()):
                    x = raw[chunk.offsets[i] : chunk.offsets[i + 1]]
                    if n_removed[i]:
                        lost = gone[chunk.bounds[i] : chunk.bounds[i + 1]].tolist()
                        x = b" ".join([w for w, g in zip(x.split(), lost, strict=True) if not g])
                    elif not want_text:
                        x = b" ".join(x.split())
                    out.append((None if null else x.decode()) if want_text else hashlib.sha256(x).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(4)[r].values, pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(out, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return run


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, most: int = CHUNK) -> DataFrame:
    """The stored chunks of docs: chunk, dids, sizes, body, rows (doc_id and the columns of carry)."""
    row = F.struct(F.col(doc_id).alias("doc_id"), *([F.struct(*[F.col(c) for c in carry]).alias("carry")] if carry else []))
    rows = docs.select(row.alias("row"), ident(doc_id).alias("did"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(tidied(_chunks(most)), T.StructType([*_CHUNK, T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])), "chunks")


def repeated_windows(chunks: DataFrame, size: int = WINDOW, width: int | None = None) -> DataFrame:
    """(chunk, places): of each chunk the places of the windows that a smaller doc_id of another chunk has too. width: the
    counters of a row of the sketch, as a power of two; by itself it follows the input, and it changes no result."""
    if width is None:
        n_bytes = chunks.agg(F.sum(F.aggregate(F.col("sizes"), F.lit(0).cast("bigint"), lambda x, n: x + F.greatest(n, F.lit(0))))).first()[0] or 0
        width = min(62, max(LEAST_BLOCK, math.ceil(math.log2(max(1, n_bytes / 6 * ROOM)))))
    block = min(width, MOST_BLOCK, max(LEAST_BLOCK, width - BLOCKS))
    parts = chunks.select("chunk", "sizes", "body").mapInArrow(tidied(_sketch(size, width, block)), "row int, block bigint, chunk bigint, cells binary")
    answers = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(tidied(_merged(block)), "chunk bigint, row int, block bigint, bits binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("row", "block", "bits")).alias("answers"))
    found = chunks.select("chunk", "dids", "sizes", "body").join(answers, "chunk").mapInArrow(tidied(_candidates(size, width, block)), "a bigint, b int, did bigint, chunk bigint, at int")
    # a window comes once for each chunk, so a very common passage doesn't fill one task
    later = found.repartition("a", "b").withColumn("least", F.expr("min(did) OVER (PARTITION BY a, b)")).filter("did > least")
    return later.select("chunk", "at").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tidied(_named), "chunk bigint, places binary")


def remove_repeated(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, width: int | None = None, chunk_bytes: int = CHUNK) -> DataFrame:
    """Every document without the words of repeated windows. Without `carry`: doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space). With it: doc_id, the struct `carry` of the columns named, n_words, n_removed
    and kept_text, which is the text unchanged where nothing was removed."""
    chunks = chunked(docs, doc_id, text, carry, chunk_bytes)
    joined = chunks.join(repeated_windows(chunks, size, width), "chunk", "left").select("chunk", "dids", "sizes", "body", "rows", "places")
    row = chunks.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("row", row), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    out = joined.mapInArrow(tidied(_apply(size, bool(carry))), schema)
    return out.select("row.*", "n_words", "n_removed", F.col("kept").alias("kept_text" if carry else "kept_sha256"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: DuckDB SQL of the same result (on small tables: it makes a row for each window).
OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p+49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT DISTINCT doc_id, p + o AS i FROM win JOIN least USING (k), range(0, 50) t(o) WHERE doc_id > m),
gone AS (SELECT doc_id, list(i) AS g FROM bad GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
