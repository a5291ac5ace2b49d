"""Token ids in succinct files (operator 7): a wavelet matrix for each shard.

Documents are dealt out by ranges of doc_id and sorted; each task encodes its texts and writes shards of about
SHARD_TOKENS ids. A shard is one compressed blob: a header, the documents' lengths, and one bit-plane for each bit of an
id, the highest first, each plane in the order that sorting stably by the planes before it gives. Rank directories are
counted when a shard is opened. Shards lie as rows of a Parquet table in the shared folder, as executors may reach
nothing but what Spark reads and writes.

Defined results: null and empty texts have only the end id; a missing doc_id comes last; rows of one doc_id follow each
other in the order of their texts' hashes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmill.llm._text import _LOWER, _WHITE, buffers, ident, steps, stored

#: Appended to every document; ids of a shard, after which the next document starts a new one.
END, SHARD_TOKENS = 2, 2_000_000
#: Pieces of text that a worker remembers (a step may add its own); a full table is emptied, which changes no result.
REMEMBERED = 700_000
#: Pieces that the library gets in one text; bytes of text in a step.
TOGETHER, STEP = 256, 8 << 20
_MAGIC = b"WVMX1\0\0\0"
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class WaveletMatrix:
    """Bit-planes with rank and select: access, counting and occurrences of a sequence of ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.bits = n, zeros, planes, len(planes)
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        cur, zeros, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for k in range(bits - 1, -1, -1):
            one = (cur >> k & 1).astype(bool)
            low = cur[~one]
            zeros.append(len(low))
            planes.append(np.packbits(one, bitorder="little"))
            cur = np.concatenate([low, cur[one]])
        return cls(len(ids), zeros, planes)

    def _rank(self, level: int, at: int) -> int:
        """Ones before `at` in a plane; 64 bytes of a plane have one entry of the directory."""
        p = self.planes[level]
        if (d := self._ranks[level]) is None:
            c = np.add.reduceat(np.bitwise_count(p), np.arange(0, max(1, len(p)), 64), dtype=np.int64) if len(p) else np.zeros(0, np.int64)
            d = self._ranks[level] = np.r_[0, np.cumsum(c)]
        block, last = at >> 9, at >> 3
        n = int(d[block]) + int(np.bitwise_count(p[block << 6 : last]).sum(dtype=np.int64))
        return n + (int(p[last] & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def access(self, at: int) -> int:
        out = 0
        for level in range(self.bits):
            one = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            r = self._rank(level, at)
            at = self.zeros[level] + r if one else at - r
            out = out << 1 | one
        return out

    def _range(self, token: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for level in range(self.bits):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, at: int | None = None) -> int:
        """Occurrences before `at` (of all)."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if at is None else at)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.n - 1  # the place of the bit of which `want` come before
            while low < high:
                mid = (low + high) // 2
                r = self._rank(level, mid + 1)
                if (r if one else mid + 1 - r) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """The whole sequence: the planes' stable sorts undone from the last to the first."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(cur)
            out[~one] = cur[: self.zeros[level]]
            out[one] = cur[self.zeros[level] :] | cur.dtype.type(1 << (self.bits - 1 - level))
            cur = out
        return cur

    def dumps(self, lengths: np.ndarray) -> bytes:
        head = np.array([self.n, self.bits, len(lengths), *self.zeros], "<u8").tobytes()
        return _MAGIC + zstandard.ZstdCompressor(level=1).compress(head + np.asarray(lengths, "<u4").tobytes() + b"".join(p.tobytes() for p in self.planes))

    @classmethod
    def loads(cls, raw: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        if raw[:8] != _MAGIC:
            raise ValueError("not a shard of token ids")
        body = zstandard.ZstdDecompressor().decompress(raw[8:])
        n, bits, docs = (int(x) for x in np.frombuffer(body, "<u8", 3))
        zeros = [int(x) for x in np.frombuffer(body, "<u8", bits, 24)]
        at = 24 + 8 * bits
        lengths = np.frombuffer(body, "<u4", docs, at)
        at, size = at + 4 * docs, (n + 7) // 8
        return cls(n, zeros, [np.frombuffer(body, np.uint8, size, at + k * size) for k in range(bits)]), lengths


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct piece of a text.

    Pieces are the text between ASCII white space, cut once more where an ASCII letter meets ASCII punctuation, with A-Z
    lowered: the vocabulary's rules lower everything, join no letter with punctuation and compose no two of these
    characters. Only the names of its special tokens may lie across such a cut, and those begin with "<|": where a step
    has these two characters, it is cut at white space alone and left as written.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.size = self._library.get_vocab_size()
        self._last = np.zeros(max(self._library.get_vocab().values()) + 1, bool)  # ids that end a word
        self._last[[i for s, i in self._library.get_vocab().items() if s.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Entry 0 is the end id."""
        self._entry: dict[str, int] = {}
        self._ids, self._starts, self._lens = np.array([END], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Appends the ids of pieces not met before. Pieces of letters alone are asked for many at a time: each is one
        word of the vocabulary's rules, so its last id is the first that ends a word; any other outcome is asked again
        piece by piece."""
        plain = [s for s in new if s.isalpha()]
        other = [s for s in new if not s.isalpha()]
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        order: list[str] = []
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, e in zip(groups, self._library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self._last[got])
            if len(ends) == len(group) and ends[-1] == len(got) - 1:
                order += group
                ids.append(got)
                lens.append(np.diff(ends, prepend=-1))
            else:
                other += group
        each = [e.ids for e in self._library.encode_batch_fast(other, add_special_tokens=False)]
        order += other
        lens.append(np.array([len(x) for x in each], np.int64))
        ids.append(np.array([i for x in each for i in x], np.uint32))
        more = np.concatenate(lens)
        for k, s in enumerate(order, len(self._lens)):
            self._entry[s] = k
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(more) - more])
        self._lens = np.concatenate([self._lens, more])
        self._ids = np.concatenate([self._ids, *ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with their end ids, and where each document starts (and the last ends)."""
        if len(self._entry) > REMEMBERED:
            self._clear()
        n = len(data)
        word = ~_WHITE[data]
        start = np.ones(n, bool)
        start[1:] = ~word[:-1]
        if not (data[1:][data[:-1] == ord("<")] == ord("|")).any():
            start[1:] |= _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
            data = _LOWER[data]
        start[offsets[offsets < n]] = True
        start &= word
        at = np.flatnonzero(start)
        body = data[word]
        if not len(at):
            return np.full(len(offsets) - 1, END, np.uint32), np.arange(len(offsets))
        begins = np.r_[np.cumsum(word, dtype=np.int64)[at] - 1, len(body)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(begins), pa.py_buffer(body)]).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        new = [s for s in names if s not in self._entry]
        if new:
            self._learn(new)
        entry = np.fromiter((self._entry[s] for s in names), np.int64, len(names))
        bounds = np.searchsorted(at, offsets)
        seq = np.insert(entry[pieces.indices.to_numpy()], bounds[1:], 0)
        lens = self._lens[seq]
        ends = np.cumsum(lens)
        flat = self._ids[np.repeat(self._starts[seq] - ends + lens, lens) + np.arange(ends[-1])]
        return flat, np.r_[0, ends[bounds[1:] + np.arange(len(bounds) - 1)]]


_READY: dict[str, LibraryEncoder] = {}


def _ready(path: str) -> LibraryEncoder:
    if path not in _READY:
        _READY[path] = LibraryEncoder(path)
    return _READY[path]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_shards(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored shards: first (a doc_id), shard (its number in the task), ids (doc_ids), n_tokens, payload."""
    path = path or _vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _ready(path)
        bits = max(1, (max(library.size, END + 1) - 1).bit_length())
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        n, made = 0, 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate(rows)
            first = ids[0] if ids[0] is not None else (1 << 63) - 1
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([made], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([WaveletMatrix.build(flat, bits).dumps(lengths)], pa.binary())], ["first", "shard", "ids", "n_tokens", "payload"])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in steps(data, offsets, STEP):
                flat, at = library.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(a, b):
                    ids.append(names[k])
                    rows.append(flat[at[k - a] : at[k - a + 1]])
                    n += len(rows[-1])
                    if n >= shard_tokens:
                        yield shard()
                        ids, rows, n, made = [], [], 0, made + 1
        if rows:
            yield shard()

    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), ident(doc_id).alias("k"))
    ordered = keyed.repartitionByRange("k").sortWithinPartitions("k", F.xxhash64("text")).select("doc_id", "text")
    return stored(ordered.mapInArrow(run, "first bigint, shard int, ids array<bigint>, n_tokens bigint, payload binary"), "tokens")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the stored shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, number, ids, raw = (batch.column(c)[k].as_py() for c in range(4))
                matrix, lengths = WaveletMatrix.loads(raw)
                flat = memoryview(matrix.all().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(flat[4 * int(e - n) : 4 * int(e)]) for n, e in zip(lengths, ends, strict=True)]
                m = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([first] * m, pa.int64()), pa.array([number] * m, pa.int32()), pa.array(ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["first", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    each = shards.select("first", "shard", "ids", "payload").mapInArrow(run, T._parse_datatype_string("first bigint, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"))
    # a row for each shard, of millions of ids: the one place where order is global
    before = shards.select("first", "shard", (F.sum("n_tokens").over(Window.orderBy("first", "shard")) - F.col("n_tokens")).alias("before"))
    return each.join(before, ["first", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_wavelet_token_files(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
