"""Benchmark decontamination (operator 9) by a distributed positional inverted index.

The corpus is indexed once, whole, in segments of some megabytes: for every term of a segment, the ascending places of it
(a place counts words over all the segment's documents, with a gap after each document that no phrase crosses). The index
is a stored table with a row for each segment and term, and one for each segment's documents. The benchmark's windows
stay a table too: each is joined to the segments that have its rarest term in the corpus, and only for those pairs are
the lists of its other terms fetched. (Where the pairs' terms are too many to be broadcast, the lists of all windows'
terms are fetched instead, so that the index itself is not shuffled.) A segment's task then takes a window's lists from
the shortest on, shifts each by the term's offset and intersects them. Proximity search intersects lists within a
distance instead.

Terms are grouped by 64 bits of hash within a segment, and stored and looked up by their bytes.

Defined results: null texts have no words; an item of fewer than `size` words, but not none, is one window; items of
null item_id hit words and count as an item, but are not in the list of ids; rows of one item_id are one item, and equal
rows of documents get equal results; an empty benchmark leaves everything clean, and an empty table of documents gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.llm._text import Words, buffers, steps, stored, tidied

#: Words of a window; bytes of text of a segment (a longer document is one of its own).
WINDOW, SEGMENT = 10, 8 << 20
#: Places between two documents of a segment.
GAP = 1 << 12
#: A table of the benchmark's is broadcast up to this many bytes, by its own sum, and joined by shuffling beyond.
SMALL = 16 << 20

#: A-Z to a-z; what ends a word to a blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def split_words(raw: bytes) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lowered."""
    return raw.translate(_FOLD.tobytes()).split()


_INDEX = "seg bigint, term binary, n int, places binary, doc_ids array<bigint>, ths array<bigint>, starts array<bigint>, n_words array<int>"


def _binaries(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Slices of data as binary cells."""
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens) + np.repeat(starts, lens)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            data = _FOLD[data]
            for first, last in steps(data, offsets, most):
                hashes, places, begins, lens, starts, n_words, at = [], [], [], [], [], [], 0
                part, off = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                for lo, hi in steps(part, off):
                    w = Words(part[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], False)
                    # documents lie GAP places apart
                    doc = np.arange(hi - lo)
                    starts.append(at + w.bounds[:-1] + doc * GAP)
                    places.append((np.arange(len(w.starts)) + at + np.repeat(doc * GAP, w.n_words)).astype("<i4"))
                    hashes.append(w.hashes(1))
                    begins.append((w.starts + off[lo]).astype(np.int32))
                    lens.append(w.lens.astype(np.int32))
                    n_words.append(w.n_words)
                    at += len(w.starts) + (hi - lo) * GAP
                h, p, b, n = (np.concatenate(x) for x in (hashes, places, begins, lens))
                order = np.argsort(h, kind="stable")
                s = h[order]
                new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
                counts = np.diff(np.r_[new, len(s)])
                m, k = len(new), last - first
                one = lambda x, kind: pa.array([*[None] * m, x], pa.list_(kind))
                # the lists lie one after the other, as they are
                lists = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((4 * np.r_[new, len(s)]).astype(np.int32)), pa.py_buffer(p[order])])
                heads = order[new]
                names = pa.concat_arrays([_binaries(part, b[heads], n[heads]), pa.nulls(1, pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m + 1, seg)), names, pa.array([*counts.tolist(), None], pa.int32()), pa.concat_arrays([lists, pa.nulls(1, pa.binary())]), one(batch.column(0).slice(first, k).to_pylist(), pa.int64()), one(batch.column(1).slice(first, k).to_pylist(), pa.int64()), one(np.concatenate(starts).tolist(), pa.int64()), one(np.concatenate(n_words).tolist(), pa.int32())],
                    ["seg", "term", "n", "places", "doc_ids", "ths", "starts", "n_words"],
                )
                seg += 1

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The stored index of all terms of all documents."""
    return stored(docs.select(F.col(doc_id).cast("bigint"), F.xxhash64(F.col(text).cast("string")), F.col(text).cast("string")).mapInArrow(tidied(_segments(segment)), _INDEX), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """(seg, d, doc_id, th, n_words): the documents of the index; d is the place in the segment."""
    one = index.filter("term IS NULL").select("seg", F.posexplode(F.arrays_zip("doc_ids", "ths", "n_words")).alias("d", "x"))
    return one.select("seg", "d", F.col("x.doc_ids").alias("doc_id"), F.col("x.ths").alias("th"), F.col("x.n_words").cast("bigint").alias("n_words"))


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = split_words((text or "").encode())
                rows = [words[i : i + size] for i in range(max(1, len(words) - size + 1) if words else 0)]
                for k in range(0, len(rows), 10_000):
                    some = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(some), pa.string()), pa.array(some, pa.list_(pa.binary()))], ["item", "words"])

    return run


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The stored (item, words, wa, wb) of the distinct windows of each item; wa, wb: 128 bits of hash of the words."""
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).mapInArrow(tidied(_windows(size)), "item string, words array<binary>")
    return stored(rows.withColumn("wa", F.xxhash64("words")).withColumn("wb", F.xxhash64("words", F.lit(1))).dropDuplicates(["item", "wa", "wb"]), "windows")


def is_small(df: DataFrame, size: Column) -> bool:
    """Whether the sum of the rows' sizes and 32 bytes each of a stored table is small."""
    return (df.agg(F.sum(size + 32)).first()[0] or 0) <= SMALL


def if_small(df: DataFrame, size: Column) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df, size) else df


class _Segment:
    """The lists of a segment's terms that were fetched."""

    def __init__(self):
        self.lists: dict[bytes, np.ndarray] = {}
        self.starts = np.zeros(0, np.int64)

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Places where the words stand in a row."""
        none = np.zeros(0, np.int64)
        lists = sorted(((self.lists.get(t, none), k) for k, t in enumerate(words)), key=lambda x: len(x[0]))
        at = lists[0][0] - lists[0][1]
        for p, offset in lists[1:]:
            if not len(at):
                break
            want = at + offset
            k = np.searchsorted(p, want)
            k[k == len(p)] = 0
            at = at[p[k] == want]
        return at

    def near(self, words: list[bytes], distance: int) -> np.ndarray:
        """Places of the rarest word that have all the others within the distance, on either side."""
        none = np.zeros(0, np.int64)
        lists = sorted((self.lists.get(t, none) for t in sorted(set(words))), key=len)
        at = lists[0]
        for p in lists[1:]:
            k = np.searchsorted(p, at - distance)
            at = at[(k < len(p)) & (p[np.minimum(k, len(p) - 1)] <= at + distance)] if len(p) else none
        return at


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Disjoint ascending spans that cover the same."""
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(s[:, 1])
    first = np.flatnonzero(np.r_[True, s[1:, 0] > top[:-1]])
    return np.stack([s[first, 0], np.maximum.reduceat(s[:, 1], first)], 1)


_ASKED = "seg bigint, kind int, term binary, places binary, starts array<bigint>, words array<binary>, wa bigint, wb bigint"


def _asked(index: DataFrame, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """By segment: its documents' places and the lists asked for by terms (seg, term; or term for all segments), then the
    windows of pairs (seg, words, wa, wb)."""
    cast = lambda df: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in (x.split(" ", 1) for x in _ASKED.split(", "))])
    heads = index.filter("term IS NULL").select("seg", "starts").join(pairs.select("seg").distinct(), "seg", "left_semi").withColumn("kind", F.lit(0))
    lists = index.filter("term IS NOT NULL").select("seg", "term", "places").join(terms, terms.columns, "left_semi").withColumn("kind", F.lit(1))
    return cast(heads).unionByName(cast(lists)).unionByName(cast(pairs.withColumn("kind", F.lit(2)))).repartition("seg").sortWithinPartitions("seg", "kind")


def _read(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """done(seg, segment, windows) of each segment, where windows are (words, wa, wb) and come one at a time."""
    now, held, found = None, _Segment(), []
    for batch in batches:
        for r in batch.to_pylist():
            if r["seg"] != now:
                if found:
                    yield done(now, held, found)
                now, held, found = r["seg"], _Segment(), []
            if r["kind"] == 0:
                held.starts = np.asarray(r["starts"], np.int64)
            elif r["kind"] == 1:
                held.lists[r["term"]] = np.frombuffer(r["places"], "<i4").astype(np.int64)
            elif len(at := held.phrase(r["words"])):
                found.append((at, len(r["words"]), r["wa"], r["wb"]))
    if found:
        yield done(now, held, found)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document with hits: spans of words, disjoint and ascending, and the windows they come from."""

    def done(seg: int, held: _Segment, found: list) -> pa.RecordBatch:
        of: dict[int, tuple[list[np.ndarray], list[tuple[int, int]]]] = {}
        for at, size, wa, wb in found:
            doc = np.searchsorted(held.starts, at, "right") - 1
            edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for f, t in zip(edges, [*edges[1:], len(doc)], strict=True):
                spans, who = of.setdefault(int(doc[f]), ([], []))
                first = at[f:t] - held.starts[doc[f]]
                spans.append(np.stack([first, first + size], 1))
                who.append((wa, wb))
        merged = [merge_spans(np.concatenate(spans)) for spans, _ in of.values()]
        return pa.RecordBatch.from_arrays([pa.array([seg] * len(of), pa.int64()), pa.array(list(of), pa.int32()), pa.array([int((m[:, 1] - m[:, 0]).sum()) for m in merged], pa.int64()), pa.array([m.ravel().tolist() for m in merged], pa.list_(pa.int32())), pa.array([[x for x, _ in who] for _, who in of.values()], pa.list_(pa.int64())), pa.array([[x for _, x in who] for _, who in of.values()], pa.list_(pa.int64()))], ["seg", "d", "n_hit", "spans", "was", "wbs"])

    return _read(batches, done)


def find_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(seg, d, n_hit, spans, was, wbs) of the documents in which any of the windows occurs."""
    distinct = stored(windows.dropDuplicates(["wa", "wb"]).select("words", "wa", "wb"), "distinct")
    length = F.aggregate("words", F.lit(0), lambda n, w: n + F.octet_length(w))
    terms = distinct.select("wa", "wb", F.explode(F.array_distinct("words")).alias("term"))
    # the rarest term of each window in the whole corpus; a window with a term that the corpus lacks occurs nowhere
    often = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    vocabulary = if_small(stored(terms.select("term").distinct(), "terms"), F.octet_length("term"))
    often = stored(often.join(vocabulary, "term", "left_semi"), "often")
    rank = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("m")
    rare = terms.join(if_small(often, F.octet_length("term")), "term", "left").groupBy("wa", "wb").agg(rank).filter("m.n > 0").select("wa", "wb", F.col("m.term").alias("term"))
    rare = stored(distinct.join(rare, ["wa", "wb"]), "rare")
    pairs = index.filter("term IS NOT NULL").select("seg", "term").join(if_small(rare, length), "term").select("seg", "words", "wa", "wb")
    pairs = stored(pairs, "pairs")
    asked = stored(pairs.select("seg", F.explode("words").alias("term")).distinct(), "asked")
    if is_small(asked, F.octet_length("term")):
        asked = F.broadcast(asked)
    else:
        # what is asked grows with the corpus, its terms don't: all segments' lists of these go to the segment's task, and
        # the whole index is joined by shuffling only if the benchmark has too many terms for that
        named = stored(rare.select(F.explode("words").alias("term")).distinct(), "named")
        asked = F.broadcast(named) if is_small(named, F.octet_length("term")) else asked
    return _asked(index, pairs, asked).mapInArrow(tidied(_hits), "seg bigint, d int, n_hit bigint, spans array<int>, was array<bigint>, wbs array<bigint>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", segment: int = SEGMENT) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated, spans (first and after the
    last word of each run of hit words) of every document."""
    index = build_index(docs, doc_id, text, segment)
    windows = benchmark_windows(benchmark, size, item_id, text)
    hits = stored(find_windows(index, windows), "hits")
    owners = if_small(windows.select("wa", "wb", "item"), F.coalesce(F.octet_length("item"), F.lit(0)))
    each = hits.select("seg", "d", F.explode(F.arrays_zip("was", "wbs")).alias("w")).select("seg", "d", F.col("w.was").alias("wa"), F.col("w.wbs").alias("wb"))
    items = each.join(owners, ["wa", "wb"]).groupBy("seg", "d").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    found = hits.select("seg", "d", "n_hit", "spans").join(items, ["seg", "d"])
    out = documents_of(index).join(found, ["seg", "d"], "left")
    n_items = (F.size("items") + F.col("unnamed")).cast("bigint")
    ids = F.concat_ws(",", F.array_sort(F.coalesce("items", F.array().cast("array<string>"))))
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(n_items, F.lit(0)).alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))


def phrase_search(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, at): every place where the phrase starts."""
    terms = [w.encode() for w in words]
    return _searched(index, terms, lambda seg: seg.phrase(terms))


def proximity_search(index: DataFrame, words: list[str], distance: int) -> DataFrame:
    """(doc_id, at): every place of a segment's rarest word that has each other word within `distance` words of it."""
    if not 0 <= distance < GAP:
        raise ValueError(f"the distance must be from 0 to {GAP - 1}")
    terms = [w.encode() for w in words]
    return _searched(index, terms, lambda seg: seg.near(terms, distance))


def _searched(index: DataFrame, terms: list[bytes], find) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids = None, _Segment(), []

        def done() -> pa.RecordBatch:
            at = find(held)
            doc = np.searchsorted(held.starts, at, "right") - 1
            return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array((at - held.starts[doc]).astype(np.int32))], ["doc_id", "at"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["seg"] != now:
                    if now is not None:
                        yield done()
                    now, held, ids = r["seg"], _Segment(), []
                if r["term"] is None:
                    held.starts, ids = np.asarray(r["starts"], np.int64), r["doc_ids"]
                else:
                    held.lists[r["term"]] = np.frombuffer(r["places"], "<i4").astype(np.int64)
        if now is not None:
            yield done()

    wanted = F.col("term").isin(*[F.lit(t) for t in dict.fromkeys(terms)])
    rows = index.filter(F.col("term").isNull() | wanted).select("seg", "term", "places", "starts", "doc_ids")
    return rows.repartition("seg").sortWithinPartitions("seg").mapInArrow(tidied(run), "doc_id bigint, at int")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents and benchmark tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return decontaminate(read("documents").select("doc_id", "text"), read("benchmark")).drop("th", "spans")


#: DuckDB SQL of the same result.
OP9_SQL = r"""
WITH split AS (SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark),
words AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
win AS (SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(w[p:p+9], ' ') AS k FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM words WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT id, n, p, array_to_string(w[p:p+n-1], ' ') AS k FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE kind = 'd' AND len(w) >= n)),
hit AS (SELECT id, item, p, n FROM place JOIN win USING (n, k)),
covered AS (SELECT id, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT id, p, n FROM hit) h, range(0, 10) t(o) WHERE o < n GROUP BY id),
named AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY id)
SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (id) LEFT JOIN named USING (id) WHERE kind = 'd'
"""
