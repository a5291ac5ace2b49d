"""Target-distribution importance resampling (operator 11): documents are drawn by how much more likely their hashed
n-grams are in a target text, with features enumerated by word-id suffix arrays.

The words of some megabytes of a partition become ids, whose suffix array is sorted by as many words as an n-gram can have
(by prefix doubling). In it, runs of suffixes with common prefixes of n words (by the LCP of neighbours) are the
occurrences of one n-gram: it is hashed once a run, by combining the words' checksums, and its bucket goes back to all
occurrences. A first pass adds the buckets up over all documents and all of the target, a second one scores each document
by the buckets' gains; between them only the counts of the buckets go through the driver. Scores are whole numbers of a
bounded range, whose counts give the least one drawn; drawn rows are numbered along ranges of their order.

Texts longer than SLICE are taken in slices that overlap by the words that n-grams may need, so memory follows the slice
(and the Arrow row).

Defined results: null texts have no words; documents without features have the weight 0; the hash of a null doc_id is that
of `7:`, and it sorts after the others; rows of equal score and doc_id are drawn one by one, in any order; repeated rows
each count. An empty target or an empty table of documents is fine; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm._text import Words, buffers, steps, stored, tidied
from draftmill.llm.decontaminate import _FOLD

#: The contract's: words of an n-gram at most, buckets, words of a document that may be drawn, drawn percent, seed.
GRAM, BUCKETS, LEAST_WORDS, SHARE, SEED = 2, 10_000, 20, 25, 7
#: Bytes of text of a suffix array.
SLICE = 4 << 20

# crc32 of a followed by b is that of a, carried over len(b) zero bytes, xor that of b. _CARRY[k] carries over 2^k bytes, by
# a table for each byte of the checksum.


def _carries(n: int) -> np.ndarray:
    base = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of the low byte over one zero byte
    one = np.zeros((4, 256), np.uint32)
    one[0] = base
    for t in range(1, 4):
        one[t] = np.arange(256, dtype=np.uint32) << (8 * t - 8)
    out = [one]
    while len(out) < n:
        t = out[-1]
        one_byte = np.arange(256, dtype=np.uint32)[None] << np.array([0, 8, 16, 24], np.uint32)[:, None]
        out.append(_carried(_carried(one_byte, t), t))
    return np.array(out)


def _carried(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


_CARRY = _carries(32)


def carry(c: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The checksums c carried over so many zero bytes each."""
    c = c.copy()
    for k in range(int(lens.max(initial=0)).bit_length()):
        at = np.flatnonzero((lens >> k) & 1)
        c[at] = _carried(c[at], _CARRY[k])
    return c


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places by the first `depth` words from them on (or as many as there are in the document); room: words from a place
    to the end of its document."""
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth and len(ids):
        step = min(known, depth - known)
        after = np.zeros(len(ids), np.int64)
        has = np.flatnonzero(room > step)
        after[has] = rank[has + step] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        known += step
    return order


def common(ids: np.ndarray, room: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """LCP: of each place in the suffix array, the words in common with the place before it, up to `depth`."""
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for j in range(depth):
        a, b = order[1:], order[:-1]
        both = (room[a] > j) & (room[b] > j) & same
        at = np.flatnonzero(both)
        both[at] = ids[a[at] + j] == ids[b[at] + j]
        same = both
        lcp[1:] += same
    return lcp


def _word_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """An id for each word, and the place of a word of each id. Ids go by 64 bits of hash, which are held against the bytes."""
    _, first, ids = np.unique(w.hashes(5), return_index=True, return_inverse=True)
    rep = first[ids]
    if (w.lens == w.lens[rep]).all():
        shift = np.repeat(w.starts[rep] - w.starts, w.lens)
        at = np.repeat(w.starts - (np.cumsum(w.lens) - w.lens), w.lens) + np.arange(int(w.lens.sum()))
        if (w.data[at] == w.data[at + shift]).all():
            return ids, first
    raw, known, first = w.data.tobytes(), {}, []  # two words with one hash
    ids = np.empty(len(w.lens), np.int64)
    for k, (a, n) in enumerate(zip(w.starts.tolist(), w.lens.tolist(), strict=True)):
        ids[k] = known.setdefault(raw[a : a + n], len(known))
        if len(first) < len(known):
            first.append(k)
    return ids, np.array(first)


def occurrences(w: Words, room: np.ndarray, gram: int, buckets: int) -> list[np.ndarray]:
    """For each n up to gram, the bucket of the n-gram from each word on, -1 where the document has fewer words."""
    ids, first = _word_ids(w)
    raw = w.data.tobytes()
    crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], np.uint32)
    lens = w.lens[first]
    blank = carry(np.full(len(crc), zlib.crc32(b" "), np.uint32), lens) ^ crc  # of a blank and the word
    order = suffix_array(ids, room, gram)
    lcp = common(ids, room, order, gram)
    out = []
    for n in range(1, gram + 1):
        has = room[order] >= n
        start = has & (lcp < n)
        heads = order[start]
        c = crc[ids[heads]]
        for j in range(1, n):
            then = ids[heads + j]
            c = carry(c, lens[then] + 1) ^ blank[then]
        bucket = np.full(len(order), -1, np.int64)
        bucket[order[has]] = (c % np.uint32(buckets)).astype(np.int64)[np.cumsum(start[has]) - 1]
        out.append(bucket)
    return out


def _slices(data: np.ndarray, offsets: np.ndarray, gram: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first document, documents, bytes, offsets, words that are only context). A document of more than `most` bytes comes
    in slices that begin with the gram - 1 words before them."""
    for lo, hi in steps(data, offsets, most):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(part) <= most or hi - lo > 1:
            yield lo, hi - lo, part, off, 0
            continue
        begin, context, size, end = 0, 0, most, 0
        while end < len(part):
            end = begin + size
            while end < len(part):  # up to a blank that ends a word in the slice
                gap = np.flatnonzero(part[end : end + most] == 32)
                if len(gap):
                    end += int(gap[0])
                    break
                end += most
            end = min(end, len(part))
            piece = part[begin:end]
            yield lo, 1, piece, np.array([0, len(piece)]), context
            word = piece != 32
            starts = np.flatnonzero(word & np.r_[True, ~word[:-1]])
            keep = starts[max(0, len(starts) - gram + 1) :]
            context = len(keep)
            begin = begin + int(keep[0]) if context else end
            size = max(most, end - begin + most)  # the words kept may be longer than a slice


def _features(data: np.ndarray, offsets: np.ndarray, gram: int, buckets: int, most: int) -> Iterator[tuple[int, Words, int, list[np.ndarray]]]:
    """(first document, words, words that are only context, buckets for each n) of each slice. An n-gram counts where its
    last word is new."""
    for lo, _, part, off, context in _slices(_FOLD[data], offsets, gram, most):
        w = Words(part, off, False)
        if not len(w.starts):
            yield lo, w, 0, [np.zeros(0, np.int64)] * gram
            continue
        room = np.repeat(w.bounds[1:], w.n_words) - np.arange(len(w.starts))
        found = occurrences(w, room, gram, buckets)
        for n, bucket in enumerate(found, 1):
            bucket[: max(0, context - n + 1)] = -1
        yield lo, w, context, found


def _counting(gram: int, buckets: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _features(*buffers(batch.column(0)), gram, buckets, most):
                for bucket in found:
                    total += np.bincount(bucket[bucket >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", gram: int = GRAM, buckets: int = BUCKETS, most: int = SLICE) -> np.ndarray:
    """The number of features in each bucket over all texts."""
    found = texts.select(F.col(text).cast("string")).mapInArrow(tidied(_counting(gram, buckets, most)), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    n_have, n_want, k = float(have.sum()), float(want.sum()), float(len(have))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (n_have + k) / ((float(s) + 1) * (n_want + k)))) for s, t in zip(have, want, strict=True)], np.int64)


def _scoring(gains: np.ndarray, gram: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = np.zeros((3, len(batch)), np.int64)
            for lo, w, context, found in _features(*buffers(batch.column(1)), gram, buckets, most):
                if not len(w.starts):
                    continue
                gain, count = np.zeros((2, len(w.starts) + 1), np.int64)
                for bucket in found:
                    has = bucket >= 0
                    count[1:] += has
                    gain[1:] += np.where(has, gains[bucket], 0)
                gain, count = gain.cumsum(), count.cumsum()
                docs = slice(lo, lo + len(w.n_words))
                n_words[docs] += w.n_words
                n_words[lo] -= context
                n_features[docs] += count[w.bounds[1:]] - count[w.bounds[:-1]]
                total[docs] += gain[w.bounds[1:]] - gain[w.bounds[:-1]]
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, buckets: int = BUCKETS, most: int = SLICE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; target: a table with a column of the same
    name as the text. share percent of the documents of at least least_words words are drawn."""
    gains = bucket_gains(bucket_counts(docs, text, gram, buckets, most), bucket_counts(target, text, gram, buckets, most))
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(tidied(_scoring(gains, gram, most)), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(rows.withColumn("score", F.col("weight") + noise), "scored")
    return draw(scored, F.col("n_words") >= least_words, share)


def draw(scored: DataFrame, may, share: int) -> DataFrame:
    """scored (a stored table) with the rank, by score from the largest and then doc_id, of the drawn: share percent, rounded
    down, of the rows that may be drawn. Scores are logarithms, so their distinct values are few (some 10^5)."""
    spark = scored.sparkSession
    counts = sorted(scored.filter(may).groupBy("score").count().collect(), key=lambda r: -r["score"])
    wanted, least, so_far = share * sum(r["count"] for r in counts) // 100, None, 0
    for r in counts:
        if so_far >= wanted:
            break
        least, so_far = r["score"], so_far + r["count"]
    no_rank = F.lit(None).cast("bigint").alias("rank")
    if least is None:
        return scored.select("*", no_rank)
    chosen = may & (F.col("score") >= least)
    # rows of one score and doc_id are told apart by their place in the stored table, so that no range gets them all
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = scored.filter(chosen).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.drop("place").withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("at", 33)
    before, starts = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["count"]
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    table = F.broadcast(spark.createDataFrame(starts, "part bigint, before bigint"))  # a row for each range
    ranked = placed.withColumn("part", part).join(table, "part").select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~F.coalesce(chosen, F.lit(False))).select("*", no_rank))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents and benchmark tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return resample(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = rf"""
WITH crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
split AS (SELECT 'd' AS kind, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
words AS (SELECT kind, row_no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
features AS MATERIALIZED (
  SELECT kind, row_no, f FROM (SELECT kind, row_no, unnest(w) AS f FROM words) UNION ALL
  SELECT kind, row_no, w[p] || ' ' || w[p + 1] FROM (SELECT kind, row_no, w, unnest(range(1, len(w))) AS p FROM words)
),
bytes AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc_table
),
counts AS (SELECT bucket, sum((kind = 'd')::BIGINT) AS s, sum((kind = 'b')::BIGINT) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s + {BUCKETS}) / ((s::DOUBLE + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT row_no, count(*) AS n, sum(gain)::BIGINT AS g FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row_no),
weights AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN sums USING (row_no) WHERE kind = 'd'
),
scored AS (SELECT doc_id, n_features, weight, n_words, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_words >= {LEAST_WORDS} AS may FROM weights),
ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, sum(may::BIGINT) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {SHARE} * n // 100 THEN place END AS rank, n_words::BIGINT AS n_words FROM ranked
"""
