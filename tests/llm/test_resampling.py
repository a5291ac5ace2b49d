"""Importance resampling against brute force over n-grams, with texts cut into slices of all sizes."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from draftmill.llm import resampling
from draftmill.llm._text import Words, buffers, stored
from draftmill.llm.decontaminate import split_words
from pyspark.sql import functions as F


def grams(text, gram):
    w = split_words((text or "").encode())
    return [b" ".join(w[i : i + n]) for n in range(1, gram + 1) for i in range(len(w) - n + 1)]


def bucket(f, buckets=resampling.BUCKETS):
    return zlib.crc32(f) % buckets


def expected(rows, target, gram=2, buckets=resampling.BUCKETS, share=25, least=20):
    have, want = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((have, [t for _, t in rows]), (want, target)):
        for t in texts:
            for f in grams(t, gram):
                counts[bucket(f, buckets)] += 1
    gain = [math.floor(1000 * math.log((float(t) + 1) * (float(have.sum()) + buckets) / ((float(s) + 1) * (float(want.sum()) + buckets)))) for s, t in zip(have, want)]
    out = []
    for i, t in rows:
        own = [gain[bucket(f, buckets)] for f in grams(t, gram)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(split_words((t or "").encode()))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], 1 << 63 if r[0] is None else r[0]))
    for k, r in enumerate(may[: share * len(may) // 100], 1):
        r[4] = k
    return [tuple(r) for r in out]


def texts():
    r = random.Random(5)
    word = lambda: r.choice(["ab", "Cd", "é", "東京", "x1", "long" * 9, "a-b", "\x1c"])
    return [None, "", "!!!", "A b-c", "one", *[" ".join(word() for _ in range(r.randint(1, 80))) for _ in range(60)], "word" * 500, " ".join(str(r.randint(0, 400)) for _ in range(3000)), "a " * 500]


def test_checksums_combine():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 255, 4096, 100_000):
        a, b = r.randbytes(20), r.randbytes(n)
        assert zlib.crc32(a + b) == int(resampling.carry(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b)


def test_suffix_array_and_common_prefixes():
    r = random.Random(2)
    ids = np.array([r.randint(0, 3) for _ in range(300)])
    ends = sorted({0, 300, *r.sample(range(300), 20)})
    room = np.concatenate([np.arange(b - a, 0, -1) for a, b in zip(ends, ends[1:])])
    for depth in (1, 2, 3, 5):
        order = resampling.suffix_array(ids, room, depth)
        prefix = [tuple(ids[p : p + min(depth, room[p])]) for p in order]
        assert sorted(order) == list(range(300)) and prefix == sorted(prefix)
        for k, lcp in enumerate(resampling.common(ids, room, order, depth)):
            a, b = prefix[k], prefix[k - 1] if k else ()
            assert lcp == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


@pytest.mark.parametrize("gram", [1, 2, 3, 4])
@pytest.mark.parametrize("most", [1, 7, 64, 4 << 20])
def test_features_of_slices(gram, most):
    """Every n-gram counts once, wherever a text is cut; a word longer than a slice stays whole."""
    want = [np.bincount([bucket(f) for f in grams(t, gram)], minlength=resampling.BUCKETS) for t in texts()]
    got = [np.zeros(resampling.BUCKETS, int) for _ in want]
    for lo, w, _, found in resampling._features(*buffers(pa.array(texts())), gram, resampling.BUCKETS, most):
        for b in found:
            for k in range(len(w.n_words)):
                own = b[w.bounds[k] : w.bounds[k + 1]]
                got[lo + k] += np.bincount(own[own >= 0], minlength=resampling.BUCKETS)
    assert all((g == x).all() for g, x in zip(got, want))


def test_words_of_one_hash(monkeypatch):
    """Ids are held against the bytes: words whose hashes collide stay apart."""
    monkeypatch.setattr(Words, "hashes", lambda self, seed: np.zeros(len(self.lens), np.uint64))
    data, off = buffers(pa.array(["a b a c b"]))
    ids, first = resampling._word_ids(Words(data, off, False))
    assert ids.tolist() == [0, 1, 0, 2, 1] and first.tolist() == [0, 1, 3]


def test_resampling(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(7, texts()[7]), (7, texts()[7]), (None, texts()[9]), (None, texts()[9]), (None, None)]
    target = ["ab Cd x1 ab", None, "", "東京 é 東京", "only here"]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, score int, rank string, bucket int")
    bench = spark.createDataFrame([(t, 0) for t in target], "text string, weight int")
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    for how in ({}, {"most": 40}, {"share": 100, "least_words": 1}, {"share": 0}, {"gram": 3, "buckets": 97}):
        brute = {k.replace("least_words", "least"): v for k, v in how.items() if k != "most"}
        want = expected(rows, target, **brute)
        got = [tuple(r) for r in resampling.resample(docs, bench, **how).select(*columns).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), how
    assert sum(w[4] is not None for w in expected(rows, target)) > 5
    # nothing to compare with, and nothing to draw
    got = [tuple(r) for r in resampling.resample(docs, bench.limit(0)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(expected(rows, []), key=str)
    assert resampling.resample(docs.limit(0), bench).count() == 0


def test_ranks_of_a_hot_tie(spark):
    """Rows of one doc_id and score are a third of all; the ranks have no gap and no repeat."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 != 2, F.col("id")).alias("doc_id"), (F.col("id") % 3 * 10).alias("score"), F.lit(50).alias("n_words"))
    drawn = resampling.draw(stored(rows, "ties"), F.col("n_words") >= 20, 50).collect()
    ranked = sorted((r for r in drawn if r["rank"]), key=lambda r: r["rank"])
    assert len(drawn) == 900 and [r["rank"] for r in ranked] == list(range(1, 451))
    key = lambda r: (-r["score"], 1 << 63 if r["doc_id"] is None else r["doc_id"])
    assert [key(r) for r in ranked] == sorted(map(key, drawn))[:450]
