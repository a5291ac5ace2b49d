"""Product codes against plain loops, and the cells' bounds against all distances."""

import hashlib
import random

import numpy as np
import pytest
from draftmill.llm import vector_codes
from pyspark.sql import functions as F


def expected(rows, rounds=4):
    """rows: (vec_id, embedding, label)."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), k) for i, v, k in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (1 << 63 if r[0] is None else r[0], r[1]))[:256]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(part(v, p), book)[1], []).append(part(v, p))
            for k, vs in own.items():
                book[k] = [sum(c) // len(vs) for c in zip(*vs)]
    out = []
    for i, v, k in kept:
        at = [nearest(part(v, p), book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{c:02x}" for _, c in at), sum(d for d, _ in at), k))
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return out, sha


def check(spark, rows, rounds=4):
    df = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    codes, books = vector_codes.product_codes(df, rounds)
    want, sha = expected(rows, rounds)
    got = [(r["vec_id"], r["code"], r["error"], None if r["label"] is None else int(r["label"])) for r in codes.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert hashlib.sha256(vector_codes.codebooks_text(books).encode()).hexdigest() == sha
    return want


def test_codes_against_loops(spark):
    r = random.Random(1)
    vector = lambda n=8: [float(np.float32(r.uniform(-1, 1))) for _ in range(n)]
    rows = [(k, vector(), k % 3 if k % 5 else None) for k in range(300)]
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 1), (903, [float("inf"), *[0.0] * 7], 1), (None, vector(), 2), (None, vector(), None), (5, rows[5][1], 0), (5, vector(), 0), (904, rows[7][1], 2)]
    assert len(check(spark, rows, 2)) == 305


def test_few_ragged_and_hot_vectors(spark):
    few = [(3, [1.0, 2.0, 3.0], 0), (1, [], 1), (2, [0.5, -0.25, 0.125, 4.0, 1.0, 9.0], 1), (4, [2e6, -2e6, 0.0, 1e5], 1)]
    assert len(check(spark, few)) == 4
    check(spark, [(k, [], None) for k in range(5)])
    check(spark, [(k, [0.5] * 8 if k % 3 else [float(k % 7)] * 8, k % 2) for k in range(400)], 1)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.product_codes(df)
    assert codes.count() == 0 and vector_codes.codebooks_text(books) == ""


@pytest.mark.parametrize(("most", "width"), [(300, 16), (1 << 20, 16), (1 << 31, 3), (2, 5), (5, 0)])
def test_bounds_lose_no_entry(most, width):
    r = np.random.default_rng(1)
    entries, queries = r.integers(-most, most + 1, (256, width)), r.integers(-most, most + 1, (300, width))
    entries[7] = entries[3]
    code, d, refined = vector_codes.VaFile(entries).nearest(queries)
    full = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2) if width else np.zeros((300, 256), int)
    assert (code == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert width < 16 or refined < 20 * len(queries)  # of 256


def test_label_errors(spark, tmp_path):
    rows = [(k, [float(k % 5), 0.0, 1.0, 2.0], k % 2 if k % 3 else None) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op12_va_file_codes(spark, str(tmp_path)).collect()
    of = {i: k for i, _, k in rows}
    total = {}
    for x in got:
        total[of[x["vec_id"]]] = total.get(of[x["vec_id"]], 0) + x["error"]
    assert len(got) == 40 and all(x["label_error"] == total[of[x["vec_id"]]] for x in got)
    assert spark.createDataFrame(got).agg(F.countDistinct("codebooks_sha256")).first()[0] == 1
