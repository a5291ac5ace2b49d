"""Language identification (operator 1): a bidirectional gated recurrent network over bytes.

One GRU reads the bytes forward and one backward; at every position a softmax over both states labels the language, and
a document's probabilities are the mean over all its positions. Texts are read whole, in segments of SEGMENT bytes, as
many side by side as fit; each segment starts from a zero state on both sides. The network is trained in numpy by
backpropagation through time with Adam, on the driver, from at most PER_LANGUAGE training documents of each language
(those of the least hash of their id) and SEGMENTS segments of each.

Defined results: a null text, or one without any letter, is `und` with score 0; so is every text if no document may be
learned from; rows with null lang aren't learned from; ties go to the language that sorts first; equal texts get equal
results whatever their other columns; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmill.llm._text import buffers, tidy, tidied

#: Bounds of the training sample; bytes of a segment; units of a direction.
PER_LANGUAGE, SEGMENTS, SEGMENT, UNITS = 300, 700, 64, 8
EPOCHS, BATCH, RATE = 10, 128, 0.02
#: Bytes that are read side by side.
SIDE = 4096 * SEGMENT


class ByteGRU:
    """Both directions and the softmax. Weights of a direction: table (3H x 256: input and bias of the gates, for each
    byte), u (3H x H). Gates z, r and candidate n; h = n + z * (h - n), n = tanh(table_n + r * (u_n h))."""

    def __init__(self, classes: int, units: int = UNITS, seed: int = 7):
        r, h = np.random.default_rng(seed), units
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.units = h
        self.p = {}
        for d in "fb":
            self.p[d + "t"] = f(3 * h, 256, k=0.3)
            self.p[d + "u"] = f(3 * h, h, k=h**-0.5)
        self.p["w"], self.p["c"] = f(classes, 2 * h, k=0.3), np.zeros((classes, 1), np.float32)

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> Iterator[np.ndarray]:
        """States (H x n) after each step over x (steps x n bytes)."""
        h, table, u = self.units, self.p[d + "t"], self.p[d + "u"]
        half = np.float32(0.5)
        s = np.zeros((h, x.shape[1]), np.float32)
        for bytes_ in x:
            a = np.take(table, bytes_, axis=1)
            b = u @ s
            g = a[: 2 * h] + b[: 2 * h]
            g *= half
            np.tanh(g, out=g)
            g *= half
            g += half  # the logistic function
            z, r = g[:h], g[h:]
            n = a[2 * h :]
            n += r * b[2 * h :]
            np.tanh(n, out=n)
            new = s - n
            new *= z
            new += n
            if keep is not None:
                keep.append((bytes_, s, z, r, n, b[2 * h :]))
            s = new
            yield s

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps x classes x n) at every position of x (steps x n)."""
        back = list(self._states(x[::-1], "b"))[::-1]
        h = self.units
        wf, wb, c = self.p["w"][:, :h], self.p["w"][:, h:], self.p["c"]
        out = np.empty((len(x), len(c), x.shape[1]), np.float32)
        for k, s in enumerate(self._states(x, "f")):
            y = wf @ s
            y += wb @ back[k]
            y += c
            np.exp(y, out=y)
            y /= y.sum(0)
            out[k] = y
        return out

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> list[float]:
        """x, mask: segments x steps; y: class of each segment. Returns the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m1, m2, step, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        n_batches = max(1, len(x) // BATCH)
        for epoch in range(epochs):
            total = 0.0
            for part in np.array_split(r.permutation(len(x)), n_batches):
                loss, grad = self.gradient(x[part].T, y[part], mask[part].T)
                total += loss
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (epochs * n_batches + 1)))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(total / n_batches)
        return losses

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions of mask, and its gradient by backpropagation through time."""
        h, (steps, n) = self.units, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        sf = list(self._states(x, "f", kept["f"]))
        sb = list(self._states(x[::-1], "b", kept["b"]))[::-1]
        w, c = self.p["w"], self.p["c"]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_f, d_b, loss, count = [None] * steps, [None] * steps, 0.0, max(1.0, float(mask.sum()))
        for k in range(steps):
            s = np.concatenate([sf[k], sb[k]])
            o = w @ s + c
            o -= o.max(0)
            e = np.exp(o)
            e /= e.sum(0)
            loss -= float((np.log(e[y, np.arange(n)] + 1e-12) * mask[k]).sum())
            e[y, np.arange(n)] -= 1
            e *= mask[k] / count
            grad["w"] += e @ s.T
            grad["c"] += e.sum(1, keepdims=True)
            d = w.T @ e
            d_f[k], d_b[steps - 1 - k] = d[:h], d[h:]
        for name, d_out in (("f", d_f), ("b", d_b)):
            u, back = self.p[name + "u"], np.zeros((h, n), np.float32)
            for k in range(steps - 1, -1, -1):
                bytes_, s, z, r, m, bn = kept[name][k]
                dh = d_out[k] + back
                dn = dh * (1 - z) * (1 - m * m)
                dz = dh * (s - m) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                gates = np.concatenate([dz, dr, dn * r])
                grad[name + "u"] += gates @ s.T
                one = np.zeros((n, 256), np.float32)
                one[np.arange(n), bytes_] = 1
                grad[name + "t"] += np.concatenate([dz, dr, dn]) @ one
                back = dh * z + u.T @ gates
        return loss / count, grad


def held_out(doc_id: str = "doc_id", remainder: int = 0) -> Column:
    """crc32 of doc_id as text, mod 5, is `remainder`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, segments: int = SEGMENTS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], ByteGRU | None]:
    """Trains on a bounded sample: of each language the `per_language` documents whose ids have the least hash, and of
    their whole texts `segments` segments taken evenly."""
    ranked = labelled.filter(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id).cast("string"), F.lit(11)).alias("h"))
    chosen = ranked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("k") <= per_language).select("lang", "id")
    rows = labelled.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), ["lang", "id"], "left_semi").collect()
    names = sorted({r["lang"] for r in rows})
    if not names:
        return names, None
    xs, ys, ms = [], [], []
    rng = np.random.default_rng(5)
    for k, name in enumerate(names):
        raw = [np.frombuffer(t, np.uint8) for t in sorted(r["text"].encode() for r in rows if r["lang"] == name)]
        places = [(i, at) for i, b in enumerate(raw) for at in range(0, len(b), SEGMENT)]
        for j in rng.permutation(len(places))[:segments]:
            i, at = places[j]
            b = raw[i][at : at + SEGMENT]
            xs.append(np.pad(b, (0, SEGMENT - len(b)), constant_values=32))
            ms.append(np.arange(SEGMENT) < len(b))
            ys.append(k)
    net = ByteGRU(len(names))
    net.train(np.stack(xs), np.array(ys), np.stack(ms).astype(np.float32))
    return names, net


def pooled(net: ByteGRU, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities (documents x classes) over all positions of each whole text."""
    tidy()
    n_bytes = np.diff(offsets)
    counts = (n_bytes + SEGMENT - 1) // SEGMENT
    doc = np.repeat(np.arange(len(counts)), counts)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][doc] - start)
    sums = np.zeros((len(counts), len(net.p["c"])))
    full = np.flatnonzero(size == SEGMENT)
    short = np.flatnonzero(size < SEGMENT)
    short = short[np.argsort(size[short], kind="stable")]
    at = np.arange(SEGMENT)
    for group in (full, short):
        for k in range(0, len(group), SIDE // SEGMENT):
            g = group[k : k + SIDE // SEGMENT]
            # a short segment has blanks after it, which the backward direction reads first
            x = np.where(at < size[g][:, None], data[np.minimum(start[g][:, None] + at, len(data) - 1)], 32)[:, : SEGMENT].T.astype(np.intp)
            p = net.probabilities(x)
            if group is short:
                p *= (at[:, None] < size[g]).astype(np.float32)[:, None, :]
            np.add.at(sums, doc[g], p.sum(0).T)
    return sums / np.maximum(n_bytes, 1)[:, None]


def predict(docs: DataFrame, names: list[str], net: ByteGRU | None, text: str = "text") -> DataFrame:
    """The columns of docs, lang_pred and score; docs must have no columns of these names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, net))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    schema = T.StructType([T.StructField("__row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            has = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if net is None:
                pred, score = ["und"] * len(has), np.zeros(len(has))
            else:
                p = pooled(net, data, offsets)
                best = p.argmax(1)
                pred = [names[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score = np.where(has, np.minimum(1.0, p[np.arange(len(best)), best]), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["__row", "lang_pred", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return docs.select(row, F.col(text).cast("string").alias("__text"), letters.alias("__has")).mapInArrow(tidied(run), schema).select("__row.*", "lang_pred", "score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    names, net = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), names, net).drop("text")
