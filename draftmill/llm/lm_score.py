"""Language-model scores (operator 3): a gated recurrent word model with a class-factored softmax.

Tokens are the text's words, A-Z lowered, then one end. Counts over all training tokens give the base score, the model's
vocabulary (the WORDS most frequent) and, for every other token, its share of its kind (by its first byte). The network
reads the token before and says the class of the next: one of the vocabulary's classes of CLASS words, within which a
second softmax says the word, or one of the KINDS of rare tokens. It learns by truncated backpropagation in numpy: first
on a bounded sample on the driver, then in groups of about GROUP_TOKENS tokens that together are all training documents.
Each group starts from a fresh copy of the driver's weights; the groups' weights are averaged by their tokens. A group is
chosen by a hash of the document and read in the hash's order, and the mean is taken in whole numbers, so neither the
partitions, nor the order in which tasks end, nor a lost task changes the weights. In training and scoring alike the
state is carried from window to window to the end of a document, so a score is that of the complete text.

Counts of the most frequent tokens (HOT at most, of LONGEST bytes at most, and the end) go to the executors, so what is
sent is bounded; every other token of a document is looked up by a join.

Defined results: a null text is empty and has the end alone; with no training documents the base score is 0 for each
token and so is the score; rows of equal doc_id are scored each; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import copy
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmill.llm._text import U64, Words, buffers, steps, stored

#: Words of the softmax, words of a class, kinds of rare tokens, units; tokens whose counts are sent to the executors.
WORDS, CLASS, KINDS, UNITS, HOT, LONGEST = 2048, 64, 32, 16, 200_000, 64
#: The driver's sample: documents, passes. Steps of a training window, documents read side by side, learning rates.
SAMPLE, PASSES, STEPS, LANES, RATE, LOCAL_RATE = 400, 6, 32, 256, 0.02, 0.05
#: Positions whose outputs are computed at once when scoring, documents side by side, rows of a softmax over classes.
AT_ONCE, SIDE, ROWS = 1 << 15, 2048, 2048
#: Tokens of a group, about; documents and tokens that its training takes at a time.
GROUP_TOKENS, PIECE, PIECE_TOKENS = 3_000_000, 8192, 1_500_000
#: Weights in a row of the table of weights; parts of a unit that a weight is rounded to; tokens of a unit of the mean.
CHUNK, FIXED, UNIT = 1024, 1 << 20, 1024
#: Logits are held below this instead of being shifted by their maximum.
MOST = np.float32(60)
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, and the end."""
    t = (text or "").encode().lower().split()
    t.append(END)
    return t


class ClassGRU:
    """Ids: 0 to words - 1 the vocabulary by rank, then the kinds of rare tokens. Classes: words // CLASS of the
    vocabulary, then one for each kind."""

    def __init__(self, words: int, units: int = UNITS, size: int = CLASS, kinds: int = KINDS, seed: int = 1, lanes: int = LANES):
        r = np.random.default_rng(seed)
        self.words, self.units, self.size, self.kinds, self.lanes = words, units, size, kinds, lanes
        self.groups = -(-words // size)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        #: Adagrad's sums; they go on where training goes on
        self.sums: dict[str, np.ndarray] = {}
        self.p = {"t": f(words + kinds, 3 * units, k=0.2), "u": f(3 * units, units, k=units**-0.5), "c": f(self.groups + kinds, units, k=0.1), "d": np.zeros(self.groups + kinds, np.float32), "w": f(self.groups, size, units, k=0.1), "b": np.zeros((self.groups, size), np.float32)}
        # places past the vocabulary in the last class never come
        self.p["b"].reshape(-1)[words:] = -1e4

    def start(self, counts: np.ndarray) -> None:
        """Biases from the counts of ids."""
        c = counts + 0.5
        own = np.zeros(self.groups * self.size)
        own[: self.words] = c[: self.words]
        by = own.reshape(self.groups, self.size)
        self.p["d"][:] = np.log(np.r_[by.sum(1), c[self.words :]] / c.sum())
        with np.errstate(divide="ignore"):
            self.p["b"][:] = np.maximum(np.log(by / np.maximum(by.sum(1, keepdims=True), 1e-9)), -1e4)

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // self.size, self.groups + ids - self.words)

    def step(self, ids: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state (n x units) after ids, and what its gradient needs."""
        h, half = self.units, np.float32(0.5)
        a = self.p["t"].take(ids, 0)
        b = s @ self.p["u"].T
        g = a[:, : 2 * h] + b[:, : 2 * h]
        g *= half
        np.tanh(g, out=g)
        g *= half
        g += half
        z, r = g[:, :h], g[:, h:]
        n = r * b[:, 2 * h :]
        n += a[:, 2 * h :]
        np.tanh(n, out=n)
        out = s - n
        out *= z
        out += n
        return out, z, r, n, b[:, 2 * h :]

    @staticmethod
    def softmax(x: np.ndarray, weights: np.ndarray, own: np.ndarray, bounded: bool, grad: np.ndarray | None, weight: float) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of `own` by the weights (n x units + 1, the bias last) after x (m x units + 1, ones last).
        bounded: no logit can pass MOST. With grad (n x units + 1): adds the gradient as in log_probability, and returns
        that of the units too. The outputs stay unscaled; their rows' factors go to the narrow side of each product."""
        at = np.arange(len(own))
        o = x @ weights.T
        if not bounded:
            np.minimum(o, MOST, out=o)
        one = o[at, own]
        np.exp(o, out=o)
        total = o @ np.ones(len(weights), o.dtype)
        if grad is None:
            return one - np.log(total), None
        o[at, own] -= total
        share = (np.float32(weight) / total)[:, None]
        grad += o.T @ (x * share)
        return one - np.log(total), (o @ weights[:, :-1]) * share

    def log_probability(self, s: np.ndarray, ids: np.ndarray, grad: dict | None = None, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of ids after states s (m x units). With grad: adds the gradient of minus their sum
        times weight, and returns that of s too."""
        p, k, h = self.p, self.classes(ids), self.units
        out = np.empty(len(ids), s.dtype)
        ds = np.empty_like(s) if grad is not None else None
        # the bias is one more unit, which is always 1
        x = np.concatenate([s, np.ones((len(s), 1), s.dtype)], 1)
        c, w = np.c_[p["c"], p["d"]], np.concatenate([p["w"], p["b"][:, :, None]], 2)
        dc, dw = (np.zeros_like(c), np.zeros_like(w)) if grad is not None else (None, None)
        # the low biases that keep a place from coming are no matter here
        widest, highest = (max(f(u).max(initial=0) for u in (c, w)) for f in (lambda u: np.abs(u[..., :h]).sum(-1), lambda u: u[..., h]))
        most = np.abs(s).max(initial=0) * widest + highest
        bounded = bool(most <= MOST)
        for lo in range(0, len(ids), ROWS):
            out[lo : lo + ROWS], d = self.softmax(x[lo : lo + ROWS], c, k[lo : lo + ROWS], bounded, dc, weight)
            if grad is not None:
                ds[lo : lo + ROWS] = d
        # numpy sorts numbers of 16 bits by their digits
        order = np.argsort(k.astype(np.uint16) if self.groups + self.kinds < 1 << 16 else k, kind="stable")
        edges = np.searchsorted(k, np.arange(self.groups + 1), sorter=order)
        order = order[: edges[-1]]
        x, word = x.take(order, 0), (ids - k * self.size).take(order)
        lp, d = np.empty(len(order), s.dtype), np.empty((len(order), h), s.dtype)
        for j in np.flatnonzero(np.diff(edges)):
            own = slice(edges[j], edges[j + 1])
            lp[own], more = self.softmax(x[own], w[j], word[own], bounded, None if dw is None else dw[j], weight)
            if grad is not None:
                d[own] = more
        out[order] += lp
        if grad is not None:
            ds[order] += d
            grad["c"] += dc[:, :h]
            grad["d"] += dc[:, h]
            grad["w"] += dw[:, :, :h]
            grad["b"] += dw[:, :, h]
        return out, ds

    def window(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, fresh: np.ndarray, s: np.ndarray, lanes: int | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradient and last state of a window (steps x lanes) of inputs and targets: truncated backpropagation,
        with the state s carried in. fresh: where a document starts and the state is set to zero. lanes: of how many
        lanes the loss is a mean, so that the few long documents at the end of a pass weigh as they do elsewhere."""
        h, steps, keep = self.units, len(x), (~fresh)[:, :, None].astype(s.dtype)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        # by step and lane: the states before and after it, the gates, the new part and the state's share in it
        before, after, z, r, n, bn = (np.empty((*x.shape, h), s.dtype) for _ in range(6))
        for k in range(steps):
            before[k] = s * keep[k]
            s, z[k], r[k], n[k], bn[k] = self.step(x[k], before[k])
            after[k] = s
        flat, real = after.reshape(-1, h), mask.ravel()
        whole = real.all()
        weight = 1.0 / (steps * lanes if lanes else max(1, int(real.sum())))
        lp, every = self.log_probability(flat if whole else flat[real], y.ravel() if whole else y.ravel()[real], grad, weight)
        if not whole:
            d, every = every, np.zeros_like(flat)
            every[real] = d
        every = every.reshape(after.shape)
        # what a gate's gradient is to that of the state, then what it is to that of the new part
        rest = 1 - z
        at_n = rest * (1 - n * n)
        at_z = (before - n) * z * rest
        at_r = bn * r * (1 - r)
        back = np.zeros_like(s)
        gates, dt, u = np.empty((*x.shape, 3 * h), s.dtype), np.empty((*x.shape, h), s.dtype), self.p["u"]
        for k in range(steps - 1, -1, -1):
            dh = every[k] + back
            dn = np.multiply(dh, at_n[k], out=dt[k])
            np.multiply(dh, at_z[k], out=gates[k, :, :h])
            np.multiply(dn, at_r[k], out=gates[k, :, h : 2 * h])
            np.multiply(dn, r[k], out=gates[k, :, 2 * h :])
            dh *= z[k]
            back = gates[k] @ u
            back += dh
            back *= keep[k]
        grad["u"] += gates.reshape(-1, 3 * h).T @ before.reshape(-1, h)
        gates[:, :, 2 * h :] = dt
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(grad["t"]) < 1 << 16 else ids, kind="stable")
        ids = ids.take(order)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grad["t"][ids[first]] = np.add.reduceat(gates.reshape(-1, 3 * h).take(order, 0), first, axis=0)
        return -float(lp.sum()) * weight, grad, s

    def train(self, docs: list[np.ndarray], end: int, rate: float, passes: int = 1, lanes: int | None = None, steps: int = STEPS, seed: int = 2) -> float:
        """Reads whole documents in lanes, one after the other in each, by Adagrad. Returns the last pass's loss."""
        rng, mean, lanes = np.random.default_rng(seed), 0.0, lanes or self.lanes
        sums = self.sums = self.sums or {k: np.full_like(v, 1e-4) for k, v in self.p.items()}
        for _ in range(passes):
            # the longest first, each to the lane with the least, so that lanes end together; then in any order
            size, lane = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
            heap = [(0, k) for k in range(lanes)]
            for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
                n, k = heap[0]
                lane[k].append(i)
                size[k] = n + len(docs[i])
                heapq.heapreplace(heap, (int(size[k]), k))
            order = [own[i] for own in lane for i in rng.permutation(len(own))]
            flat = np.concatenate([docs[i] for i in order] or [np.zeros(0, np.int32)])
            lens = np.array([len(docs[i]) for i in order], np.int64)
            head = np.zeros(len(flat), bool)
            head[np.cumsum(lens) - lens] = True
            start = np.cumsum(size) - size
            s, losses, k = np.zeros((lanes, self.units), np.float32), [], 0
            while (live := size > k).any():  # lanes that have ended are left out
                place = k + np.arange(steps)[:, None]
                real = place < size[live]
                at = np.where(real, start[live] + place, start[live])
                y, fresh = flat[at], head[at] & real
                x = np.where(fresh, end, flat[np.maximum(at - 1, 0)])
                k += steps
                loss, grad, part = self.window(x, y, real, fresh, s[live], lanes)
                s[live] = part
                losses += [loss] if live.all() else []
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                clip = np.float32(min(1.0, 2.0 / max(norm, 1e-9)))
                for name, g in grad.items():
                    g *= clip
                    sums[name] += g * g
                    self.p[name] -= np.float32(rate) * g / np.sqrt(sums[name])
            mean = float(np.mean(losses)) if losses else 0.0
        return mean

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of each whole document; the state is carried over windows."""
        out = np.zeros(len(docs))
        order = np.argsort([-len(d) for d in docs], kind="stable")
        for at in range(0, len(order), SIDE):
            group = order[at : at + SIDE]
            lens = np.array([len(docs[i]) for i in group])
            starts = np.cumsum(lens) - lens
            flat = np.concatenate([docs[i] for i in group])
            t, s, live = 0, np.zeros((len(group), self.units), np.float32), len(group)
            prev = np.full(len(group), end)
            while live:
                span = int(min(max(STEPS, AT_ONCE // live), lens[0] - t))
                states, targets, owners = [], [], []
                for k in range(span):
                    live = int(np.searchsorted(-lens, -(t + k), "left"))  # documents longer than t + k
                    s, prev = s[:live], prev[:live]
                    s = self.step(prev, s)[0]
                    prev = flat[starts[:live] + t + k]
                    states.append(s)
                    targets.append(prev)
                    owners.append(np.arange(live))
                lp, _ = self.log_probability(np.concatenate(states), np.concatenate(targets))
                out[group] += np.bincount(np.concatenate(owners), lp.astype(np.float64), len(group))
                t += span
                live = int(np.searchsorted(-lens, -t, "left"))
                s, prev = s[:live], prev[:live]
        return out

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, v: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = v[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n


class Lexicon:
    """The HOT tokens by rank, with their counts and the model's ids; found by 64 bits of hash in an open table."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray | list[int], words: int):
        self.counts = np.array(counts, np.int64)
        self.words = min(words, len(tokens))
        n = np.arange(len(tokens))
        self.ids = np.where(n < self.words, n, self.words + np.array([kind(t) for t in tokens], np.int64)) if tokens else n
        self.end_rank = tokens.index(END) if END in tokens else -1
        self.end = int(self.ids[self.end_rank]) if self.end_rank >= 0 else self.words
        self.bits = max(4, (4 * len(tokens)).bit_length())
        self.keys, self.ranks = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        real = [t for t in tokens if t]
        w = Words(np.frombuffer(b" ".join(real), np.uint8), np.array([0, sum(map(len, real)) + max(0, len(real) - 1)]), False)
        at = np.array([i for i, t in enumerate(tokens) if t], np.int32)
        self.probes = 0
        for h, i in zip(w.hashes(1), at, strict=True):
            k, tries = int(h) & ((1 << self.bits) - 1), 1
            while self.ranks[k] >= 0:
                k, tries = (k + 1) & ((1 << self.bits) - 1), tries + 1
            self.keys[k], self.ranks[k] = h, i
            self.probes = max(self.probes, tries)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ranks, -1 where not among the HOT."""
        mask = U64((1 << self.bits) - 1)
        k = (h & mask).astype(np.intp)
        out = np.where(self.keys[k] == h, self.ranks[k], -1)
        left = np.flatnonzero((out < 0) & (self.ranks[k] >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                break
            k[left] = (k[left] + 1) & int(mask)
            at = k[left]
            hit = (self.keys[at] == h[left]) & (self.ranks[at] >= 0)
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit & (self.ranks[at] >= 0)]
        return out

    def encode(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks and ids of all documents' tokens, each with its end, and the documents' bounds."""
        n = len(w.n_words)
        bounds = w.bounds + np.arange(n + 1)
        places = np.arange(len(h)) + np.repeat(np.arange(n), w.n_words)
        ranks, ids = np.full(len(h) + n, self.end_rank, np.int32), np.full(len(h) + n, self.end, np.int32)
        r = self.find(h)
        ranks[places] = r
        # a zero key also stands for an empty place, whose rank is -1
        ids[places] = np.where(r >= 0, self.ids[r] if len(self.ids) else 0, self.words + w.data[w.starts].astype(np.int64) % KINDS)
        return ranks, ids, bounds


def kind(token: bytes) -> int:
    return token[0] % KINDS if token else 0


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) over all the documents' tokens; counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            keys, counts, names = [], [], []
            for lo, hi in steps(data, offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True)
                k, first, n = np.unique(w.hashes(1), return_index=True, return_counts=True)
                raw = w.data.tobytes()
                keys.append(k)
                counts.append(n)
                names += [raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
            k, first, which = np.unique(np.concatenate(keys) if keys else np.zeros(0, U64), return_index=True, return_inverse=True)
            n = np.bincount(which, np.concatenate(counts) if counts else None, len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([END, *(names[i] for i in first)], pa.binary()), pa.array([batch.num_rows, *n], pa.int64())], ["token", "c"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def encoded(lexicon: Lexicon, column: pa.Array) -> list[np.ndarray]:
    """Ids of each text."""
    data, offsets = buffers(column)
    out: list[np.ndarray] = []
    for lo, hi in steps(data, offsets):
        w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True)
        _, ids, bounds = lexicon.encode(w, w.hashes(1))
        out += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _averaged(train: DataFrame, doc_id: str, text: str, shared, total: int) -> np.ndarray | None:
    """The mean of the weights of all groups of training documents, by their tokens. Weights are summed as whole
    numbers (up to some 10 ** 13 tokens), so the mean is the same in whatever order they come."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, start = shared.value
        sums, units = None, 0
        now, own, held, n_held, n_group = None, None, [], 0, 0

        def flush() -> None:
            nonlocal held, n_held
            if held:
                own.train(held, lexicon.end, LOCAL_RATE, seed=len(held))
                held, n_held = [], 0

        def done() -> None:
            nonlocal sums, units, n_group
            flush()
            if n_group:
                u = -(-n_group // UNIT)
                v = np.rint(own.vector().astype(np.float64) * FIXED).astype(np.int64) * u
                sums = v if sums is None else sums + v
                units += u
            n_group = 0

        for batch in batches:
            groups = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, PIECE):
                for g, ids in zip(groups[at : at + PIECE], encoded(lexicon, batch.column(2).slice(at, PIECE)), strict=True):
                    if g != now:
                        done()
                        now, own = g, copy.deepcopy(start)  # the broadcast object belongs to all tasks of this worker
                    held.append(ids)
                    n_held += len(ids)
                    n_group += len(ids)
                    if len(held) >= PIECE or n_held >= PIECE_TOKENS:
                        flush()
        done()
        if units:
            n = -(-len(sums) // CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([units] * n, pa.int64()), pa.array([sums[k * CHUNK : (k + 1) * CHUNK].astype("<i8").tobytes() for k in range(n)], pa.binary())], ["chunk", "units", "weights"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        totals: Counter[int] = Counter()
        for batch in batches:
            for k, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<i8")
                totals[k] += n
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(s / (totals[k] * FIXED)).astype("<f4").tobytes()], pa.binary())], ["chunk", "weights"])

    h = F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string"), F.lit(13))
    groups = max(1, round(total / GROUP_TOKENS))
    docs = train.select(h.alias("h"), F.col(text).cast("string").alias("text")).select(F.pmod("h", F.lit(groups)).alias("g"), "h", "text")
    parts = docs.repartition("g").sortWithinPartitions("g", "h").mapInArrow(learn, "chunk int, units bigint, weights binary")
    rows = parts.repartition("chunk").mapInArrow(mean, "chunk int, weights binary").collect()
    return np.concatenate([np.frombuffer(r["weights"], "<f4") for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else None


_SCORED = "row bigint, id bigint, held_out boolean, token binary, kind int, n bigint, n_tokens bigint, n_known bigint, base double, score double"


def score_texts(docs: DataFrame, learn_from: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (not learn_from), n_tokens, n_known, train_tokens, base_score, score of every document.
    learn_from: SQL condition for the documents that are learned from."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    train = docs.filter(learn_from)
    counts = stored(token_counts(train, text), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = np.log(total + 0.5 * (distinct + 1))
    # at most HOT rows come here: those above the count, in fine steps of its logarithm, that so many tokens pass
    fine = F.floor(F.log2("c") * 64).cast("int")
    many, least = 0, 1 << 30
    short = F.length("token") <= LONGEST
    for r in sorted(counts.filter(short).groupBy(fine.alias("k")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["k"]):
        many += r["v"]
        if many > HOT:
            break
        least = r["k"]
    # the end is always among them, as it has no text to be looked up by
    hot = counts.filter((fine >= least) & short | (F.col("token") == F.lit(END))).toArrow()
    pairs = sorted(zip((-c for c in hot.column("c").to_pylist()), hot.column("token").to_pylist(), strict=True))
    tokens = [t for _, t in pairs]
    lexicon = Lexicon(tokens, [-c for c, _ in pairs], WORDS)
    # what the rare tokens of each kind make up: of all but the vocabulary
    vocabulary = lexicon.words
    kinds = F.when(F.length("token") > 0, F.conv(F.hex(F.substring("token", 1, 1)), 16, 10).cast("int") % KINDS).otherwise(0)
    mass, types = np.zeros(KINDS), np.zeros(KINDS)
    for r in counts.groupBy(kinds.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r["k"]], types[r["k"]] = r["c"], r["v"]
    for i, t in enumerate(tokens[:vocabulary]):
        mass[kind(t)] -= lexicon.counts[i]
        types[kind(t)] -= 1
    lexicon.rare = np.log(mass + 0.5 * (types + 1))
    net = ClassGRU(vocabulary)
    if total:
        net.start(np.r_[lexicon.counts[:vocabulary], mass])
        sample = train.select(F.col(text).cast("string").alias("t")).orderBy(F.xxhash64(F.col(doc_id).cast("string"), F.lit(3)), "t").limit(SAMPLE).collect()
        net.train(encoded(lexicon, pa.array([r["t"] for r in sample], pa.string())), lexicon.end, RATE, PASSES, lanes=32)
        v = _averaged(train, doc_id, text, sc.broadcast((lexicon, net)), total)
        if v is not None:
            net.load(v)
    shared = sc.broadcast((lexicon, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, net = shared.value
        row = TaskContext.get().partitionId() << 36
        log_counts = np.log(lexicon.counts + 0.5) if len(lexicon.counts) else np.zeros(1)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            none = lambda kind, k: pa.nulls(k, kind)
            texts: list[np.ndarray] = []
            base, more, n_known = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            for lo, hi in steps(data, offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True)
                h = w.hashes(1)
                ranks, ids, bounds = lexicon.encode(w, h)
                m, n = hi - lo, np.diff(bounds)
                doc = np.repeat(np.arange(m), n)
                texts += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                known = ranks >= 0
                if not total:
                    base[lo:hi] = n * (np.log(0.5) - below)
                    continue
                base[lo:hi] = np.bincount(doc[known], log_counts[ranks[known]], m) - n * below
                beyond = known & (ranks >= lexicon.words)
                more[lo:hi] = np.bincount(doc[beyond], log_counts[ranks[beyond]] - lexicon.rare[ids[beyond] - lexicon.words], m)
                n_known[lo:hi] = np.bincount(doc[known], None, m)
                at = np.flatnonzero(ranks < 0)
                if not len(at):
                    continue
                word = at - doc[at]
                order = np.lexsort((h[word], doc[at]))
                word, of = word[order], doc[at][order]
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[word][1:] != h[word][:-1])])
                k = np.diff(np.r_[new, len(of)])
                raw, word, of = w.data.tobytes(), word[new], of[new]
                names = [raw[a:b] for a, b in zip(w.starts[word].tolist(), w.ends[word].tolist(), strict=True)]
                m = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(rows[lo + of]), none(pa.int64(), m), none(pa.bool_(), m), pa.array(names, pa.binary()), pa.array((w.data[w.starts[word]] % KINDS).astype(np.int32)), pa.array(k.astype(np.int64)), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), none(pa.float64(), m)], _NAMES)
            m = len(rows)
            scores = more + net.score(texts, lexicon.end) if total else base
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(1), none(pa.binary(), m), none(pa.int32(), m), none(pa.int64(), m), pa.array(np.array([len(x) for x in texts], np.int64)), pa.array(n_known), pa.array(base), pa.array(scores.astype(np.float64))], _NAMES)

    marked = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.expr(f"NOT ({learn_from})").alias("held_out"), F.col(text).cast("string").alias("text"))
    found = stored(marked.mapInArrow(run, _SCORED), "scores")
    rare = found.filter("token IS NOT NULL").select("row", "token", "kind", "n").join(counts, "token", "left")
    share = F.get(F.array(*[F.lit(float(x)) for x in lexicon.rare]), F.col("kind"))
    lc = F.log(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    looked = rare.select("row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * lc).alias("base"), (F.col("n") * (lc - share)).alias("score"))
    looked = looked.groupBy("row").agg(*[F.sum(c).alias(f"{c}_more") for c in ("n_known", "base", "score")])
    texts = found.filter("token IS NULL").select("row", F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "base", "score").join(looked, "row", "left")
    both = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_more"), F.lit(0))
    return texts.select("doc_id", "held_out", "n_tokens", both("n_known").alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"), (both("base") / F.lit(float(np.log(10)))).alias("base_score"), (both("score") / F.lit(float(np.log(10)))).alias("score"))


_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def op3_recurrent_lm_score(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 1, true)")
