"""Near-duplicate groups by MinHash (operator 4).

Each text becomes the set of its distinct shingles of five words. Documents of equal sets are one representative from
there on (the least doc_id). Representatives get the minima of BANDS x ROWS universal hashes; those that agree in a band
share a bucket. Within a bucket every document is held against a centre, not against every other: pairs whose signatures
agree enough are confirmed on their full sets, the links go into connected components by alternating large-star and
small-star, and buckets whose documents already share a component are done. After STARS such rounds, each with other
centres, the buckets left over are closed exactly: documents that share one, directly or through others, are a cluster;
a cluster is cut into chunks, and each task counts the common shingles of two chunks by one product of their incidence
matrices, and returns only links that join components. So that unlike texts which share a phrase don't run together into
one cluster, the documents left over first get FINE_BANDS finer bands of FINE_ROWS hashes each, and clusters are closed
over these. So no link of a bucket is lost, and no pairs are written.

A node of the graph is a distinct set, not a doc_id, so rows without a doc_id, or of one doc_id, are linked only by
their texts. Sets, buckets and components that hold many rows are broadcast instead of shuffled to one task.

Defined results: a null text, or one without words, has an empty set, and is its own group; a text of fewer than five
words has one shingle, the whole sequence; a missing doc_id counts as the largest, so a component has no id only if no
document of it has one; rows of one doc_id but other texts are held apart by their sets; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.llm._text import CREATED, NO_ID, U64, Words, _table, buffers, discard, discard_since, ident, join_groups, mix, steps, stored, tidied, windows

SHINGLE = 5
#: Bands and hashes of a band: of pairs at 0.85, all but 4 in 10 million share a bucket; at 0.8, all but 3 in a million.
BANDS, ROWS = 24, 4
#: The same for documents left over: of pairs at 0.8, all but 3 in 100 million share a fine bucket.
FINE_BANDS, FINE_ROWS = 96, 8
#: How far below the threshold the share of agreeing minima may lie (over five standard deviations).
SLACK = 0.23
#: Rounds with one centre a bucket, before all that is left is compared.
STARS = 2
#: Documents of a chunk; shingles of a product.
CHUNK, COLUMNS = 512, 4096


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64 bits), by document, and the bounds of each document's."""
    h = w.hashes(1)
    whole = np.zeros(len(h), U64)
    long = w.n_words >= size
    n_shingles = np.where(long, w.n_words - size + 1, (w.n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(w.n_words)), n_shingles)
    first = np.repeat(w.bounds[:-1], n_shingles) + np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    k = windows(h, size, 1)
    whole[: len(k)] = k
    s = whole[first]
    for i in np.flatnonzero(~long & (w.n_words > 0)):
        a, b = w.bounds[i], w.bounds[i + 1]
        s[np.searchsorted(doc, i)] = windows(h[a:b], int(b - a), 2)[0]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[keep], np.searchsorted(doc[keep], np.arange(len(w.n_words) + 1))


def _universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(n, seed), mix(np.arange(n, dtype=U64) + U64(seed + 56))


_COARSE, _FINE = _universal(BANDS * ROWS, 21), _universal(FINE_BANDS * FINE_ROWS, 1021)


def minima(s: np.ndarray, bounds: np.ndarray, hashes: tuple[np.ndarray, np.ndarray] = _COARSE) -> np.ndarray:
    """(documents x hashes) minima of universal hashes (a * x + b, the upper 32 bits); no set may be empty."""
    a, b = hashes
    out = np.empty((len(bounds) - 1, len(a)), np.uint32)
    for k in range(len(a)):
        v = s * a[k]
        v += b[k]
        out[:, k] = np.minimum.reduceat(v, bounds[:-1]) >> U64(32)
    return out


def _set_hashes(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each (not empty) set, as two sums over its shingles."""
    return np.add.reduceat(mix(s), starts), np.add.reduceat(mix(s ^ U64(0x9E3779B97F4A7C15)), starts)


def _sets_of(size: int, signatures: bool):
    """did, th, n, a, b of each text, and its signature or its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for lo, hi in steps(data, offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True)
                s, bounds = shingle_sets(w, size)
                n = np.diff(bounds)
                a, b = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
                full = np.flatnonzero(n)
                if len(full):
                    a[full], b[full] = _set_hashes(s, bounds[:-1][full])
                if signatures:
                    sig = np.zeros((hi - lo, BANDS * ROWS), np.uint32)
                    if len(full):
                        sig[full] = minima(s, np.r_[bounds[:-1][full], len(s)])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (BANDS * ROWS)), pa.array(sig.view(np.int32).ravel()))
                else:
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], ["did", "th", "n", "a", "b", "sig" if signatures else "shingles"])

    return run


def _fine_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, band, key) of the finer bands, from the stored shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lists = part.column(2)
            s = lists.flatten().to_numpy().view(U64)
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            m = minima(s, bounds, _FINE).reshape(part.num_rows, FINE_BANDS, FINE_ROWS).astype(U64)
            key = np.zeros(m.shape[:2], U64)
            for k in range(FINE_ROWS):
                key = mix(key ^ (m[:, :, k] + U64(k + 1)))
            each = lambda c: np.repeat(part.column(c).to_numpy(), FINE_BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(each(0)), pa.array(each(1)), pa.array(np.tile(np.arange(FINE_BANDS, dtype=np.int32), part.num_rows)), pa.array(key.ravel().view(np.int64))], ["node", "root", "band", "key"])


def _agreeing() -> Column:
    return F.expr("size(filter(zip_with(sig_x, sig_y, (p, q) -> p = q), e -> e))")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y), those whose signatures agree enough and whose full sets have 100 * common >= percent * all."""
    s = lambda k: sets.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("shingles").alias(f"set_{k}"))
    both = pairs.join(s("x"), "x").join(s("y"), "y").filter(_agreeing() >= int((percent / 100 - SLACK) * BANDS * ROWS))
    common = both.select("x", "y", F.size(F.array_intersect("set_x", "set_y")).cast("bigint").alias("c"), (F.size("set_x") + F.size("set_y")).cast("bigint").alias("n"))
    return common.filter(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("x", "y")


def _linked(dids: np.ndarray, roots: np.ndarray, chunks: np.ndarray, lists: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between documents of different roots, as few as join the same components."""
    n = np.array([len(x) for x in lists], np.int64)
    s, at = np.unique(np.concatenate(lists), return_inverse=True)
    doc = np.repeat(np.arange(len(n)), n)
    more = np.bincount(at, minlength=len(s)) > 1
    place = np.cumsum(more) - 1
    doc, at = doc[more[at]], place[at[more[at]]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    common = np.zeros((len(n), len(n)), np.float32)
    for lo in range(0, int(more.sum()), COLUMNS):
        f, t = np.searchsorted(at, (lo, lo + COLUMNS))
        m = np.zeros((len(n), COLUMNS), np.float32)
        m[doc[f:t], at[f:t] - lo] = 1
        common += m @ m.T
    c = np.rint(common).astype(np.int64)
    x, y = np.nonzero(np.triu((100 * c >= percent * (n[:, None] + n[None, :] - c)) & (roots[:, None] != roots[None, :]), 1))
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(int(roots[i])), top(int(roots[j]))
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((int(dids[i]), int(dids[j])))
    return out


def block_links(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between nodes of different roots among those of left (node, root) that share a fine bucket, directly
    or through others; all that are needed to join components that any of their links joins."""
    own = stored(sets.select("node", "shingles").join(left.select("node", "root").distinct(), "node").select("node", "root", "shingles"), "open-sets")
    fine = stored(own.mapInArrow(tidied(_fine_keys), "node bigint, root bigint, band int, key bigint"), "fine")
    least = fine.groupBy("band", "key").agg(F.min("node").alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("copies")).filter("lo < hi").drop("lo", "hi")
    shared = join_groups(fine.select("node", "band", "key"), least, ["band", "key"], fine.count()).filter("y IS NOT NULL")
    cluster = components(shared.select(F.col("node").alias("x"), "y").distinct())
    cluster = stored(cluster.unionByName(cluster.select(F.col("root").alias("node"), "root").distinct()), "clusters")
    size = cluster.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("m"))
    rows = cluster.join(size, "root").select("node", F.col("root").alias("cluster"), F.pmod(F.xxhash64("node"), F.col("m")).cast("int").alias("chunk"), "m")
    rows = own.join(rows, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "root", "shingles")
    key = ["cluster", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        now = None

        def done() -> pa.RecordBatch:
            links = _linked(np.array([r[0] for r in held]), np.array([r[1] for r in held]), np.array([r[2] for r in held]), [r[3] for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([max(a) for a in links], pa.int64()), pa.array([min(a) for a in links], pa.int64())], ["x", "y"])

        for batch in batches:
            c, i, j, chunk, node, root, lists = batch.columns
            for k in range(batch.num_rows):
                this = (c[k].as_py(), i[k].as_py(), j[k].as_py())
                if this != now and held:
                    yield done()
                    held = []
                now = this
                held.append((node[k].as_py(), root[k].as_py(), chunk[k].as_py(), lists[k].values.to_numpy()))
        if held:
            yield done()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidied(run), "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node's least reachable node, by alternating large-star and small-star until nothing changes.
    Edges are (x, y), in either direction; roots themselves and nodes without edges aren't returned."""
    now = stored(edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    mark = None
    while True:
        # large-star: of each node, larger neighbours go to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = now.select(F.col("x").alias("v"), F.col("y").alias("x")).join(least, "x").filter("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        # small-star: of each node, smaller neighbours and the node go to the least of them
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(small, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        before, now = now, stored(moved.unionByName(small.select("x", F.col("m").alias("y"))).distinct(), "edges")
        discard(before)
        r = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if tuple(r) == mark:
            return now.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root"))
        mark = tuple(r)


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """did (doc_id, or the largest number for none), n_shingles, a and b (hash of the set), component (a did). Rows come
    in no order; one for each row of docs."""
    keyed = docs.select(ident(doc_id).alias("did"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    kinds = "did bigint, th bigint, n bigint, a bigint, b bigint"
    mark = len(CREATED)
    sig = stored(keyed.mapInArrow(tidied(_sets_of(size, True)), f"{kinds}, sig array<int>"), "signatures")
    # equal sets are one node; its number is stored with it
    heads = sig.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("did", "th")).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    heads = stored(heads.select(F.monotonically_increasing_id().alias("node"), "a", "b", "rep.did", "rep.th", "copies", "sig"), "heads")
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col("sig")[k * ROWS + i] for i in range(ROWS)]) for k in range(BANDS)])
    bands = stored(heads.select("node", F.posexplode(keys).alias("band", "key")), "bands")
    many = bands.count()
    full = bands.groupBy("band", "key").agg(F.count("*").alias("copies")).filter("copies > 1").withColumn("found", F.lit(True))
    every, bands = bands, stored(join_groups(bands, full, ["band", "key"], many).filter("found").drop("found"), "buckets")
    discard(every)
    wanted = heads.join(bands.select("node").distinct(), "node", "left_semi")
    # texts are read again only for those that share a bucket
    texts = keyed.join(wanted.select("did", "th"), ["did", "th"], "left_semi").mapInArrow(tidied(_sets_of(size, False)), f"{kinds}, shingles array<bigint>")
    texts = texts.dropDuplicates(["did", "th", "a", "b"]).select("did", "th", "a", "b", "shingles")
    sets = stored(wanted.join(texts, ["did", "th", "a", "b"]).select("node", "sig", "shingles"), "sets")

    left = bands.withColumn("root", F.col("node"))
    roots = None
    for k in range(STARS + 1):
        if k < STARS:
            rank = F.col("node") if k == 0 else F.xxhash64("node", F.lit(k))
            centre = left.groupBy("band", "key").agg(F.min_by("node", rank).alias("y"), F.min_by("root", rank).alias("root_y"), F.count("*").alias("copies"))
            pairs = join_groups(left, centre, ["band", "key"], many).filter("root <> root_y")
            pairs = pairs.select(F.greatest("node", "y").alias("x"), F.least("node", "y").alias("y")).distinct()
            new = stored(confirmed(pairs, sets, percent), "links")
        else:
            new = stored(block_links(sets, left, percent), "links")
        edges = new if roots is None else new.unionByName(roots.select(F.col("node").alias("x"), F.col("root").alias("y")))
        roots = stored(components(edges), "roots")
        if k < STARS:
            left = stored(bands.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
            open_ = left.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("copies")).filter("lo < hi").select("band", "key", "copies", F.lit(True).alias("open"))
            left = stored(join_groups(left, open_, ["band", "key"], many).filter("open").drop("open"), "open")
            if left.isEmpty():
                break
    own = stored(heads.select("a", "b", "did", "copies", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "rooted")
    least = own.groupBy("root").agg(F.min("did").alias("component"), F.count("*").alias("parts"))
    of_set = join_groups(own.withColumnRenamed("copies", "rows"), least.withColumnRenamed("parts", "copies"), ["root"], many)
    of_set = stored(of_set.select("a", "b", "component", F.col("rows").alias("copies")), "components")
    discard_since(docs.sparkSession, mark, sig, of_set)  # what follows reads these two alone
    members = sig.select("did", F.col("n").alias("n_shingles"), "a", "b")
    found = join_groups(members.filter("n_shingles > 0"), of_set, ["a", "b"], sig.count())
    return found.unionByName(members.filter("n_shingles = 0").withColumn("component", F.col("did")))


def _shown(c: str) -> Column:
    return F.when(F.col(c) != NO_ID, F.col(c))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
    return found.select(_shown("did").alias("doc_id"), "n_shingles", _shown("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))


#: DuckDB SQL of the same result.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p+4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""
