"""Sharding by a k-d tree over metadata (operator 6).

Every distinct text is a point: its size in bytes, and 31-bit hashes of the language and source of its first document
(the least doc_id), so that equal texts lie together. A node is split along the
dimension that is widest in it (as a share of the whole table's range) at the median weighted by bytes, until leaves
reach the target bytes. The medians are found by counting: each pass sums bytes by the next bits of (coordinate, hash of
the text), for all nodes of a level at once; the more nodes, the fewer bits, so the driver gets a bounded
histogram whatever the input. Splits are a table that is joined level by level, as small as the tree.
Points of one coordinate are cut by the hash of the text, so a group of equal texts is never cut: it lies in one shard,
however large it is. Where a group outweighs a leaf, the shards' bytes can't be near equal; its shard is as large as it is,
and the others share the rest.

Defined results: a null text has no bytes (size 1) and the crc of the empty text; null language or source is a value of
its own; equal rows may get different slots, never the same one; an empty table gives an empty result; extra columns are
ignored; missing metadata columns count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.llm._text import ident, join_groups, stored

#: Bits of a pass; rows of a slot bucket, and the most buckets of a shard.
DIGIT, BUCKET_ROWS, BUCKETS = 12, 500, 1 << 14
#: Bins of all nodes of a pass, as a power of 2.
BINS = 17
DIMS = ("x0", "x1", "x2")


def points(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """The stored points, their number and their bytes. doc_id, did, size, text_crc32, coordinates x0 to x2, and tie: 32 bits
    of the text's hash that order documents of one coordinate."""
    named = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) if c in docs.columns else F.lit(0)
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    one = docs.select(F.col(doc_id).alias("doc_id"), ident(doc_id).alias("did"), (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("th"), F.shiftright(named("lang").cast("bigint"), 1).alias("x1"), F.shiftright(named("source").cast("bigint"), 1).alias("x2"))
    one = stored(one, "rows")
    n, total = one.agg(F.count("*"), F.sum("size")).first()
    # of a text with one document, or for a large group, one row comes out of each task; only texts with more are joined
    first = one.groupBy("th", "text_crc32").agg(F.min(F.struct("did", "x1", "x2")).alias("f"), F.count("*").alias("copies"))
    first = stored(first.filter("copies > 1").select("th", "text_crc32", "copies", F.col("f.x1").alias("y1"), F.col("f.x2").alias("y2")), "texts")
    tie = F.col("th").bitwiseAND(F.lit(0xFFFFFFFF))
    pts = join_groups(one, first, ["th", "text_crc32"], n)
    return stored(pts.select("doc_id", "did", "size", "text_crc32", F.col("size").alias("x0"), F.coalesce("y1", "x1").alias("x1"), F.coalesce("y2", "x2").alias("x2"), tie.alias("tie")), "points"), n, total or 0


def _key(dim: str) -> Column:
    """63 bits: the coordinate, then the tie."""
    return F.shiftleft(F.col(dim), 32) + F.col("tie")


def _own_key() -> Column:
    """The key along the dimension that the column `dim` names."""
    return F.coalesce(*[F.when(F.col("dim") == d, _key(d)) for d in DIMS])


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as large as the tree."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _medians(at: DataFrame, dims: dict[int, str], totals: dict[int, int]) -> dict[int, int]:
    """The key of each node's dimension at which the keys below weigh half, as near as keys allow."""
    spark = at.sparkSession
    digit = max(1, min(DIGIT, BINS - len(dims).bit_length()))
    prefix, below, weight, done = dict.fromkeys(dims, 0), dict.fromkeys(dims, 0), dict.fromkeys(dims, 0), {}
    bits = 63
    while len(done) < len(dims):
        step = min(digit, bits)
        bits -= step
        open_ = [n for n in dims if n not in done]
        want = _table(spark, [(n, dims[n], prefix[n]) for n in open_], "node bigint, dim string, want bigint")
        df = at.join(want, "node").select("node", "size", "want", _own_key().alias("key"))
        part = df.filter(F.shiftright("key", bits + step) == F.col("want")).groupBy("node", F.shiftright("key", bits).alias("bin")).agg(F.sum("size").alias("w")).collect()
        bins: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
        for r in part:
            bins[r["node"]].append((r["bin"], r["w"]))
        for n in open_:
            own = sorted(bins[n])
            for b, w in own:
                prefix[n], weight[n] = b, w
                if below[n] + w >= totals[n] / 2 or b == own[-1][0]:
                    break
                below[n] += w
            if not bits:
                up = totals[n] / 2 - below[n] > weight[n] / 2  # the half is nearer with this bin below it
                done[n] = (prefix[n] + up) << bits
    return done


def _down(at: DataFrame, splits: list[tuple[int, str, int]]) -> DataFrame:
    """at with the column `node` one level on, where its node was split."""
    table = _table(at.sparkSession, splits, "node bigint, dim string, cut bigint")
    node = F.when(F.col("dim").isNull(), F.col("node")).when(_own_key() < F.col("cut"), 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
    return at.join(table, "node", "left").withColumn("node", node).drop("dim", "cut")


def kd_tree(pts: DataFrame, shards: int | None = None, target_bytes: float = 0) -> DataFrame:
    """pts with the column `node` (the root is 1, the children of n are 2 n and 2 n + 1): the leaf of each point. A node is
    split until there are `shards` leaves, a power of two, or, without that, until a leaf has target_bytes at most (a leaf
    of one text can have more)."""
    at = pts.withColumn("node", F.lit(1).cast("bigint"))
    ranges, level = None, 0

    def is_open(r) -> bool:
        if shards:
            return level < shards.bit_length() - 1
        return r["s"] > target_bytes and (r["first"] < r["last"] or any(r[f"lo{d}"] < r[f"hi{d}"] for d in DIMS))

    while True:
        # of this level alone: a row for each node
        here = at.filter(F.col("node") >= F.lit(1 << level).cast("bigint")).groupBy("node")
        stats = here.agg(F.sum("size").alias("s"), F.min(_key("x0")).alias("first"), F.max(_key("x0")).alias("last"), *[F.min(d).alias(f"lo{d}") for d in DIMS], *[F.max(d).alias(f"hi{d}") for d in DIMS]).collect()
        stats = [r for r in stats if is_open(r)]
        if not stats:
            return at
        span = lambda r, d: r[f"hi{d}"] - r[f"lo{d}"]
        ranges = ranges or {d: max(1, span(stats[0], d)) for d in DIMS}
        dims = {r["node"]: max(DIMS, key=lambda d, r=r: (span(r, d) / ranges[d], d)) for r in stats}
        found = _medians(at, dims, {r["node"]: r["s"] for r in stats})
        at = _down(at, [(n, dims[n], found[n]) for n in sorted(dims)])
        level += 1
        if level % 8 == 0:
            at = stored(at, "level")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Either the shards (a power of two), or the bytes that a shard may have, and
    then as many shards as the tree has leaves."""
    if shards is not None and (shards < 1 or shards & (shards - 1)):
        raise ValueError("a k-d tree has a power of two of leaves")
    if (shards is None) == (not target_bytes):
        raise ValueError("either the number of shards or the bytes of a shard")
    pts, n, _ = points(docs, doc_id, text)
    at = kd_tree(pts, shards, target_bytes or 0)
    if shards:
        placed = at.withColumn("shard", (F.col("node") - shards).cast("int"))
    else:
        leaves = sorted((r["node"] for r in at.select("node").distinct().collect()), key=lambda v: (v / (1 << (v.bit_length() - 1)), v))
        placed = at.join(_table(docs.sparkSession, [(v, k) for k, v in enumerate(leaves)], "node bigint, shard int"), "node")
    many = max(1, min(BUCKETS, n // BUCKET_ROWS))
    placed = placed.select("doc_id", "did", "size", "text_crc32", "shard", F.pmod(F.xxhash64("did", "text_crc32", F.lit(9)), F.lit(many)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("did", "text_crc32")).cast("bigint") - 1
    return placed.withColumn("own", own).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"))


def op6_kd_tree_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table: eight shards, whose bytes are near equal."""
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
