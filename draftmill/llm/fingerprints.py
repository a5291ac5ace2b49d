"""Document fingerprints by closed syncmers (operator 8), with DataFrame functions only.

The alphabet is that of characters, with runs of blanks `[\\x20\\x09-\\x0D]` as one blank and none at the ends. Of every
run of K characters, the hashes of its inner runs of S characters are compared; the run is an anchor if the least of
them is the first or the last. Whether a run is an anchor depends on its own characters alone, so an edit changes the
anchors of the runs that it touches and no others; of any 2 K - S - 1 characters one run at least is an anchor. An anchor
has a hash and a place, so two documents are matched by position: `positional_matches` counts the common anchors of each
shift between them. The fingerprint is the anchors' hashes in text order (8 hex digits each, the places in a column of
their own); a likeness is the Jaccard index of the full hashes of two documents' anchors.

Defined results: a null text counts as empty; a text of blanks alone has no anchors; a text of which no run is an anchor,
as one of fewer than K characters, has one, the whole text; two fingerprints without anchors, those of texts of blanks,
are alike (1), one with and one without are not (0); a missing doc_id counts as the largest; among rows of one doc_id the
hash of the text gives the order; a single document is its own next; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.llm._text import NO_ID, ident

#: Characters of a run and of its inner runs; the inner runs between the first and the last are 2 ** k.
K, S = 8, 3
#: Documents of a range of ids, and the most ranges whose bounds go to the executors; bytes of text of a range, above
#: which each range is cut evenly into parts.
RANGE_ROWS, RANGES, RANGE_BYTES = 100, 4096, 64 << 20
_BLANKS = " \t\n\x0b\f\r"


def _let(x: Column, f) -> Column:
    """f(x) with x computed once: a lambda's variable holds the value itself, without a copy for each access."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def plain(text: Column) -> Column:
    """The text with runs of blanks as one blank, and none at the ends."""
    return F.regexp_replace(F.btrim(text, F.lit(_BLANKS)), "[\\x20\\x09-\\x0D]+", " ")


def _run(u: Column, at: Column, size: int) -> Column:
    """The hash of `size` characters of a text in UTF-32."""
    return F.xxhash64(F.substring(u, 4 * at + 1, F.lit(4 * size)))


def with_runs(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the anchors among the runs of a plain text, in text order: their places `name`_at and hashes `name`_h. The text
    goes in four bytes a character, so that a run is cut out without a scan from the text's start."""
    n, last = F.length(text), K - S
    u, none = F.encode(text, "UTF-32"), lambda kind: F.array().cast(f"array<{kind}>")

    def chosen(h: Column) -> Column:
        def anchor(i: Column) -> Column:
            inner = F.least(*[F.get(h, i + k) for k in range(1, last)])
            return F.least(F.get(h, i), F.get(h, i + last)) <= inner

        return F.filter(F.sequence(F.lit(0), n - K), anchor)

    places = _let(_let(u, lambda u: F.transform(F.sequence(F.lit(0), n - S), lambda i: _run(u, i, S))), chosen)
    df = df.withColumn(f"{name}_at", F.when(n >= K, places).otherwise(none("int")))
    return df.withColumn(f"{name}_h", _let(u, lambda u: F.transform(f"{name}_at", lambda i: _run(u, i, K))))


def or_whole(name: str, length: Column, whole: Column) -> list[Column]:
    """The anchors, or where there are none the whole plain text as one (none of an empty text)."""
    known = (F.size(f"{name}_at") > 0) | (length == 0)
    return [F.when(known, F.col(f"{name}_at")).otherwise(F.array(F.lit(0))).alias(f"{name}_at"), F.when(known, F.col(f"{name}_h")).otherwise(F.array(whole)).alias(f"{name}_h")]


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the anchors of the text in text order, `name`_at and `name`_h."""
    own, columns = f"__t_{name}", df.columns
    df = with_runs(df.withColumn(own, plain(F.col(text))), own, name)
    return df.select(*columns, *or_whole(name, F.length(own), F.xxhash64(own)))


def with_joined(df: DataFrame, left: str, left_runs: str, right: str, right_runs: str, name: str) -> DataFrame:
    """Adds the anchors of the concatenation of two texts, left and right, without hashing them again: whether a run is an
    anchor depends on its own characters alone, so those of the joined text are those inside left, those inside right,
    and those of the few runs that lie across. left_runs and right_runs: anchors (with_runs) of plain texts that begin with
    plain left and plain right."""
    c, columns = lambda x: f"__{x}_{name}", df.columns
    blank = F.lit("[\\x20\\x09-\\x0D]")
    df = df.withColumn(c("l"), plain(F.col(left))).withColumn(c("r"), plain(F.col(right)))
    p, q = F.length(c("l")), F.length(c("r"))
    apart = (p > 0) & (q > 0) & (F.rlike(F.right(left, F.lit(1)), blank) | F.rlike(F.left(right, F.lit(1)), blank))
    df = df.withColumn(c("sep"), F.when(apart, " ").otherwise("")).withColumn(c("p"), p).withColumn(c("q"), q)
    df = with_runs(df.withColumn(c("x"), F.concat(F.right(c("l"), F.lit(K - 1)), c("sep"), F.left(c("r"), F.lit(K - 1)))), c("x"), c("x"))
    inside = lambda runs, size: _let(F.col(size), lambda m: F.filter(f"{runs}_at", lambda at: at + K <= m))
    moved = lambda places, by: _let(by, lambda n: F.transform(places, lambda at: at + n))
    df = df.withColumn(c("a"), inside(left_runs, c("p"))).withColumn(c("b"), inside(right_runs, c("q")))
    start, rest = F.greatest(F.col(c("p")) - (K - 1), F.lit(0)), F.col(c("p")) + F.length(c("sep"))
    at = F.concat(c("a"), moved(f"{c('x')}_at", start), moved(c("b"), rest))
    h = F.concat(F.slice(f"{left_runs}_h", F.lit(1), F.size(c("a"))), f"{c('x')}_h", F.slice(f"{right_runs}_h", F.lit(1), F.size(c("b"))))
    df = df.withColumn(f"{name}_at", at).withColumn(f"{name}_h", h)
    return df.select(*columns, *or_whole(name, F.col(c("p")) + F.col(c("q")), F.xxhash64(F.concat(c("l"), c("sep"), c("r")))))


def likeness(a: str, b: str) -> Column:
    """Of two columns of hashes."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def shown(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def positional_matches(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, shift, n) of each pair of texts with anchors a and b: how many anchors both have at places `shift` apart."""
    side = lambda x, at: pairs.select(key, F.explode(F.arrays_zip(F.col(f"{x}_h").alias("h"), F.col(f"{x}_at").alias("at"))).alias("x")).select(key, "x.h", F.col("x.at").alias(at))
    return side(a, "p").join(side(b, "q"), [key, "h"]).groupBy(key, (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("n"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and positions of every document."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return with_anchors(texts, "text", "own").select("doc_id", shown("own_h").alias("fingerprint"), F.col("own_at").alias("positions"))


def _ranged(docs: DataFrame) -> DataFrame:
    """Adds `b`, the range that a document (did, th) is in, and `halo`: the first document of each range comes a second
    time, in the range before it (that of the first range in the last), so that each document's next is in its range.
    Documents go by descending did, then ascending th; rows without an id are a range of their own, cut by th. A range is
    cut into as many parts as its bytes need, so there are more of them as the table grows."""
    n, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    most = max(1, min(RANGES, n // RANGE_ROWS))
    parts = max(1, -(-(n_bytes or 0) // (most * RANGE_BYTES)))
    real = docs.filter(F.col("did") != NO_ID)
    found = real.agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.percentile_approx("did", [k / most for k in range(1, most)] or [0.5], 10 * most + 1000).alias("x")).first()
    cuts = sorted({x for x in (found["x"] or []) if found["lo"] <= x < found["hi"]}) if most > 1 else []
    steps = max(1, len(cuts).bit_length())
    top = (1 << 63) - 1
    bounds = F.array(*[F.lit(x).cast("bigint") for x in [*cuts, *[top] * ((1 << steps) - len(cuts))]])
    # how many cuts lie below: binary search, 2 ** steps bounds
    find = F.aggregate(F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)]), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) < F.col("did")), at + step).otherwise(at))
    edges = F.array(*[F.lit(x).cast("double") for x in [found["lo"] or 0, *cuts, found["hi"] or 0]])
    lo, hi = F.get(edges, F.col("c")), F.get(edges, F.col("c") + 1)
    share = F.when(F.col("did") == NO_ID, F.lit(0.5) - F.col("th").cast("double") / F.lit(2.0**64)).otherwise((F.col("did").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)))
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts))).cast("bigint")
    df = docs.withColumn("c", F.when(F.col("did") == NO_ID, len(cuts) + 1).otherwise(find)).withColumn("b", F.col("c") * F.lit(parts).cast("bigint") + part).drop("c")
    # a row for each range: its first document, and the range before it
    first = df.groupBy("b").agg(F.max(F.struct("did", F.bitwise_not("th").alias("not_th"))).alias("m"))
    order = Window.orderBy(F.desc("b"))
    last = F.min("b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = first.select("m.did", F.bitwise_not("m.not_th").alias("th"), F.coalesce(F.lag("b").over(order), last).alias("before"))
    # a range has one first document, so copies are as many as ranges (equal rows, by id and text, come together)
    halo = df.drop("b").join(F.broadcast(first), ["did", "th"]).select("doc_id", "did", "th", "text", F.col("before").alias("b"), F.lit(True).alias("halo"))
    return df.select("doc_id", "did", "th", "text", "b", F.lit(False).alias("halo")).unionByName(halo)


def op8_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table. The texts are shuffled once, by ranges of doc_id."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document and its text with the last half replaced by the start of the next document: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions. A document's runs are hashed once:
    the edited text's anchors are put together from those of its two parts."""
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.select(F.col(doc_id).alias("doc_id"), ident(doc_id).alias("did"), F.xxhash64(full).alias("th"), full.alias("text"))
    placed = with_runs(_ranged(docs).repartition("b").withColumn("plain", plain(F.col("text"))), "plain", "own")
    placed = placed.withColumn("whole", F.xxhash64("plain")).withColumn("size", F.length("plain")).drop("plain")
    order = Window.partitionBy("b").orderBy("halo", F.desc("did"), "th")
    placed = placed.withColumn("next", F.lead(F.struct("text", "own_at", "own_h", "whole", "size")).over(order)).filter(~F.col("halo"))
    placed = placed.select("doc_id", "text", "own_at", "own_h", "whole", "size", *[F.col(f"next.{x}").alias(f"next_{x}") for x in ("whole", "size")], F.col("next.own_at").alias("next_at"), F.col("next.own_h").alias("next_h"), F.col("next.text").alias("next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    halves = placed.withColumn("head", F.substring("text", F.lit(1), n - half)).withColumn("tail", F.substring("next", F.lit(1), half)).drop("next")
    out = with_joined(halves, "head", "own", "tail", "next", "edited")
    kept = ["doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"), "edited_h"]
    out = out.select(*kept, *or_whole("own", F.col("size"), F.col("whole")), or_whole("next", F.col("next_size"), F.col("next_whole"))[1])
    return out.select("doc_id", "n_chars", "edited_sha256", shown("own_h").alias("fingerprint"), shown("edited_h").alias("edited_fingerprint"), likeness("own_h", "edited_h").alias("near_edited"), likeness("own_h", "next_h").alias("near_next"), F.col("own_at").alias("positions"))
