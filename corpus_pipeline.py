"""From raw documents to token ids in five stages, each of which calls one corpus operator.

A stage's result is written before the next stage starts (by `run`, or by whoever calls the stages); the tables that the
stages before have stored are deleted then, unless the documents still read them. Every stage takes what the stage before it kept, as rows of documents (doc_id, text, lang, source, n_chars); the last
returns the token ids and a hash of the text decoded from them. Empty tables go through all stages; rows of null text are rejected by the first.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm import bpe, decontaminate, language_id, near_dedup, substring_dedup
from draftmill.llm._text import CREATED, discard_since, discard_unread, ident, stored
from draftmill.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language ID rejects texts without letters, and those of which no language gets this mean probability.
LEAST_SCORE = 0.3
#: Near duplicates have this share of common shingles, in percent.
NEAR = 80


#: Tables that the stages have stored and that may still be needed.
_LEFT: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        _LEFT[:] = discard_unread(spark, _LEFT, docs)
        mark = len(CREATED)
        out = f(spark, docs, sf_dir)
        _LEFT.extend(CREATED[mark:])
        return out

    return stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents; documents whose language can't be told go. lang becomes the prediction."""
    names, net = language_id.fit(docs)
    found = language_id.predict(docs.select(*COLUMNS), names, net)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the least doc_id (a missing one is the largest), among
    rows of one doc_id that of the least hash of its text, and one of equal rows. Every row has a key of its own."""
    own = (F.monotonically_increasing_id().alias("__key"), ident().alias("__did"), F.xxhash64(F.col("text").cast("string")).alias("__th"))
    docs = stored(docs.select(*COLUMNS, *own), "keyed")
    found = near_dedup.near_duplicates(docs, NEAR, doc_id="__key").select(F.col("did").alias("__key"), "component")
    first = F.min(F.struct("__did", "__th", "__key")).alias("m")
    kept = docs.select("__key", "__did", "__th").join(found, "__key").groupBy("component").agg(first).select(F.col("m.__key").alias("__key"))
    return docs.join(kept, "__key", "left_semi").select(*COLUMNS)


@_stage
def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; texts without such words stay as they are."""
    # smaller chunks than by default, as the executors still hold what earlier stages took
    out = substring_dedup.remove_repeated(docs, carry=["lang", "source"], chunk_bytes=4 << 20)
    return out.select("doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source", F.length("kept_text").cast("bigint").alias("n_chars"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    mark = len(CREATED)
    # smaller segments than by default, for the same reason as the chunks above
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), segment=4 << 20)
    bad = stored(found.filter("contaminated").select(F.coalesce("doc_id", F.lit(-1)).alias("__bad"), F.col("th").alias("__th")).distinct(), "bad")
    discard_since(spark, mark, bad)
    bad = decontaminate.if_small(bad, F.lit(16))  # the texts stay where they are, unless very many are bad
    mine = (F.coalesce("doc_id", F.lit(-1)) == F.col("__bad")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__th"))
    return docs.join(bad, mine, "left_anti").select(*COLUMNS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, sha256 of the text decoded from them, and their number."""
    return bpe.round_trip(docs).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language ID", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("passage removal", remove_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The first stage is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs
