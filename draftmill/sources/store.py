"""The store of image states as JSON files, and what is written beside it.

A store file is one JSON object of states by image key, or such an object under `images` (as older versions wrote). Keys
are paths whose last two parts are node and image, with either slash.

Defined results: a file that can't be read as such an object is one row with `error` and no key; entries that are no
objects, and keys of fewer than two parts, are passed over; of states of one key in a file the last one stands. `migrated`
says that reading has changed a state's result or its mark of review, so that the file should be written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftmill.functions import repair
from draftmill.functions import text as X
from draftmill.functions.staging import stage
from draftmill.operators.records import FIELDS

STATE = ("image_key", "node_id", "image_name", "status", "task_uuid", "message", "updated_at", "manual_reviewed", "result")


def _at(item: str, name: str | None, kind: str, may_fail: bool = True) -> Column:
    """A part of a variant (or the whole), as a kind."""
    path = "$" if name is None else f"$.{name}"
    return F.expr(f"{'try_' if may_fail else ''}variant_get({item}, '{path}', '{kind}')")


def _given(item: str, name: str | None = None) -> Column:
    """A value as text; null for JSON's null, and where there is none."""
    v = _at(item, name, "variant", False)
    return F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), F.coalesce(_at(item, name, "string"), F.to_json(v)))


def _kind(item: str, name: str | None = None) -> Column:
    return F.coalesce(F.schema_of_variant(_at(item, name, "variant", False)), F.lit("NONE"))


def _texts(item: str) -> Column:
    """The values of a list, its lists' values among them, as trimmed texts, each once; a single value as a list of one."""
    listed = F.expr(f"flatten(transform(coalesce(try_variant_get({item}, '$', 'array<variant>'), array()), x -> coalesce(try_variant_get(x, '$', 'array<string>'), array(try_variant_get(x, '$', 'string')))))")
    return X.notes(F.when(_kind(item).startswith("ARRAY"), listed).when(F.col(item).isNull(), F.array().cast("array<string>")).otherwise(F.array(_given(item))))


def result_reasons(states: DataFrame, result: str = "result", key: str = "image_key") -> DataFrame:
    """(image_key, field, reason, notes, migrated) of the fields of results (a variant) that have a reason or notes. Of a
    list of reasons the first that is known is the reason, the others are notes; a single one stays as it is, trimmed.
    migrated: the stored ones differ."""
    own = states.select(key, F.expr(f"cast({result} AS map<string, variant>)").alias("m"), F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    stored = lambda what: F.try_element_at("m", F.concat("field", F.lit(what)))
    own = own.select(key, "field", stored("_reason").alias("r"), stored("_notes").alias("n")).filter("r IS NOT NULL OR n IS NOT NULL")
    own = stage(own, listed=_kind("r").startswith("ARRAY"), given=_texts("r"), noted=_texts("n"), plain=_given("r"))
    reason = F.when(F.col("listed"), X.reason_of(F.col("given"))).otherwise(F.nullif(F.trim("plain"), F.lit("")))
    notes = F.when(F.col("listed"), F.array_distinct(F.concat("noted", X.other_notes(F.col("given"))))).otherwise(F.col("noted"))
    own = stage(own, reason=reason, notes=notes)
    same = F.col("r").isNotNull() & ~F.col("listed") & F.col("plain").eqNullSafe(F.col("reason")) & _kind("n").startswith("ARRAY") & _at("n", None, "array<string>").eqNullSafe(F.col("notes"))
    return own.select(key, "field", "reason", "notes", (~F.coalesce(same, F.lit(False))).alias("migrated"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The states of the store files under path: STATE (the result as a variant), migrated, file, error."""
    return states_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def states_of(files: DataFrame) -> DataFrame:
    """The same of store files that were read: file, value (its text)."""
    files = files.select("file", "value", F.try_parse_json("value").alias("v"))
    is_object = lambda c: F.coalesce(F.expr(f"schema_of_variant({c})").startswith("OBJECT"), F.lit(False))
    # read as maps, as these keep the entries' order, which a variant doesn't
    wrapped = F.when(is_object("variant_get(v, '$.images', 'variant')"), F.from_json("value", "images map<string,variant>")["images"])
    files = files.withColumn("own", F.coalesce(wrapped, F.when(is_object("v"), F.from_json("value", "map<string,variant>"))))
    each = files.filter("own IS NOT NULL").select("file", F.posexplode(F.map_entries("own")).alias("k", "e")).select("file", "k", F.col("e.key").alias("key"), F.col("e.value").alias("s")).filter(is_object("s"))
    parts = F.filter(F.split(F.replace(F.col("key"), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    each = each.withColumn("parts", parts).filter(F.size("parts") >= 2)
    named = lambda k, at: F.coalesce(F.nullif(_given("s", k), F.lit("")), F.element_at("parts", at))
    each = each.withColumns({"node_id": named("node_id", -2), "image_name": named("image_name", -1)}).withColumn("image_key", F.concat_ws("/", "node_id", "image_name"))
    last = Window.partitionBy("file", "image_key").orderBy(F.desc("k"))
    each = each.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    mark, kind = _given("s", "manual_reviewed"), _kind("s", "manual_reviewed")
    plain = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & mark.isin("0", "1")
    result = F.when(_kind("s", "result").startswith("OBJECT"), _at("s", "result", "variant", False)).otherwise(F.parse_json(F.lit("{}")))
    out = each.select("image_key", "node_id", "image_name", X.image_status(F.coalesce(_given("s", "status"), F.lit(""))).alias("status"), _given("s", "task_uuid").alias("task_uuid"), F.coalesce(F.nullif(_given("s", "message"), F.lit("")), _given("s", "error")).alias("message"), _at("s", "updated_at", "bigint").alias("updated_at"), repair.reviewed(mark).alias("manual_reviewed"), result.alias("result"), (~plain).alias("unplain"), "file")
    moved = result_reasons(out.withColumn("image_key", F.struct("file", "image_key"))).groupBy("image_key").agg(F.bool_or("migrated").alias("moved")).select("image_key.*", "moved")
    out = out.join(moved, ["file", "image_key"], "left").withColumn("migrated", F.col("unplain") | F.coalesce("moved", F.lit(False)))
    bad = files.filter("own IS NULL").select("file", F.lit("no object of states").alias("error"))
    return out.select(*STATE, "migrated", "file", F.lit(None).cast("string").alias("error")).unionByName(bad, allowMissingColumns=True)


def append_log(states: DataFrame, path: str) -> None:
    """Adds states (STATE, the result as JSON text) to the log, partitioned by the day of their change; what is in the log
    stays as it is, and a job that fails adds nothing."""
    day = F.coalesce(F.to_date(F.timestamp_millis("updated_at")), F.to_date(F.lit("1970-01-01")))
    states.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def log_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each image in the log."""
    log = spark.read.parquet(path)
    last = Window.partitionBy("image_key").orderBy(F.col("updated_at").desc_nulls_last(), F.col("status").desc(), F.xxhash64(*[c for c in log.columns if c != "day"]))
    return log.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "day")


def write_sidecars(records: DataFrame, path: str, node: str = "node_id") -> None:
    """One JSON line for each record, in a folder for each node; records keep a name of their own (unlike files that are
    named by node alone, images of one node don't replace one another)."""
    whole = F.to_json(F.struct(*[c for c in records.columns]), {"ignoreNullFields": "false"})
    records.select(F.col(node).alias("node"), whole.alias("value")).write.mode("overwrite").partitionBy("node").text(path)


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records from their sidecars; a line that is no record has null fields and is in `broken`."""
    full = f"{schema}, broken string"
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "broken"}).alias("r")).select("r.*")


def write_rows(rows: DataFrame, path: str) -> None:
    """Flat rows as CSV with a header; texts are quoted, so that blanks at their ends and empty ones come back."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("escape", '"').csv(path)
