"""The log of image states: latest state, listing, overlay of manual reviews, roll-ups, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key. max_by sums up before the shuffle, so a key with many rows is one row a task."""
    rest = [c for c in log.columns if c != key]
    one = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return one.select(key, *[f"r.{c}" for c in rest])


def listing(catalog: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Every image, with its state or the defaults."""
    return catalog.join(state, key, "left").withColumn("status", F.coalesce("status", F.lit(0))).withColumn("reviewed", F.coalesce("reviewed", F.lit(0)))


def missing(catalog: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return catalog.join(state, key, "left_anti")


def overlay(base: DataFrame, reviews: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of a review replace those there are; null never clears, an empty text does replace."""
    r = reviews.select(key, F.lit(1).alias("__seen"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(r, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns} | {"reviewed": F.coalesce("__seen", F.lit(0))}).drop("__seen", *[f"__{c}" for c in columns])


def counts(state: DataFrame) -> DataFrame:
    """Images by folder, and by status, in one pass."""
    return state.groupingSets([["folder"], ["status"]], "folder", "status").agg(F.count("*").alias("n"))


def roll_up(state: DataFrame, task: str) -> DataFrame:
    """A task's state: running before pending before completed before failed."""
    s = F.col("status")
    of = F.when(F.max((s == 1).cast("int")) == 1, "running").when(F.max((s == 0).cast("int")) == 1, "pending").when(F.min((s == 2).cast("int")) == 1, "completed").otherwise("failed")
    return state.groupBy(task).agg(of.alias("task_status"), F.count("*").alias("total"), F.count_if((s == 2) | (s == 3)).alias("done"), F.count_if(s == 3).alias("failures"), F.min("updated_at").alias("started"), F.max("updated_at").alias("finished"))


def progress(state: DataFrame) -> DataFrame:
    open_ = F.count_if(F.col("status").isin(0, 1))
    return state.agg(F.when(F.count("*") == 0, 0.0).otherwise(F.round((1 - open_ / F.count("*")) * 100, 2)).alias("progress"), F.count("*").alias("total"))


def export(catalog: DataFrame, state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The chosen images with their state, by folder and key; keys that no image has are left out (see `unknown`)."""
    return catalog.join(keys, key, "left_semi").join(state, key)


def unknown(catalog: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.join(catalog, key, "left_anti")


def exported(catalog: DataFrame, state: DataFrame, key: str, keys: DataFrame | None = None, code: int | None = None, folder: str | None = None) -> DataFrame:
    """The chosen images (all without keys) with their state, of one status and folder (whatever its case) if given, in
    the order of folder and key. Keys that no image has: see `unknown`; an export with any is refused by its caller."""
    rows = catalog if keys is None else catalog.join(keys, key, "left_semi")
    rows = rows.join(state, key, "left").withColumn("status", F.coalesce("status", F.lit(0)))
    if code is not None:
        rows = rows.filter(F.col("status") == code)
    if folder is not None:
        rows = rows.filter(F.lower("folder") == folder.strip().lower())
    return rows.orderBy("folder", key)


def rerun(catalog: DataFrame, state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """What becomes of each key that is asked for again: `not found` without an image, `conflict` while it runs, else `ok`."""
    known = catalog.select(key, F.lit(True).alias("__known"))
    running = state.filter("status = 1").select(key, F.lit(True).alias("__running"))
    out = keys.select(key).distinct().join(known, key, "left").join(running, key, "left")
    return out.select(key, F.when(F.col("__known").isNull(), "not found").when(F.col("__running"), "conflict").otherwise("ok").alias("outcome"))


def failed(state: DataFrame, message: str, updated_at: int, owned: DataFrame | None = None, key: str = "image_key") -> DataFrame:
    """New rows of the log that end what still runs (of the owned keys alone, if given), as after a restart."""
    rows = state.filter("status = 1")
    rows = rows if owned is None else rows.join(owned, key, "left_semi")
    return rows.withColumns({"status": F.lit(3), "message": F.lit(message), "updated_at": F.lit(updated_at).cast("bigint")})


def seeded_counts(state: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, status, n): images of each known folder, and of each status from 0 to 3, 0 for none."""
    by = state.groupBy("folder").agg(F.count("*").alias("n"))
    known = folders.select("folder").distinct().join(by, "folder", "left").select("folder", F.lit(None).cast("int").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    codes = state.sparkSession.range(4).select(F.col("id").cast("int").alias("status"))
    own = codes.join(state.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select(F.lit(None).cast(folders.schema["folder"].dataType).alias("folder"), "status", F.coalesce("n", F.lit(0)).alias("n"))
    return known.unionByName(own)


def preview(rows: DataFrame) -> DataFrame:
    """Images of each folder, the most first, with the total."""
    one = rows.groupBy("folder").agg(F.count("*").alias("n"))
    return one.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "folder")


def page(rows: DataFrame, number: int, size: int = 20, *order: str) -> DataFrame:
    """A page of a list, from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def folders(rows: DataFrame, code: int | None = None) -> DataFrame:
    """Images of each folder by its name, of one status if given; a missing folder is `Unknown folder`."""
    rows = rows if code is None else rows.filter(F.col("status") == code)
    return rows.groupBy(F.coalesce("folder", F.lit("Unknown folder")).alias("folder")).agg(F.count("*").alias("n")).orderBy("folder")


def shown_boxes(fields: DataFrame, least: float = 0.3, without: tuple[str, ...] = ("drawing_type",)) -> DataFrame:
    """The fields (name, box x0 to y1, confidence) that are drawn on an image: those with a box of some extent and enough
    confidence (1 if missing)."""
    extent = (F.col("x0") != F.col("x1")) & (F.col("y0") != F.col("y1"))
    return fields.filter(~F.col("name").isin(*without) & extent & (F.coalesce("confidence", F.lit(1.0)) >= least))


def resolved(catalog: DataFrame, folder: str, node_id: str, image_name: str) -> DataFrame:
    """The image of a folder (whatever its case), node and name, as one row or none. Only the catalog is asked, so that no
    name can lead out of it."""
    plain = F.lit("/" not in node_id + image_name and "\\" not in node_id + image_name)
    return catalog.filter(plain & (F.upper("folder") == folder.upper()) & (F.col("node_id") == node_id) & (F.col("image_name") == image_name))


def marked_results(states: DataFrame, results: DataFrame, fields: tuple[str, ...], sure: float = 0.75) -> DataFrame:
    """A row for each image as it is exported: image_key, reviewed, each field's value, and, if any image is not reviewed,
    its confidence (none for reviewed images) and whether it is marked as low (below `sure`, strictly). states: image_key,
    reviewed; results: image_key, name, value, conf."""
    told = states.filter("reviewed = 0").limit(1).count() > 0
    own = [F.max(F.when(F.col("name") == f, F.struct("value", "conf"))).alias(f) for f in fields]
    wide = states.select("image_key", "reviewed").join(results.groupBy("image_key").agg(*own), "image_key", "left")
    open_ = F.col("reviewed") == 0
    columns = []
    for f in fields:
        columns.append(F.col(f"{f}.value").alias(f))
        if told:
            columns.append(F.when(open_, F.col(f"{f}.conf")).alias(f"{f}_conf"))
            columns.append(F.coalesce(open_ & (F.col(f"{f}.conf") < sure), F.lit(False)).alias(f"{f}_low"))
    return wide.select("image_key", "reviewed", *columns)
