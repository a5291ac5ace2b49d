"""Images and OCR payloads as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("tif", "tiff", "jpg", "jpeg", "png", "bmp", "webp")


def catalog(spark: SparkSession, root: str, *excluded: str) -> DataFrame:
    """One row for each image under root: path, folder (the first part below root), node_id, image_name, image_key, size
    in KB and 16 digits of the content's hash. Folders are excluded whatever their case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.split(F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split(":")[-1] + "/", ""), "/")
    df = files.filter(F.lower(F.col("path")).rlike(r"\.(" + "|".join(SUFFIXES) + ")$")).select("path", F.get(below, 0).alias("folder"), F.element_at(F.split("path", "/"), -2).alias("node_id"), F.element_at(F.split("path", "/"), -1).alias("image_name"), F.round(F.col("length") / 1024, 1).alias("filesize_kb"), F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))
    return df.filter(~F.lower("folder").isin(*[x.lower() for x in excluded]) if excluded else F.lit(True)).withColumn("image_key", F.concat_ws("/", "node_id", "image_name"))


def parallel_arrays(df: DataFrame) -> DataFrame:
    """Readings of a payload with arrays text, conf (0 to 100, below 0 for none), left, top, width, height."""
    one = df.select("sheet_id", F.posexplode(F.arrays_zip("text", "conf", "left", "top", "width", "height")).alias("seq", "r"))
    one = one.filter((F.trim("r.text") != "") & (F.col("r.conf") >= 0))
    return one.select("sheet_id", "seq", F.col("r.text").alias("text"), F.col("r.left").alias("x0"), F.col("r.top").alias("y0"), (F.col("r.left") + F.col("r.width")).alias("x1"), (F.col("r.top") + F.col("r.height")).alias("y1"), (F.col("r.conf") / 100.0).alias("conf"))


def polygons(df: DataFrame) -> DataFrame:
    """Readings of a payload with arrays texts, scores and polys (points of x and y): boxes around the points."""
    one = df.select("sheet_id", F.posexplode(F.arrays_zip("texts", "scores", "polys")).alias("seq", "r")).filter(F.trim("r.texts") != "")
    side = lambda i, f: f(F.transform("r.polys", lambda p: F.get(p, i)))
    return one.select("sheet_id", "seq", F.col("r.texts").alias("text"), F.floor(side(0, F.array_min)).cast("int").alias("x0"), F.floor(side(1, F.array_min)).cast("int").alias("y0"), F.ceil(side(0, F.array_max)).cast("int").alias("x1"), F.ceil(side(1, F.array_max)).cast("int").alias("y1"), F.coalesce("r.scores", F.lit(0.0)).alias("conf"))
