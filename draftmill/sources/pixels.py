"""Pixels of images as rows: ink as runs of scan lines, runs as components, and the height of characters from them.

images: path, and image as Spark's image source gives it. Pixels are only looked at where an image lies in one row: its part
is made grey, split into ink and paper by Otsu's threshold, and left as runs. From there on all is relational, but for the
joining of touching runs, a union of sets folded over an image's runs.

Defined results: an image that can't be decoded has no runs and the verdict `unreadable_file`; grey is 0.299 red + 0.587
green + 0.114 blue, rounded; images of one grey have no ink if they are white, or else one component; fewer than ten
components give the height 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions import repair
from draftmill.functions import text as X
from draftmill.operators.folding import folded
from draftmill.sources import images as I

#: The part of an image that is looked at: from these shares of its width and height on.
CORNER = (0.60, 0.60)
#: Characters: least and largest height, least width, least share of ink in the box, largest ratio of the sides.
LEAST_HEIGHT, MOST_SIDE, LEAST_WIDTH, LEAST_INK, MOST_RATIO, FEWEST = 3, 120, 2, 0.15, 8, 10


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of grey values; channels are blue, green, red (and alpha), or grey alone."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    return np.rint(a[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(a: np.ndarray) -> int:
    """The first grey value at which values up to it and those above it lie apart the most."""
    counts = np.bincount(a.ravel(), minlength=256).astype(float)
    below, weight = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * (below[-1] - below) * (weight / below - (weight[-1] - weight) / (below[-1] - below)) ** 2
    return int(np.nan_to_num(apart).argmax())


def _runs(corner: tuple[float, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = grey(data, height, width, channels)[int(height * corner[1]) :, int(width * corner[0]) :]
                if not a.size:
                    continue
                ink = np.pad(a <= otsu(a), ((0, 0), (1, 1))).astype(np.int8)
                y, x = np.nonzero(np.diff(ink, axis=1))  # starts and ends in turn
                yield pa.RecordBatch.from_arrays([pa.array([path] * (len(y) // 2), pa.string()), *(pa.array(v.astype(np.int32)) for v in (y[::2], x[::2], x[1::2]))], ["path", "y", "x0", "x1"])

    return run


def ink_runs(images: DataFrame, corner: tuple[float, float] = CORNER) -> DataFrame:
    """(path, y, x0, x1): the runs of ink in an image's lower right part, x1 excluded."""
    ok = images.filter(F.col("image.height") > 0).select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return ok.mapInArrow(_runs(corner), "path string, y int, x0 int, x1 int")


def components(runs: DataFrame, key: str = "path") -> DataFrame:
    """(key, part, width, height, area) of what runs make up that touch, also by a corner."""

    def fold(rows: list[tuple]) -> list[int]:
        first = list(range(len(rows)))

        def find(k: int) -> int:
            while first[k] != k:
                first[k] = first[first[k]]
                k = first[k]
            return k

        above = here = 0  # where the line above, and this line, begin
        near = 0
        for k, (y, x0, x1) in enumerate(rows):
            if y != rows[here][0]:
                above = here if rows[here][0] == y - 1 else k
                here, near = k, above
            while near < here and rows[near][2] < x0:
                near += 1
            other = near
            while other < here and rows[other][1] <= x1:
                a, b = find(k), find(other)
                first[max(a, b)] = min(a, b)
                other += 1
        return [find(k) for k in range(len(rows))]

    joined = folded(runs, key, ["y", "x0"], ["y", "x0", "x1"], fold, "part")
    return joined.groupBy(key, "part").agg((F.max("x1") - F.min("x0")).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.sum(F.col("x1") - F.col("x0")).alias("area"))


def char_heights(parts: DataFrame, key: str = "path") -> DataFrame:
    """(key, height, components): the height that a tenth of an image's characters exceed, and their number."""
    w, h = F.col("width"), F.col("height")
    ok = h.between(LEAST_HEIGHT, MOST_SIDE) & w.between(LEAST_WIDTH, MOST_SIDE) & (F.col("area") >= LEAST_INK * w * h) & (w <= MOST_RATIO * h) & (h <= MOST_RATIO * w)
    n = F.count("*")
    return parts.filter(ok).groupBy(key).agg(F.when(n >= FEWEST, F.percentile("height", 0.9)).otherwise(0.0).alias("height"), n.alias("components"))


def assessed(images: DataFrame) -> DataFrame:
    """(path, char_height, components, verdict, width, height) of each image."""
    found = char_heights(components(ink_runs(images))).withColumnRenamed("height", "char_height")
    size = images.select("path", F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    out = size.join(found, "path", "left").withColumns({"char_height": F.coalesce("char_height", F.lit(0.0)), "components": F.coalesce("components", F.lit(0))})
    bad = F.col("height") <= 0
    return out.select("path", F.bround("char_height", 1).alias("char_height"), "components", F.when(bad, "unreadable_file").otherwise(X.verdict(F.col("char_height"))).alias("verdict"), *[F.when(~bad, F.col(c)).alias(c) for c in ("width", "height")])


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path and image of all images under root; those that can't be decoded stay, with a height of -1."""
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root).select(F.col("image.origin").alias("path"), "image")


def manifest(spark: SparkSession, root: str, *excluded: str) -> DataFrame:
    """A row for each image: the catalog's columns, the series, and what was assessed."""
    files = I.catalog(spark, root, *excluded)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = assessed(read_images(spark, root)).withColumn("__p", plain("path")).drop("path")
    return files.withColumn("series", repair.series(F.col("path"))).withColumn("__p", plain("path")).join(seen, "__p", "left").drop("__p").withColumn("verdict", F.coalesce("verdict", F.lit("unreadable_file")))


def _ruled(percentile: float, share: float, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = grey(data, height, width, channels)
                ink = a < np.percentile(a, percentile)
                for across in (True, False):
                    one = np.pad(ink if across else ink.T, ((0, 0), (1, 1))).astype(np.int8)
                    at, p = np.nonzero(np.diff(one, axis=1))
                    at, p0, p1 = at[::2].astype(float), p[::2].astype(float), p[1::2].astype(float)
                    long = p1 - p0 >= max(int((width if across else height) * share), least)
                    at, p0, p1 = at[long], p0[long], p1[long]
                    sides = (p0, at, p1, at) if across else (at, p0, at, p1)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(np.full(len(at), across)), pa.array(np.arange(len(at), dtype=np.int32)), *map(pa.array, sides)], ["sheet_id", "horizontal", "seq", "x0", "y0", "x1", "y1"])

    return run


def ruled_runs(images: DataFrame, percentile: float = 15.0, share: float = 0.10, least: int = 25) -> DataFrame:
    """The long runs of dark pixels of images, along rows and columns, as lines (sheet_id, the path; horizontal, seq, x0 to
    y1): those that an opening with a bar of their length would leave. Dark: below a percentile of the image's greys. Runs
    of one place add up in locate.line_places, which gives the places of frames."""
    ok = images.filter(F.col("image.height") > 0).select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return ok.mapInArrow(_ruled(percentile, share, least), "sheet_id string, horizontal boolean, seq int, x0 double, y0 double, x1 double, y1 double")


def pages(images: DataFrame) -> DataFrame:
    """(sheet_id, w, h) of the images that can be decoded."""
    return images.filter(F.col("image.height") > 0).select(F.col("path").alias("sheet_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"))
