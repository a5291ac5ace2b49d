"""What OCR engines return, as readings: a function of one payload (JSON text) to many rows, by Arrow batches.

payloads: sheet_id, pass, engine, payload, factor (how much the image was enlarged), width, height (of the enlarged image).
Engines: `paddle` (pages with rec_texts, rec_scores, rec_polys, or pairs of a polygon and [text, score]), `tesseract` (one
pass or a list of them, each with arrays text, conf, left, top, width, height) and `doctr` (pages of blocks of lines of
words with value, confidence and relative geometry).

Defined results: boxes are scaled back outward to whole pixels; readings of blanks go, but for doctr's words, which stay;
tesseract's readings below 0 go, and of equal texts and boxes of its passes the first stays; a missing score is 0, a
missing polygon a point at the origin; odd items, and passes that are null or broken, are passed over. A payload that is no
JSON, or not of its engine's shape, is one row with `error` and no text; a null payload gives none.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

READING = "seq int, text string, x0 int, y0 int, x1 int, y1 int, conf double, error string"

Found = tuple[str, tuple[float, float, float, float], float]


def _paddle(data: object, _w: float, _h: float) -> Iterator[Found]:
    for page in data if isinstance(data, list) else [data]:
        if page is None:
            continue
        page = page.get("res", page) if isinstance(page, dict) else page
        if isinstance(page, dict):
            texts, scores = page.get("rec_texts") or [], page.get("rec_scores") or []
            polys = page.get("rec_polys") or page.get("dt_polys") or []
            items = [(polys[k] if k < len(polys) else [[0, 0]], (t, scores[k] if k < len(scores) else 0.0)) for k, t in enumerate(texts)]
        else:
            items = page
        for item in items:
            try:
                poly, (text, conf) = item[0], item[1]
                xs, ys = [float(p[0]) for p in poly], [float(p[1]) for p in poly]
                found = (text or "").strip(), (min(xs), min(ys), max(xs), max(ys)), float(conf)
            except (TypeError, ValueError, IndexError, KeyError, AttributeError):
                continue
            if found[0]:
                yield found


def _tesseract(data: object, _w: float, _h: float) -> Iterator[Found]:
    for one in data if isinstance(data, list) else [data]:
        if not isinstance(one, dict):
            continue
        try:
            rows = [((t or "").strip(), float(c), *map(float, box)) for t, c, *box in zip(*(one[k] for k in ("text", "conf", "left", "top", "width", "height")), strict=True)]
        except (TypeError, ValueError, KeyError, AttributeError):
            continue
        for text, conf, x, y, w, h in rows:
            if text and conf >= 0:
                yield text, (x, y, x + w, y + h), conf / 100.0


def _doctr(data: object, w: float, h: float) -> Iterator[Found]:
    for page in data["pages"]:
        for block in page["blocks"]:
            for line in block["lines"]:
                for word in line["words"]:
                    (x0, y0), (x1, y1) = word["geometry"]
                    yield (word["value"] or "").strip(), (x0 * w, y0 * h, x1 * w, y1 * h), float(word["confidence"])


ENGINES = {"paddle": _paddle, "tesseract": _tesseract, "doctr": _doctr}


class Readings:
    """The table function: (engine, payload, factor, width, height) to rows of READING."""

    def eval(self, engine: str, payload: str, factor: float, width: float, height: float) -> Iterator[tuple]:
        if payload is None:
            return
        bad = lambda why: (None, None, None, None, None, None, None, why)
        if engine not in ENGINES:
            yield bad("unknown engine")
            return
        try:
            data = json.loads(payload)
            if not isinstance(data, (dict, list)):
                raise ValueError("neither object nor list")
            found = list(ENGINES[engine](data, width or 0.0, height or 0.0))
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            yield bad(f"{type(e).__name__}: {e}"[:200])
            return
        seen, seq, by = set(), 0, factor or 1.0
        for text, (x0, y0, x1, y1), conf in found:
            box = math.floor(x0 / by), math.floor(y0 / by), math.ceil(x1 / by), math.ceil(y1 / by)
            if engine == "tesseract" and (text, box) in seen:
                continue
            seen.add((text, box))
            yield (seq, text, *box, conf, None)
            seq += 1


#: Payloads whose readings are held at once.
AT_ONCE = 1000


def readings(payloads: DataFrame) -> DataFrame:
    """payloads with a row for each reading: sheet_id, pass, engine and the columns of READING."""
    own = payloads.select("sheet_id", "pass", "engine", "payload", F.col("factor").cast("double").alias("factor"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    schema = T.StructType([*own.schema.fields[:3], *T._parse_datatype_string(READING).fields])
    of_readings = to_arrow_schema(T._parse_datatype_string(READING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Readings().eval
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                found = [list(read(*args)) for args in zip(*(part.column(c).to_pylist() for c in range(2, 7)), strict=True)]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                rows = [r for f in found for r in f]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(of_readings)
                made = [pa.array(c, f.type) for c, f in zip(columns, of_readings, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in range(3)], *made], names=schema.names)

    return own.mapInArrow(run, schema)


def read_all(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good readings, with seq over all engines of a sheet and pass, in the order of the engines' names; and of each
    sheet, pass and engine its number of readings and its error."""
    every = readings(payloads)
    good = every.filter("error IS NULL")
    place = Window.partitionBy("sheet_id", "pass").orderBy("engine", "seq")
    told = every.groupBy("sheet_id", "pass", "engine").agg(F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("error"))
    ran = payloads.select("sheet_id", "pass", "engine").distinct().join(told, ["sheet_id", "pass", "engine"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return good.drop("error").withColumn("seq", F.row_number().over(place) - 1), ran
