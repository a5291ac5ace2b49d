"""The driver's tables read as OCR readings, images and states, with integer arithmetic alone; the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = """
SELECT l_orderkey AS sheet_id, CASE l_returnflag WHEN 'A' THEN 'paddle' WHEN 'N' THEN 'tesseract' ELSE 'doctr' END AS engine,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS INT) AS seq,
  CAST((l_suppkey % 3) * 60 + l_partkey % 16 AS INT) AS x0, CAST((l_linenumber % 2) * 24 + l_partkey % 5 AS INT) AS y0,
  CAST((l_suppkey % 3) * 60 + l_partkey % 16 + 48 AS INT) AS x1, CAST((l_linenumber % 2) * 24 + l_partkey % 5 + 16 AS INT) AS y1,
  CAST(l_partkey % 71 + 29 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf,
  CASE l_partkey % 8 WHEN 0 THEN 'SCALE' WHEN 1 THEN concat('1:', CAST(10 * (1 + l_partkey % 20) AS {text})) WHEN 2 THEN {day}
    WHEN 3 THEN concat(CAST(100 + l_suppkey AS {text}), '/A', CAST(l_linenumber AS {text})) WHEN 4 THEN 'DRAWN BY' WHEN 5 THEN 'DRAWING NO.'
    WHEN 6 THEN concat(p_type, ' PLAN') ELSE p_name END AS text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
TOKENS_DUCK = TOKENS.format(text="VARCHAR", day="strftime(l_shipdate, '%d %b %Y')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet_id, engine, seq, box, conf, text. Parts are joined as Spark sees fit by their size. The key is renamed before it is
    numbered by, so that Spark knows the tokens to lie by sheet_id, and what goes by sheet needs no further shuffle."""
    sql = TOKENS.format(text="STRING", day="date_format(l_shipdate, 'dd MMM yyyy')").replace("l_orderkey AS sheet_id", "sheet_id").replace("l_orderkey", "sheet_id")
    lineitem = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sheet_id")
    return spark.sql(sql.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), lineitem=lineitem, part=table(spark, sf_dir, "part"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of states: user_id as image key, its event types as states in the order of their names."""
    status = F.when(F.col("event_type") < "d", 0).when(F.col("event_type") < "n", 1).when(F.col("event_type") < "s", 2).otherwise(3)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image_key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at"), status.alias("status"), (F.col("user_id") % 7).cast("int").alias("folder"), (F.col("user_id") % 50).cast("int").alias("task"))


LOG_DUCK = """SELECT user_id AS image_key, event_id AS seq, epoch_us(ts) // 1000 AS updated_at, CASE WHEN event_type < 'd' THEN 0 WHEN event_type < 'n' THEN 1 WHEN event_type < 's' THEN 2 ELSE 3 END AS status, (user_id % 7)::INT AS folder, (user_id % 50)::INT AS task FROM events"""
LATEST_DUCK = f"log AS ({LOG_DUCK}), state AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY updated_at DESC, seq DESC) AS k FROM log) WHERE k = 1)"

FIELDS = """
SELECT sheet_id, CASE seq WHEN 0 THEN 'drawing_number' WHEN 1 THEN 'project_name' WHEN 2 THEN 'scale' WHEN 3 THEN 'date' WHEN 4 THEN 'architect' WHEN 5 THEN 'drawing_title' WHEN 6 THEN 'draughtsperson' ELSE 'drawing_type' END AS name,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' WHEN k % 4 = 0 THEN 'As  shown' ELSE concat('v-', CAST(k AS {text})) END AS verbatim,
  CASE WHEN k % 5 = 0 THEN concat('V', CAST(k AS {text})) WHEN k % 7 = 0 THEN '' WHEN k % 17 = 0 THEN 'other' END AS corrected,
  CASE WHEN p % 3 = 0 THEN 'ocr' WHEN p % 3 = 1 THEN '' END AS basis, CAST(k % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS confidence,
  CASE WHEN p % 4 = 0 THEN 'needs_review' WHEN p % 9 = 1 THEN 'rejected' ELSE 'auto_accept' END AS status,
  CASE WHEN k % 22 = 0 THEN ' illegible ' WHEN k % 11 = 0 THEN 'odd note' END AS reason,
  CASE WHEN k % 6 = 0 THEN 'ambiguous' ELSE 'a note' END AS note, CASE WHEN p % 2 = 0 THEN 'rule' WHEN p % 5 = 0 THEN '' ELSE 'model' END AS source
FROM (SELECT l_orderkey AS sheet_id, l_partkey AS k, l_suppkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS seq FROM {lineitem}) WHERE seq < 8
"""
SHEETS = """
SELECT DISTINCT l_orderkey AS sheet_id, CASE l_orderkey % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'fallback' ELSE 'anchor' END AS method,
  CAST(l_orderkey % 7 AS DOUBLE) / CAST(8 AS DOUBLE) AS method_conf, CASE WHEN l_orderkey % 10 = 0 THEN 'no tokens' END AS error,
  CASE WHEN l_orderkey % 6 = 0 THEN {list}('blurred') ELSE {none} END AS reasons
FROM {lineitem}
"""
FIELDS_DUCK = FIELDS.format(text="VARCHAR", lineitem="lineitem")
SHEETS_DUCK = SHEETS.format(lineitem="lineitem", list="list_value", none="[]::VARCHAR[]")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values of sheets; the note as an array."""
    f = spark.sql(FIELDS.format(text="STRING", lineitem="{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return f.withColumn("notes", F.array("note")).drop("note")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets: how their region was found, and what went wrong."""
    return spark.sql(SHEETS.format(lineitem="{lineitem}", list="array", none="cast(array() AS array<string>)"), lineitem=table(spark, sf_dir, "lineitem"))
