import os

import duckdb
import pytest
from draftmill import catalog
from draftmill.functions import text as X
from draftmill.operators import extract, fusion, layout
from draftmill.streaming.status_log import activity, latest_stream
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
TOKEN = "sheet_id long, engine string, seq int, x0 int, y0 int, x1 int, y1 int, conf double, text string"


def rounded(v):
    return float(f"{float(v):.9g}") if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{D}/{t}'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    mine = sorted((tuple(rounded(r[c]) for c in cols) for r in got.collect()), key=str)
    assert mine == sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=str)


def boxes(spark, *rows):
    return spark.createDataFrame([(1, e, k, *b, c, t) for k, (e, b, c, t) in enumerate(rows)], TOKEN)


def test_fuse(spark):
    t = boxes(spark, ("a", (0, 0, 100, 20), 0.9, "ABC"), ("b", (2, 0, 100, 20), 0.8, "abc "), ("a", (1, 0, 100, 20), 0.7, "X"), ("c", (500, 0, 600, 20), 0.5, "far"), ("c", (0, 0, 100, 20), 0.2, "low"))
    got = sorted(tuple(r) for r in fusion.fuse(t, 3).select("text", "agreement", "readings").collect())
    assert got == [("ABC", round(2 / 3, 3), 2), ("far", round(1 / 3, 3), 1)]
    assert fusion.fuse(t.limit(0), 3).count() == 0


def test_rows(spark):
    t = boxes(spark, ("a", (50, 0, 100, 20), 0.9, "b"), ("a", (0, 0, 40, 20), 0.9, "a"), ("a", (0, 60, 40, 80), 0.9, "c"))
    assert {r["text"]: r["row_no"] for r in layout.rows(t).collect()} == {"a": 1, "b": 1, "c": 2}


def test_anchors_and_ratio(spark):
    r = spark.createDataFrame([("SCALE", "SCALES"), ("DATE", "D4TE"), ("", ""), ("", "A")], "a string, b string").select(F.round(X.indel_ratio(F.col("a"), F.col("b")), 4)).collect()
    assert [x[0] for x in r] == [90.9091, 75.0, 100.0, 0.0]
    t = layout.token_ids(boxes(spark, ("a", (0, 0, 9, 9), 0.9, "SCALE"), ("a", (20, 0, 29, 9), 0.9, "DRAWN BY:"), ("a", (40, 0, 49, 9), 0.9, "zz")), "seq")
    assert {(r["label"], r["tid"]) for r in extract.find_anchors(t).collect()} == {("scale", 0), ("draughtsperson", 1)}


def test_formats(spark):
    rows = [("A-101", True), ("12 Mar 1950", False), ("120/A3.", True), ("1950", False), ("", False), (None, False)]
    got = spark.createDataFrame(rows, "s string, want boolean").select("want", X.is_drawing_number(F.col("s")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5, 0), (1, 9, 2), (2, 1, 1)], "k int, at long, status int").write.parquet(str(tmp_path / "in"))
    s = latest_stream(spark.readStream.schema("k int, at long, status int").parquet(str(tmp_path / "in")), "k", "at")
    q = s.writeStream.outputMode("complete").format("memory").queryName("latest_states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["status"]) for r in spark.table("latest_states").collect()} == {(1, 2), (2, 1)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_activity_leaves_late_rows_out(spark, tmp_path):
    """Windows of an hour over a stream; a row that comes more than a day late counts no more."""
    at = lambda day, hour: (f"2024-01-{day:02d} {hour:02d}:10:00", day % 2)
    batches = [[at(1, 1), at(1, 1), at(1, 2)], [at(5, 3)], [at(1, 1), at(5, 3), at(5, 4)]]
    (tmp_path / "in").mkdir()
    log = spark.readStream.schema("ts timestamp, status int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for rows in batches:
        spark.createDataFrame(rows, "ts string, status int").select(F.col("ts").cast("timestamp").alias("ts"), "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = activity(log, "ts").writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination()
    seen = [(x["start"].day, x["start"].hour, x["status"], x["n"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (1, 1, 1, 2) in seen and (1, 2, 1, 1) in seen and (5, 3, 1, 2) in seen and (5, 4, 1, 1) in seen
    assert (1, 1, 1, 3) not in seen
