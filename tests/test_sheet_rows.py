"""Steps that keep a sheet's rows together: what they give on odd and large sheets, and that they shuffle by sheet alone."""

import random

import pytest
from pyspark.sql import functions as F

from draftmill.operators import candidates, extract, fusion, layout, locate, rules, tables, views
from draftmill.session import ship
from draftmill.sources import payloads

BOX = "x0 int, y0 int, x1 int, y1 int"


@pytest.fixture
def far(spark):
    """As with tables too large for a broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield ship(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark, n=3):
    rows = [(s, k, k, ["SCALE", "1:50", "DRAWN BY", None][k % 4], 60 * k, 0, 60 * k + 48, 16, 0.5, 0.5) for s in range(n) for k in range(6)]
    return spark.createDataFrame(rows, f"sheet_id long, seq int, tid int, text string, {BOX}, conf double, agreement double").repartition("sheet_id")


def test_nothing_is_joined_by_text(far):
    """the most frequent texts would meet in one task."""
    t = some(far)
    for df in (extract.find_anchors(t), locate.keyword_hits(t)):
        assert "hashpartitioning(clean" not in plan(df) and "hashpartitioning(__up" not in plan(df) and "Join" not in plan(df)
    got = {(r["sheet_id"], r["label"]): r["tid"] for r in extract.find_anchors(t).collect()}
    assert got == {(s, k): v for s in range(3) for k, v in (("scale", 0), ("draughtsperson", 2))}
    assert extract.find_anchors(t, 85.0, {}).count() == 0


def test_joins_by_sheet_and_token_stay_where_they_lie(far):
    """F18, F8."""
    t = some(far).withColumns({"row_no": F.lit(1), "alternatives": F.array().cast("array<string>")})
    assert plan(views.index(t, t.select("sheet_id", "tid", F.lit("a").alias("preferred"), F.lit("b").alias("why")))).count("Exchange hashpartitioning(sheet_id") <= 2
    seeds = t.filter("tid = 1").select("sheet_id", F.lit("scale").alias("name"), F.lit(0).alias("turn"), F.col("tid").alias("seed"), F.lit(False).alias("alone"), F.lit(None).cast("string").alias("word"))
    df = rules.extended(seeds, t)
    assert "Window" not in plan(df)
    # the next label ends the row
    assert [(r["tids"], r["whole"]) for r in df.filter("sheet_id = 0").collect()] == [([1], "1:50")]


def test_places_are_not_gathered_before_the_shuffle(far):
    """F16: a table of all distinct places stood in each task."""
    df = far.createDataFrame([(1, a) for a in (5, 5, None, 11, 18, 18, 40)], "k int, at int")
    runs = layout.peaks(df, "k", "at")
    assert "Aggregate" not in plan(runs).split("Exchange hashpartitioning(k")[1]
    assert sorted((r["run"], r["peak"], r["n"]) for r in runs.collect()) == [(1, None, 1), (2, 8, 2), (3, 18, 1), (4, 40, 1)]


def test_lines_are_merged_in_one_row(far):
    """the lines of all sheets were shuffled once more after they were numbered."""
    lines = far.createDataFrame([(1, True, k, 10.0 * k, 5.0, 10.0 * k + 9, 5.0) for k in range(4)] + [(1, True, 9, None, 5.0, 3.0, 5.0), (1, False, 0, 3.0, 3.0, 3.0, 3.5)], "sheet_id int, horizontal boolean, seq int, x0 double, y0 double, x1 double, y1 double")
    pages = far.createDataFrame([(1, 180, 100)], "sheet_id int, w int, h int")
    df = tables.merged_lines(lines, pages)
    assert plan(df).count("Exchange") <= 2
    assert [tuple(r) for r in df.collect()] == [(1, True, 0, 0.0, 5.0, 39.0, 5.0)]


def test_later_fields_are_not_looked_at(far):
    """F17."""
    kind = "sheet_id int, tid int, text string, candidates array<struct<text:string,engine:string,conf:double>>"
    t = far.createDataFrame([(1, 0, "12", [("12/A3", "a", 0.5)]), (1, 1, "x", [("1:50", "a", 0.5)])], kind)
    got = {r["tid"]: (r["field"], r["reasons"]) for r in candidates.hints(t).collect()}
    assert got == {0: (None, ["superset"]), 1: ("scale", ["format"])}
    assert plan(candidates.hints(t)).count("size(r0") > 1


def test_groups_of_large_and_small_sheets(far):
    """many sheets at once give what a loop gives, and fusing shuffles once."""
    rng = random.Random(5)
    rows = []
    for sheet, n in enumerate([1, 2, 3, 7, 40, 150, 5, 1]):
        for k in range(n):
            x, y = rng.randrange(60), rng.randrange(20)
            rows.append((sheet, rng.choice("abc"), k, x, y, x + rng.randrange(1, 30), y + rng.randrange(1, 12), rng.choice([0.4, 0.6, 0.9]), rng.choice(["S", "s ", None, "T"])))
    df = far.createDataFrame(rows, f"sheet_id int, engine string, seq int, {BOX}, conf double, text string")
    want = {}
    for sheet in {r[0] for r in rows}:
        groups = []
        for r in sorted((r for r in rows if r[0] == sheet), key=lambda r: (r[4], r[3], r[2])):
            def iou(a, b=r):
                s = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
                return s / max((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - s, 1)
            at = next((g for g, own in enumerate(groups) if any(iou(a) >= 0.5 for a in own)), None)
            if at is None:
                groups.append([r])
                at = len(groups) - 1
            elif any(a[1] == r[1] for a in groups[at]):
                at = -1
            else:
                groups[at].append(r)
            want[sheet, r[2]] = at
    assert {(r["sheet_id"], r["seq"]): r["grp"] for r in fusion.overlap_groups(df).collect()} == want
    assert plan(fusion.fuse(df, 3)).count("Exchange") == 1
    assert fusion.fuse(df, 3).count() == len({(s, g) for (s, _), g in want.items() if g >= 0})


def test_payloads_go_by_batches(far):
    """F14."""
    df = far.createDataFrame([(1, "fine", "doctr", "{", 1.0, 5, 5), (2, "fine", "doctr", None, 1.0, 5, 5), (3, "fine", "paddle", '[{"rec_texts": ["a"]}]', None, 5, 5)], "sheet_id int, pass string, engine string, payload string, factor double, width int, height int")
    got = payloads.readings(df)
    assert "UDTF" not in plan(got)
    assert sorted((r["sheet_id"], r["seq"], r["text"], r["error"] is None) for r in got.collect()) == [(1, None, None, False), (3, 0, "a", True)]


def test_tokens_placed_in_one_row(far):
    """no union of upright and rotated tokens, no second shuffle."""
    rows = [(1, 0, "a", 0, 0, 20, 10), (1, 1, "b", 25, 1, 40, 11), (1, 2, "up", 60, 0, 64, 90), (1, 3, "c", 0, 30, 20, 40)]
    df = far.createDataFrame(rows, f"sheet_id int, seq int, text string, {BOX}")
    at = views.placed(df)
    assert "Union" not in plan(at) and plan(at).count("Exchange") == 1
    assert sorted((r["seq"], r["row_no"], r["tid"]) for r in at.collect()) == [(0, 1, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3)]
