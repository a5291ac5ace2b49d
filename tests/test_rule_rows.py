"""Rules for fields in the row of a sheet: one shuffle, and names that are found by windows of all texts at once."""

import random

import pytest
from draftmill.operators import rules
from draftmill.session import ship
from pyspark.sql import functions as F

TOKEN = "sheet_id long, tid int, text string, x0 int, y0 int, x1 int, y1 int, conf double, agreement double, candidates array<string>"


@pytest.mark.parametrize("query", [rules.rule_fields, rules.label_values])
def test_one_shuffle(spark, query):
    """Before, parts of a sheet were computed apart, shuffled each and met by joins."""
    ship(spark)
    df = spark.createDataFrame([(1, 0, "SCALE", 0, 0, 40, 10, 0.5, 1.0, ["SCALE"]), (1, 1, "1:100", 60, 0, 90, 10, 0.5, 1.0, ["1:100"])], TOKEN).repartition(3)
    plan = query(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan, plan


def test_names_of_many_texts(spark):
    r = random.Random(3)
    names = ("ABCAB", "BCA", "AAAAAAAA", "CB AB", "\U0001f600BC")
    texts = ["".join(r.choice("AB C\U0001f600") for _ in range(r.randint(0, 14))) for _ in range(500)] + [None, "", "ABCAB", "xABCABx" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for least in (60.0, 80.0, 100.0):
        got = {x["i"]: (x["m"]["k"], x["m"]["score"]) for x in df.select("i", rules.known_name(F.col("t"), names, least).alias("m")).collect()}
        for i, t in enumerate(texts):
            scores = [rules.partial_ratio(n, t or "", least) for n in names]
            assert got[i] == ((scores.index(max(scores)), max(scores)) if max(scores) >= least else (None, None)), (t, scores)
    assert {x["m"]["k"] for x in df.select(rules.known_name(F.col("t"), (), 80.0).alias("m")).collect()} == {None}


def test_best_total_in_many_sheets(spark):
    """Two labels that want one token, sheets without labels and a label without a box in one batch."""
    labels = {"scale": ["SCALE"], "date": ["DATE"]}
    rows = [(1, 0, "SCALE", 0, 0, 40, 10), (1, 1, "DATE", 0, 2, 40, 12), (1, 2, "a", 60, 1, 90, 11), (1, 3, "b", 300, 7, 330, 17)]
    rows += [(2, 0, "x", 0, 0, 1, 1), (3, 0, "DATE", None, None, None, None), (3, 1, "a", 60, 1, 90, 11)]
    df = spark.createDataFrame([(*t, 0.5, 1.0, None) for t in rows], TOKEN).coalesce(1)
    got = {(x["sheet_id"], x["label"], x["tid"], x["text"]) for x in rules.label_values(df, labels).collect()}
    assert got == {(1, "scale", 2, "a")}  # b is for the date alone: it takes part in the sum, its score is under the floor
