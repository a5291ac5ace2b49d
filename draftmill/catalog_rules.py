"""Queries of the rules that find fields, over the driver's tables, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftmill.catalog import _Q, TOK, query
from draftmill.functions import text as X
from draftmill.operators import layout, rules
from draftmill.plans.relations import tokens


def _tokens(spark, sf_dir):
    """Tokens with ids, an agreement and candidates; some texts are followed by a mark, so that rows of values occur."""
    t = layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq").withColumn("agreement", (F.col("seq") % 3) / 2)
    longer = F.when(F.col("seq") % 2 == 0, F.concat("text", F.lit("/1"))).otherwise(F.col("text"))
    return t.select("sheet_id", "tid", "text", "x0", "y0", "x1", "y1", "conf", "agreement", F.array("text", longer).alias("candidates"))


_IDS = TOK + ", i AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid, (seq % 3) / 2 AS agreement FROM t)"
_ROW = f"""{_IDS}, f AS (SELECT sheet_id, min(tid) AS seed FROM i WHERE regexp_matches(text, '{_Q(X.SCALE)}') AND NOT regexp_matches(text, '{X.BARE_LABEL}') GROUP BY sheet_id),
s AS (SELECT f.*, x0 AS sx, y0 + y1 AS sy, greatest(y1 - y0, 1) AS h FROM f JOIN i ON f.sheet_id = i.sheet_id AND f.seed = i.tid),
r AS (SELECT s.*, tid, text, x0, x1, conf, agreement FROM s JOIN i USING (sheet_id) WHERE tid = seed OR (abs(y0 + y1 - sy) <= 1.2 * h AND (x0 > sx OR (x0 = sx AND tid > seed)))),
e AS (SELECT *, CASE WHEN tid = seed THEN 0 WHEN x0 - lag(x1) OVER (PARTITION BY sheet_id ORDER BY x0, tid) > 1.8 * h OR regexp_matches(text, '{X.BARE_LABEL}') OR regexp_matches(text, '{rules.ROW_END}') THEN 1 ELSE 0 END AS past FROM r),
g AS (SELECT * FROM (SELECT *, sum(past) OVER (PARTITION BY sheet_id ORDER BY x0, tid) AS n FROM e) WHERE n = 0),
w AS (SELECT sheet_id, seed::INT AS seed, string_agg(tid::VARCHAR, ',' ORDER BY x0, tid) AS tids, string_agg(text, ' ' ORDER BY x0, tid) AS whole, min(agreement)::DOUBLE AS agreement, min(conf) AS conf FROM g GROUP BY sheet_id, seed)
SELECT *, trim(regexp_extract(whole, '{_Q(X.SCALE)}', 0)) AS scale, length(trim(regexp_extract(whole, '{_Q(X.SCALE)}', 0))) < 0.8 * length(trim(whole)) AS noisy FROM w"""


@query(_ROW)
def scale_groups(spark, sf_dir):
    """The first scale of each sheet with what stands right of it in its row."""
    return rules.scale_groups(_tokens(spark, sf_dir)).withColumn("tids", F.concat_ws(",", F.col("tids").cast("array<string>")))


@query()
def label_values(spark, sf_dir):
    """The values that labels get when the sum of all pairs' scores is the greatest; tested against all assignments."""
    return rules.label_values(_tokens(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query()
def rule_fields(spark, sf_dir):
    """All fields of all sheets by rules; tested against a plain loop. Titles and clients of the parts stand for names."""
    names = ("STANDARD BRUSHED", "PROMO POLISHED", "ECONOMY ANODIZED COPPER")
    out = rules.rule_fields(_tokens(spark, sf_dir), names)
    return out.withColumn("tids", F.concat_ws(",", F.col("tids").cast("array<string>")))
