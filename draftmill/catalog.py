"""Queries over the driver's tables, one for each operator of the library, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions import geometry as G
from draftmill.functions import text as X
from draftmill.operators import extract, fusion, layout, status, triage
from draftmill.operators.ranges import box_pairs
from draftmill.plans.relations import LATEST_DUCK, LOG_DUCK, TOKENS_DUCK, log, table, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "fused_tokens"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TOK = f"WITH t AS ({TOKENS_DUCK}) "
PAIRS = TOK + ", p AS (SELECT a.sheet_id, a.seq AS a, b.seq AS b, (a.x1-a.x0)*(a.y1-a.y0) AS aa, (b.x1-b.x0)*(b.y1-b.y0) AS ab, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) * greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS s FROM t a JOIN t b ON a.sheet_id = b.sheet_id AND a.seq < b.seq) "


@query(PAIRS + "SELECT sheet_id, a, b, round(s / greatest(aa + ab - s, 1), 6) AS iou, round(s / greatest(least(aa, ab), 1), 6) AS io_min, s / greatest(ab, 1) >= 0.7 AS a_has_b FROM p WHERE s > 0")
def box_overlaps(spark, sf_dir):
    p = box_pairs(tokens(spark, sf_dir), "sheet_id", "seq")
    return p.select("sheet_id", F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), F.round(G.iou("a_", "b_"), 6).alias("iou"), F.round(G.io_min("a_", "b_"), 6).alias("io_min"), G.contains("a_", "b_").alias("a_has_b"))


@query(TOK + "SELECT sheet_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t GROUP BY sheet_id")
def box_unions(spark, sf_dir):
    return G.union_box(tokens(spark, sf_dir), "sheet_id")


@query(TOK + "SELECT sheet_id, seq, floor(x0 / 2.5)::INT AS x0, floor(y0 / 2.5)::INT AS y0, ceil(x1 / 2.5)::INT AS x1, ceil(y1 / 2.5)::INT AS y1 FROM t")
def boxes_scaled_back(spark, sf_dir):
    return tokens(spark, sf_dir).select("sheet_id", "seq", *G.scaled_back(2.5))


@query(TOK + "SELECT sheet_id, seq FROM t WHERE (x0 + x1) / 2.0 BETWEEN 60 AND 120 AND (y0 + y1) / 2.0 BETWEEN 10 AND 40")
def tokens_in_region(spark, sf_dir):
    at = [F.lit(x) for x in (60, 10, 120, 40)]
    return tokens(spark, sf_dir).filter(G.centre_inside("", *at)).select("sheet_id", "seq")


@query(TOK + r"SELECT sheet_id, seq, trim(regexp_replace(upper(text), '\s+', ' ', 'g')) AS norm, regexp_replace(upper(text), '\s+', '', 'g') AS squeezed, regexp_replace(regexp_replace(upper(text), '\s+', '', 'g'), '[.,;:]+$', '') AS number_key, round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(regexp_replace(text, '\s', '', 'g')) END, 6) AS alpha FROM t")
def text_forms(spark, sf_dir):
    t = F.col("text")
    return tokens(spark, sf_dir).select("sheet_id", "seq", X.norm(t).alias("norm"), X.squeezed(t).alias("squeezed"), X.number_key(t).alias("number_key"), F.round(X.alpha_ratio(t), 6).alias("alpha"))


_Q = lambda s: s.replace("'", "''")
_NUMBER = rf"trim(regexp_replace(upper(text), '\s+', ' ', 'g'))"


@query(TOK + f"SELECT sheet_id, seq, regexp_matches(text, '{_Q(X.SCALE)}') AS is_scale, regexp_matches(text, '{X.VAGUE_SCALE}') AS is_vague, regexp_matches(text, '(?i){X.DATE}') AS is_date, regexp_matches(text, '{X.CAPTION}') AS is_caption, try_cast(nullif(regexp_extract(text, '{X.YEAR}', 1), '') AS INT) AS year, regexp_matches(regexp_replace({_NUMBER}, '[.,;:]+$', ''), '(?i)^({X.DRAWING_NUMBER})$') AND NOT regexp_matches(regexp_replace({_NUMBER}, '[.,;:]+$', ''), '(?i)^({X.DATE})$') AS is_number, CASE len(k) WHEN 0 THEN NULL WHEN 1 THEN k[1] ELSE 'mixed' END AS kind FROM (SELECT *, list_filter(['perspective', 'elevation', 'section', 'detail', 'plan'], lambda w: contains(lower(text), w)) AS k FROM (SELECT sheet_id, seq, CASE seq % 5 WHEN 0 THEN concat('Section A-A ', text) WHEN 1 THEN concat('north ELEVATION ', text) WHEN 2 THEN concat('DETAIL 1 and perspective ', text) ELSE text END AS text FROM t))")
def text_formats(spark, sf_dir):
    t = F.col("text")
    k = F.col("seq") % 5
    mixed = F.when(k == 0, F.concat(F.lit("Section A-A "), t)).when(k == 1, F.concat(F.lit("north ELEVATION "), t)).when(k == 2, F.concat(F.lit("DETAIL 1 and perspective "), t)).otherwise(t)
    return tokens(spark, sf_dir).withColumn("text", mixed).select("sheet_id", "seq", X.is_scale(t).alias("is_scale"), X.is_vague_scale(t).alias("is_vague"), X.is_date(t).alias("is_date"), X.is_caption(t).alias("is_caption"), X.year(t).alias("year"), X.is_drawing_number(t).alias("is_number"), X.drawing_type(t).alias("kind"))


@query(TOK + "SELECT engine, count(*) AS n_tokens, count(DISTINCT sheet_id) AS n_sheets, round(avg(conf), 6) AS mean_conf FROM t GROUP BY engine")
def engine_counts(spark, sf_dir):
    return fusion.engine_summary(tokens(spark, sf_dir))


@query(TOK + "SELECT *, CASE WHEN reach > 1.05 THEN 'error' WHEN reach < 0.55 THEN 'warning' ELSE 'ok' END AS extent FROM (SELECT sheet_id, greatest(max(x1) / 170, max(y1) / 45) AS reach FROM t GROUP BY sheet_id)")
def sheet_extent(spark, sf_dir):
    return fusion.extent(tokens(spark, sf_dir), 170, 45)


@query(TOK + "SELECT sheet_id, engine, seq, x0, y0, x1, y1, conf, text FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, text, x0, y0, x1, y1 ORDER BY seq) AS k FROM t) WHERE k = 1")
def distinct_readings(spark, sf_dir):
    return fusion.distinct_readings(tokens(spark, sf_dir))


@query()
def fused_tokens(spark, sf_dir):
    """Readings of three engines made tokens; tested against a plain loop."""
    shown = F.transform("candidates", lambda c: F.concat_ws("@", c["text"], c["engine"], c["conf"].cast("string")))
    return fusion.fuse(tokens(spark, sf_dir), 3).withColumn("candidates", F.array_join(shown, "|"))


@query(TOK + "SELECT c.sheet_id, c.seq FROM t c WHERE c.engine = 'paddle' AND NOT EXISTS (SELECT 1 FROM t f WHERE f.engine = 'doctr' AND f.sheet_id = c.sheet_id AND greatest(0, least(c.x1,f.x1)-greatest(c.x0,f.x0)) * greatest(0, least(c.y1,f.y1)-greatest(c.y0,f.y0)) / ((f.x1-f.x0)*(f.y1-f.y0)) >= 0.7)")
def uncovered_readings(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return fusion.covered(t.filter("engine = 'paddle'"), t.filter("engine = 'doctr'")).select("sheet_id", "seq")


@query()
def token_rows(spark, sf_dir):
    return layout.rows(tokens(spark, sf_dir)).select("sheet_id", "seq", "row_no")


@query(TOK + ", u AS (SELECT sheet_id, seq, (y1 - y0) * (1 + (seq % 4) * 3) AS h, x1 - x0 AS w FROM t) SELECT u.sheet_id, seq, h >= 2 * w AND h >= 1.8 * m AS rotated FROM u JOIN (SELECT sheet_id, median(h) AS m FROM u GROUP BY sheet_id) USING (sheet_id)")
def rotated_tokens(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("y1", F.col("y0") + (F.col("y1") - F.col("y0")) * (1 + (F.col("seq") % 4) * 3))
    return layout.rotated(t).select("sheet_id", "seq", "rotated")


@query(TOK + "SELECT sheet_id, seq, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid FROM t")
def token_ids(spark, sf_dir):
    return layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq").select("sheet_id", "seq", "tid")


@query(TOK + "SELECT sheet_id, least(floor((x0 + x1) / 2.0 / 200 * 48), 47)::INT AS bx, least(floor((y0 + y1) / 2.0 / 64 * 48), 47)::INT AS \"by\", sum((x1 - x0) * (y1 - y0))::BIGINT AS ink FROM t GROUP BY 1, 2, 3")
def ink_density(spark, sf_dir):
    return layout.density(tokens(spark, sf_dir), 200, 64)


@query("WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS a FROM lineitem), n AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY k ORDER BY a) <= 6 THEN 0 ELSE 1 END AS fresh FROM d), r AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a) AS run FROM n) SELECT k, run::BIGINT AS run, floor(avg(a))::BIGINT AS peak, count(*) AS n FROM r GROUP BY k, run")
def line_peaks(spark, sf_dir):
    return layout.peaks(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("at")), "k", "at")


@query()
def label_anchors(spark, sf_dir):
    return extract.find_anchors(layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq"))


_LABELS = {w.upper().rstrip(".") for ws in extract.ANCHORS.values() for w in ws}
_CLEAN = r"regexp_replace(upper({}), '[.:]+$', '')"


@query(TOK + f", p AS (SELECT a.sheet_id, {_CLEAN.format('a.text')} AS word, a.seq AS label, t.seq AS value, (t.x0+t.x1)/2.0 - (a.x0+a.x1)/2.0 AS dx, (t.y0+t.y1)/2.0 - (a.y0+a.y1)/2.0 AS dy, t.x0 - a.x1 AS gap, a.y1 - a.y0 AS h, a.x1 - a.x0 AS w FROM t a JOIN t ON a.sheet_id = t.sheet_id WHERE {_CLEAN.format('a.text')} IN {tuple(sorted(_LABELS))} AND {_CLEAN.format('t.text')} NOT IN {tuple(sorted(_LABELS))}), s AS (SELECT sheet_id, word, label, value, CASE WHEN abs(dy) < 0.6 * h AND gap >= 0 THEN 1 - least(gap, 300) / 300.0 WHEN abs(dx) < w AND dy > 0 AND dy < 3 * h THEN 0.9 - dy / (3.0 * h) ELSE 0 END AS score FROM p) SELECT sheet_id, word, label, value, round(score, 6) AS score FROM s WHERE score > 0")
def label_value_scores(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("word", F.regexp_replace(F.upper("text"), r"[.:]+$", ""))
    side = lambda p, df, *more: df.select("sheet_id", *more, *[F.col(c).alias(f"{p}{c}") for c in ("seq", "x0", "y0", "x1", "y1")])
    is_label = F.col("word").isin(*_LABELS)
    p = side("a_", t.filter(is_label), "word").join(side("t_", t.filter(~is_label)), "sheet_id").withColumn("score", extract.pair_score())
    return p.filter("score > 0").select("sheet_id", "word", F.col("a_seq").alias("label"), F.col("t_seq").alias("value"), F.round("score", 6).alias("score"))


@query(TOK + f", i AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid FROM t), m AS (SELECT sheet_id, tid, text FROM i WHERE regexp_matches(text, '{_Q(X.SCALE)}') AND NOT regexp_matches(text, '{X.BARE_LABEL}')) SELECT sheet_id, min(tid)::INT AS tid, arg_min(text, tid) AS value FROM m GROUP BY sheet_id")
def first_scales(spark, sf_dir):
    return extract.first_match(layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq"), "scale")


@query(TOK + f", i AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid FROM t), m AS (SELECT sheet_id, tid, text FROM i WHERE try_cast(nullif(regexp_extract(text, '{X.YEAR}', 1), '') AS INT) BETWEEN 1900 AND 2000) SELECT sheet_id, min(tid)::INT AS tid, arg_min(text, tid) AS value FROM m GROUP BY sheet_id")
def first_dates(spark, sf_dir):
    return extract.first_match(layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq"), "date")


@query(TOK + f", i AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid FROM t), m AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY seq % 3 DESC, conf DESC, tid) AS k FROM i WHERE regexp_matches(text, '(?i){X.DRAWING_NUMBER}')) SELECT sheet_id, tid, text AS value FROM m WHERE k = 1")
def surest_numbers(spark, sf_dir):
    t = layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq").withColumn("agreement", (F.col("seq") % 3) / 2)
    return extract.first_match(t, "number")


_FIELDS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'v' END AS verbatim, CASE WHEN l_partkey % 5 = 0 THEN 'c' END AS corrected, CASE WHEN l_partkey % 22 = 0 THEN 'illegible' WHEN l_partkey % 11 = 0 THEN 'ambiguous' END AS reason, l_suppkey % 9 <> 0 AS evidence_ok, CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_partkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS agreement, CAST(l_suppkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS ocr_conf, CASE WHEN l_partkey % 3 = 0 THEN CAST(1 AS DOUBLE) WHEN l_partkey % 3 = 1 THEN CAST(0 AS DOUBLE) END AS format, CASE l_linenumber % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'sure' ELSE '' END AS model_label, l_linenumber % 4 = 0 AS adjudicated, l_suppkey % 10 = 1 AS repaired FROM lineitem"
_MEAN = "CASE WHEN adjudicated THEN greatest(agreement, 0.85) ELSE agreement END AS g, CASE model_label WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.35::DOUBLE WHEN '' THEN NULL ELSE 0.5::DOUBLE END AS m"


@query(f"WITH f AS ({_FIELDS}), a AS (SELECT *, {_MEAN} FROM f), b AS (SELECT *, (coalesce(0.18::DOUBLE * g, 0) + 0.18::DOUBLE * ocr_conf + coalesce(0.18::DOUBLE * format, 0) + coalesce(0.15::DOUBLE * m, 0)) / (CASE WHEN g IS NULL THEN 0 ELSE 0.18::DOUBLE END + 0.18::DOUBLE + CASE WHEN format IS NULL THEN 0 ELSE 0.18::DOUBLE END + CASE WHEN m IS NULL THEN 0 ELSE 0.15::DOUBLE END) AS r FROM a), c AS (SELECT *, CASE WHEN corrected IS NOT NULL THEN least(round(r, 3), CASE WHEN format = 0 THEN 0.45 ELSE 0.85 END) ELSE round(r, 3) END AS r1 FROM b), d AS (SELECT *, CASE WHEN repaired THEN least(r1, 0.74) ELSE r1 END AS r2 FROM c) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT evidence_ok THEN 'needs_review' WHEN verbatim IS NULL AND reason = 'illegible' THEN 'rejected' WHEN verbatim IS NULL THEN 'needs_review' WHEN r2 >= 0.75 THEN 'auto_accept' WHEN r2 >= 0.45 THEN 'needs_review' ELSE 'rejected' END AS status, CASE WHEN NOT evidence_ok OR verbatim IS NULL THEN 0 ELSE coalesce(r2, 0) END AS confidence FROM d")
def field_confidence(spark, sf_dir):
    f = spark.sql(_FIELDS.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf_dir, "lineitem"))
    return extract.confidence(f).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "confidence")


@query("WITH r AS (SELECT source AS series, least(n_chars, 3000) / CAST(100 AS DOUBLE) AS height FROM documents), v AS (SELECT *, CASE WHEN height >= 20 THEN 'reliable' WHEN height >= 8 THEN 'marginal' ELSE 'unrecoverable' END AS verdict FROM r) SELECT coalesce(series, 'unknown') AS series, count(*) AS n, round(median(coalesce(height, 0)), 4) AS median_height, count(*) FILTER (verdict = 'reliable') AS reliable, count(*) FILTER (verdict = 'marginal') AS marginal, count(*) FILTER (verdict = 'unrecoverable') AS unrecoverable, round(count(*) FILTER (verdict = 'unrecoverable') * 100.0 / count(*), 1) AS pct_unrecoverable FROM v GROUP BY 1")
def series_summary(spark, sf_dir):
    h = F.least(F.col("n_chars"), F.lit(3000)) / F.lit(100.0)
    return triage.summary(table(spark, sf_dir, "documents").select(F.col("source").alias("series"), h.alias("height"), X.verdict(h).alias("verdict")))


@query(TOK + "SELECT sheet_id, round(avg(CASE WHEN length(trim(text)) <= 3 AND NOT regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END), 6) AS noise FROM t GROUP BY sheet_id")
def sheet_noise(spark, sf_dir):
    return triage.noise(tokens(spark, sf_dir))


@query(TOK + ", j AS (SELECT sheet_id, upper(string_agg(text, ' ' ORDER BY seq)) AS a FROM t GROUP BY sheet_id) SELECT sheet_id, (" + " + ".join(f"contains(a, '{w}')::INT" for w in X.PROBE_WORDS) + ")::INT AS probes FROM j")
def sheet_probes(spark, sf_dir):
    return triage.probe(tokens(spark, sf_dir))


def _state(spark, sf_dir):
    return status.latest(log(spark, sf_dir), "image_key", "updated_at", "seq")


@query(f"WITH {LATEST_DUCK} SELECT * FROM state")
def latest_states(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"WITH {LATEST_DUCK} SELECT folder, status, count(*) AS n FROM state GROUP BY GROUPING SETS ((folder), (status))")
def state_counts(spark, sf_dir):
    return status.counts(_state(spark, sf_dir))


@query(f"WITH {LATEST_DUCK} SELECT task, CASE WHEN bool_or(status = 1) THEN 'running' WHEN bool_or(status = 0) THEN 'pending' WHEN bool_and(status = 2) THEN 'completed' ELSE 'failed' END AS task_status, count(*) AS total, count(*) FILTER (status IN (2, 3)) AS done, count(*) FILTER (status = 3) AS failures, min(updated_at) AS started, max(updated_at) AS finished FROM state GROUP BY task")
def task_states(spark, sf_dir):
    return status.roll_up(_state(spark, sf_dir), "task")


@query(f"WITH {LATEST_DUCK} SELECT round((1 - count(*) FILTER (status IN (0, 1)) / count(*)) * 100, 2) AS progress, count(*) AS total FROM state")
def task_progress(spark, sf_dir):
    return status.progress(_state(spark, sf_dir))


def _images(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_key"), F.col("c_nationkey").alias("node"))


@query(f"WITH {LATEST_DUCK} SELECT c_custkey AS image_key, c_nationkey AS node, coalesce(status, 0) AS status, 0 AS reviewed FROM customer LEFT JOIN state ON c_custkey = image_key")
def image_listing(spark, sf_dir):
    state = _state(spark, sf_dir).select("image_key", "status", F.lit(0).alias("reviewed"))
    return status.listing(_images(spark, sf_dir), state, "image_key")


@query(f"WITH {LATEST_DUCK} SELECT c_custkey AS image_key, c_nationkey AS node FROM customer WHERE c_custkey NOT IN (SELECT image_key FROM state)")
def images_without_state(spark, sf_dir):
    return status.missing(_images(spark, sf_dir), _state(spark, sf_dir), "image_key")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'checked' WHEN toxic = 1 THEN '' ELSE source END AS source, coalesce(CASE WHEN quality = 1 THEN 'xx' END, lang) AS lang, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS reviewed FROM documents LEFT JOIN labels l USING (doc_id)")
def review_overlay(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "checked").when(F.col("toxic") == 1, "").alias("source"), F.when(F.col("quality") == 1, "xx").alias("lang"))
    return status.overlay(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), r, "doc_id", ["source", "lang"])


@query(f"WITH {LATEST_DUCK} SELECT c_custkey AS image_key, c_nationkey AS node, status, folder FROM customer JOIN state ON c_custkey = image_key WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def export_rows(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("image_key"))
    return status.export(_images(spark, sf_dir), _state(spark, sf_dir).select("image_key", "status", "folder"), keys, "image_key")


@query("SELECT lower(trim(event_type)) AS word, CASE WHEN lower(trim(event_type)) IN ('running') THEN 1 WHEN lower(trim(event_type)) = 'success' THEN 2 WHEN lower(trim(event_type)) = 'failed' THEN 3 ELSE 0 END AS code, count(*) AS n FROM events GROUP BY 1, 2")
def status_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lower(F.trim("event_type")).alias("word"), X.image_status(F.col("event_type")).alias("code"))
    return e.groupBy("word", "code").agg(F.count("*").alias("n"))


@query(f"WITH v AS (SELECT conv_id, turn, [trim(role), NULL, ' ', CASE turn % 3 WHEN 0 THEN 'low_resolution' WHEN 1 THEN 'a note' ELSE 'ambiguous' END, trim(role), CASE WHEN turn % 2 = 0 THEN 'illegible' END] AS x FROM conversations), n AS (SELECT conv_id, turn, list_filter(x, lambda y: y IS NOT NULL AND trim(y) <> '') AS x FROM v), r AS (SELECT *, list_filter(x, lambda y: y IN {X.REASONS})[1] AS reason FROM n) SELECT conv_id, turn, reason, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i AND (reason IS NULL OR y <> reason)), '|') AS notes FROM r")
def reasons_and_notes(spark, sf_dir):
    k = F.col("turn")
    said = F.when(k % 3 == 0, "low_resolution").when(k % 3 == 1, " a note ").otherwise("ambiguous")
    v = F.array(F.col("role"), F.lit(None), F.lit(" "), said, F.col("role"), F.when(k % 2 == 0, "illegible"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.reason_of(v).alias("reason"), F.array_join(X.other_notes(v), "|").alias("notes"))


@query("SELECT conv_id, turn, nullif(regexp_extract(concat('```json {\"a\": \"', text, '\"} ```'), '(?s)\\{.*\\}', 0), '') AS reply FROM conversations")
def reply_objects(spark, sf_dir):
    s = F.concat(F.lit('```json {"a": "'), F.col("text"), F.lit('"} ```'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.reply_object(s).alias("reply"))


@query("SELECT sum(l_quantity)::DOUBLE AS total, (sum(CAST(l_quantity AS BIGINT)) // count(*))::BIGINT AS per_image, count(*) AS calls FROM lineitem")
def usage_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").cast("double").alias("total"), F.expr("sum(cast(l_quantity AS bigint)) div count(*)").alias("per_image"), F.count("*").alias("calls"))


@query(f"WITH log AS ({LOG_DUCK}) SELECT to_hex(0) AS x, count(*) AS n, count(DISTINCT image_key) AS images FROM log")
def log_size(spark, sf_dir):
    return log(spark, sf_dir).agg(F.lit("0").alias("x"), F.count("*").alias("n"), F.count_distinct("image_key").alias("images"))
