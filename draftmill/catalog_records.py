"""Queries of repairs, records, regions, views and the task service over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftmill.catalog import TOK, _images, _state, query, table
from draftmill.functions import repair as P
from draftmill.operators import fusion, layout, records, regions, status, views
from draftmill.plans.relations import FIELDS_DUCK, LATEST_DUCK, SHEETS_DUCK, fields, sheets, tokens

FLD = f"WITH f AS ({FIELDS_DUCK}), s AS ({SHEETS_DUCK}) "
_VALUE = "coalesce(nullif(corrected, ''), nullif(verbatim, ''))"


def _flat_sql() -> str:
    of = {"": _VALUE, "_verbatim": "verbatim", "_corrected": "corrected", "_correction_basis": "basis", "_conf": "confidence", "_status": "status", "_reason": "reason"}
    one = ", ".join(f"coalesce(max(CASE WHEN name = '{f}' THEN coalesce(({c})::VARCHAR, '') END), '') AS \"{f}{k}\"" for f in records.FIELDS for k, c in of.items() if k != "_conf")
    return FLD + f", w AS (SELECT sheet_id, {one}, max((status <> 'auto_accept')::INT) AS opened FROM f GROUP BY sheet_id) SELECT s.sheet_id, w.* EXCLUDE (sheet_id, opened), method AS localization_method, method_conf AS localization_conf, CASE WHEN coalesce(error, '') <> '' THEN 'failed' ELSE 'success' END AS processing_status, coalesce(error, '') AS processing_error, CASE WHEN coalesce(error, '') <> '' OR coalesce(opened, 0) = 1 THEN 'needs_review' ELSE 'auto_accept' END AS review_status FROM s LEFT JOIN w USING (sheet_id)"


@query(_flat_sql())
def flat_rows(spark, sf_dir):
    """All columns but the confidences, which are compared as numbers by result_fields."""
    return records.flat_rows(sheets(spark, sf_dir), fields(spark, sf_dir)).drop(*[f"{f}_conf" for f in records.FIELDS])


@query(FLD + f"SELECT sheet_id, name, {_VALUE} AS value, verbatim, corrected, basis AS correction_basis, round(confidence, 3) AS conf, nullif(source, '') AS source, CASE WHEN trim(reason) = 'illegible' THEN 'illegible' WHEN note = 'ambiguous' THEN 'ambiguous' END AS reason, array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL), '|') AS notes, status AS review_status FROM (SELECT *, CASE WHEN trim(reason) = 'illegible' THEN [note] WHEN note = 'ambiguous' THEN [trim(reason)] ELSE [trim(reason), note] END AS list_distinct_ordered FROM f)")
def result_fields(spark, sf_dir):
    return records.result_fields(fields(spark, sf_dir)).withColumn("notes", F.array_join("notes", "|"))


_PARTS = {"value": _VALUE, "verbatim": "verbatim", "corrected": "corrected", "correction_basis": "basis", "conf": "round(confidence, 3)", "source": "nullif(source, '')", "reason": "CASE WHEN trim(reason) = 'illegible' THEN 'illegible' WHEN note = 'ambiguous' THEN 'ambiguous' END", "notes": "array_to_string(list_filter(CASE WHEN trim(reason) = 'illegible' THEN [note] WHEN note = 'ambiguous' THEN [trim(reason)] ELSE [trim(reason), note] END, lambda x: x IS NOT NULL), '|')", "review_status": "status"}


@query(FLD + "SELECT sheet_id, " + ", ".join(f"max(CASE WHEN name = '{f}' THEN {c} END) AS {f}_{k}" for f in records.FIELDS for k, c in _PARTS.items()) + " FROM f GROUP BY sheet_id")
def result_documents(spark, sf_dir):
    """Every part of every field of each sheet's document."""
    d = records.result_documents(fields(spark, sf_dir))
    part = lambda f, k: F.array_join(F.col(f"{f}.notes"), "|") if k == "notes" else F.col(f"{f}.{k}")
    return d.select("sheet_id", *[part(f, k).alias(f"{f}_{k}") for f in records.FIELDS for k in _PARTS])


_CAP = "method_conf < 0.5 OR len(reasons) > 0"


@query(FLD + f"SELECT sheet_id, name, CASE WHEN {_CAP} THEN least(confidence, 0.45) ELSE confidence END AS confidence, CASE WHEN {_CAP} THEN 'needs_review' ELSE status END AS status, array_to_string(list_concat([note], CASE WHEN name = 'scale' AND regexp_matches(verbatim, '(?i)AS\\s+SHOWN') THEN ['" + records.VAGUE_NOTE + "'] ELSE [] END, reasons, CASE WHEN method_conf < 0.5 AND method <> 'fallback' THEN [concat('Localization method ', method, ' has confidence of only ', method_conf)] ELSE [] END), '|') AS notes FROM f JOIN s USING (sheet_id)")
def degraded_fields(spark, sf_dir):
    d = records.degraded(fields(spark, sf_dir), sheets(spark, sf_dir))
    return d.select("sheet_id", "name", "confidence", "status", F.array_join("notes", "|").alias("notes"))


@query(FLD + "SELECT coalesce(r.sheet_id, m.sheet_id) AS sheet_id, coalesce(r.name, m.name) AS name, CASE WHEN r.sheet_id IS NOT NULL THEN r.v ELSE m.v END AS value, CASE WHEN r.sheet_id IS NOT NULL THEN 'rule' ELSE 'model' END AS source, CASE WHEN r.sheet_id IS NOT NULL AND m.sheet_id IS NOT NULL THEN concat('model: ', coalesce(m.v, '')) ELSE '' END AS notes FROM (SELECT sheet_id, name, verbatim AS v FROM f WHERE source = 'rule') r FULL JOIN (SELECT sheet_id, name, corrected AS v FROM f WHERE status <> 'rejected') m ON r.sheet_id = m.sheet_id AND r.name = m.name")
def merged_sources(spark, sf_dir):
    f = fields(spark, sf_dir)
    out = records.merge_sources(f.filter("source = 'rule'").withColumn("value", F.col("verbatim")), f.filter("status <> 'rejected'").withColumn("value", F.col("corrected")))
    return out.withColumn("notes", F.array_join("notes", "|"))


@query(FLD + "SELECT count(*) AS n, count(*) FILTER (coalesce(error, '') <> '') AS failed, CASE WHEN count(*) FILTER (coalesce(error, '') <> '') > 0 THEN 1 ELSE 0 END AS exit_code FROM s")
def run_totals(spark, sf_dir):
    return records.run_totals(records.flat_rows(sheets(spark, sf_dir), fields(spark, sf_dir)))


@query(FLD + r"SELECT sheet_id, name, CASE WHEN coalesce(corrected, '') = '' OR regexp_replace(upper(coalesce(verbatim, '')), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(upper(corrected), '[^\p{L}\p{N}]', '', 'g') THEN NULL WHEN coalesce(basis, '') <> '' THEN 'fix' ELSE 'normalize' END AS kind FROM f")
def correction_kinds(spark, sf_dir):
    return fields(spark, sf_dir).select("sheet_id", "name", P.correction_kind(F.col("verbatim"), F.col("corrected"), F.col("basis")).alias("kind"))


_TID = TOK + ", i AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid FROM t) "


@query(_TID + ", n AS (SELECT DISTINCT sheet_id, seq, u AS tid FROM (SELECT sheet_id, seq, unnest([seq, seq + 1, seq * 3]) AS u FROM t)) SELECT n.sheet_id, n.seq::VARCHAR AS name, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n LEFT JOIN i ON i.sheet_id = n.sheet_id AND i.tid = n.tid GROUP BY n.sheet_id, n.seq")
def token_boxes(spark, sf_dir):
    t = layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq")
    named = t.select("sheet_id", F.col("seq").cast("string").alias("name"), F.array("seq", F.col("seq") + 1, F.col("seq") * 3).alias("tids"))
    return records.token_boxes(named, t)


@query(TOK + "SELECT sheet_id, seq, CASE WHEN seq % 3 = 0 THEN x0 WHEN seq % 3 = 1 THEN x0 + 1 END AS ex0, CASE WHEN seq % 3 = 0 THEN x1 + 5 WHEN seq % 3 = 1 THEN x1 END AS ex1, CASE WHEN seq % 3 < 2 THEN y0 END AS ey0, CASE WHEN seq % 3 < 2 THEN y1 END AS ey1 FROM t")
def evidence_boxes(spark, sf_dir):
    """Regions of no extent count for nothing; without any the total stands, and without that nothing."""
    d = lambda *c: F.array(*[F.expr(x).cast("double") for x in c])
    some = F.array(d("x0 + 0.7", "y0", "x1 + 0.2", "y1"), d("x0", "y0", "x1 + 5", "y1"), d("x1 + 50", "y0", "x0", "y1"))
    none = F.array(d("x1", "y0", "x0", "y1"))
    box = records.evidence_box(F.when(F.col("seq") % 3 == 0, some).otherwise(none), F.when(F.col("seq") % 3 == 1, d("x0 + 1.5", "y0", "x1", "y1")).otherwise(d("x0", "y0", "x0", "y1")))
    return tokens(spark, sf_dir).select("sheet_id", "seq", F.get(box, 0).alias("ex0"), F.get(box, 2).alias("ex1"), F.get(box, 1).alias("ey0"), F.get(box, 3).alias("ey1"))


def _with_next(spark, sf_dir):
    t = tokens(spark, sf_dir)
    side = lambda p: t.select("sheet_id", *[F.col(c).alias(f"{p}{c}") for c in ("seq", "x0", "y0", "x1", "y1")])
    a, b = side("a_"), side("b_")
    return a.join(b, (a.sheet_id == b.sheet_id) & (F.col("a_seq") + 1 == F.col("b_seq"))).drop(b.sheet_id)


@query(TOK + "SELECT a.sheet_id, a.seq, CASE WHEN least(a.x1, b.x1) <= greatest(a.x0, b.x0) THEN 0 ELSE round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(a.x1 - a.x0, b.x1 - b.x0), 1), 6) END AS across, round(sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(0.6 * greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)), 6) AS gap FROM t a JOIN t b ON a.sheet_id = b.sheet_id AND a.seq + 1 = b.seq")
def box_gaps(spark, sf_dir):
    return _with_next(spark, sf_dir).select("sheet_id", F.col("a_seq").alias("seq"), F.round(regions.across("a_", "b_"), 6).alias("across"), F.round(regions.gap("a_", "b_"), 6).alias("gap"))


@query(TOK + "SELECT sheet_id, seq, x0 + 7 AS x0, y0 + 9 AS y0, x1 + 7 AS x1, y1 + 9 AS y1, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2.0 + 7 AS cx, (y0 + y1) / 2.0 + 9 AS cy, (y0 + y1) / 2.0 + 9 BETWEEN 9 AND 30 AND greatest(0, least(x1 + 7, 90) - greatest(x0 + 7, 20)) >= 0.8 * greatest(x1 - x0, 1) AS in_column FROM t")
def box_measures(spark, sf_dir):
    t = regions.measures(regions.shifted(tokens(spark, sf_dir), F.lit(7), F.lit(9)))
    return t.select("sheet_id", "seq", "x0", "y0", "x1", "y1", "w", "h", "cx", "cy", regions.in_column("", F.lit(20), F.lit(9), F.lit(90), F.lit(30)).alias("in_column"))


@query(TOK + "SELECT sheet_id, engine, round(least(sum((x1 - x0) * (y1 - y0)) / greatest((max(x1) - min(x0)) * (max(y1) - min(y0)), 1), 1.0), 6) AS compactness, ((max(x1) - min(x0)) * (max(y1) - min(y0)))::BIGINT AS area FROM t GROUP BY sheet_id, engine")
def compactness(spark, sf_dir):
    c = regions.compactness(tokens(spark, sf_dir), "sheet_id", "engine")
    return c.select("sheet_id", "engine", F.round("compactness", 6).alias("compactness"), F.col("area").cast("bigint").alias("area"))


@query(TOK + "SELECT b.sheet_id, round(coalesce(avg(((m.x0 + m.x1) / 2.0 BETWEEN 10 AND 90 AND (m.y0 + m.y1) / 2.0 BETWEEN 5 AND 30)::INT), 1.0), 6) AS coverage FROM (SELECT DISTINCT sheet_id FROM t) b LEFT JOIN (SELECT * FROM t WHERE engine = 'doctr') m USING (sheet_id) GROUP BY b.sheet_id")
def region_coverage(spark, sf_dir):
    t = tokens(spark, sf_dir)
    boxes = t.select("sheet_id").distinct().select("sheet_id", F.lit(10).alias("x0"), F.lit(5).alias("y0"), F.lit(90).alias("x1"), F.lit(30).alias("y1"))
    return regions.coverage(boxes, t.filter("engine = 'doctr'"), "sheet_id").select("sheet_id", F.round("coverage", 6).alias("coverage"))


def _near(side: str, lines: str, most: int) -> str:
    return f"coalesce(list_extract(list_sort(list_filter([{{'d': abs(v - {side}), 'v': v}} FOR v IN {lines}], lambda c: c.d <= {most}), 'ASC'), 1).v, {side})"


@query(TOK + f", n AS (SELECT sheet_id, seq, x0, y0, x1, y1, greatest(0, {_near('x0', '[3, 40, 77]', 12)}) AS a, greatest(0, {_near('y0', '[2, 31]', 6)}) AS b, least(200, {_near('x1', '[3, 40, 77]', 12)}) AS c, least(100, {_near('y1', '[2, 31]', 6)}) AS d FROM t) SELECT sheet_id, seq, (CASE WHEN c - a < 20 OR d - b < 20 THEN x0 ELSE a END)::INT AS x0, (CASE WHEN c - a < 20 OR d - b < 20 THEN y0 ELSE b END)::INT AS y0, (CASE WHEN c - a < 20 OR d - b < 20 THEN x1 ELSE c END)::INT AS x1, (CASE WHEN c - a < 20 OR d - b < 20 THEN y1 ELSE d END)::INT AS y1 FROM n")
def snapped_boxes(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("xs", F.array(F.lit(3), F.lit(40), F.lit(77))).withColumn("ys", F.array(F.lit(2), F.lit(31)))
    return t.select("sheet_id", "seq", *regions.snapped("", "xs", "ys", F.lit(200), F.lit(100)))


_LABEL = " ".join(f"CASE WHEN regexp_matches(u, '{p}') THEN '{k}' END," for k, p in regions.LABELS.items()).rstrip(",")


@query(TOK + f", u AS (SELECT sheet_id, trim(upper(text), ' .:,;') AS u FROM t), l AS (SELECT DISTINCT sheet_id, unnest([{_LABEL}]) AS k FROM u) SELECT sheet_id, coalesce(string_agg(k, '|' ORDER BY k), '') AS labels FROM l GROUP BY sheet_id")
def sheet_labels(spark, sf_dir):
    return regions.labels_of(tokens(spark, sf_dir)).withColumn("labels", F.array_join("labels", "|"))


@query("SELECT c_custkey, CASE WHEN contains(p, 'BSM') THEN 'BSM' WHEN contains(p, 'CABANA') THEN 'YFA-Cabana' WHEN contains(p, 'STATE') THEN 'YFA-StateGov' WHEN contains(p, 'YFA') THEN 'YFA' ELSE 'unknown' END AS series, (c_custkey % 3 = 1)::INT AS reviewed, h AS header FROM (SELECT c_custkey, upper(['a/bsm 1/x', 'yfa/Cabana/y', 'state/yfa', 'q/YFA2/r', 'none'][c_custkey % 5 + 1]) AS p, c_custkey % 4 < 3 AS h FROM customer)")
def image_series(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    mark, head = pick(["0", " 1 ", "yes"]), pick([" Title block", "Smith & Co. Archi-tects", "Pty. Ltd.", "Subtitle"])
    return table(spark, sf_dir, "customer").select("c_custkey", P.series(pick(["a/bsm 1/x", "yfa/Cabana/y", "state/yfa", "q/YFA2/r", "none"])).alias("series"), P.reviewed(mark).alias("reviewed"), regions.is_header(head).alias("header"))


_OTHER = "CASE seq % 6 WHEN 0 THEN concat(text, '1/', cast(seq AS {s})) WHEN 1 THEN '##' WHEN 2 THEN concat('|', text, ' .') WHEN 3 THEN concat(text, 'WIDE') WHEN 4 THEN concat(text, ' 1a ') ELSE substr(text, 2) END"


@query(TOK + f""", o AS (SELECT *, trim(text) AS m, trim({_OTHER.format(s='VARCHAR')}) AS a FROM t),
e AS (SELECT *, trim(substr(a, 1, strpos(a, m) - 1) || substr(a, strpos(a, m) + length(m))) AS extra FROM o),
c AS (SELECT *, regexp_replace(extra, '\\s', '', 'g') AS core FROM e)
SELECT sheet_id, seq, CASE WHEN m <> '' AND length(a) > length(m) AND strpos(a, m) > 0 AND length(extra) BETWEEN 1 AND 4 AND length(core) - length(regexp_replace(core, '[1IiljL|/\\\\''\"`.,\\-_0-9]', '', 'g')) >= 0.6 * length(core) THEN extra END AS extra, contains(upper(a), upper(m)) OR contains(upper(m), upper(a)) AS same FROM c""")
def fuller_readings(spark, sf_dir):
    """What another reading has beyond a token's own; the others are longer, shorter, wider or quite different."""
    t = tokens(spark, sf_dir)
    more = F.expr(_OTHER.format(s="STRING"))
    return t.select("sheet_id", "seq", P.more_complete(F.col("text"), more).alias("extra"), P.same_text(F.col("text"), more).alias("same"))


@query(TOK + "SELECT sheet_id, seq, round(CASE WHEN h > 0 THEN greatest(least(least(greatest(42 / h, 2.5), 6), 4000.0 / w), 0.1) ELSE least(2.5, 4000.0 / w) END, 6) AS up FROM (SELECT sheet_id, seq, (seq * 4)::DOUBLE AS h, 500 + x0 * 20 AS w FROM t)")
def crop_scales(spark, sf_dir):
    return tokens(spark, sf_dir).select("sheet_id", "seq", F.round(regions.scales((F.col("seq") * 4).cast("double"), 500 + F.col("x0") * 20, 42.0, 2.5, 6.0), 6).alias("up"))


_LINES = TOK + ", i AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, seq) - 1)::INT AS tid, (y0 // 24 + 1)::INT AS row_no FROM t), l AS (SELECT sheet_id, row_no, min(x0) AS lx, min(y0) AS ly FROM i GROUP BY sheet_id, row_no) "


def _rows(spark, sf_dir):
    t = layout.token_ids(tokens(spark, sf_dir), "y0", "x0", "seq").withColumn("row_no", F.floor(F.col("y0") / 24).cast("int") + 1)
    return t.withColumn("alternatives", F.when(F.col("seq") % 3 == 0, F.array(F.concat("engine", F.lit(":"), F.upper("text")))).otherwise(F.array().cast("array<string>")))


@query(_LINES + "SELECT sheet_id, row_no, string_agg(text, ' ' ORDER BY x0, tid) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY sheet_id, row_no")
def text_lines(spark, sf_dir):
    return views.lines(_rows(spark, sf_dir)).select("sheet_id", "row_no", "text", "x0", "y0", "x1", "y1")


@query(_LINES + "SELECT sheet_id, string_agg(concat('[', tid, '] row ', row_no, '  ', text, CASE WHEN seq % 3 = 0 THEN concat('   ← alternatives ', engine, ':', upper(text)) ELSE '' END, CASE WHEN seq % 4 = 1 THEN concat(chr(10), repeat(' ', length(concat('[', tid, '] row ', row_no))), '   ⚠ prefer ''', lower(text), ''': longer') ELSE '' END), chr(10) ORDER BY ly, lx, x0, tid) AS index FROM i JOIN l USING (sheet_id, row_no) GROUP BY sheet_id")
def index_views(spark, sf_dir):
    t = _rows(spark, sf_dir)
    hints = t.filter("seq % 4 = 1").select("sheet_id", "tid", F.lower("text").alias("preferred"), F.lit("longer").alias("why"))
    return views.index(t, hints)


@query()
def grid_views(spark, sf_dir):
    return views.grid(_rows(spark, sf_dir))


def _passes(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return tuple(fusion.in_order(fusion.fuse(t.filter(own), n)) for own, n in (("engine <> 'paddle'", 2), ("engine = 'paddle'", 1)))


@query()
def merged_passes(spark, sf_dir):
    """Two engines' tokens are the fine pass, the third one's the coarse; tested against a plain loop."""
    fine, coarse = _passes(spark, sf_dir)
    shown = F.transform("candidates", lambda c: F.concat_ws("@", c["text"], c["engine"], c["conf"].cast("string")))
    return fusion.merged_passes(fine, coarse).withColumn("candidates", F.array_join(shown, "|"))


@query()
def merge_counts(spark, sf_dir):
    """What the merging of passes did on each sheet; tested against a plain loop."""
    return fusion.merge_summary(fusion.merged_passes(*_passes(spark, sf_dir)))


@query(TOK + "SELECT sheet_id, seq, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY sqrt(power(x1 - x0, 2) + power(y1 + seq - y0, 2)) DESC, x0, y0, x1, y1 + seq) AS k FROM t) WHERE k <= 3")
def longest_segments(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("y1", F.col("y1") + F.col("seq"))
    return views.longest(t, "sheet_id", 3).select("sheet_id", "seq", "rank")


@query(f"WITH {LATEST_DUCK} SELECT k AS image_key, CASE WHEN c_custkey IS NULL THEN 'not found' WHEN status = 1 THEN 'conflict' ELSE 'ok' END AS outcome FROM (SELECT DISTINCT o_custkey + o_orderkey % 2 * 100000 AS k FROM orders) LEFT JOIN customer ON c_custkey = k LEFT JOIN state ON image_key = k AND status = 1")
def rerun_outcomes(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000).alias("image_key"))
    return status.rerun(_images(spark, sf_dir), _state(spark, sf_dir), keys, "image_key")


@query(f"WITH {LATEST_DUCK} SELECT image_key, seq, 7::BIGINT AS updated_at, 3 AS status, folder, task, 'interrupted' AS message FROM state WHERE status = 1 AND image_key IN (SELECT c_custkey FROM customer)")
def restarted_states(spark, sf_dir):
    return status.failed(_state(spark, sf_dir), "interrupted", 7, _images(spark, sf_dir).select("image_key"))


@query(f"WITH {LATEST_DUCK} SELECT f::INT AS folder, NULL::INT AS status, (SELECT count(*) FROM state WHERE folder = f) AS n FROM range(0, 9) t(f) UNION ALL SELECT NULL, s::INT, (SELECT count(*) FROM state WHERE status = s) FROM range(0, 4) t(s)")
def seeded_counts(spark, sf_dir):
    return status.seeded_counts(_state(spark, sf_dir), spark.range(9).select(F.col("id").cast("int").alias("folder")))


@query(f"WITH {LATEST_DUCK} SELECT c_nationkey::VARCHAR AS folder, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM customer JOIN state ON image_key = c_custkey WHERE status = 2 GROUP BY c_nationkey")
def export_preview(spark, sf_dir):
    rows = _images(spark, sf_dir).withColumn("folder", F.col("node").cast("string"))
    return status.preview(status.exported(rows, _state(spark, sf_dir).select("image_key", "status"), "image_key", code=2))


@query(f"WITH {LATEST_DUCK} SELECT image_key, folder FROM state WHERE status = 0 AND folder = 3 ORDER BY image_key LIMIT 20 OFFSET 20")
def second_page(spark, sf_dir):
    return status.page(_state(spark, sf_dir).filter("status = 0 AND folder = 3").select("image_key", "folder"), 2, 20, "image_key")


@query(TOK + "SELECT sheet_id, seq, seq % 4 = 0 OR contains(upper(text), 'REVISION') OR contains(upper(text), 'AMENDMENT') OR contains(upper(text), 'REV.') AS revision FROM t")
def revision_words(spark, sf_dir):
    t = F.when(F.col("seq") % 4 == 0, F.concat("text", F.lit(" amendments"))).otherwise(F.col("text"))
    return tokens(spark, sf_dir).select("sheet_id", "seq", P.names_revision(t).alias("revision"))


@query()
def repaired_readings(spark, sf_dir):
    """The repairs of each distinct text: as a number field, and in general; the candidates of the first."""
    t = tokens(spark, sf_dir).select("text").distinct()
    return t.select("text", P.with_digits(F.col("text"), "date").alias("numeric"), P.with_digits(F.col("text")).alias("general"), F.array_join(P.variants(F.col("text"), "date"), "|").alias("variants"))


@query("WITH c AS (SELECT CASE WHEN l_suppkey % 9 > 0 THEN l_partkey END AS p, CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey END AS q, CASE WHEN l_suppkey % 9 > 0 AND l_linenumber > 1 THEN l_partkey + l_suppkey END AS t FROM lineitem), s AS (SELECT count(*) AS calls, sum(p)::BIGINT AS prompt, sum(q)::BIGINT AS completion FROM c WHERE t > 0) SELECT *, prompt // calls AS prompt_each, completion // calls AS completion_each, (prompt + completion) * 1000 // calls AS per_thousand FROM s")
def model_usage(spark, sf_dir):
    """Tokens of all calls that told them."""
    told = F.col("l_suppkey") % 9 > 0
    calls = table(spark, sf_dir, "lineitem").select(F.when(told, F.col("l_partkey")).alias("prompt_tokens"), F.when(told, F.col("l_suppkey")).alias("completion_tokens"), F.when(told & (F.col("l_linenumber") > 1), F.col("l_partkey") + F.col("l_suppkey")).alias("total_tokens"))
    return records.usage_totals(calls)


@query(TOK + "SELECT sheet_id, seq, round(CASE WHEN up * w > 4000 THEN 4000.0 / w ELSE up END, 6) AS up FROM (SELECT sheet_id, seq, 500 + x0 * 20 AS w, CASE WHEN seq > 0 THEN 26 / (seq * 4)::DOUBLE ELSE 2.0 END AS up FROM t)")
def page_scales(spark, sf_dir):
    """The enlargement of pages for their first reading."""
    return tokens(spark, sf_dir).select("sheet_id", "seq", F.round(regions.coarse_scale((F.col("seq") * 4).cast("double"), 500 + F.col("x0") * 20), 6).alias("up"))
