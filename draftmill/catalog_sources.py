"""Queries of payloads, stores, prompts and exports over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftmill.catalog import TOK, query
from draftmill.operators import prompt, status
from draftmill.operators.records import FIELDS, shown_value
from draftmill.plans.relations import FIELDS_DUCK, LATEST_DUCK, LOG_DUCK, fields, log, tokens
from draftmill.sources import payloads, store


def _payloads(spark, sf_dir):
    """What three engines would have returned for each sheet: its tokens as payloads of an image enlarged twice, some blank
    or unsure, tesseract's in two equal passes; every thirteenth sheet's are cut off."""
    t = tokens(spark, sf_dir)
    k = F.col("seq")
    text = F.when(k % 7 == 6, " ").otherwise(F.concat(F.lit(" "), "text"))
    x0, y0, x1, y1 = (F.col(c) * 2 + d for c, d in (("x0", 1), ("y0", 1), ("x1", 1), ("y1", 0)))
    conf = F.when(k % 5 == 4, -1.0).otherwise(F.round(F.col("conf") * 100))
    word = F.struct(text.alias("value"), F.col("conf").alias("confidence"), F.array(F.array(x0 / 512, y0 / 256), F.array(x1 / 512, y1 / 256)).alias("geometry"))
    part = F.struct(k.alias("k"), text.alias("text"), conf.alias("conf"), F.col("conf").alias("score"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), word.alias("word"))
    own = t.groupBy("sheet_id", "engine").agg(F.array_sort(F.collect_list(part)).alias("p"))
    p = F.col("p")
    of = lambda f: F.transform(p, f)
    one = F.struct(p["text"].alias("text"), p["conf"].alias("conf"), p["x0"].alias("left"), p["y0"].alias("top"), of(lambda r: r["x1"] - r["x0"]).alias("width"), of(lambda r: r["y1"] - r["y0"]).alias("height"))
    corners = of(lambda r: F.array(F.array(r["x1"], r["y0"]), F.array(r["x0"], r["y1"])))
    paddle = F.array(F.struct(p["text"].alias("rec_texts"), p["score"].alias("rec_scores"), corners.alias("rec_polys")))
    doctr = F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(p["word"].alias("words"))).alias("lines"))).alias("blocks"))).alias("pages"))
    text = F.when(F.col("engine") == "tesseract", F.to_json(F.array(one, one))).when(F.col("engine") == "paddle", F.to_json(paddle)).otherwise(F.to_json(doctr))
    cut = F.when(F.col("sheet_id") % 13 == 0, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return own.select("sheet_id", F.lit("fine").alias("pass"), "engine", cut.alias("payload"), F.lit(2.0).alias("factor"), F.lit(512).alias("width"), F.lit(256).alias("height"))


_READ = TOK + """, r AS (SELECT sheet_id, engine, seq, CASE WHEN seq % 7 = 6 THEN '' ELSE text END AS text, x0, y0, (x1 + 1)::INT AS x1, y1, CASE WHEN engine = 'tesseract' THEN CASE WHEN seq % 5 = 4 THEN -1 ELSE round(conf * 100) / 100 END ELSE conf END AS conf FROM t WHERE sheet_id % 13 > 0),
k AS (SELECT * FROM r WHERE engine = 'doctr' OR (text <> '' AND conf >= 0)),
d AS (SELECT * FROM k QUALIFY engine <> 'tesseract' OR row_number() OVER (PARTITION BY sheet_id, engine, text, x0, y0, x1, y1 ORDER BY seq) = 1)"""


@query(_READ + ", g AS (SELECT sheet_id, engine, (row_number() OVER (PARTITION BY sheet_id, engine ORDER BY seq) - 1)::INT AS seq, trim(text) AS text, x0, y0, x1, y1, conf, false AS broken FROM d) SELECT * FROM g UNION ALL SELECT DISTINCT sheet_id, engine, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM t WHERE sheet_id % 13 = 0")
def payload_readings(spark, sf_dir):
    """The readings of the engines' payloads; a payload that is cut off is a row of its own."""
    r = payloads.readings(_payloads(spark, sf_dir))
    return r.select("sheet_id", "engine", "seq", "text", "x0", "y0", "x1", "y1", "conf", F.col("error").isNotNull().alias("broken"))


@query(_READ + ", n AS (SELECT sheet_id, engine, count(*) AS n FROM d GROUP BY ALL) SELECT DISTINCT t.sheet_id, t.engine, coalesce(n, 0) AS n, t.sheet_id % 13 = 0 AS broken FROM t LEFT JOIN n ON n.sheet_id = t.sheet_id AND n.engine = t.engine")
def engine_runs(spark, sf_dir):
    """How many readings each engine gave for each sheet, and whether it failed."""
    _, ran = payloads.read_all(_payloads(spark, sf_dir))
    return ran.select("sheet_id", "engine", "n", F.col("error").isNotNull().alias("broken"))


_WORDS = ("queued", "running", "success", "3")


@query(f"WITH log AS ({LOG_DUCK}), k AS (SELECT *, image_key % 40 AS bucket, 'n' || folder AS node, image_key || '.png' AS name FROM log), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY image_key ORDER BY seq DESC) = 1) SELECT node || '/' || name AS image_key, status, updated_at, (seq % 3 = 1)::INT AS reviewed, seq % 3 = 2 OR seq % 4 = 0 AS migrated, CASE WHEN seq % 4 = 0 THEN 'illegible' WHEN seq % 4 = 1 THEN 'odd' END AS reason, CASE WHEN seq % 4 = 0 THEN 'note,seen' WHEN seq % 4 = 1 THEN 'note' END AS notes FROM l")
def stored_states(spark, sf_dir):
    """The log of states as forty store files, old and new in form, read back."""
    s = log(spark, sf_dir)
    n = F.col("seq")
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), F.col("status").cast("int"))
    mark = F.when(n % 3 == 0, "0").when(n % 3 == 1, "1").otherwise('" 0 "')
    result = F.when(n % 4 == 0, '{"scale_reason": ["seen", "illegible"], "scale_notes": ["note"]}').when(n % 4 == 1, '{"scale_reason": "odd", "scale_notes": ["note"]}').otherwise("{}")
    one = F.format_string('"x/n%d/%d.png": {"status": "%s", "updated_at": %d, "manual_reviewed": %s, "result": %s}', F.col("folder"), F.col("image_key"), word, F.col("updated_at"), mark, result)
    last = status.latest(s.withColumn("one", one), "image_key", "seq")
    # an older state of an image stands before its last one, under another path of the same node and image
    first = F.regexp_replace(one, "^\"x/", "\"y\\\\\\\\\\\\\\\\z/")
    old = s.join(last.select("image_key", F.col("seq").alias("__last")), "image_key").filter(n < F.col("__last")).groupBy("image_key").agg(F.max_by(first, "seq").alias("one")).withColumn("k", F.lit(0))
    every = old.unionByName(last.select("image_key", "one", F.lit(1).alias("k")))
    files = every.groupBy((F.col("image_key") % 40).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "image_key", "one")))["one"], ", ").alias("body"))
    value = F.when(F.col("bucket") % 2 == 0, F.concat(F.lit('{"images": {'), "body", F.lit("}}"))).otherwise(F.concat(F.lit("{"), "body", F.lit("}")))
    got = store.states_of(files.select(F.col("bucket").cast("string").alias("file"), value.alias("value")))
    reasons = store.result_reasons(got).select("image_key", "reason", F.array_join("notes", ",").alias("notes"))
    return got.join(reasons, "image_key", "left").select("image_key", F.col("status").cast("int").alias("status"), "updated_at", F.col("manual_reviewed").alias("reviewed"), "migrated", "reason", "notes")


_OPEN = {f: prompt.DESCRIPTIONS[f] for f in FIELDS}


@query(f"WITH f AS ({FIELDS_DUCK}), g AS (SELECT sheet_id, coalesce(list(name) FILTER (status = 'auto_accept'), []) AS known, string_agg('  ' || name || ' = ' || coalesce(verbatim, ''), chr(10) ORDER BY name) FILTER (status = 'auto_accept') AS locked, string_agg('  ' || name || ': ' || status, chr(10) ORDER BY name) FILTER (status = 'rejected') AS doubted FROM f GROUP BY sheet_id), w AS (SELECT *, list_filter({list(_OPEN)}, lambda n: NOT list_contains(known, n)) AS pending FROM g) SELECT sheet_id, array_to_string(pending, ',') AS pending, sha256('GRID' || chr(10) || 'g' || sheet_id || chr(10) || chr(10) || 'INDEX' || chr(10) || '[0] x' || chr(10) || chr(10) || 'Already known:' || chr(10) || coalesce(locked, '  (none)') || chr(10) || chr(10) || 'Wanted:' || chr(10) || array_to_string(list_transform(pending, lambda n: '  ' || n || ': ' || map({list(_OPEN)}, {[v for v in _OPEN.values()]})[n]), chr(10)) || chr(10) || CASE WHEN doubted IS NULL THEN '' ELSE chr(10) || 'The rules weren''t sure of these:' || chr(10) || doubted || chr(10) END || chr(10) || '{prompt.TASK.replace(chr(39), chr(39) * 2)}') AS prompt_sha256 FROM w WHERE len(pending) > 0")
def model_prompts(spark, sf_dir):
    """What the model is asked for each sheet that has fields pending."""
    f = fields(spark, sf_dir).select("sheet_id", "name", (F.col("status") == "auto_accept").alias("locked"), "verbatim", F.when(F.col("status") == "rejected", F.col("status")).alias("rejected"))
    views = f.select("sheet_id").distinct().select("sheet_id", F.concat(F.lit("g"), F.col("sheet_id").cast("string")).alias("grid"), F.lit("[0] x").alias("index"))
    p = prompt.prompts(views, f).filter("prompt IS NOT NULL")
    return p.select("sheet_id", F.array_join("pending", ",").alias("pending"), F.sha2("prompt", 256).alias("prompt_sha256"))


_MARK = ("scale", "date")


@query(f"WITH f AS ({FIELDS_DUCK}), v AS (SELECT sheet_id, name, coalesce(nullif(corrected, ''), nullif(verbatim, '')) AS value, round(confidence, 3) AS conf FROM f) SELECT sheet_id AS image_key, (sheet_id % 3 = 0)::INT AS reviewed, " + ", ".join(f"max(value) FILTER (name = '{f}') AS {f}, CASE WHEN sheet_id % 3 > 0 THEN max(conf) FILTER (name = '{f}') END AS {f}_conf, sheet_id % 3 > 0 AND coalesce(max(conf) FILTER (name = '{f}') < 0.75, false) AS {f}_low" for f in _MARK) + " FROM v GROUP BY sheet_id")
def marked_results(spark, sf_dir):
    """The rows of an export with the marks of reviewed images and of unsure values."""
    f = fields(spark, sf_dir)
    states = f.select(F.col("sheet_id").alias("image_key")).distinct().withColumn("reviewed", (F.col("image_key") % 3 == 0).cast("int"))
    return status.marked_results(states, f.select(F.col("sheet_id").alias("image_key"), "name", shown_value().alias("value"), F.round("confidence", 3).alias("conf")), _MARK)


@query(f"WITH {LATEST_DUCK} SELECT coalesce(CASE WHEN folder > 0 THEN 'f' || folder END, 'Unknown folder') AS folder, count(*) AS n FROM state WHERE status = 2 GROUP BY 1")
def folder_list(spark, sf_dir):
    """The folders of images of one status."""
    s = status.latest(log(spark, sf_dir), "image_key", "updated_at", "seq")
    return status.folders(s.withColumn("folder", F.when(F.col("folder") > 0, F.concat(F.lit("f"), F.col("folder").cast("string")))), 2)


@query(TOK + ", b AS (SELECT sheet_id, seq, CASE WHEN seq % 6 = 5 THEN 'drawing_type' ELSE 'f' || seq END AS name, CASE WHEN seq % 4 = 1 THEN NULL ELSE x0 END AS x0, x1, CASE WHEN seq % 5 = 3 THEN y1 ELSE y0 END AS y0, y1, CASE WHEN seq % 3 > 0 THEN conf END AS confidence FROM t) SELECT sheet_id, seq FROM b WHERE name <> 'drawing_type' AND x0 IS NOT NULL AND x0 <> x1 AND y0 <> y1 AND coalesce(confidence, 1) >= 0.3")
def shown_boxes(spark, sf_dir):
    """The boxes that are drawn on an image."""
    k = F.col("seq")
    b = tokens(spark, sf_dir).withColumns({"name": F.when(k % 6 == 5, "drawing_type").otherwise(F.concat(F.lit("f"), k.cast("string"))), "x0": F.when(k % 4 == 1, None).otherwise(F.col("x0")), "y0": F.when(k % 5 == 3, F.col("y1")).otherwise(F.col("y0")), "confidence": F.when(k % 3 > 0, F.col("conf"))})
    return status.shown_boxes(b).select("sheet_id", "seq")
