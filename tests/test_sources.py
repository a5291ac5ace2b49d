"""Payloads of three engines, the store of states, its log and sidecars, and pixels."""

import hashlib
import json
import struct
import zlib

import numpy as np
from draftmill.operators import fusion, locate, prompt, status
from draftmill.sources import payloads, pixels, store
from pyspark.sql import functions as F

PAYLOADS = "sheet_id int, pass string, engine string, payload string, factor double, width int, height int"
TESSERACT = {"text": ["SITE", " ", None, "PLAN", "low"], "conf": [91.0, 90, 80, "75.5", -1], "left": [10, 0, 0, 61, 0], "top": [5, 0, 0, 5, 0], "width": [40, 1, 1, 41, 1], "height": [9, 1, 1, 10, 1]}
PADDLE = [None, {"rec_texts": ["SITE PLAN", "  ", "bare"], "rec_scores": [0.9, 0.8], "rec_polys": [[[10, 5], [101, 6], [102, 15], [9, 14]], [[0, 0]]]}, [[[[1, 2], [3, 4]], ["old", 0.5]], "odd", [[[1, 2]], None]]]
DOCTR = {"pages": [{"blocks": [{"lines": [{"words": [{"value": " SITE ", "confidence": 0.8, "geometry": [[0.05, 0.05], [0.25, 0.15]]}, {"value": "", "confidence": 0.1, "geometry": [[0, 0], [1, 1]]}]}]}]}]}


def rows(df):
    return sorted([tuple(x[k] for k in ("text", "x0", "y0", "x1", "y1", "conf")) for x in df.collect()], key=str)


def test_payloads(spark):
    table = [(1, "fine", "tesseract", json.dumps([TESSERACT, None, {"text": ["x"]}, TESSERACT]), 2.0, 200, 100), (1, "fine", "paddle", json.dumps(PADDLE), 2.0, 200, 100), (1, "fine", "doctr", json.dumps(DOCTR), 2.0, 200, 100)]
    odd = [(2, "fine", "doctr", "{}", 1.0, 1, 1), (2, "fine", "paddle", "not json", 1.0, 1, 1), (2, "fine", "tesseract", "3", 1.0, 1, 1), (2, "coarse", "other", "[]", 1.0, 1, 1), (3, "fine", "paddle", None, 1.0, 1, 1), (3, "fine", "doctr", '{"pages": []}', None, None, None), (4, "fine", "paddle", json.dumps({"res": PADDLE[1]}), 1.0, 1, 1)]
    df = spark.createDataFrame(table + odd, PAYLOADS)
    got = payloads.readings(df)
    by = lambda s, e: rows(got.filter((F.col("sheet_id") == s) & (F.col("engine") == e)))
    assert by(1, "tesseract") == [("PLAN", 30, 2, 51, 8, 0.755), ("SITE", 5, 2, 25, 7, 0.91)]
    assert by(1, "paddle") == [("SITE PLAN", 4, 2, 51, 8, 0.9), ("bare", 0, 0, 0, 0, 0.0), ("old", 0, 1, 2, 2, 0.5)]
    assert by(1, "doctr") == [("", 0, 0, 100, 50, 0.1), ("SITE", 5, 2, 25, 8, 0.8)]
    assert [r[0] for r in by(4, "paddle")] == ["SITE PLAN", "bare"]
    bad = got.filter("error IS NOT NULL").select("sheet_id", "engine", "text").collect()
    assert sorted(map(tuple, bad)) == [(2, "doctr", None), (2, "other", None), (2, "paddle", None), (2, "tesseract", None)]
    good, ran = payloads.read_all(df)
    assert good.filter("sheet_id = 1").count() == 7 and good.groupBy("sheet_id", "pass").agg(F.max("seq") - F.count("*")).filter("`(max(seq) - count(1))` <> -1").count() == 0
    told = {(x["sheet_id"], x["engine"]): (x["n"], x["error"] is not None) for x in ran.collect()}
    assert told[1, "paddle"] == (3, False) and told[2, "other"] == (0, True) and told[3, "paddle"] == told[3, "doctr"] == (0, False)
    assert payloads.readings(df.limit(0)).count() == 0


def test_three_engines_make_one_token(spark):
    """The golden case: three engines read one title; a token that only the coarse pass has is recovered."""
    one = lambda text, x: json.dumps({"text": [text], "conf": [90], "left": [x], "top": [10], "width": [80], "height": [20]})
    word = json.dumps({"pages": [{"blocks": [{"lines": [{"words": [{"value": "SITE PLAN", "confidence": 0.9, "geometry": [[0.05, 0.1], [0.45, 0.3]]}]}]}]}]})
    poly = json.dumps([{"rec_texts": ["SITE PLAN"], "rec_scores": [0.95], "rec_polys": [[[10, 10], [90, 10], [90, 30], [10, 30]]]}])
    table = [(1, "fine", "tesseract", one("SITE PLAN", 10), 1.0, 200, 100), (1, "fine", "paddle", poly, 1.0, 200, 100), (1, "fine", "doctr", word, 1.0, 200, 100), (1, "coarse", "tesseract", json.dumps({"text": ["SITE PLAN", "NORTH"], "conf": [80, 70], "left": [10, 120], "top": [10, 60], "width": [80, 50], "height": [20, 20]}), 1.0, 200, 100)]
    good, _ = payloads.read_all(spark.createDataFrame(table, PAYLOADS))
    fine = fusion.in_order(fusion.fuse(good.filter("pass = 'fine'"), 3))
    x = fine.first()
    assert (fine.count(), x["text"], x["agreement"], len(x["candidates"])) == (1, "SITE PLAN", 1.0, 3)
    assert tuple(fusion.pass_summary(fine).first()) == (1, 1, 0)
    merged = fusion.merged_passes(fine, fusion.in_order(fusion.fuse(good.filter("pass = 'coarse'"), 1)))
    assert [(r["text"], r["agreement"]) for r in merged.orderBy("place").collect()] == [("SITE PLAN", 1.0), ("NORTH", 0.5)]
    assert tuple(fusion.merge_summary(merged).first()) == (1, 1, 0, 1, 2)


def test_store(spark, tmp_path):
    new = {
        "F/node1/a.png": {"status": "2", "manual_reviewed": 1, "updated_at": 5, "message": "", "error": "late", "result": {"scale_reason": ["seen", "illegible", "ambiguous"], "scale_notes": ["n", ["deep", None], " n "], "date_reason": " not_present ", "date_notes": []}},
        "node1\\b.png": {"status": "queued", "manual_reviewed": "1", "node_id": "own", "result": None},
        "node1/c.png": {"status": 7, "manual_reviewed": 0, "result": {"date_reason": "odd", "date_notes": ["x"], "architect_notes": None}},
        "alone.png": {"status": 1}, "node1/d.png": "no object", "node1/e.png": {"status": "3", "manual_reviewed": True},
        "G/node1/a.png": {"status": 3, "manual_reviewed": 0, "task_uuid": "t", "result": {}},
    }
    for name, text in {"new.json": json.dumps(new), "old.json": json.dumps({"images": {"n/x.png": {"status": "success", "manual_reviewed": 0}}, "other": 1}), "broken.json": '{"a/b": {', "list.json": "[1]", "empty.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    got = store.read_store(spark, str(tmp_path))
    by = {x["image_key"]: x for x in got.filter("error IS NULL").collect()}
    assert {k: (x["status"], x["manual_reviewed"], x["migrated"], x["message"], x["task_uuid"]) for k, x in by.items()} == {"node1/a.png": (3, 0, False, None, "t"), "own/b.png": (0, 1, True, None, None), "node1/c.png": (0, 0, True, None, None), "node1/e.png": (3, 1, True, None, None), "n/x.png": (2, 0, False, None, None)}
    assert sorted(x["file"].rsplit("/", 1)[-1] for x in got.filter("error IS NOT NULL").collect()) == ["broken.json", "list.json"]
    first = spark.createDataFrame([("node1/a.png", json.dumps(new["F/node1/a.png"]["result"])), ("node1/c.png", json.dumps(new["node1/c.png"]["result"])), ("z", "{}"), ("y", json.dumps({"date_reason": None, "date_notes": ["a", "b"]}))], "image_key string, r string").select("image_key", F.parse_json("r").alias("result"))
    fields = {(x["image_key"], x["field"]): (x["reason"], x["notes"], x["migrated"]) for x in store.result_reasons(first).collect()}
    assert fields == {("node1/a.png", "scale"): ("illegible", ["n", "deep", "seen", "ambiguous"], True), ("node1/a.png", "date"): ("not_present", [], True), ("node1/c.png", "date"): ("odd", ["x"], False), ("node1/c.png", "architect"): (None, [], True), ("y", "date"): (None, ["a", "b"], False)}


def test_log_and_sidecars(spark, tmp_path):
    schema = "image_key string, node_id string, image_name string, status int, task_uuid string, message string, updated_at bigint, manual_reviewed int, result string"
    state = lambda k, s, at: (k, "n", k, s, None, None, at, 0, "{}")
    path = str(tmp_path / "log")
    store.append_log(spark.createDataFrame([state("a", 0, 1), state("b", 1, 86_400_000)], schema), path)
    store.append_log(spark.createDataFrame([state("a", 2, 90_000_000), state("b", 0, 5), state("c", 1, None)], schema), path)
    assert {x["image_key"]: x["status"] for x in store.log_states(spark, path).collect()} == {"a": 2, "b": 1, "c": 1}
    assert spark.read.parquet(path).select("day").distinct().count() == 2
    records = spark.createDataFrame([("n1", "a.png", [1, 2], {"scale": "1:10"}, None), ("n1", "b.png", [], {}, 0.5), ("n 2", "ü.png", None, None, None)], "node_id string, image_name string, box array<int>, fields map<string,string>, conf double")
    out = str(tmp_path / "side")
    store.write_sidecars(records, out)
    (tmp_path / "side" / "node=n1" / "z.txt").write_text("{broken\n")
    back = store.read_sidecars(spark, out, "node_id string, image_name string, box array<int>, fields map<string,string>, conf double")
    assert sorted(map(tuple, back.filter("broken IS NULL").drop("broken").collect()), key=str) == sorted(map(tuple, records.collect()), key=str)
    assert [x["broken"] for x in back.filter("broken IS NOT NULL").collect()] == ["{broken"]
    flat = spark.createDataFrame([("1", ' a "b", c ', ""), ("2", "x\ny", "ü")], "k string, t string, u string")
    store.write_rows(flat, str(tmp_path / "csv"))
    again = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("emptyValue", "").csv(str(tmp_path / "csv"))
    assert sorted((x["k"], x["t"], x["u"] or "") for x in again.collect()) == sorted(map(tuple, flat.collect()))


def png(a):
    """A grey image as a PNG file."""
    h, w = a.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filled(ink):
    """(width, height, area) of what touches, by flood fill."""
    todo, out = {(int(y), int(x)) for y, x in np.argwhere(ink)}, []
    while todo:
        part, front = [], [todo.pop()]
        while front:
            y, x = front.pop()
            part.append((y, x))
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in todo:
                    todo.remove(p)
                    front.append(p)
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        out.append((max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return sorted(out)


def drawn(r, h, w, n):
    a = np.full((h, w), 230, np.uint8)
    for _ in range(n):
        y, x = int(r.integers(0, h - 30)), int(r.integers(0, w - 20))
        a[y : y + int(r.integers(2, 28)), x : x + int(r.integers(1, 14))] = r.integers(0, 90)
    a[r.random((h, w)) < 0.02] = 20
    return a


def test_pixels(spark, tmp_path):
    r = np.random.default_rng(4)
    pages = {"bsm/one/a.png": drawn(r, 300, 400, 160), "bsm/one/b.png": drawn(r, 120, 90, 20), "YFA/two/c.png": np.full((50, 60), 255, np.uint8), "YFA/two/d.png": drawn(r, 500, 300, 300)}
    for name, a in pages.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(png(a))
    (tmp_path / "YFA/two/bad.png").write_bytes(b"no image")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/e.png").write_bytes(png(pages["YFA/two/c.png"]))
    (tmp_path / "YFA/two/notes.txt").write_text("x")
    seen = pixels.read_images(spark, str(tmp_path))
    parts = {}
    for x in pixels.components(pixels.ink_runs(seen)).collect():
        parts.setdefault("/".join(x["path"].split("/")[-3:]), []).append((x["width"], x["height"], x["area"]))
    rows = {x["image_key"]: x for x in pixels.manifest(spark, str(tmp_path), "SKIP").collect()}
    for name, a in pages.items():
        h, w = a.shape
        part = a[int(h * 0.6) :, int(w * 0.6) :]
        apart = []
        for t in range(256):
            low, high = part[part <= t].astype(float), part[part > t].astype(float)
            apart.append(len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0.0)
        assert np.isclose(apart[pixels.otsu(part)], max(apart))
        want = filled(part <= pixels.otsu(part))
        assert sorted(parts.get(name, [])) == want, name
        heights = [ph for pw, ph, n in want if 3 <= ph <= 120 and 2 <= pw <= 120 and n >= 0.15 * pw * ph and pw <= 8 * ph and ph <= 8 * pw]
        x = rows["/".join(name.split("/")[1:])]
        assert (x["components"], x["width"], x["height"]) == (len(heights), w, h)
        assert abs(x["char_height"] - (np.percentile(heights, 90) if len(heights) >= 10 else 0.0)) <= 0.051
        assert x["verdict"] == ("reliable" if x["char_height"] >= 20 else "marginal" if x["char_height"] >= 8 else "unrecoverable")
        assert x["sha256"] == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()[:16] and x["series"] == ("BSM" if name[0] == "b" else "YFA")
    assert rows["two/bad.png"]["verdict"] == "unreadable_file" and rows["two/bad.png"]["width"] is None and len(rows) == 5
    assert any(x["components"] >= 10 for x in rows.values())
    colour = np.array([[[10, 20, 30], [200, 100, 50]]], np.uint8)
    assert pixels.grey(colour.tobytes(), 1, 2, 3).tolist() == [[round(1.14 + 11.74 + 8.97), round(22.8 + 58.7 + 14.95)]]


def test_thin_lines_touch_by_corners(spark):
    """Diagonals, rings and combs are one component each; a gap of a line parts them."""
    art = ["#.....#...####", ".#...#....#..#", "..#.#.....#..#", "...#......####", "..............", "##.##.########", "##.##.#.#.#.#.", "......#.#.#.#."]
    ink = np.array([[c == "#" for c in line] for line in art])
    runs = [("a", y, int(x0), int(x1)) for y, line in enumerate(ink) for x0, x1 in zip(*(np.flatnonzero(np.diff(np.pad(line.astype(int), 1)) == s) for s in (1, -1)))]
    got = pixels.components(spark.createDataFrame(runs, "path string, y int, x0 int, x1 int")).collect()
    assert sorted((x["width"], x["height"], x["area"]) for x in got) == filled(ink)


def test_resolved_and_marked(spark):
    images = spark.createDataFrame([("Fold", "n1", "a.png"), ("fold2", "n1", "a.png")], "folder string, node_id string, image_name string")
    assert [x["folder"] for x in status.resolved(images, "FOLD", "n1", "a.png").collect()] == ["Fold"]
    assert status.resolved(images, "fold", "../n1", "a.png").count() == 0 and status.resolved(images, "fold", "n1", "..\\a.png").count() == 0
    states = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "image_key string, reviewed int")
    results = spark.createDataFrame([("a", "scale", "1:10", 0.75), ("a", "date", "1960", 0.749), ("b", "scale", "1:5", 0.1)], "image_key string, name string, value string, conf double")
    got = {x["image_key"]: x.asDict() for x in status.marked_results(states, results, ("scale", "date")).collect()}
    assert (got["a"]["scale_low"], got["a"]["date_low"], got["b"]["scale_conf"], got["b"]["scale_low"], got["c"]["scale"]) == (False, True, None, False, None)
    assert status.marked_results(states.filter("reviewed = 1"), results, ("scale",)).columns == ["image_key", "reviewed", "scale"]
    views = spark.createDataFrame([(1, "g", "i"), (2, None, None)], "sheet_id int, grid string, index string")
    fields = spark.createDataFrame([(1, f, True, "v", None) for f in prompt.DESCRIPTIONS] + [(2, "scale", False, None, "noisy"), (2, "odd", True, "x", None)], "sheet_id int, name string, locked boolean, verbatim string, rejected string")
    got = {x["sheet_id"]: x for x in prompt.prompts(views, fields).collect()}
    assert (got[1]["pending"], got[1]["prompt"]) == ([], None) and len(got[2]["pending"]) == 8
    assert "  scale: noisy" in got[2]["prompt"] and "(none)" in got[2]["prompt"] and got[2]["prompt"].endswith(prompt.TASK)


def test_ruled_frames(spark, tmp_path):
    """A frame's places from pixels, against the profiles of rows and columns; its cells and the way by cells."""
    a = np.full((400, 600), 240, np.uint8)
    for y in (250, 251, 252, 380):
        a[y, 380:590] = 10
    for x in (380, 381, 589):
        a[250:381, x] = 10
    a[100, 20:70] = 10  # too short to be a frame's side
    a[120:130, 100:110] = 10
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "bad.png").write_bytes(b"no")
    seen = pixels.read_images(spark, str(tmp_path))
    lines, sizes = pixels.ruled_runs(seen), pixels.pages(seen)
    ink = a < np.percentile(a, 15)
    profile = lambda m, least: [k for k, line in enumerate(m) if sum(len(r) for r in "".join("#" if v else " " for v in line).split() if len(r) >= least) >= 0.25 * len(line)]
    ys, xs = profile(ink, 60), profile(ink.T, 40)
    assert ys == [250, 251, 252, 380] and xs == [380, 381, 589]
    x = locate.line_places(lines, sizes).first()
    assert (x["xs"], x["ys"]) == ([380, 589], [251, 380])
    path = sizes.first()["sheet_id"]
    words = spark.createDataFrame([(path, k, "note", 400 + 40 * k, 300, 430 + 40 * k, 312) for k in range(4)], "sheet_id string, tid int, text string, x0 int, y0 int, x1 int, y1 int")
    found = locate.locate(sizes, words, lines).first()
    assert found["method"] == "frame" and (found["x0"], found["y0"], found["x1"], found["y1"]) == (381, 252, 589, 380)
