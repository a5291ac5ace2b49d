"""Repairs, views, pass merging and the service's tables against plain loops."""

import random

import pytest
from draftmill.functions import repair
from draftmill.operators import fusion, records, regions, status, views
from pyspark.sql import functions as F

DIGIT = dict(zip(repair.CONFUSED, repair.DIGITS))


def repaired(text, numeric):
    parts, at = [], 0
    words = text.split()
    if not numeric and sum(len(w) > 2 and w.replace(".", "").isalpha() for w in words) >= 2 and not any(c.isdigit() for c in text):
        return text
    out = list(text)
    for at, c in enumerate(text):
        if c not in DIGIT:
            continue
        lo, hi = at, at
        while lo and not text[lo - 1].isspace():
            lo -= 1
        while hi + 1 < len(text) and not text[hi + 1].isspace():
            hi += 1
        word = text[lo : hi + 1]
        before, after = text[at - 1] if at else " ", text[at + 1] if at + 1 < len(text) else " "
        if word.upper().strip(".,;:") in repair.SAFE_WORDS:
            continue
        tests = before.isdigit() or after.isdigit(), not before.isalpha() and not after.isalpha(), any(x.isdigit() for x in word) and len(word) <= 12, numeric and len(word) <= 3
        if any(tests):
            out[at] = DIGIT[c]
    return "".join(out)


def test_confused_letters(spark):
    r = random.Random(1)
    texts = ["", "SCALE 1:lOO", "NO. 12B", "I2/O5", "Solid BOLD doors", "To be Issued", "DO. S", "  Il  O5 ", "l", "ABCDEFGHIJKLMNOPS1", "O-l-S", "NO", "x\tl\n5"]
    texts += ["".join(r.choice("IlOoSBDx1 5./:NA") for _ in range(r.randint(1, 16))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", repair.with_digits(F.col("t"), "date").alias("n"), repair.with_digits(F.col("t")).alias("g"), repair.with_digits(F.col("t"), "architect").alias("a"), repair.variants(F.col("t"), "scale").alias("v")).collect()
    for x in rows:
        assert (x["n"], x["g"], x["a"]) == (repaired(x["t"], True), repaired(x["t"], False), x["t"]), x
        want = [x["t"]]
        for k, c in enumerate(x["t"]):
            if c in DIGIT and len(want) < 8:
                want.append(x["t"][:k] + DIGIT[c] + x["t"][k + 1 :])
        full = repaired(x["t"], True)
        assert x["v"] == want + ([] if full in want else [full])


def test_more_complete_and_alike(spark):
    rows = [("1:10", "1:100", "0"), ("A", "A", None), ("12", "12 ABCDE", None), ("12", "12/1", "/1"), ("DOOR", "DOORWAY", None), ("", "x", None), (None, "x", None), ("a1", "xa1", None), ("5", "-5-", "--")]
    df = spark.createDataFrame(rows, "m string, a string, w string")
    assert all(x["got"] == x["w"] for x in df.withColumn("got", repair.more_complete(F.col("m"), F.col("a"))).collect())
    one = spark.createDataFrame([("12", ["12", "12 ABCDE", "12/1", "12-"])], "m string, o array<string>").select(repair.first_more_complete(F.col("m"), F.col("o"))).first()[0]
    assert one == "12/1"
    pairs = spark.createDataFrame([("Drawn  by", "DRAWN BY", True), ("DRAWN", "drawn by", True), ("SCALE", "5CALE", True), ("SCALE", "DATE", False), ("", "x", False), (None, None, False)], "a string, b string, w boolean")
    assert all(x["got"] == x["w"] for x in pairs.withColumn("got", repair.same_text(F.col("a"), F.col("b"))).collect())


def test_grid_view(spark):
    r = random.Random(2)
    rows = []
    for sheet in range(6):
        for tid in range(r.randint(1, 14)):
            row = tid // 3
            x, y = r.randint(0, 500), row * r.choice([20, 70]) + r.randint(0, 3)
            rows.append((sheet, row, tid, "".join(r.choice("abc") for _ in range(r.randint(1, 7))), x, y, x + r.randint(5, 60), y + r.randint(8, 14)))
    got = {x["sheet_id"]: x["grid"] for x in views.grid(spark.createDataFrame(rows, "sheet_id int, row_no int, tid int, text string, x0 int, y0 int, x1 int, y1 int"), 40).collect()}
    for sheet in range(6):
        own = [x for x in rows if x[0] == sheet]
        widths = sorted((x[6] - x[4]) / len(x[3]) for x in own)
        n = len(widths)
        unit, left = max((widths[(n - 1) // 2] + widths[n // 2]) / 2, 1.0), min(x[4] for x in own)
        by_row = {}
        for x in own:
            by_row.setdefault(x[1], []).append(x)
        out, bottom = [], None
        for line in sorted(by_row.values(), key=lambda w: (min(x[5] for x in w), min(x[4] for x in w), w[0][1])):
            top, low = min(x[5] for x in line), max(x[7] for x in line)
            if bottom is not None:
                out += [""] * min(max(int((top - bottom) / max(low - top, 1)) - 1, 0), 2)
            text = ""
            for x in sorted(line, key=lambda x: (x[4], x[2])):
                text = text.ljust(int((x[4] - left) / unit))
                text += ("" if not text or text.endswith(" ") else " ") + x[3]
            out.append(text[:40].rstrip())
            bottom = low
        assert got[sheet] == "\n".join(out)


def test_merging_of_passes(spark):
    schema = "sheet_id int, seq int, text string, x0 int, y0 int, x1 int, y1 int, conf double"
    fine = [(1, 0, "SCALE", 0, 0, 50, 10, 0.9), (1, 1, "1:100", 60, 0, 100, 10, 0.9), (1, 2, "DATE", 0, 20, 40, 30, 0.9), (2, 0, "A", 0, 0, 10, 10, 0.9)]
    coarse = [(1, 0, "SCALE", 0, 0, 50, 10, 0.5), (1, 1, "1:1OO", 60, 0, 102, 10, 0.5), (1, 2, "whole row", 0, 15, 200, 30, 0.5), (1, 3, "MISSED", 0, 50, 40, 60, 0.5), (1, 4, "SCALES", 1, 0, 50, 10, 0.5), (3, 0, "alone", 0, 0, 9, 9, 0.4)]
    rows = fusion.matched(spark.createDataFrame(fine, schema), spark.createDataFrame(coarse, schema)).collect()
    got = {(x["sheet_id"], x["is_fine"], x["seq"]): x["match"] for x in rows}
    # the row that covers DATE is taken by it, as the share of the smaller box is whole; a second reading of SCALE covers it
    want = {(1, True, 0): 0, (1, True, 1): 1, (1, True, 2): 2, (2, True, 0): fusion.NONE, (1, False, 0): 0, (1, False, 1): 1, (1, False, 2): 2, (1, False, 3): fusion.RECOVERED, (1, False, 4): fusion.COVERS, (3, False, 0): fusion.RECOVERED}
    assert got == want


def shared(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def plain(s):
    return " ".join(s.upper().split())


def lcs(a, b):
    return 0 if not a or not b else 1 + lcs(a[1:], b[1:]) if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))


def fused_by_loop(rows, engines, least=0.3):
    """rows of one sheet: seq, engine, text, box, conf."""
    groups = []
    for t in sorted((t for t in rows if t[4] >= least), key=lambda t: (t[3][1], t[3][0], t[0])):
        near = [g for g in groups if any(shared(t[3], o[3]) / max(area(t[3]) + area(o[3]) - shared(t[3], o[3]), 1) >= 0.5 for o in g)]
        if not near:
            groups.append([t])
        elif t[1] not in [o[1] for o in near[0]]:
            near[0].append(t)
    out = []
    for g in groups:
        best = max(g, key=lambda t: t[4])
        share = sum(plain(t[2]) == plain(best[2]) for t in g) / len(g) * (min(len(g), engines) / engines)
        box = tuple(f(t[3][k] for t in g) for k, f in enumerate((min, min, max, max)))
        out.append({"text": best[2].strip(), "box": box, "conf": best[4], "agreement": round(share, 3), "candidates": [(t[2], t[1], t[4], None) for t in g]})
    return sorted(out, key=lambda t: (t["box"][1] + t["box"][3], t["box"][0]))


def merged_by_loop(fine, coarse):
    free, conflicts = list(range(len(coarse))), 0
    for f in fine:
        f["candidates"] = list(f["candidates"])
        for k in sorted(free, key=lambda k: -shared(f["box"], coarse[k]["box"]) / max(min(area(f["box"]), area(coarse[k]["box"])), 1)):
            c = coarse[k]
            score = shared(f["box"], c["box"]) / max(min(area(f["box"]), area(c["box"])), 1)
            if score < 0.55:
                break
            a, b = plain(f["text"]), plain(c["text"])
            alike = bool(a and b) and (a in b or b in a or 200 * lcs(a, b) / (len(a) + len(b)) >= 70)
            if not alike and score < 0.85:
                continue
            free.remove(k)
            if a != b:
                f["candidates"].append((c["text"], (c["candidates"][0][1] if c["candidates"] else "ocr") + "@coarse", c["conf"], list(c["box"])))
                f["agreement"] = round(sum(plain(x[0]) == a for x in f["candidates"]) / len(f["candidates"]), 3)
                conflicts += 1
            break
    new = [dict(coarse[k]) for k in free if not any(shared(coarse[k]["box"], f["box"]) / max(area(f["box"]), 1) >= 0.7 for f in fine)]
    for c in new:
        c["agreement"] = min(c["agreement"], 0.5)
        c["candidates"] = [(t, e + "@coarse", s, None) for t, e, s, _ in c["candidates"]] or [(c["text"], "ocr@coarse", c["conf"], None)]
    out = sorted(fine + new, key=lambda t: (t["box"][1] + t["box"][3], t["box"][0]))
    return out, (len(fine) - conflicts, conflicts, len(new), len(out))


def test_passes_against_loops(spark):
    """Random sheets of two passes: groups, agreements, candidates, conflicts, recoveries and their counts."""
    r = random.Random(8)
    rows = []
    for sheet in range(60):
        spots = [(r.randint(0, 3) * 40 + r.randint(0, 6), r.randint(0, 3) * 12 + r.randint(0, 4)) for _ in range(r.randint(1, 5))]
        for seq in range(r.randint(1, 12)):
            x, y = r.choice(spots)
            x, y = x + r.randint(0, 9), y + r.randint(0, 4)
            rows.append((sheet, r.choice(["fine", "fine", "coarse"]), r.choice("abc"), seq, r.choice(["SCALE", "scale ", "5CALE", "1:100", "1:1OO", "DATE", "PLAN A"]), x, y, x + r.randint(20, 60), y + r.randint(8, 16), r.randint(20, 99) / 100))
    df = spark.createDataFrame(rows, "sheet_id int, pass string, engine string, seq int, text string, x0 int, y0 int, x1 int, y1 int, conf double")
    fine, coarse = (fusion.in_order(fusion.fuse(df.filter(f"pass = '{p}'"), 3)) for p in ("fine", "coarse"))
    got, counts = {}, {x["sheet_id"]: tuple(x)[1:] for x in fusion.merge_summary(fusion.merged_passes(fine, coarse)).collect()}
    for x in fusion.merged_passes(fine, coarse).orderBy("sheet_id", "place").collect():
        got.setdefault(x["sheet_id"], []).append((x["text"], (x["x0"], x["y0"], x["x1"], x["y1"]), x["conf"], x["agreement"], [tuple(c) for c in x["candidates"]]))
    conflicts = 0
    for sheet in range(60):
        own = lambda p: fused_by_loop([(t[3], t[2], t[4], t[5:9], t[9]) for t in rows if t[0] == sheet and t[1] == p], 3)
        want, numbers = merged_by_loop(own("fine"), own("coarse"))
        assert got.get(sheet, []) == [(t["text"], t["box"], t["conf"], t["agreement"], t["candidates"]) for t in want], sheet
        assert counts.get(sheet, (0, 0, 0, 0)) == numbers
        conflicts += numbers[1]
    assert conflicts > 20
    assert fusion.merged_passes(fine.limit(0), coarse).filter("agreement > 0.5").count() == 0 and fusion.merged_passes(fine, coarse.limit(0)).count() == fine.count()
    summary = {x["sheet_id"]: tuple(x)[1:] for x in fusion.pass_summary(fine).collect()}
    assert all(summary.get(k, (0, 0)) == (len(w), sum(t["agreement"] < 1 for t in w)) for k in range(60) for w in [fused_by_loop([(t[3], t[2], t[4], t[5:9], t[9]) for t in rows if t[0] == k and t[1] == "fine"], 3)])


def test_agreements_of_passes(spark):
    """Three engines that agree: 1.0, also beside an equal coarse reading; two of three after a related coarse reading:
    0.667; a recovered token: 0.5, or its own if that is less."""
    schema = f"sheet_id int, seq int, text string, x0 int, y0 int, x1 int, y1 int, conf double, agreement double, candidates {fusion.CANDIDATES}"
    cand = lambda *texts: [(t, "abc"[k], 0.9, None) for k, t in enumerate(texts)]
    fine = [(1, 0, "SITE PLAN", 0, 0, 50, 10, 0.9, 1.0, cand("SITE PLAN", "site plan", "SITE  PLAN")), (1, 1, "1:100", 60, 0, 100, 10, 0.9, 1.0, cand("1:100", "1:100")), (1, 2, "X", 0, 90, 9, 99, 0.9, 0.333, cand("X"))]
    coarse = [(1, 0, "Site plan", 0, 0, 50, 10, 0.5, 1.0, cand("Site plan")), (1, 1, "1:1OO", 60, 0, 102, 10, 0.5, 1.0, cand("1:1OO")), (1, 2, "MISSED", 0, 50, 40, 60, 0.5, 1.0, cand("MISSED")), (1, 3, "FAR", 200, 50, 240, 60, 0.5, 0.25, [])]
    out = {x["text"]: x for x in fusion.merged_passes(spark.createDataFrame(fine, schema), spark.createDataFrame(coarse, schema)).collect()}
    assert {k: x["agreement"] for k, x in out.items()} == {"SITE PLAN": 1.0, "1:100": 0.667, "X": 0.333, "MISSED": 0.5, "FAR": 0.25}
    assert tuple(out["1:100"]["candidates"][2]) == ("1:1OO", "a@coarse", 0.5, [60, 0, 102, 10]) and [c["engine"] for c in out["FAR"]["candidates"]] == ["ocr@coarse"]


def test_export_and_snapping(spark):
    images = spark.createDataFrame([(1, "A"), (2, "b"), (3, "B")], "image_key int, folder string")
    state = spark.createDataFrame([(1, 2), (2, 2)], "image_key int, status int")
    keys = spark.createDataFrame([(2,), (3,), (9,)], "image_key int")
    assert [x["image_key"] for x in status.exported(images, state, "image_key", keys, folder=" B ").collect()] == [3, 2]
    assert [x["image_key"] for x in status.exported(images, state, "image_key", code=2).collect()] == [1, 2]
    assert {x["image_key"]: x["outcome"] for x in status.rerun(images, spark.createDataFrame([(2, 1)], state.schema), keys, "image_key").collect()} == {2: "conflict", 3: "ok", 9: "not found"}
    box = spark.createDataFrame([(10, 10, 90, 90, [4, 16], []), (10, 10, 40, 40, [30], [])], "x0 int, y0 int, x1 int, y1 int, xs array<int>, ys array<int>")
    got = [tuple(x) for x in box.select(*regions.snapped("", "xs", "ys", F.lit(200), F.lit(100), 0.15)).collect()]
    assert got == [(4, 10, 90, 90), (10, 10, 40, 40)]


@pytest.mark.parametrize("name", ["flat_rows", "result_fields", "degraded_fields", "index_views", "snapped_boxes"])
def test_empty_tables(spark, tmp_path, name):
    from draftmill import catalog, catalog_records  # noqa: F401

    for t in ("lineitem", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_usage_of_the_model(spark):
    calls = spark.createDataFrame([(10, 3, 13), (5, 2, 7), (99, 99, None), (1, 1, 0), (None, None, None)], "prompt_tokens int, completion_tokens int, total_tokens int")
    assert tuple(records.usage_totals(calls).first()) == (2, 15, 5, 7, 2, 10_000)
    assert tuple(records.usage_totals(calls.limit(0)).first()) == (0, 0, 0, None, None, None)
