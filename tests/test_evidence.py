"""Evidence of fields, replies and calls against plain loops over all combinations of readings."""

import itertools
import json
import random
import re

from draftmill import catalog_evidence  # noqa: F401  (it adds its queries to the catalog)
from draftmill.catalog import QUERIES
from draftmill.operators import evidence
from draftmill.operators.fusion import CANDIDATES
from pyspark.sql import functions as F

TOKENS = f"sheet_id int, tid int, text string, x0 int, y0 int, x1 int, y1 int, conf double, agreement double, candidates {CANDIDATES}"


def flat(s):
    return re.sub(r"\s+", "", (s or "").upper())


def readings(token):
    """Each distinct reading of a token: itself first, then what the candidates add."""
    tid, text, box, candidates = token[1], token[2], list(token[3:7]), token[9] or []
    by = next((c[1] for c in candidates if flat(c[0]) == flat(text)), "token")
    out = {flat(text): (tid, text or "", by, box)}
    for c in candidates:
        if flat(c[0]) and flat(c[0]) not in out:
            out[flat(c[0])] = (tid, c[0], c[1], list(c[3]) if c[3] else box)
    return out


def expected_regions(ids, verbatim, by_id):
    """All combinations; of those that reach a place after a token, the one that was first there."""
    if not ids or any(i not in by_id for i in ids):
        return None
    want = flat(verbatim)
    if not any("".join(c) == want for c in itertools.product(*[readings(by_id[i]) for i in ids])):
        return None
    ways = [("", [])]
    for i in ids:
        seen, then = set(), []
        for done, path in ways:
            for text, region in readings(by_id[i]).items():
                if want.startswith(done + text) and done + text not in seen:
                    seen.add(done + text)
                    then.append((done + text, [*path, region]))
        ways = then
    return dict(ways)[want]


def expected(ids, verbatim, by_id):
    found = expected_regions(ids, verbatim, by_id)
    if not ids:
        return "none cited", [], None
    if any(i not in by_id for i in ids):
        return "missing", [], None
    own, want = "".join(flat(by_id[i][2]) for i in ids), flat(verbatim)
    if found is not None or own == want:
        return "ok", [], found
    if not want.startswith(own):
        return "unlike", [], None
    rest, extra = want[len(own) :], []
    for tid in sorted(by_id):
        t = flat(by_id[tid][2])
        if tid not in ids and t and rest.startswith(t):
            rest = rest[len(t) :]
            extra.append(tid)
    return ("fabricated", [], None) if rest else ("incomplete", extra, None)


def sheets(r):
    rows = []
    for sheet in range(40):
        for tid in range(r.randint(1, 6)):
            text = r.choice(["A", "AB", "B A", "a", "BAB", "", None])
            x, y = r.randint(0, 50), r.randint(0, 50)
            candidates = [(r.choice(["A", "AA", "b", "AB ", " ", "BA", text]), r.choice("pq"), r.random(), r.choice([None, [1, 2, 3, 4]])) for _ in range(r.randint(0, 3))]
            rows.append((sheet, tid, text, x, y, x + 9, y + 5, r.random(), r.randint(0, 3) / 3, candidates if r.random() < 0.9 else None))
    return rows


def test_evidence_against_all_combinations(spark):
    r = random.Random(4)
    rows = sheets(r)
    fields = []
    for k in range(600):
        sheet = r.randint(0, 41)
        own = {t[1]: t for t in rows if t[0] == sheet}
        ids = [r.choice([*own, 9] if r.random() < 0.1 else [*own]) for _ in range(r.randint(0, 4))] if own else [0]
        said = "".join(r.choice([*readings(own[i])]) for i in ids if i in own)
        more = "".join(flat(own[i][2]) for i in sorted(own) if i not in ids and r.random() < 0.6)
        verbatim = r.choice([said, said, said.lower().replace("A", " a"), said + more, said + "Z", "Q" + said, None])
        fields.append((sheet, f"f{k}", ids if r.random() < 0.97 else None, verbatim, "extra"))
    df = spark.createDataFrame(fields, "sheet_id int, name string, tokens array<int>, verbatim string, more string")
    got = {x["name"]: x for x in evidence.evidence(df, spark.createDataFrame(rows, TOKENS)).collect()}
    seen = set()
    for sheet, name, ids, verbatim, _ in fields:
        outcome, extra, found = expected(ids or [], verbatim, {t[1]: t for t in rows if t[0] == sheet})
        x = got[name]
        seen.add(outcome)
        assert (x["outcome"], x["extra"], x["evidence_ok"]) == (outcome, extra, outcome in ("ok", "none cited")), (name, ids, verbatim)
        assert (None if x["regions"] is None else [tuple(g) for g in x["regions"]]) == (None if found is None else [tuple(g) for g in found]), (name, ids, verbatim)
        if found:
            boxes = [g[3] for g in found]
            assert tuple(x["evidence_bbox"]) == (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
        else:
            assert x["evidence_bbox"] is None
    assert seen == {"none cited", "missing", "ok", "unlike", "incomplete", "fabricated"} and len(got) == 600


def test_long_verbatim_has_few_ways(spark):
    """Twenty tokens of three readings each: 3^20 combinations, but few places."""
    rows = [(1, k, "A", 0, 0, 1, 1, 0.5, 1.0, [("AA", "p", 0.1, None), ("AAA", "q", 0.1, None)]) for k in range(20)]
    df = spark.createDataFrame([(1, "x", [*range(20)], "A" * 41), (1, "y", [*range(20)], "A" * 61)], "sheet_id int, name string, tokens array<int>, verbatim string")
    got = {x["name"]: x["regions"] for x in evidence.evidence(df, spark.createDataFrame(rows, TOKENS)).collect()}
    assert "".join(g["text"] for g in got["x"]) == "A" * 41 and got["y"] is None


def test_replies(spark):
    rows = [(1, 0, "SITE", 0, 0, 10, 10, 0.9, 1.0, None), (1, 1, "PLAN", 12, 0, 20, 10, 0.8, 0.5, [("PLAN", "a", 0.8, None)]), (1, 2, "A 1", 0, 20, 9, 30, 0.7, 0.667, [])]
    replies = [
        (1, "so:\n```json\n" + json.dumps({"title": {"tokens": [0], "verbatim": "site plan", "confidence": "high", "note": "seen"}, "number": {"tokens": ["2"], "verbatim": "A1", "corrected": "A7", "correction_basis": "glyph"}, "bad": {"tokens": [{}]}, "text": "no object", "none": {"tokens": None, "verbatim": None, "reason": "illegible"}}) + "\n```"),
        (2, "nothing of use"), (3, None), (4, '{"a": {"tokens": [0], "verbatim": "q", "corrected": "r"}}'), (5, '{"a": {}, "a": {}}'), (6, "[1]"), (7, "{}"), (8, '{"a": {"tokens": [1'),
    ]
    r = spark.createDataFrame(replies, "sheet_id int, raw_response string")
    items = {(x["sheet_id"], x["name"]): x["error"] for x in evidence.reply_items(r).collect()}
    bad = "no JSON object"
    assert items == {(1, "title"): None, (1, "number"): None, (1, "bad"): "tokens are no list of whole numbers", (1, "none"): None, (2, None): bad, (3, None): bad, (4, "a"): None, (5, None): bad, (6, None): bad, (8, None): bad}
    t = spark.createDataFrame(rows, TOKENS)
    got = {(x["sheet_id"], x["name"]): x for x in evidence.reply_fields(r, t).collect()}
    title, number, none, other = (got[k] for k in ((1, "title"), (1, "number"), (1, "none"), (4, "a")))
    assert (title["tokens"], title["tokens_repaired"], title["outcome"], title["agreement"], title["conf"], title["adjudicated"]) == ([0, 1], [1], "ok", 0.5, 0.8, True)
    assert title["notes"] == ["seen", "tokens added for: PLAN"] and [g["tid"] for g in title["regions"]] == [0, 1]
    assert (number["correction"], number["corrected_signal"], number["outcome"], number["agreement"]) == ("fix", True, "ok", 0.667)
    assert (none["outcome"], none["evidence_ok"], none["agreement"], none["reason"], none["adjudicated"]) == ("none cited", True, None, "illegible", False)
    assert (other["outcome"], other["evidence_ok"], other["correction"], other["status"], other["agreement"]) == ("missing", False, "normalize", "needs_review", None)
    assert len(got) == 4
    counts = {x["sheet_id"]: tuple(x)[1:] for x in evidence.reply_summary(r, t).collect()}
    assert counts == {1: (1, 3, 0, 1), 2: (1, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 1, 1, 0), 5: (1, 0, 0, 0), 6: (1, 0, 0, 0), 8: (1, 0, 0, 0)}
    assert evidence.reply_fields(r.limit(0), t).count() == 0 and evidence.reply_fields(r, t.limit(0)).filter("outcome = 'missing'").count() == 3


def test_calls(spark):
    rows = [(1, 0, True, False, None, None), (2, 3, True, False, None, None), (3, 3, False, False, None, None), (4, 2, True, True, "timeout", None), (5, 2, True, True, None, "oops"), (6, 2, True, True, None, '{"a":{}}'), (7, None, None, None, None, None), (8, 1, True, True, None, None)]
    c = spark.createDataFrame(rows, "sheet_id int, pending int, enabled boolean, available boolean, error string, raw_response string")
    got = {x["sheet_id"]: (x["outcome"], x["processing_status"]) for x in evidence.call_outcomes(c).collect()}
    assert got == {1: ("nothing pending", "success"), 2: ("unavailable", "failed"), 3: ("unavailable", "success"), 4: ("request failed", "failed"), 5: ("unreadable reply", "failed"), 6: ("parsed", "success"), 7: ("nothing pending", "success"), 8: ("unreadable reply", "failed")}


def test_reply_summary_reads_items_once(spark):
    """Rows in error and fields are counted in one pass: no join of the items with themselves."""
    t = spark.createDataFrame([(1, 0, "SCALE", 0, 0, 9, 9, 0.9, 1.0)], "sheet_id INT, tid INT, text STRING, x0 INT, y0 INT, x1 INT, y1 INT, conf DOUBLE, agreement DOUBLE").withColumn("candidates", F.lit(None).cast("array<struct<text:string,engine:string,conf:double,source_bbox:array<int>>>"))
    said = spark.createDataFrame([(1, '{"a": {"tokens": [0], "verbatim": "scale"}, "b": {"tokens": ["x"], "verbatim": "q"}}'), (2, "no object")], "sheet_id INT, raw_response STRING")
    got = evidence.reply_summary(said, t)
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, 0, 0), (2, 1, 0, 0, 0)]


def test_replies_may_hold_their_tokens(spark):
    """Replies with their sheet's tokens beside them give the same as tokens that are joined, and nothing is joined."""
    rows = [(1, 0, "SITE", 0, 0, 10, 10, 0.9, 1.0, None), (1, 1, "PLAN", 12, 0, 20, 10, 0.8, 0.5, [("PLAM", "a", 0.8, None)]), (1, 1, "plan", 12, 0, 20, 10, 0.8, 0.5, None), (1, None, "X", 0, 0, 1, 1, 0.5, 1.0, None)]
    said = {"a": {"tokens": [0], "verbatim": "site plan", "note": [1, {"k": None}]}, "b": {"tokens": [1], "verbatim": "plam", "corrected": 1.5}, "c": {"tokens": [None], "verbatim": True}, "d": {"tokens": [1, 7], "verbatim": None}, "e": {"tokens": "1"}, "f": 3}
    r = spark.createDataFrame([(1, json.dumps(said)), (2, '{"a": {"tokens": [0], "verbatim": "q"}}'), (3, "no"), (4, "{}")], "sheet_id int, raw_response string")
    t = spark.createDataFrame(rows, TOKENS)
    held = r.join(evidence.sheet_tokens(t), "sheet_id", "left").localCheckpoint()
    fields, counts = evidence.reply_fields(held), evidence.reply_summary(held)
    assert not any("Join" in x._jdf.queryExecution().executedPlan().toString() for x in (fields, counts))
    assert sorted(map(str, fields.collect())) == sorted(map(str, evidence.reply_fields(r, t).collect()))
    got = {(x["sheet_id"], x["name"]): (x["tokens"], x["outcome"], x["verbatim"], x["corrected"]) for x in fields.collect()}
    assert got == {(1, "a"): ([0, 1], "ok", "site plan", None), (1, "b"): ([1], "ok", "plam", "1.5"), (1, "c"): ([], "none cited", "true", None), (1, "d"): ([1, 7], "missing", None, None), (2, "a"): ([0], "missing", "q", None)}
    assert next(x["notes"][0] for x in fields.collect() if x["name"] == "a") == '[1,{"k":null}]'
    assert {x["sheet_id"]: tuple(x)[1:] for x in counts.collect()} == {1: (1, 4, 1, 1), 2: (0, 1, 1, 0), 3: (1, 0, 0, 0)}


def test_model_fields_reads_tokens_once(spark):
    for name in ("model_fields", "reply_counts"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("hashpartitioning(sheet_id") == 1, name
