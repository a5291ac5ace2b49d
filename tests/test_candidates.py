"""Better readings against plain loops, and the views that show them."""

import random
import re

from draftmill.functions import text as X
from draftmill.operators import candidates, layout, views
from draftmill.operators.fusion import CANDIDATES
from pyspark.sql import functions as F
from test_records import DIGIT, repaired

PATTERNS = {"drawing_number": re.compile(X.DRAWING_NUMBER, re.I), "scale": re.compile(X.SCALE), "date": re.compile(X.DATE, re.I)}
SCHEMA = f"sheet_id int, tid int, text string, x0 int, y0 int, x1 int, y1 int, candidates {CANDIDATES}"


def norm(s):
    return " ".join((s or "").upper().split())


def variants(s):
    out = [s]
    for k, c in enumerate(s):
        if c in DIGIT and len(out) < 8:
            out.append(s[:k] + DIGIT[c] + s[k + 1 :])
    full = repaired(s, True)
    return out + ([] if full in out else [full])


def hint(text, others, field):
    main, best = norm(text), None
    for c in others:
        if c[0] is None or c[0].strip() == (text or "").strip():
            continue
        other, why = norm(c[0]), []
        if main and main != other and main in other:
            why.append("superset")
        if field and not PATTERNS[field].search(main):
            fits = [v for v in variants(other) if PATTERNS[field].search(v)]
            why += ["format"] if PATTERNS[field].search(other) else [f"repaired: {fits[0]}"] if fits else []
        if why and (best is None or len(why) > len(best[4])):
            best = (field, c[0], c[1], round(c[2], 3), why)
    return best


def test_hints(spark):
    r = random.Random(12)
    texts = ["603/A1", "6O3/A1", "603/A", "SCALE 1:10", "1:10", "I:1O", "l:1O", "12 Jan 1964", "12 JAN", "1964", "I964", "plan", "plan A", "A-1O2", "", "  ", None, "AB 1B8"]
    rows = [(k // 9, k % 9, r.choice(texts), 0, 0, 1, 1, [(r.choice(texts), r.choice("pq"), r.random(), None) for _ in range(r.randint(0, 4))] if k % 11 else None) for k in range(700)]
    got = {(x["sheet_id"], x["tid"]): tuple(x)[2:] for x in candidates.hints(spark.createDataFrame(rows, SCHEMA)).collect()}
    kinds = set()
    for sheet, tid, text, *_, others in rows:
        want = next((h for f in candidates.ASKED if (h := hint(text, others or [], f))), None)
        assert got.get((sheet, tid)) == want, (text, others)
        kinds.add(want and (want[0], want[4][0].split(":")[0]))
    assert {None, (None, "superset"), ("drawing_number", "format"), ("scale", "repaired"), ("date", "repaired")} <= kinds


def test_views_of_rows(spark):
    """Rows, ids, hints and both views one after the other; a rotated token is a line of its own."""
    tokens = [("a", 0, "SCALE", 0, 0, 50, 10), ("b", 1, "1:1OO", 60, 1, 100, 11), ("c", 2, "SIDE", 200, 0, 208, 60), ("d", 3, "plan", 0, 40, 40, 50), ("e", 4, "B", 60, 40, 70, 50)]
    rows = [(1, "x", seq, text, *box, 0.5, [(text, "p", 0.5, None), ("1:100", "q", 0.9, None)] if text == "1:1OO" else [(text, "p", 0.5, None)]) for _, seq, text, *box in tokens]
    t = spark.createDataFrame(rows, f"sheet_id int, engine string, seq int, text string, x0 int, y0 int, x1 int, y1 int, conf double, candidates {CANDIDATES}")
    placed = views.placed(t)
    got = {x["text"]: (x["row_no"], x["tid"]) for x in placed.collect()}
    assert got == {"SCALE": (1, 0), "1:1OO": (1, 1), "SIDE": (2, 2), "plan": (3, 3), "B": (3, 4)}
    both = views.both(t).first()
    assert both["grid"].splitlines()[0].split() == ["SCALE", "1:1OO"] and "SIDE" in both["grid"]
    lines = both["index"].splitlines()
    assert lines[0].startswith("[0] row 1  SCALE") and "1:100" in lines[1] and "prefer" in lines[2] and "repaired" not in lines[2]
    assert any(x.startswith("[2] row 2  SIDE") for x in lines)
    assert layout.rotated(t).filter("rotated").count() == 1 and views.both(t.limit(0)).count() == 0


def test_kept_lines_and_dimensions(spark):
    rows = [("NORTH ELEVATION", True, False), ("Scale 1:50", True, False), ("LIVING ROOM", True, False), ("ROOM 1234567", False, False), ("living", False, False), ("ABC", False, False), ("10'-6\"", False, True), ("2400 x 1200", False, False), ("", False, False)]
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(rows)], "k int, t string")
    for x in df.select("k", X.keep_line(F.col("t")).alias("keep"), X.is_dimension(F.col("t")).alias("size")).collect():
        assert (x["keep"], x["size"]) == rows[x["k"]][1:], rows[x["k"]]
