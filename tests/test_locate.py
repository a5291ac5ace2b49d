"""The ways to a title block against plain loops: flood fill, dense grids and naive ratios."""

import json
import math
import random

import numpy as np
import pytest
from draftmill.operators import locate

LINES = "sheet_id int, horizontal boolean, seq int, x0 double, y0 double, x1 double, y1 double"
TOKENS = "sheet_id int, tid int, text string, x0 int, y0 int, x1 int, y1 int"
PAGES = "sheet_id int, w int, h int"
SIDES = ("x0", "y0", "x1", "y1")


def ratio(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            row[i][j] = row[i - 1][j - 1] + 1 if x == y else max(row[i - 1][j], row[i][j - 1])
    return 200 * row[-1][-1] / (len(a) + len(b))


def hit(text, word, least=85):
    if len(text) < max(len(word) / 2, 4):
        return False
    n = len(word)
    parts = [text[max(k, 0) : k + n] for k in range(1 - n, len(text))] if len(text) >= n else []
    return word in text or ratio(word, text) >= least or any(ratio(word, p) >= least for p in parts if p)


def mid(t):
    return (t[3] + t[5]) / 2, (t[4] + t[6]) / 2


def test_hits():
    r = random.Random(7)
    words = [*locate.STRONG, *locate.WEAK]
    seen = set()
    for _ in range(3000):
        w = r.choice(words)
        t = [*r.choice([w, w[: len(w) // 2 + 2], w + " BY", "XX " + w, r.choice(words)])]
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(["O", "0", "", "A", " "])
        t = "".join(t)
        assert locate.is_hit(t, w, 85) == hit(t, w), (t, w)
        seen.add((hit(t, w), w in t))
    assert seen == {(True, True), (True, False), (False, False)}


def snapped(box, xs, ys, w, h):
    near = lambda v, places, most: min((abs(p - v), k, p) for k, p in enumerate(places) if abs(p - v) <= most)[2] if any(abs(p - v) <= most for p in places) else None
    to = [near(v, xs if k % 2 == 0 else ys, (w, h)[k % 2] * 0.06) for k, v in enumerate(box)]
    new = [v if t is None else t for v, t in zip(box, to)]
    new = max(0, new[0]), max(0, new[1]), min(w, new[2]), min(h, new[3])
    return (box, False) if new[2] - new[0] < 20 or new[3] - new[1] < 20 else (new, any(t is not None for t in to))


def anchored(tokens, w, h, xs, ys):
    kinds = []
    for t in tokens:
        up = (t[2] or "").upper().strip(" .:,;")
        if len(up) >= 4 and any(c.isalpha() for c in up):
            kinds += [(0, t)] if any(hit(up, x) for x in locate.STRONG) else [(1, t)] if any(hit(up, x) for x in locate.WEAK) else []
    strong = sum(k == 0 for k, _ in kinds)
    weak = len(kinds) - strong
    if not strong and weak < 2:
        return None
    kinds.sort(key=lambda k: (math.hypot(mid(k[1])[0] - w, mid(k[1])[1] - h), k[0], k[1][1]))
    kept = []
    for _, t in kinds:
        if not kept or any(max(abs(mid(t)[0] - mid(k)[0]) / w, abs(mid(t)[1] - mid(k)[1]) / h) <= 0.22 for k in kept):
            kept.append(t)
    box = int(max(min(t[3] for t in kept) - w * 0.03, 0)), int(max(min(t[4] for t in kept) - h * 0.03, 0)), int(min(max(t[5] for t in kept) + w * 0.03, w)), int(min(max(t[6] for t in kept) + h * 0.03, h))
    box, moved = snapped(box, xs, ys, w, h)
    return (*box, round(min(0.55 + 0.12 * strong + 0.05 * weak + (0.08 if moved else 0), 0.97), 3)), {"strong": strong, "weak": weak, "used": len(kept), "snapped": moved, "words": [t[2] for t in kept[:8]]}


def places(lines, across, w, h):
    share = {}
    for a in lines:
        if a[1] == across:
            at = math.floor((a[4] + a[6]) / 2 if across else (a[3] + a[5]) / 2)
            share[at] = share.get(at, 0) + ((a[5] - a[3]) / w if across else (a[6] - a[4]) / h)
    runs = []
    for at in sorted(k for k, s in share.items() if s >= 0.25):
        if runs and at - runs[-1][-1] <= 6:
            runs[-1].append(at)
        else:
            runs.append([at])
    return [sum(x) // len(x) for x in runs]


def faces(lines, w, h):
    """Flood fill over unit squares, with walls along the lines."""
    level, upright = np.zeros((h + 1, w), bool), np.zeros((h, w + 1), bool)
    for _, across, _, x0, y0, x1, y1 in lines:
        if across:
            level[int(y0), int(x0) : int(x1)] = True
        else:
            upright[int(y0) : int(y1), int(x0)] = True
    seen, out = np.zeros((h, w), bool), []
    for y in range(h):
        for x in range(w):
            if seen[y, x]:
                continue
            todo, own = [(y, x)], []
            seen[y, x] = True
            while todo:
                i, j = todo.pop()
                own.append((i, j))
                for a, b, wall in ((i - 1, j, level[i, j]), (i + 1, j, level[i + 1, j]), (i, j - 1, upright[i, j]), (i, j + 1, upright[i, j + 1])):
                    if 0 <= a < h and 0 <= b < w and not wall and not seen[a, b]:
                        seen[a, b] = True
                        todo.append((a, b))
            ys, xs = [i for i, _ in own], [j for _, j in own]
            out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
    return out


def filled(tokens, b):
    return [t for t in tokens if b[0] <= mid(t)[0] <= b[2] and b[1] <= mid(t)[1] <= b[3]]


def celled(tokens, lines, w, h):
    all_, best = faces(lines, w, h), None
    for b in all_:
        own = filled(tokens, b)
        share = b[4] / (w * h)
        if not 0.01 <= share <= 0.30 or b[2] - b[0] < 40 or b[3] - b[1] < 40 or len(own) < 3:
            continue
        pos = (b[0] + (b[2] - b[0]) / 2) / w * 0.5 + (b[1] + (b[3] - b[1]) / 2) / h * 0.5
        dense = min(sum((t[5] - t[3]) * (t[6] - t[4]) for t in own) / max(b[4], 1) * 4, 1.0)
        score = 0.45 * pos + 0.30 * dense + 0.25 * (1.0 if 0.02 <= share <= 0.25 else 0.4)
        if best is None or score > best[0]:
            best = score, b[:4]
    if best is None:
        return None
    first = box = best[1]
    merged = 0
    for _ in range(6):
        before = merged
        for c in all_:
            if c[4] > w * h * 0.30 or c[2] - c[0] < 20 or c[3] - c[1] < 20 or len(filled(tokens, c)) < 2:
                continue
            union = min(c[0], box[0]), min(c[1], box[1]), max(c[2], box[2]), max(c[3], box[3])
            over_x, over_y = min(c[2], box[2]) - max(c[0], box[0]), min(c[3], box[3]) - max(c[1], box[1])
            if union != box and (over_y > 0 and -over_x <= w * 0.02 or over_x > 0 and -over_y <= h * 0.02):
                box, merged = union, merged + 1
        if merged == before:
            break
        if (box[2] - box[0]) * (box[3] - box[1]) > w * h * 0.35:
            box, merged = first, 0
            break
    return (*box, round(min(best[0], 0.92), 3)), merged


def dense(tokens, w, h, n=48, inside=2):
    if len(tokens) < 10:
        return None
    grid = np.zeros((n, n))
    for t in tokens:
        grid[min(int(mid(t)[1] / h * n), n - 1), min(int(mid(t)[0] / w * n), n - 1)] += (t[5] - t[3]) * (t[6] - t[4])
    heat = blurred(grid)
    if heat.max() <= 0:
        return None
    low = heat.copy()
    low[:16] = low[:, :16] = 0
    low = low if low.max() > 0 else heat
    y, x = np.unravel_index(np.argmax(low), low.shape)
    b, least, on = [x, y, x, y], low[y, x] * 0.45, True
    while on:
        on = False
        for k, step in ((1, -1), (3, 1), (0, -1), (2, 1)):
            new = [*b]
            new[k] = min(max(new[k] + step, 0), n - 1)
            if new != b and heat[new[1] : new[3] + 1, new[0] : new[2] + 1].mean() >= least:
                b, on = new, True
    box = int(b[0] / n * w), int(b[1] / n * h), int((b[2] + 1) / n * w), int((b[3] + 1) / n * h)
    own = filled(tokens, box)
    return None if len(own) < inside else (*box, round(0.45 + 0.15 * min(len(own) / 20, 1.0), 3))


def blurred(grid):
    k = np.array(locate.KERNEL)
    wide = np.pad(grid, 2, mode="reflect")
    n = len(grid)
    rows = sum(k[d] * wide[:, d : d + n] for d in range(5))
    return sum(k[d] * rows[d : d + n] for d in range(5))


@pytest.fixture(scope="module")
def sheets():
    r = random.Random(9)
    out = []
    for k in range(79):
        w, h = r.choice([(240, 200), (300, 180)])
        lines = [(k, True, i, float(r.choice([0, 0, w // 2, r.randint(0, w - 60)])), float(y), float(r.choice([w, w, w // 2 + 60])), float(y)) for i, y in enumerate(r.sample(range(0, h + 1, 10), r.choice([0, 2, 4, 6])))]
        lines += [(k, False, i, float(x), float(r.choice([0, h // 2])), float(x), float(r.choice([h, h - 30]))) for i, x in enumerate(r.sample(range(0, w + 1, 10), r.choice([0, 2, 4, 6])))]
        tokens = []
        for t in range(r.randint(0, 30)):
            x, y = r.choice([(r.randint(0, w - 40), r.randint(0, h - 10)), (r.randint(w // 2, w - 40), r.randint(h // 2, h - 10))])
            text = r.choice(["Drawn:", "SC4LE", "Bates  Smart", "ARCHITECT5", "Date", "DATE 12", "note", "wall", "12", None, "Sheet No."]) if k % 3 else r.choice(["note", "wall", "Scale", "ab", None, "12"])
            tokens.append((k, t, text, x, y, x + r.randint(8, 38), y + r.randint(4, 9)))
        out.append((w, h, lines, tokens))
    # one sheet of dense text without words or lines
    k = len(out)
    out.append((480, 480, [], [(k, t, "note", 300 + 9 * (t % 5), 400 + 4 * (t // 5), 309 + 9 * (t % 5), 404 + 4 * (t // 5)) for t in range(30)]))
    return out


@pytest.fixture(scope="module")
def tables(spark, sheets):
    return spark.createDataFrame([(k, s[0], s[1]) for k, s in enumerate(sheets)], PAGES), spark.createDataFrame([t for s in sheets for t in s[3]], TOKENS), spark.createDataFrame([a for s in sheets for a in s[2]], LINES)


def same(got, want):
    """Equal boxes, and confidences that may differ where the fourth digit is a five."""
    return tuple(got[:4]) == tuple(want[:4]) and abs(got[4] - want[4]) < 0.0011


def by_sheet(df):
    return {x["sheet_id"]: ((*[x[c] for c in SIDES], x["confidence"]), json.loads(x["detail"])) for x in df.collect()}


def test_anchors(sheets, tables):
    pages, tokens, lines = tables
    got, n = by_sheet(locate.by_anchors(tokens, pages, lines)), 0
    for k, (w, h, ls, ts) in enumerate(sheets):
        want = anchored(ts, w, h, places(ls, False, w, h), places(ls, True, w, h))
        assert same(got[k][0], want[0]) and got[k][1] == want[1] if want else k not in got, k
        n += want is not None and want[1]["snapped"]
    assert 20 < len(got) < 80 and n


def test_cells(sheets, tables):
    pages, tokens, lines = tables
    got, found = {}, locate.cells(lines, pages).orderBy("sheet_id", "cell").collect()
    for x in found:
        got.setdefault(x["sheet_id"], []).append((*[x[c] for c in SIDES], x["area"]))
    best, n = by_sheet(locate.by_cells(tokens, pages, lines)), 0
    for k, (w, h, ls, ts) in enumerate(sheets):
        assert got[k] == faces(ls, w, h), k
        want = celled(ts, ls, w, h)
        assert same(best[k][0], want[0]) and best[k][1]["merged_cells"] == want[1] if want else k not in best, k
        n += want is not None and want[1] > 0
    assert n > 3 and len(best) > 10


def test_density(spark, sheets, tables):
    pages, tokens, _ = tables
    r = random.Random(1)
    grid = [(0, r.choice([0, 1, 2, 3, 46, 47, 20]), r.choice([0, 1, 45, 47, 9]), r.randint(1, 9)) for _ in range(12)]
    grid = list({g[1:3]: g for g in grid}.values())
    full = np.zeros((48, 48))
    for _, x, y, v in grid:
        full[y, x] = v
    got = np.zeros((48, 48))
    for x in locate.smoothed(spark.createDataFrame(grid, "sheet_id int, bx int, by int, ink int")).collect():
        got[x["by"], x["bx"]] = x["heat"]
    assert np.allclose(got, blurred(full))
    found = by_sheet(locate.by_density(tokens, pages, inside=2))
    for k, (w, h, _, ts) in enumerate(sheets):
        want = dense(ts, w, h)
        assert same(found[k][0], want) if want else k not in found, k
    assert len(found) > 20


def test_first_way_is_taken(spark, sheets, tables):
    pages, tokens, lines = tables
    table = spark.createDataFrame([(3, 1, 2, 3, 4, "text_layout", ["scale"], ["top"], 1.0)], "sheet_id int, x0 int, y0 int, x1 int, y1 int, source string, groups array<string>, support array<string>, coverage double")
    got = {x["sheet_id"]: x for x in locate.locate(pages, tokens, lines, table).collect()}
    ways = [("anchor", by_sheet(locate.by_anchors(tokens, pages, lines))), ("frame", by_sheet(locate.by_cells(tokens, pages, lines))), ("density", by_sheet(locate.by_density(tokens, pages)))]
    for k, (w, h, _, ts) in enumerate(sheets):
        method = next((m for m, rows in ways if k in rows), "fallback")
        own = dict(ways).get(method, {}).get(k, ((int(w * 0.60), int(h * 0.55), w, h, 0.15), None))[0]
        method, own = ("local_frame", (1, 2, 3, 4, 0.85)) if k == 3 else (method, own)
        assert got[k]["method"] == method and same([*[got[k][c] for c in SIDES], got[k]["confidence"]], own), k
        if method == "fallback":
            assert json.loads(got[k]["detail"]) == {"degraded": True, "tokens": len(filled(ts, own[:4]))}
    assert {x["method"] for x in got.values()} == {"local_frame", "anchor", "frame", "density", "fallback"} and len(got) == len(sheets)


def test_early_stops(spark):
    pages = spark.createDataFrame([(k, 10, 10) for k in range(1, 7)], PAGES)
    texts = {1: ["ab", "c", "de", "f"], 2: ["ab", "c", "de", "SCALE"], 3: ["ab", "c", "de", "long"], 4: ["a", "b", "c", "DA", "TE"], 6: ["a", "b", "c"]}
    tokens = spark.createDataFrame([(k, i, t, 0, 0, 1, 1) for k, ts in texts.items() for i, t in enumerate(ts)], TOKENS)
    forced = spark.createDataFrame([(6,), (5,)], "sheet_id int")
    assert {tuple(x) for x in locate.early_stops(pages, tokens).collect()} == {(1, "noise"), (4, "noise"), (5, "no tokens"), (6, "noise")}
    assert {tuple(x) for x in locate.early_stops(pages, tokens, forced).collect()} == {(1, "noise"), (4, "noise"), (5, "no tokens")}


def test_nothing(spark):
    pages = spark.createDataFrame([(1, 100, 80)], PAGES)
    none, lines = spark.createDataFrame([], TOKENS), spark.createDataFrame([], LINES)
    assert [tuple(x)[:6] for x in locate.locate(pages, none, lines).collect()] == [(1, "fallback", 60, 44, 100, 80)]
    assert locate.locate(pages.limit(0), none, lines).count() == 0


def test_cells_of_many_pages_at_once(spark):
    """Faces come from one pass over whole pages: elementary cells are never rows. What has no place is no line."""
    pages = spark.createDataFrame([(k, 100.0, 60.0) for k in range(300)], "sheet_id INT, w DOUBLE, h DOUBLE")
    lines = [(k, False, 0, 50.0, -5.0, 50.0, 70.0) for k in range(0, 300, 2)] + [(k, True, 1, 0.0, 30.0, 50.0, 30.0) for k in range(0, 300, 4)] + [(k, True, 2, None, None, None, None) for k in range(300)]
    faces_ = locate.cells(spark.createDataFrame(lines, "sheet_id INT, horizontal BOOLEAN, seq INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"), pages)
    assert "explode" not in faces_._jdf.queryExecution().executedPlan().toString().lower()
    got = {}
    for x in faces_.orderBy("sheet_id", "cell").collect():
        got.setdefault(x["sheet_id"], []).append((*[x[c] for c in SIDES], x["area"]))
    half = [(0.0, 0.0, 50.0, 60.0, 3000.0), (50.0, 0.0, 100.0, 60.0, 3000.0)]
    quarters = [(0.0, 0.0, 50.0, 30.0, 1500.0), half[1], (0.0, 30.0, 50.0, 60.0, 1500.0)]
    assert all(got[k] == (quarters if k % 4 == 0 else half if k % 2 == 0 else [(0.0, 0.0, 100.0, 60.0, 6000.0)]) for k in range(300)) and len(got) == 300


def test_density_is_smoothed_within_sheets(spark):
    """One shuffle, by sheet; what a bin gives to others is never shuffled. Borders mirror, as the kernel's sums show."""
    grid = spark.createDataFrame([(1, 0, 0, 16.0), (2, 47, 24, 256.0), (2, 46, 24, None)], "sheet_id INT, bx INT, by INT, ink DOUBLE")
    heat = locate.smoothed(grid)
    assert heat._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["sheet_id"], r["bx"], r["by"]): r["heat"] for r in heat.collect()}
    assert got[(1, 0, 0)] == 16 * 0.375**2 and got[(1, 2, 0)] == 16 * 0.0625 * 0.375 and len(got) == 9 + 15
    assert got[(2, 47, 24)] == 256 * 0.375**2 and got[(2, 45, 26)] == 256 * 0.0625**2
