"""Every operator on small tables with nulls, empty and repeated texts and ids, and extra columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from draftmill.llm import bpe, decontaminate, fingerprints, language_id, lm_score, near_dedup, sharding, substring_dedup, token_counts, token_files

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t, lower=False):
    raw = (t or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    para = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, base = para(70), para(120)
    near = base.split()
    near[60] = "changed"
    out = [None, "", "   \n\t", "one", "One", base, base.upper(), " ".join(near), f"{para(30)} {shared} {para(20)}", f"{shared}  {para(10)}", shared, base, "a " * 300, "b\x1cc\x85d \x00x", "<|endoftext|> It's 東京 ΣΑΣ x" * 3]
    return out + [para(r.randint(1, 200)) for _ in range(40)] + [para(6000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "ab"[i % 2] if i % 5 else None, "s", i) for i, t in enumerate(texts())]
    rows += [(5, texts()[5], "a", "s", 0), (None, texts()[8], "a", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_substring_dedup(docs, rows):
    big = 1 << 63
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, big), big - 1 if i is None else i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (big - 1 if i is None else i) for j in range(50)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    # a sketch far too narrow passes more windows, and chunks of one document share none: the result stays
    for how in ({}, {"width": 5}, {"width": 5, "chunk_bytes": 1}, {"chunk_bytes": 2000}):
        got = [tuple(r) for r in substring_dedup.remove_repeated(docs, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 100
    assert substring_dedup.remove_repeated(docs.limit(0)).count() == 0
    # names that the operator uses itself may be carried
    kept = substring_dedup.remove_repeated(docs.withColumn("row", docs.n_words).withColumn("kept", docs.lang), carry=["n_words", "row", "kept"]).collect()
    assert sorted((x["doc_id"] is None, x["n_words"], x["n_removed"]) for x in kept) == sorted((i is None, n, g) for i, n, g, _ in want)
    assert all(x["kept_text"] == dict(rows)[x["doc_id"]] for x in kept if not x["n_removed"] and x["doc_id"] is not None)


def test_substring_dedup_of_equal_rows(spark):
    r = random.Random(9)
    a, b = (" ".join(str(r.randint(0, 10**6)) for _ in range(70)) for _ in range(2))
    rows = [(None, a)] * 200 + [(7, b), (8, b), (8, b), (9, a + " " + b)]
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=4000).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"]) for x in got) == {(None, 70, 70): 200, (7, 70, 0): 1, (8, 70, 70): 2, (9, 140, 70): 1}


def test_packed_numbers():
    r = np.random.default_rng(2)
    for top in (3, 300, 10**5, 1 << 34):
        x = np.unique(r.integers(0, top, 200))
        assert (substring_dedup.unpacked(substring_dedup.packed(x)) == x).all()
    assert not len(substring_dedup.unpacked(substring_dedup.packed(np.zeros(0, np.int64))))


def test_near_dedup(docs, rows):
    sets = []
    for i, t in rows:
        w = words(t, True)
        sets.append((near_dedup.NO_ID if i is None else i, frozenset({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else ()))))
    # rows are linked by their texts alone: a row without a doc_id, or one of a doc_id that repeats, is a row of its own
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = top(k), top(j)
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    got = sorted((r["did"], r["n_shingles"], r["component"]) for r in near_dedup.near_duplicates(docs, 85).collect())
    assert got == sorted((i, len(a), least[top(k)]) for k, (i, a) in enumerate(sets))
    assert near_dedup.near_duplicates(docs.limit(0), 85).count() == 0


def test_near_dedup_without_ids(spark):
    r = random.Random(11)
    a, b = (" ".join(str(r.randint(0, 10**6)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (None, a + " x"), (None, b), (None, b), (3, ""), (None, None), (4, b + " y"), (4, "none of these words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    no = near_dedup.NO_ID
    assert Counter((x["did"], x["component"]) for x in got) == {(1, 1): 1, (no, 1): 1, (no, 4): 2, (4, 4): 2, (3, 3): 1, (no, no): 1}


def test_near_dedup_left_over_buckets(spark, monkeypatch):
    """Chains of near copies and heavy groups: without star rounds all links come from the finer bands."""
    monkeypatch.setattr(near_dedup, "STARS", 0)
    monkeypatch.setattr("draftmill.llm._text.HEAVY_ROWS", 10)
    r = random.Random(12)
    words_ = [str(r.randint(0, 10**6)) for _ in range(150)]
    rows, i = [], 0
    for g in range(4):
        own = [str(r.randint(0, 10**6)) for _ in range(100)]
        for _ in range(30):
            own[r.randrange(100)] = str(r.randint(0, 10**6))
            rows.append((i, " ".join(words_[:20] + own)))
            i += 1
    rows += [(1000 + k, rows[0][1]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in range(len(rows)):
        for j in range(k):
            if 100 * len(sets[k] & sets[j]) >= 85 * len(sets[k] | sets[j]):
                p, q = top(k), top(j)
                up[max(p, q)] = min(p, q)
    got = {x["did"]: x["component"] for x in near_dedup.near_duplicates(docs, 85).collect()}
    assert got == {i: rows[top(k)][0] for k, (i, _) in enumerate(rows)} and 4 <= len(set(got.values())) < 60


def test_block_products_find_every_link():
    r = np.random.default_rng(1)
    lists = [np.unique(r.integers(0, 60, 40)) for _ in range(30)]
    n = np.arange(30)
    links = near_dedup._linked(n, n, np.zeros(30), lists, 50)
    want = {(i, j) for i in n for j in n if i < j and 100 * len(np.intersect1d(lists[i], lists[j])) >= 50 * len(np.union1d(lists[i], lists[j]))}
    assert {(i, j) for i, j in links} <= want and links

    def parts(pairs):
        up = list(range(30))
        for i, j in pairs:
            p, q = up[i], up[j]
            up = [p if x == q else x for x in up]
        return [[k for k in range(30) if up[k] == u] for u in sorted(set(up))]

    assert sorted(parts(links)) == sorted(parts(want))


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    got = {x["node"]: x["root"] for x in near_dedup.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert all(got.get(x, x) == top(x) for p in pairs for x in p)


def test_decontaminate(spark, docs, rows, monkeypatch):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    items = [(1, " ".join(rows[8][1].split()[40:60])), (2, "One!"), (3, None), (4, ""), (2, "not there at all"), (5, rows[5][1])]
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, who = split(t), set(), set()
        for key, own in wins.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    who |= own
        want.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"segment": 3000}):
        out = decontaminate.decontaminate(docs, bench, **how).drop("th").collect()
        assert sorted((tuple(r)[:6] for r in out), key=str) == sorted(want, key=str) and any(w[5] for w in want)
        assert all(sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_hit"] for r in out)
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert sorted((tuple(r)[:6] for r in decontaminate.decontaminate(docs, bench).drop("th").collect()), key=str) == sorted(want, key=str)
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_index_is_not_shuffled_for_what_is_asked(spark, docs, rows, monkeypatch):
    """More is asked of all segments than may be broadcast, but of no more terms."""
    bench = spark.createDataFrame([(5, rows[5][1])], "item_id long, text string")
    held = docs.crossJoin(spark.range(30)).selectExpr("id * 1000 + coalesce(doc_id, -1) AS doc_id", "text")
    want = sorted((tuple(r) for r in decontaminate.decontaminate(held, bench).collect()), key=str)
    index, windows = decontaminate.build_index(held, segment=3000), decontaminate.benchmark_windows(bench)
    monkeypatch.setattr(decontaminate, "SMALL", sum(len(t) + 32 + 4 for t in decontaminate.split_words(rows[5][1].encode())) * 3)
    monkeypatch.setattr(decontaminate, "_asked", lambda i, p, t, f=decontaminate._asked: asked.append(t) or f(i, p, t))
    asked, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = decontaminate.find_windows(index, windows)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[[^\]]*term", plan) and asked[0].columns == ["term"]
        assert sorted((tuple(r) for r in decontaminate.decontaminate(held, bench, segment=3000).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any(w[6] for w in want)


def test_positional_index(spark, docs, rows):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    index = decontaminate.build_index(docs, segment=5000)
    # every term of every document is indexed
    assert index.agg({"n": "sum"}).first()[0] == sum(len(split(t)) for _, t in rows)
    own = split(rows[8][1])
    for phrase in (own[3:6], own[40:41], [b"one"], [b"not", b"here"]):
        want = sorted(((i, k) for i, t in rows for w in [split(t)] for k in range(len(w)) if w[k : k + len(phrase)] == phrase), key=str)
        got = [tuple(r) for r in decontaminate.phrase_search(index, [w.decode() for w in phrase]).collect()]
        assert sorted(got, key=str) == want
    near = decontaminate.proximity_search(index, [own[3].decode(), own[6].decode()], 3).collect()
    first = {i: split(t) for i, t in rows}
    assert near and all(any(x in first[r["doc_id"]][max(0, r["at"] - 3) : r["at"] + 4] for x in (own[3], own[6])) for r in near)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe(docs, rows, library):
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_words(library):
    t, r = bpe.ready(bpe.vocabulary()), random.Random(2)
    own = ["".join(r.choice("aeiotnsr'é0") for _ in range(r.randint(1, 20))) for _ in range(3000)] + ["t" * k for k in range(1, 40)]
    own.append("".join(r.choice("aeiotnsrbcdf") for _ in range(20_000)))
    assert all(t.encode(w) == library.encode(w, add_special_tokens=False).ids for w in own)


def test_automaton_applies_merges_in_order():
    """Against merging by rank, on random merges over a few symbols, among them ones that no word ever uses."""
    r = random.Random(13)
    for _ in range(60):
        symbols, merges = ["a", "b", "c"], []
        names = list(symbols)
        while len(merges) < 14:
            x, y = r.choice(names), r.choice(names)
            if len(x + y) <= 6 and (x, y) not in merges and x + y not in names:
                merges.append((x, y))
                names.append(x + y)
        machine = bpe.Automaton({t: k for k, t in enumerate(names)}, merges, "")
        for _ in range(60):
            word = "".join(r.choice(symbols) for _ in range(r.randint(1, 14)))
            parts = list(word)
            for x, y in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == x and parts[k + 1] == y:
                        parts[k : k + 2] = [x + y]
                    k += 1
            assert [names[t] for t in machine.word(word)] == parts


def test_token_files(docs, rows, library):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    at, want = 0, []
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.read_shards(token_files.write_shards(docs, shard_tokens=900)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_library_pieces(library):
    """Cuts, lowering and joint requests give what the library gives for the whole text."""
    r = random.Random(8)
    odd = ["'s", "'LL", "t", "T", "re", "Ab", "x", ".", ",", "<", "|", ">", "<|endoftext|>", "<|STARTOFTEXT|>", "7", "é", "É", "e\u0301", "\u0301", "Σ", "İ", "ǅ", "東", "ª", "²", "½", " ", "  ", "\n", "\u00a0", "\x1c", "\u2028", "…", "$$", "-", "_", "\x00", "\u200d", "K", "ﬁ", "𝐀"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    encoder = token_files._ready(token_files._vocabulary())
    for some in ([x] for x in texts[:300]), ([x for x in texts if "<" not in x],), (texts,), ([None, "", " "],):
        for group in some:
            raw = [(x or "").encode() for x in group]
            flat, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            assert [list(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [[*e.ids, 2] for e in library.encode_batch([x or "" for x in group], add_special_tokens=False)]


def test_wavelet_matrix():
    x = np.random.default_rng(1).integers(0, 700, 5000)
    w, _ = token_files.WaveletMatrix.loads(token_files.WaveletMatrix.build(x, 10).dumps(np.array([5000])))
    assert (w.all() == x).all() and [w.access(i) for i in range(0, 5000, 37)] == list(x[::37])
    assert w.occurrences(int(x[9])) == list(np.flatnonzero(x == x[9])) and w.count(int(x[9]), 2500) == (x[:2500] == x[9]).sum()


def test_trie_counts(docs, rows):
    scores = token_counts.pieces(token_counts._vocabulary())
    c = token_counts.Trie(scores)

    def plain(word):
        s = token_counts.MARK + word
        best = [(0.0, 0)]
        for d in range(1, len(s) + 1):
            n = len(s[d - 1].encode())
            options = [(best[d - 1][0] + n * c.byte_score, -best[d - 1][1] - n)]
            options += [(best[j][0] + scores[s[j:d]], -best[j][1] - 1) for j in range(d) if s[j:d] in scores]
            v, k = max(options)
            best.append((v, -k))
        return best[-1][1]

    for r in token_counts.token_counts(docs.filter("doc_id < 30")).collect():
        w = [x.decode() for x in words(dict(rows)[r["doc_id"]])]
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(map(plain, w)))
    some = {"alpha", "alphabet", "alphabets", "beta", "é" * 70, "x" * 200}
    got = c.counts(some)
    assert {w: got[w] for w in some} == {w: plain(w) for w in some}
    assert len(c.best) == 1 + len({(token_counts.MARK + w)[:k] for w in c.terminal for k in range(1, len(w) + 2)})  # a node for each prefix
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_sharding(docs, rows):
    got = sharding.kd_shards(docs, 4).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert sharding.kd_shards(docs.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.kd_shards(docs, 3)


def test_sharding_balances_and_keeps_equal_texts(spark, monkeypatch):
    monkeypatch.setattr("draftmill.llm._text.HEAVY_ROWS", 50)
    r = random.Random(14)
    text = lambda: " ".join(str(r.randint(0, 999)) for _ in range(r.randint(2, 60)))
    small = [text() for _ in range(60)]
    rows = [(i, text() if i % 3 else small[i % 60], r.choice("abc"), r.choice("xyz")) for i in range(3000)] + [(5000 + i, "the same text", None, "x") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(docs, 8).collect()
    size = Counter()
    where = {}
    for x in got:
        size[x["shard"]] += x["size"]
        where.setdefault(x["text_crc32"], set()).add(x["shard"])
    total = sum(size.values())
    assert len(size) == 8 and all(abs(v - total / 8) < 0.1 * total / 8 for v in size.values())
    assert all(len(v) == 1 for v in where.values())
    got = sharding.kd_shards(docs, target_bytes=total / 21).collect()
    size, where = Counter(), {}
    for x in got:
        size[x["shard"]] += x["size"]
        where.setdefault(x["text_crc32"], set()).add(x["shard"])
    # the one group that outweighs a leaf is a shard of its own
    assert all(len(v) == 1 for v in where.values())
    (hot,) = where[zlib.crc32(b"the same text")]
    assert size[hot] == 1500 * 14 > total / 21
    assert sorted(size) == list(range(len(size))) and all(v <= total / 21 for k, v in size.items() if k != hot) and len(size) <= 44 and len(got) == len(rows)


def test_sharding_of_one_text_and_of_half(spark):
    """Equal texts of half of all bytes, or of all, stay in one shard; the slots have no gaps."""
    half = [(i, "x" * 40, "a", "s") for i in range(400)] + [(1000 + i, f"{i:040d}", "ab"[i % 2], "s") for i in range(400)]
    for rows in (half, half[:400]):
        got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
        assert len({x["shard"] for x in got if x["doc_id"] < 1000}) == 1 and len(got) == len(rows)
        for k in {x["shard"] for x in got}:
            assert sorted(x["slot"] for x in got if x["shard"] == k) == list(range(sum(x["shard"] == k for x in got)))


def test_fingerprints(docs, rows):
    got = {}
    for r in fingerprints.fingerprints(docs).collect():
        got.setdefault(r["doc_id"], r["fingerprint"])
    assert got[0] == got[1] == got[2] == "" and got[5] == got[11] != got[7] and len(got[3]) == 8
    a, b = (({x[k : k + 8] for k in range(0, len(x), 8)}) for x in (got[5], got[7]))
    assert 0.5 < len(a & b) / len(a | b) < 1


@pytest.mark.parametrize("ranges", [(100, 64 << 20), (6, 500)])
def test_fingerprint_edits(spark, docs, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", ranges[0])
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", ranges[1])
    more = spark.createDataFrame([(None, f"no id {i} of any kind {i * i}") for i in range(20)] + [(3, "the same id"), (70, "mild win"), (71, "spring w")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    big = 1 << 63
    order = sorted(((r["doc_id"], r["t"], r["h"]) for r in docs.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()), key=lambda r: (-(big if r[0] is None else r[0]), r[2]))
    cut = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    like = lambda a, b: len(cut(a) & cut(b)) / len(cut(a) | cut(b)) if a or b else 1.0
    prints = {r["text"]: r["fingerprint"] for r in fingerprints.fingerprints(docs.unionByName(spark.createDataFrame([], docs.schema))).join(docs, "doc_id").collect()}
    own = {r["t"]: r["f"] for r in fingerprints.with_anchors(docs.selectExpr("coalesce(text, '') t"), "t", "x").select("t", fingerprints.shown("x_h").alias("f")).collect()}
    want, edits = [], []
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        edits.append((e,))
        want.append([i, len(t), hashlib.sha256(e.encode()).hexdigest(), own[t], e, after])
    of = {r["t"]: r["f"] for r in fingerprints.with_anchors(spark.createDataFrame(edits, "t string"), "t", "x").select("t", fingerprints.shown("x_h").alias("f")).collect()}
    rows = [(i, n, h, f, of[e], round(like(f, of[e]), 6), round(like(f, own[after]), 6)) for i, n, h, f, e, after in want]
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in fingerprints.fingerprint_edits(docs).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert all(f for t, f in own.items() if t.strip()) and prints


def test_every_text_has_an_anchor_and_matches_by_position(spark):
    r = random.Random(15)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "a" for n in [*range(1, 16)] * 12]
    rows = fingerprints.with_anchors(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "x").collect()
    assert all(len(x["x_h"]) == len(x["x_at"]) > 0 for x in rows)
    unlike = [x for x in rows if len(x["t"]) >= 8]
    assert len({a for x in unlike for a in x["x_h"]}) >= len({x["t"] for x in unlike}) * 0.9
    text = "".join(r.choice("abcdefgh") for _ in range(400))
    pair = spark.createDataFrame([(1, text, "zzzzz" + text[100:])], "k int, p string, q string")
    both = fingerprints.with_anchors(fingerprints.with_anchors(pair, "p", "x"), "q", "y")
    shifts = {m["shift"]: m["n"] for m in fingerprints.positional_matches(both, "k", "x", "y").collect()}
    assert max(shifts, key=shifts.get) == -95 and shifts[-95] > 100


def test_fingerprints_of_short_and_unspaced_texts(spark):
    a, b = "mild winter brings rain", "東京都の図面を読み取り、表題欄の値を確かめてから保存する"
    pairs = [(a, a[:12] + "/0123456789"), (b, b[:14] + "x" * 14), ("ab  \t cd efghij", "ab cd efghij"), (a, "zzyyxxwwvvuuttssrrqqpp")]
    df = fingerprints.with_anchors(fingerprints.with_anchors(spark.createDataFrame(pairs, "p string, q string"), "p", "x"), "q", "y")
    got = [r[0] for r in df.select(fingerprints.likeness("x_h", "y_h")).collect()]
    assert 0 < got[0] < 1 and 0 < got[1] < 1 and got[2] == 1 and got[3] == 0
    # closed syncmers by their definition: every window of 2 K - S - 1 characters has one
    text = "".join(random.Random(4).choice("abé東 x") for _ in range(400)).strip()
    plain = re.sub(" +", " ", text)
    k, s = fingerprints.K, fingerprints.S
    rows = [(i, plain[i : i + k]) for i in range(len(plain) - k + 1)]
    inner = spark.createDataFrame([(i, [("".join(r[j : j + s])) for j in range(k - s + 1)], r) for i, r in rows], "i int, inner array<string>, r string")
    utf32 = "xxhash64(encode({}, 'UTF-32'))".format
    want = inner.selectExpr("i", f"transform(inner, z -> {utf32('z')}) h", f"{utf32('r')} v").filter("array_min(h) = h[0] or array_min(h) = h[size(h) - 1]").orderBy("i").collect()
    own = fingerprints.with_anchors(spark.createDataFrame([(text,)], "t string"), "t", "x").first()
    assert own["x_h"] == [r["v"] for r in want] and own["x_at"] == [r["i"] for r in want]
    at = [-1, *(r["i"] for r in want), len(rows)]
    assert max(y - x for x, y in zip(at, at[1:])) <= k - s


def test_language_id(spark):
    r = random.Random(1)
    make = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abcde") if i % 2 else make("vwxyz"), "p" if i % 2 else "q") for i in range(80)] + [(99, None, "p"), (98, "123 !", "q"), (97, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, net = language_id.fit(d.filter(~language_id.held_out()))
    got = language_id.predict(d, names, net).collect()
    assert all(x["lang_pred"] == ("und" if x["doc_id"] > 90 else x["lang"]) for x in got) and all(0 <= x["score"] <= 1 for x in got)
    assert language_id.predict(d, [], None).filter("lang_pred <> 'und'").count() == 0


def test_gradients():
    r = np.random.default_rng(0)
    net = language_id.ByteGRU(3, 4)
    lm = lm_score.ClassGRU(10, 4, 4, 3)
    x, y, mask = r.integers(0, 256, (6, 5)), r.integers(0, 3, 5), (r.random((6, 5)) < 0.8).astype(float)
    a, b, m, f, s = r.integers(0, 13, (6, 5)), r.integers(0, 13, (6, 5)), r.random((6, 5)) < 0.8, r.random((6, 5)) < 0.2, r.standard_normal((5, 4))
    for own, run in ((net, lambda: net.gradient(x, y, mask)), (lm, lambda: lm.window(a, b, m, f, s)[:2])):
        own.p = {k: v.astype(np.float64) for k, v in own.p.items()}
        for k, g in run()[1].items():
            i = np.unravel_index(np.abs(g).argmax(), g.shape)
            old = own.p[k][i]
            own.p[k][i] = old + 1e-4
            up = run()[0]
            own.p[k][i] = old - 1e-4
            down = run()[0]
            own.p[k][i] = old
            assert abs((up - down) / 2e-4 - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_lm_score(docs, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t, True), b""])
    n, v = sum(c.values()), len(c)
    want = sorted(((held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t, True), b""]), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t, True), b""]), 4)) for i, t in rows), key=str)
    out = lm_score.score_texts(docs, "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 1, true)").collect()
    assert sorted(((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out), key=str) == want
    assert all(r["score"] < 0 for r in out)


def test_lm_scores_are_a_function_of_the_table(docs, monkeypatch):
    """Equal scores in two runs and over other partitions; each group trains from the same start."""
    monkeypatch.setattr(lm_score, "GROUP_TOKENS", 1500)
    rule = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 1, true)"
    runs = []
    for n in (3, 3, 8, 1):
        out = lm_score.score_texts(docs.repartition(n, "doc_id", "text"), rule).collect()
        runs.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out))
    for other in runs[1:]:
        for x, y in zip(runs[0], other, strict=True):
            assert x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-6 * abs(x[3]) and abs(x[4] - y[4]) < 1e-4 * abs(x[4])


def test_lm_score_by_a_plain_loop():
    r = np.random.default_rng(4)
    net = lm_score.ClassGRU(100, units=6, size=16)
    docs = [r.integers(0, 100 + net.kinds, n).astype(np.int32) for n in (1, 5, 40, 40, 700)]
    net.train(docs, 3, 0.05, passes=2, lanes=4)
    p, h = net.p, net.units
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for d in docs:
        s, before, total = np.zeros(h), 3, 0.0
        for y in d:
            a, b = p["t"][before].astype(float), p["u"].astype(float) @ s
            z, g = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
            n = np.tanh(a[2 * h :] + g * b[2 * h :])
            s = n + z * (s - n)
            o = p["c"].astype(float) @ s + p["d"]
            k = int(net.classes(np.array([y]))[0])
            total += o[k] - np.log(np.exp(o).sum())
            if k < net.groups:
                v = p["w"][k].astype(float) @ s + p["b"][k]
                total += v[y - k * net.size] - np.log(np.exp(v).sum())
            before = y
        want.append(total)
    assert np.allclose(net.score(docs, 3), want, rtol=1e-4)
    assert np.allclose(np.exp(net.log_probability(np.zeros((1, h), np.float32).repeat(100 + net.kinds, 0), np.arange(100 + net.kinds))[0]).sum(), 1, atol=1e-4)


class Counted(np.ndarray):
    """Counts the elements that go through functions of it, by the largest array of each."""

    passed, __array_priority__ = 0, 1

    def __array_ufunc__(self, f, method, *given, out=None, **how):
        plain = lambda xs: tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in xs)
        got = getattr(f, method)(*plain(given), **how, **({"out": plain(out)} if out else {}))
        Counted.passed += max(np.size(x) for x in (*given, got))
        return out[0] if out else got.view(Counted) if isinstance(got, np.ndarray) else got


def test_lm_goes_few_times_over_its_outputs():
    """Product, exponential, sum and two products for the gradient; a bound on the logits only where they could pass it."""
    r = np.random.default_rng(5)
    net = lm_score.ClassGRU(2048)
    ids, s = r.integers(0, 2048, 4096), np.tanh(r.standard_normal((4096, net.units))).astype(np.float32)
    outputs = len(ids) * (net.groups + net.kinds + net.size)
    passes = {}
    for scale in (1, 1000):
        net.p["c"] = net.p["c"] * np.float32(scale)
        grad = {k: np.zeros_like(v) for k, v in net.p.items()}
        want = net.log_probability(s, ids, grad)[0]
        assert np.isfinite(want).all() and all(np.isfinite(g).all() for g in grad.values())
        own, net.p, Counted.passed = net.p, {k: v.view(Counted) for k, v in net.p.items()}, 0
        assert np.allclose(net.log_probability(s.view(Counted), ids, grad)[0], want)
        passes[scale], net.p = Counted.passed / outputs, own
    assert 5 <= passes[1] < 6.5 < passes[1000] + 1


def test_lm_beats_the_base_on_held_out_text(spark):
    d = lm_score.op3_recurrent_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert d[0] > d[1] + 0.1


def test_lm_score_of_long_texts(spark, monkeypatch):
    """The end counts where more words than HOT are more frequent than it."""
    monkeypatch.setattr(lm_score, "HOT", 4)
    rows = [(i, " ".join(f"w{k % 9}" for k in range(200 + i))) for i in range(3)]
    c = Counter(w for _, t in rows for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    want = {i: (len(words(t)) + 1, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b""]), 4)) for i, t in rows}
    out = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), "true").collect()
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 4)) for r in out} == want and all(r["score"] < 0 for r in out)


def test_pipeline_decodes(spark, docs, rows, library):
    import corpus_pipeline

    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    got = corpus_pipeline.encode(spark, docs, "").select("doc_id", "ids", "decoded_sha256", "n_tokens").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    r = random.Random(6)
    para = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d = (para() for _ in range(4))
    ids = [(None, a), (None, a + " more"), (None, b), (1, b), (2, c), (2, c), (3, c), (3, d)]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in ids], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted((t[:len(a)], i) for i, t in got) == sorted([(a, None), (b, 1), (c, 2), (d, 3)])


def test_pipeline(spark):
    """Whole, and stage by stage as the stages' contract says: each result written and read again."""
    import corpus_pipeline
    from draftmill.llm import _text

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs, made = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(path := f"{_text.shared_dir(spark)}/own-stage{k}-{random.random()}")
        docs = spark.read.parquet(path)
        made.append(len(corpus_pipeline._LEFT))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() <= before.count()
    assert sorted(map(str, docs.collect())) == sorted(map(str, out)) and max(made) < 20
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_pipeline_stages_by_brute_force(spark, library):
    """What each stage decides on documents made for it."""
    import corpus_pipeline

    r = random.Random(21)
    para = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(n))
    item, passage = para(14), para(60)
    texts_ = [para(80) for _ in range(20)] + [f"{para(30)} {item} {para(30)}", f"{para(30)} {passage} {para(20)}", f"{para(20)} {passage}"]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in enumerate(texts_)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.remove_passages(spark, docs, "").collect()}
    assert got == {i: t for i, t in enumerate(texts_[:-1])} | {22: " ".join(texts_[22].split()[:20])}
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = {x["doc_id"] for x in corpus_pipeline.drop_contaminated(spark, docs, d).collect()}
    assert got == set(range(23)) - {20}
    empty = corpus_pipeline.identify_language(spark, docs.limit(0), "")
    assert empty.count() == 0
    junk = spark.createDataFrame([(100, None, None, "s", 0), (101, "12 34 !", None, "s", 7)], docs.schema)
    assert {x["doc_id"] for x in corpus_pipeline.identify_language(spark, docs.unionByName(junk), "").collect()} == set(range(23))


def test_pipeline_leaves_texts_where_they_are(spark, tmp_path):
    """They are not shuffled to find the few that hold the benchmark's, whatever Spark takes for small by itself."""
    import corpus_pipeline

    item = " ".join(f"word{k}" for k in range(12))
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in [(1, "a b c"), (None, f"x {item} y"), (-1, "d"), (2, item), (None, "e")]], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == [(-1, "d"), (1, "a b c"), (None, "e")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
