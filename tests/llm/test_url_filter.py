"""URL rules against all rules for each url."""

import random

import pytest
from draftmill.llm import url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:n], rest[n:]
    m = next((k for k, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:m]


def expected(url, rules, other="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, other)
    return host, path, rule, verdict


def check(spark, urls, rules, **how):
    pages = spark.createDataFrame([(k if k % 9 else None, u, "h", "p", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    table = spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")
    got = [tuple(r) for r in url_filter.judge(pages, table, **how).collect()]
    clean = [(h.lower(), p, v) for h, p, v in rules if h is not None and p is not None]
    want = [(k if k % 9 else None, *expected(u, clean, how.get("other", "allow"))) for k, u in enumerate(urls)]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


ODD = [None, "", "no scheme", "http://", "http:///en/x", "http://COM/EN/", "http://com", "http://com/?q", "http://example.com/en/#top", "https://www.Example.com/en/1?x=/en/", "x://a..com/en/", "http://example.com./en/", "http://notexample.com/en/", "http://example.com:80/en/", "http://net/es/", "http://a.net/fr/x", "http://a.net/de/", "a://b://net/es/", "http://É.com/ü", "http://x\ny.com/a\nb", "http://example.com?x/en/", "ftp://" + "a." * 200 + "com/" + "p" * 3000]


def test_contract_rules(spark):
    want = check(spark, ODD * 3, url_filter.RULES)
    assert {w[3] for w in want} == {None, "com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"}


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_nested_rules(spark, monkeypatch, ranges):
    """Rules nested in hosts and paths, in one range and in many."""
    monkeypatch.setattr(url_filter, "RANGES", ranges)
    monkeypatch.setattr(url_filter, "RANGES_EACH", 64)
    r = random.Random(ranges)
    label, step = lambda: r.choice(["a", "b", "c", "ab", ""]), lambda: r.choice(["/", "/x", "/x/", "/xy", "/y/z", ""])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    rules = [(host(), step() + r.choice(["", step()]), r.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{host()}{step()}{step()}{r.choice(['', '?q', '#/x'])}" for _ in range(1500)]
    want = check(spark, urls, rules, other="block")
    assert len({w[3] for w in want}) > 15


def test_hot_urls_and_repeated_rules(spark):
    """A third of the rows is one url, another third one path on many hosts; equal rules that differ block."""
    urls = [["http://hot.example.com/en/", f"http://h{k}.example.com/en/", f"http://{k}.org/x"][k % 3] for k in range(4500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("Example.com", "/", "allow"), ("example.com", "/", "block"), (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).groupBy("rule", "verdict").count().collect()
    assert {tuple(x) for x in got} == {("example.com/", "block", 3000), (None, "allow", 1500)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert [r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()] == ["allow", "allow"]


def test_plan_is_native(spark):
    """No Python worker in the plan."""
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.sql("SELECT 'com' AS host, '/' AS path, 'block' AS verdict")
    plan = url_filter.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
