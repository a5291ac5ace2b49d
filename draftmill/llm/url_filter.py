"""URL filters (operator 13), native: a sort-merge range join of urls with rules of hosts and paths.

A host's labels in reverse, each ended by "/", then "#", then the path make a key in which a rule is an interval: all the
keys that it is a prefix of. ("/" can't be in a host, and "#" in neither.) As a rule fits subdomains too, a url has one
key for each of its host's ancestors; only depths and hosts that rules have are kept, and each key once. Intervals of
prefixes are nested or apart, so one sweep over keys in order, rules before urls, needs only the stack of the rule that
started last: entries of it that have ended are popped, the innermost of the others fits. The keys are cut into ranges
that are swept apart from each other; each range gets the stack that was open at its start. The urls' rows meet their
verdicts at the end, where frequent keys and urls are joined by broadcast.

Defined results: the rule of the longest host and path wins, of equally long ones that of the longer host; rules of equal
host and path are one, which blocks if any of them does; rules without host or path are ignored; urls that no rule fits,
null urls among them, get the verdict of `other`. A null url or one without "://" has an empty host and path. Repeated
rows and null ids are kept. An empty table of urls or rules is fine; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftmill.llm._text import discard, join_groups, stored

#: Ranges of keys that are swept apart, at most; and for each of a session's shuffle partitions.
RANGES, RANGES_EACH = 4096, 8
#: Keys by which ranges are drawn, for each range, and characters of them. Only the balance of work depends on these.
DRAWN, DRAWN_CHARS = 16, 200
#: Rules' hosts are broadcast up to this many bytes, and joined by shuffling beyond.
SMALL = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lowered, and the path of a url; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host, path = F.regexp_extract(rest, "^[^/?#]*", 0), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "/"), F.lit("/#"), path)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict, name, depth, key) of the distinct rules."""
    host = F.translate(F.col("host"), UPPER, LOWER).alias("host")
    one = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(host, "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return one.select("*", F.concat("host", "path").alias("name"), F.size(_labels(F.col("host"))).alias("depth"), _key(_labels(F.col("host")), F.col("path")).alias("key"))


def stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules that are open when a rule starts, outermost first, itself last."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # as many as the longest path has characters
    cut = F.explode(F.filter(F.array([F.lit(n) for n in lengths]), lambda n: n <= F.length("path")))
    each = rules.select("key", "host", "path", cut.alias("n")).select("key", _key(_labels(F.col("host")), F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("outer"))
    outer = rules.select(F.col("key").alias("outer"), F.struct(F.length("key").alias("n"), F.length("host").alias("h"), F.col("key"), "name", "verdict").alias("entry"))
    return each.join(outer, "outer").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def _ranges(keys: DataFrame, total: int) -> tuple[Column, int]:
    """The range of a key, and their number. Cuts are drawn by a hash of the keys."""
    many = min(RANGES, RANGES_EACH * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = max(1, total // (many * DRAWN))
    drawn = keys.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select(F.substring("key", 1, DRAWN_CHARS).alias("k")).collect()
    drawn = sorted({r["k"] for r in drawn}, key=lambda k: k.encode())
    many = min(many, len(drawn) + 1)
    cuts = [drawn[i * len(drawn) // many] for i in range(1, many)]
    if not cuts:
        return F.lit(0), 1
    wide = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    lits = lambda x: F.array([F.lit(s) for s in x])
    at = lambda cuts, key: F.size(F.filter(cuts, lambda c: c <= key))
    key = F.col("key")
    group = at(lits([g[0] for g in groups]), key)  # the first groups that start at or before the key
    inner = at(F.element_at(F.array([lits(g) for g in groups]), F.greatest(group, F.lit(1))), key)
    return F.when(group == 0, 0).otherwise((group - 1) * wide + inner), many


def sweep(keys: DataFrame, rules: DataFrame, total: int) -> DataFrame:
    """(key, copies, n, h, name, verdict) of the keys (unique, with their number in copies): the innermost rule whose
    interval holds the key, or null."""
    span, many = _ranges(keys, total)
    starts = stacks(rules).withColumn("span", span)
    last = starts.groupBy("span").agg(F.max_by("stack", "key").alias("stack"))  # a row a range
    # each range opens with the last stack of the nearest range before it in which a rule starts
    with_starts, near = {r["span"] for r in last.select("span").collect()}, [-1]
    for k in range(many - 1):
        near.append(k if k in with_starts else near[-1])
    spans = keys.sparkSession.range(many).select(F.col("id").cast("int").alias("opens"), F.get(F.array([F.lit(k) for k in near]), F.col("id").cast("int")).alias("span"))
    opened = spans.join(last, "span").select(F.col("opens").alias("span"), F.lit("").alias("key"), "stack")
    no_copies = F.lit(None).cast("bigint").alias("copies")
    events = starts.select("span", "key", "stack", no_copies).unionByName(opened.select("*", no_copies))
    events = events.unionByName(keys.select(span.alias("span"), "key", F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"), "copies"))
    order = Window.partitionBy("span").orderBy(F.col("key"), F.col("copies").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", True).over(order)).filter("copies IS NOT NULL")
    open_ = F.filter("stack", lambda s: F.startswith(F.col("key"), s["key"]))
    return swept.select("key", "copies", F.try_element_at(open_, F.lit(-1)).alias("top")).select("key", "copies", "top.n", "top.h", "top.name", "top.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", carry: tuple[str, ...] = ("page_id",), other: str = "allow") -> DataFrame:
    """The carried columns of pages with host, path, rule and verdict. rules: (host, path, verdict)."""
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.struct(*carry).alias("own"), host.alias("host"), path.alias("path"))
    unique = stored(rows.groupBy("host", "path").agg(F.count("*").alias("copies")), "urls")
    rules = stored(canonical_rules(rules), "rules")
    total = unique.agg(F.sum("copies")).first()[0] or 0
    depths = sorted(r[0] for r in rules.select("depth").distinct().collect())  # as many as the longest rule's host has labels
    out = lambda df, rule, verdict: df.select("own.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(other)).alias("verdict"))
    if not total or not depths:
        return out(rows, F.lit(None).cast("string"), F.lit(None).cast("string"))

    labels = _labels(F.col("host"))
    fitting = F.filter(F.array([F.lit(d) for d in depths]), lambda d: d <= F.size(labels))
    points = unique.select("host", "path", F.explode(F.transform(fitting, lambda d: F.array_join(F.slice(labels, 1, d), "/"))).alias("up"))
    ups = rules.select(F.array_join(_labels(F.col("host")), "/").alias("up")).distinct()
    size = ups.agg(F.sum(F.octet_length("up") + 16)).first()[0]
    points = points.join(F.broadcast(ups) if size <= SMALL else ups, "up", "left_semi")
    points = points.select("host", "path", F.concat("up", F.lit("/#"), "path").alias("key"))

    keys = stored(points.groupBy("key").agg(F.count("*").alias("copies")), "keys")
    n, n_points = keys.agg(F.count("*"), F.sum("copies")).first()
    found = stored(sweep(keys, rules, n), "swept")
    discard(keys)
    best = F.max(F.struct("n", "h", "name", "verdict")).alias("best")
    fits = join_groups(points, found, ["key"], n_points or 0).filter("n IS NOT NULL").groupBy("host", "path").agg(best)
    verdicts = stored(unique.join(fits, ["host", "path"], "left").select("host", "path", "copies", "best.name", F.col("best.verdict").alias("said")), "verdicts")
    discard(found)
    discard(unique)
    return out(join_groups(rows, verdicts, ["host", "path"], total), F.col("name"), F.col("said"))


#: The contract's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole pages table."""
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS rules(host, path, verdict)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP13_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_no
  FROM rest
),
fits AS (
  SELECT row_no, arg_max(r_host || r_path, length(r_host || r_path) * 10000 + length(r_host)) AS rule, arg_max(r_verdict, length(r_host || r_path) * 10000 + length(r_host)) AS verdict
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY row_no
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (row_no)
"""
