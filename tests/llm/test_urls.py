import pytest
from pyspark.sql import functions as F

from chartwave.llm import queries, urls

URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://a.net", "http://a.net/x?y#z", "https://www.Example.NET/en/1",
    "http://example.net/en", "http://notexample.net/en/1", "http://example.com/de/1", "http://x.org/fr/1", "http://org/fr/",
    "http://m.casino-win.example.com/en/1", "http://casino-win.net/", "http://casino-winners.com/", "a://b://c/d", "http://x.org?fr/",
    "http://FREE-BETS.example.org/fr/2", "http://exa mple.com/de/\n1", "http://ünï.example.com#x/de/",
]


def judge(url):
    host = path = ""
    if url and "://" in url:
        tail = url.split("://", 1)[1]
        end = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in tail[:end])
        path = tail[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rule in queries.RULES:
        site, _, rest = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, *max(fits)[1:]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in queries.BLOCKED_HOSTS) else "allow"


def blocked(spark):
    return spark.createDataFrame([(h,) for h in [*queries.BLOCKED_HOSTS, None, queries.BLOCKED_HOSTS[0]]], "host string")


@pytest.mark.parametrize("max_bytes", [urls.MAX_CASCADE_BYTES, 0])
def test_matches_brute_force(spark, max_bytes):
    rows = [(i, u, "x", True) for i, u in enumerate(URLS + URLS[-3:])] + [(None, URLS[7], "x", True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, listed boolean")
    got = urls.filter_urls(pages, queries.RULES, blocked(spark), max_bytes).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, [(i, *judge(u)) for i, u, *_ in rows]))


@pytest.mark.parametrize("n_listed", [0, 1, 300, 2999, 3000])
def test_cascade_is_exact_over_its_universe(spark, n_listed):
    universe = spark.range(3000).select(F.concat(F.lit("host-"), "id").alias("key"))
    listed = universe.where(F.substring("key", 6, 9).cast("int") < n_listed)
    levels = urls.cascade(listed, universe)
    hit = universe.where(urls.listed_in(F.col("key"), levels, [x.array() for x in levels]))
    assert hit.count() == n_listed and hit.join(listed, "key").count() == n_listed
    assert n_listed != 300 or len(levels) > 1


def test_no_python_and_no_join_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urls.filter_urls(pages, queries.RULES, blocked(spark))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


def test_the_list_is_large_and_near_misses_pass(spark):
    listed = queries.blocked_hosts(spark)
    n = len(queries.BLOCKED_NAMES) * len(queries.BLOCKED_ZONES)
    assert listed.distinct().count() == queries.BLOCKED_MIRRORS + n and listed.where(F.col("host").isin(queries.BLOCKED_HOSTS)).count() == n
    hosts = ["casino-win7.com", "m.ads-track3333.example.org", "casino-win0.com", "casino-win7.co", "xcasino-win7.com", "casino-win3335.com", "casino-win7.example.comm", "spam-farm.net"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r.verdict for r in urls.filter_urls(pages, [], listed).collect()}
    assert [got[h] for h in hosts] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block"]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, queries.RULES, blocked(spark)).count() == 0
