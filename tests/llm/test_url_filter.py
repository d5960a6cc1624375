from pyspark.sql import functions as F

from sensorflow.llm import url_filter

RULES = [("net", "/", "block"), ("b.net", "/x/", "allow"), ("b.net", "/x/y", "block"), ("same.org", "/", "allow"), ("same.org", "/", "block"), ("", "/q/", "block")]
URLS = [
    None, "", "no scheme/x/", "http://", "http://net", "http://net/", "HTTP://A.B.NET/x/1?u=http://c.org/", "http://b.net/x", "http://b.net/x/yes", "http://ab.net/x/",
    "http://b.net.org/x/", "http://same.org/", "http://sub.same.org/a#b", "http:///q/1", "http://ÄB.net/", "http://b.net/" + "x/" * 20_000, "http://" + "a." * 5_000 + "net/", "://b.net/x/", "http://b.net\n/x/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest)] + [rest.find(c) for c in "/?#" if c in rest])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([len(tail)] + [tail.find(c) for c in "?#" if c in tail])]
    fitting = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, url) for i, url in enumerate(URLS * 2)], "page_id long, url string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    found = url_filter.judge(pages.withColumn("rule", F.lit("own")), rules).collect()
    assert len(found) == 2 * len(URLS)
    for row in found:
        assert (row.host, row.path, row.rule, row.verdict) == brute(row.url)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, rules).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_many_rule_shapes(spark):
    """20,000 shapes: paths of 0 to 9,999 characters on hosts of one and of two labels."""
    rules = spark.range(10_000).selectExpr("repeat('a', cast(id AS int)) AS path", "if(id % 3 = 0, 'allow', 'block') AS verdict")
    rules = rules.selectExpr("'h' AS host", "path", "verdict").unionByName(rules.selectExpr("'g.i' AS host", "path", "verdict"))
    slashed = rules.selectExpr("host", "concat('/', path) AS path", "verdict")
    lengths = (0, 1, 49, 9_999, 12_000)
    pages = [(f"http://{host}/{'a' * n}", n, host) for host in ("h", "x.h", "g.i", "i", "y.g.i") for n in lengths]
    found = url_filter.judge(spark.createDataFrame(pages, "url string, n int, at string"), slashed).collect()
    assert len(found) == len(pages)
    for r in found:
        longest = min(r.n, 9_999)
        rule = {"h": "h", "x.h": "h", "g.i": "g.i", "y.g.i": "g.i"}.get(r.at)
        assert r.rule == (None if rule is None else f"{rule}/{'a' * longest}")
        assert r.verdict == ("allow" if rule is None or longest % 3 == 0 else "block")
