import itertools

from pyspark.sql import functions as F

from quadrille.llm.queries import URL_RULES
from quadrille.llm.url_filter import filter_urls, host_stacks, path_stacks, rule_table


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"))
    return host, path, best[1] + best[2], best[0]


HOSTS = ["example.com", "WWW.Example.com", "badexample.com", "com", "x.org", "m.example.net", "example.com.", "ÉX.example.com", ""]
PATHS = ["", "/", "/en/7", "/en/71?x=/de/", "/de/8#/es/", "/es/a", "?a://b", "#top", "/en"]
URLS = [f"http://{h}{p}" for h, p in itertools.product(HOSTS, PATHS)] + [None, "", "example.com/en/7", "://", "a://b://c/en/"]


def test_against_plain_rules(spark):
    rows = [(k, u, "extra", "clash") for k, u in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[0], "extra", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, other string, verdict string")
    got = filter_urls(df, URL_RULES).collect()
    want = sorted(repr((i, o, *plain(u, URL_RULES))) for i, u, o, _ in rows)
    assert sorted(repr((r.page_id, r.other, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_nested_rules_and_ties(spark):
    rules = [("block", "a", ""), ("allow", "b.a", ""), ("block", "c.b.a", ""), ("allow", "a", "/x"), ("block", "b.a", "/x"), ("allow", "b.a", "/x"), ("block", "ab.a", "")]
    urls = [f"h://{h}{p}" for h in ("a", "b.a", "c.b.a", "z.c.b.a", "ab.a", "b.a.c", "x.ab.a") for p in ("", "/x", "/xy", "/y")]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == {u: plain(u, rules) for u in urls}


def test_rules_as_a_table_and_host_in_capitals(spark):
    rules = [("block", "a", "/x"), ("allow", "b.a", ""), ("block", "c.b.a", ""), ("allow", "a", "/x"), ("block", "A", ""), ("block", "b.a", "/x"), ("allow", "b.a", "/x"), ("allow", "c.b.a", "/x/y/z")]
    urls = [f"h://{h}{p}" for h in ("a", "b.a", "c.b.a", "z.c.b.a", "ab.a", "b.a.c") for p in ("", "/x", "/xy", "/y", "/x/y/z/", "/x/y")]
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), given).collect()}
    assert got == {u: plain(u, [(v, h.lower(), p) for v, h, p in rules]) for u in urls}


def test_many_rules_that_nest_under_one_domain(spark, tiny):
    """100,000 rules of one domain, in hosts and in paths, among them some that fit no page; in as many ranges as there are."""
    many = [("block" if k % 3 else "allow", f"h{k % 50}.example.com" if k % 2 else "example.com", f"/p{k}/") for k in range(100_000)]
    nested = [("allow" if k % 2 else "block", ".".join(["d"] * k + ["example.com"]), "/" + "s" * k) for k in range(60)]
    rules = many + nested
    urls = [f"https://{h}/{p}" for h in ("example.com", "h3.example.com", "x.h49.example.com", "d.d.d.example.com", ".".join(["d"] * 70) + ".example.com", "example.org") for p in ("", "p3/q", "p6/", "p49/", "p99999/", "p4/", "s", "ss?p", "s" * 100, "p100000/")]
    wide = {(h, p): v for v, h, p in rules}

    def looked_up(url):
        host, path, _, _ = plain(url, [])
        labels = host.split(".")
        fits = [(h, p) for k in range(len(labels)) for n in range(len(path) + 1) if (h := ".".join(labels[k:]), p := path[:n]) in wide]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        return (host, path, best[0] + best[1], wide[best]) if best else (host, path, None, "allow")

    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame([(u,) for u in urls] * 2, "url string"), rules).collect()}
    assert got == {u: looked_up(u) for u in urls} and len({v[2] for v in got.values()}) > 9


def test_a_hot_url_and_a_hot_host(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("http://a.com/en/")).otherwise(F.concat(F.lit("http://b.com/"), F.col("id"))).alias("url"))
    got = filter_urls(df, [("block", "com", "/en"), ("block", "b.com", "/1"), ("allow", "b.com", "/19")])
    seen = {(r.rule, r.verdict): r["count"] for r in got.groupBy("rule", "verdict").count().collect()}
    ids = [k for k in range(30_000) if k % 3]
    want = {("com/en", "block"): 10_000, ("b.com/19", "allow"): sum(str(k).startswith("19") for k in ids), ("b.com/1", "block"): sum(str(k).startswith("1") and not str(k).startswith("19") for k in ids)}
    assert seen == want | {(None, "allow"): 30_000 - sum(want.values())}


def test_empty_table_and_no_rules(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
    assert [r.verdict for r in filter_urls(spark.createDataFrame([(1, "h://a")], "page_id long, url string"), []).collect()] == ["allow"]


def test_stacks(spark):
    rules = rule_table(spark.createDataFrame([*URL_RULES, ("block", "example.com", "/en")], "verdict string, host string, path string"))
    hosts = {r.hk: sorted(r.open) for r in host_stacks(rules).collect()}
    assert hosts["com.example."] == [4, 12] and hosts["com."] == [4]
    paths = {(r.hk, r.rp): sorted(map(tuple, r.open)) for r in path_stacks(rules).collect()}
    assert paths["com.example.", "/en/7"] == [(3, "block"), (5, "allow")]


def test_native_plan(spark, tiny):
    from quadrille.llm.queries import op8_url_filter

    plan = op8_url_filter(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
