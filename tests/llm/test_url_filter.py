import random

from cohortry.llm import url_filter as U

URLS = [
    "http://shop.example.org/es/a?x=1", "HTTP://Example.ORG/es/", "http://example.org/en/12#t", "http://example.org/en/2", "http://myexample.org/es/", "http://a.b.com/fr/x",
    "http://a.b.com/de/x", "https://com/de/", "http://example.net/", "http://example.org", "http://example.org?q=/es/", None, "", "no scheme/es/", "://example.org/es/", "http://org/",
    "http://ÉXAMPLE.org/es/", "http://u@example.org:80/es/", "http://x.org/" + "y" * 100_000, "http://a.com/fr/\n/x", "http:///es/",
]


def by_hand(url, rules=U.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [
        (len(k), k, v) for v, k in rules if path.startswith("/" + k.partition("/")[2]) and (host == k.partition("/")[0] or host.endswith("." + k.partition("/")[0]))
    ]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, U.UNLISTED)


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(None, "http://a.org/", "h", 1)] * 2, "page_id long, url string, host string, keys int")


def test_urls_by_hand(spark):
    rows = U.judge_urls(frame(spark, URLS)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = "http://a.org/" if r["page_id"] is None else URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(url), url


def test_long_lists_are_exact(spark):
    rng = random.Random(4)
    names = [f"{rng.choice('abc')}{rng.randrange(60)}.{rng.choice(['com', 'org', 'net'])}" for _ in range(120)]
    rules = [(rng.choice(["allow", "block"]), f"{rng.choice(names)}/{rng.choice(['', 'x/', 'y/z', 'xy'])}") for _ in range(300)]
    blocked = {k for v, k in rules if v == "block"}
    rules = sorted({("block" if k in blocked else v, k) for v, k in rules})
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(names)}/{rng.choice(['', 'x/1', 'y/z', 'xyz', 'q'])}" for _ in range(600)]
    for r in U.judge_urls(frame(spark, urls), rules).collect():
        url = "http://a.org/" if r["page_id"] is None else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(url, rules), url


def test_cascade_over_its_universe(spark):
    keys = [f"k{i}" for i in range(5000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = universe.filter("cast(substring(key, 2) as int) % 7 = 0")
    levels = U.build_cascade(universe, listed)
    assert 2 <= len(levels) < 40 and sum(x.bits for x in levels) < 20 * 5000 / 7
    arrays = universe.selectExpr("key", "array(key) as keys")
    got = {r["key"] for r in U.with_membership(arrays, "keys", levels, "in").filter("size(`in`) = 1").collect()}
    assert got == {k for k in keys if int(k[1:]) % 7 == 0}


def test_empty_table_and_no_rules(spark):
    assert U.judge_urls(frame(spark, []).filter("false")).count() == 0
    assert {r["verdict"] for r in U.judge_urls(frame(spark, URLS), []).collect()} == {U.UNLISTED}
