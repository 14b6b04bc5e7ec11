import random

from fleetsig.llm import urls
from fleetsig.llm.catalogue import URL_RULES

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i, c in enumerate(tail) if c in "?#"] + [len(tail)])]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def check(spark, rows, rules):
    pages = spark.createDataFrame([(k, u, 1, "x") for k, u in rows], "page_id long, url string, salt int, range string")
    found = urls.judge_urls(pages, spark.createDataFrame(rules, RULES))
    want = [(k, *plain(u, rules)) for k, u in rows]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_the_fixed_rules(spark):
    rows = [
        (1, "http://Example.COM/en/x?y=/fr/#z"), (2, "https://www.example.com/en/"), (3, "http://a.www.example.com/en/q"),
        (4, "http://badexample.com/en/1"), (5, "http://x.net/es/1"), (6, "http://net/fr/"), (7, "http://x.net/esp"), (8, None),
        (9, "no scheme/en/"), (10, ""), (11, "http://"), (12, "http://com"), (13, "http://com/"), (14, "ftp://x.org/a://b/"),
        (15, "http://example.com?/en/"), (16, "http://ÉX.com/en/"), (None, "http://a.b.com/é"), (1, "http://Example.COM/en/x"),
        (17, "http://x.com/" + "p" * 100000), (18, "http://a..com//"), (19, "http://.com/"), (20, "x\ny://h.net/es/\nq"),
    ]
    check(spark, rows, URL_RULES)
    check(spark, rows[:3], [])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty, spark.createDataFrame(URL_RULES, RULES)).collect() == []


def test_nested_rules_and_a_hot_host(spark):
    rng = random.Random(3)
    labels = ["com", "net", "a", "b", "www"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += rules[:9] + [("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("a.com", None, "block")]
    hosts = ["www.a.com"] * 200 + [host() for _ in range(300)]
    rows = [(i, f"http://{h}/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 4)))) for i, h in enumerate(hosts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        check(spark, rows, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
