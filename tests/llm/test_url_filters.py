import random
import re

import pytest

from verbaflow.llm import url_filters as u

URLS = ["http://example.com/en/1", "https://www.EXAMPLE.com/en/x?q", "http://a.b.example.com/en/", "http://example.com/de/", "http://example.com", "http://xexample.com/en/", "ftp://net/es/x", "http://a.net/fr/#y", "http://a.net/fr", "http://a.org/", "nothing", "", None, "://com/", "http://com?x=/en/", "http:///en/", "http://example.com:80/en/", "a://b://c/d", "http://com/\nx", "http://www.example.com/en/" + "y" * 5000]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, u.DEFAULT))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, ranges=None):
    pages = spark.createDataFrame([(i, x, "q", "q") for i, x in enumerate(urls)], "page_id long, url string, host string, key string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    return {r.page_id: tuple(r)[1:] for r in u.filtered(pages, table, ranges=ranges).collect()}


@pytest.mark.parametrize("ranges", [1, 7])
def test_against_plain_rules(spark, ranges):
    rnd = random.Random(ranges)
    labels = ["a", "b", "com", "example", "net", "www", "x-y"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    urls = URLS + ["http://" + rnd.choice(hosts) + rnd.choice(["", "/", "/en/", "/en/x/y", "/es/?q"]) for _ in range(300)] + ["http://a.com/en/hot"] * 200
    rules = u.RULES + [(rnd.choice(["allow", "block"]), rnd.choice(hosts), rnd.choice(["/", "/en/", "/en/x/", ""])) for _ in range(80)] + [("block", "", "/"), (None, "com", "/"), u.RULES[0]]
    kept = [r for r in rules if r[0] and r[1]]
    assert judged(spark, urls, rules, ranges) == {i: plain(x, kept) for i, x in enumerate(urls)}


def test_empty(spark):
    assert judged(spark, [], u.RULES) == {}
    assert judged(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}


def test_null_ids_and_repeated_rows(spark):
    pages = spark.createDataFrame([(None, "http://example.com/en/a"), (None, "http://example.com/en/a"), (1, None), (1, None), (1, "http://a.net/es/")], "page_id long, url string")
    out = sorted((r.page_id or 0, r.host, r.rule or "", r.verdict) for r in u.filtered(pages, spark.createDataFrame(u.RULES, "verdict string, host string, path string")).collect())
    assert out == [(0, "example.com", "example.com/en/", "block")] * 2 + [(1, "", "", "allow")] * 2 + [(1, "a.net", "net/es/", "block")]
