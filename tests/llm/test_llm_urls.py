import re

import pytest
from pyspark.sql import functions as F

from hydromelt.llm import urls

PAGES = "page_id long, url string, html string, key string, block string, host string, path string, rule string"
URLS = ["http://Blog.Example.COM/en/1?x=://", "https://www.example.com/en/", "http://a.net/es/x", "http://net/fr/", "http://xnet/fr/", "ftp://a.org",
        "http://a.org/x.html", "https://www.a.org/x/", "http://a.org/X", None, "", "nothing here", "http://", "http:///p", "http://example.com", "http://a.org?q",
        "http://É.com/p\nq#f", "http://m.spam-farm.example.org/en/7?utm_source=feed", "http://spam-farm.example.org/en/7.html",
        "http://x.net/" + "long/" * 5000, "http://a.org/x.html"]


def brute(url, listed):
    rest = url.partition("://")[2] if url and "://" in url else ""
    bare = re.match(r"[^?#]*", rest)[0]
    host, slash, path = bare.partition("/")
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    key = re.sub(r"\A(www|m)\.", "", host) + re.sub(r"(/|\.html)\Z", "", path) if host else None
    return host, path, rule and rule.name, key in listed, rule.action if rule else "block" if key in listed else "allow"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, *"xxxxxx") for i, u in rows], PAGES).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_verdicts(spark, monkeypatch, small):
    if small:  # one bit a word for all: every URL is a possible hit, and the join decides
        monkeypatch.setattr(urls, "KEYS_PER_BLOCK", 10**6)
        monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
    rows = [*enumerate(URLS), (None, URLS[6]), (6, URLS[6])]
    listed = ["a.org/x", "a.org/x", "spam-farm.example.org/en/7", None, "never/seen", *(f"h{i}.org/p" for i in range(300))]
    got = urls.judge(pages(spark, rows), spark.createDataFrame([(k,) for k in listed], "key string")).collect()
    want = sorted((str(i), *map(str, brute(u, set(listed) - {None}))) for i, u in rows)
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"))
    blocks = -(-5000 // urls.KEYS_PER_BLOCK)
    bloom = urls.build_filter(listed, blocks)
    assert bloom.count() <= blocks
    assert urls.possible(listed, bloom, blocks).count() == 5000
    others = spark.range(50_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert urls.possible(others, bloom, blocks).count() < 0.02 * 50_000
    assert urls.listed_keys(others.unionByName(listed), listed).count() == 5000


def test_empty_sides(spark):
    some, none = pages(spark, enumerate(URLS)), pages(spark, [])
    assert {r["verdict"] for r in urls.judge(some, urls.listed_from(none)).where("rule IS NULL").collect()} == {"allow"}
    assert urls.judge(none, urls.listed_from(some)).count() == 0
