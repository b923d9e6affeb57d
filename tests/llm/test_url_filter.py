import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter as U


@pytest.mark.parametrize("n_listed,n_all", [(0, 50), (40, 40), (300, 3000), (5, 0)])
def test_cascade_is_exact_over_its_universe(spark, n_listed, n_all):
    rng = random.Random(n_listed)
    keys = [f"host{i}.example.com" for i in range(max(n_all, n_listed))]
    listed = set(rng.sample(keys, n_listed))
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    c = U.build_cascade(frame(sorted(listed) + sorted(listed)[:3]), frame(keys[:n_all] + [None]))
    got = c.flag(frame([*keys, None]), F.col("key"), "hit").collect()
    assert {r.key for r in got if r.hit} == listed


def test_filters_of_many_arrays_are_exact_and_join_nothing(spark):
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    keys = [f"host{i}.example.com" for i in range(3000)]
    listed = set(random.Random(7).sample(keys, 400))
    c = U.build_cascade(frame(sorted(listed)), frame(keys), segment_bits=256)
    assert c.levels[0].segments > 10 and c.levels[0].words.count() == c.levels[0].segments and c.levels[0].bits <= 320
    got = c.flag(frame([*keys, None]), F.col("key"), "hit")
    assert {r.key for r in got.collect() if r.hit} == listed
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hosts_paths_and_rules(spark):
    urls = [
        ("http://A.Example.COM/en/71?q#f", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
        ("x://u://v.net/de/8", "u:", "//v.net/de/8", None, "allow"),
        ("https://example.net/de/89", "example.net", "/de/89", "example.net/de/8", "block"),
        ("https://notexample.net/de/89", "notexample.net", "/de/89", "net/de/", "allow"),
        ("https://é.org?x=/es/", "é.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    empty = spark.createDataFrame([], "key string")
    got = {r.page_id: r for r in U.judge(pages, U.build_cascade(empty, empty)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    hosts = pages.select(U.host_of(F.col("url")).alias("key"))
    assert U.judge(pages, U.build_cascade(hosts, hosts)).count() == 0


def test_long_urls_and_repeated_rows(spark):
    long = "http://Long.example.net/de/" + "8" * 200_000 + "?x"
    pages = spark.createDataFrame([(1, long), (2, "http://a.com/en/"), (2, "http://a.com/en/")], "page_id long, url string")
    hosts = pages.select(U.host_of(F.col("url")).alias("key"))
    got = [(r.page_id, r.rule, r.verdict, len(r.path)) for r in U.judge(pages, U.build_cascade(hosts.limit(0), hosts)).orderBy("page_id").collect()]
    assert got == [(1, "example.net/de/8", "block", 200_004), (2, "com/en/", "block", 4), (2, "com/en/", "block", 4)]
