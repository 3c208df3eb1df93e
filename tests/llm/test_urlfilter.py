import random
import re

import pytest
from pyspark.sql import functions as F

from marrow.llm import urlfilter
from marrow.llm.common import settled


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("https://x.net/de/8#f", "x.net", "/de/8", "net/de/", "allow"),
        ("https://example.net/de/80", "example.net", "/de/80", "example.net/de/8", "block"),
        ("https://b.org/es/", "b.org", "/es/", "org/es/", "block"),
        ("https://b.org?x=/es/", "b.org", "", None, "allow"),
        ("m.spam-farm.example.org/x", "", "", None, "allow"),
        ("x://m.spam-farm.example.org#/", "m.spam-farm.example.org", "", None, "block"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://ÀB.com/Ä\n/x", "Àb.com", "/Ä\n/x", None, "allow"),
    ],
)
def test_one_url(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "h")], "page_id int, url string, host string")
    r = urlfilter.judge(df).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


@pytest.mark.parametrize(("inside", "outside"), [(40, 3000), (800, 900), (0, 50), (50, 0), (1, 1)])
def test_cascade_is_exact_on_its_universe(spark, inside, outside):
    rng = random.Random(inside)
    keys = [(f"k{rng.random()}", i < inside) for i in range(inside + outside)]
    df = spark.createDataFrame([*keys, ("", False)], "key string, listed boolean")
    levels = urlfilter.cascade(df)
    assert df.where(urlfilter.member(levels, F.col("key")) != F.col("listed")).count() == 0
    assert len(levels) > 1 or inside < 2 or outside < 100


def test_a_long_list_is_dealt_to_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "FILTERS", 2)
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.x/") for i in range(200)] + [(999, None)], "page_id int, url string")
    listed = settled(spark.createDataFrame([(f"h{i}.x",) for i in range(0, 50, 3)] + [(None,), ("elsewhere",)], "key string"), "listed")
    one, several = (urlfilter.judge(pages, listed, max_bits=m) for m in (urlfilter.MAX_BITS, 0))
    assert "Join" not in several._jdf.queryExecution().toString()
    assert sorted(one.collect()) == sorted(several.collect())
    assert one.where("verdict = 'block'").count() == 17 * 4


def test_plan_has_no_bits(spark):
    """The plan has no list of numbers; hosts of many labels and those under listed domains are told exactly."""
    hosts = [f"{'w.' * (i % 4)}n{i}.com" for i in range(3000)]
    pages = spark.createDataFrame([(i, f"https://{h}/") for i, h in enumerate(hosts)], "page_id int, url string")
    listed = spark.createDataFrame([(f"n{i}.com",) for i in range(0, 3000, 2)] + [(f"w.n{i}.com",) for i in range(1, 3000, 6)], "key string")
    got = urlfilter.judge(pages, listed)
    assert not re.search(r"(-?[0-9]+, ?){30}", got._jdf.queryExecution().toString())
    want = {i for i, h in enumerate(hosts) if i % 2 == 0 or (i % 6 == 1 and i % 4 > 0)}
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == want


def test_repeats_clashes_and_long_urls(spark):
    long = "http://" + "a." * 20000 + "spam-farm.example.com/" + "x" * 100_000
    rows = [(1, long, "x", True), (1, long, "x", True), (2, "http://" + "b" * 300_000, "y", False)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id int, url string, host string, blocked boolean")).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "block"), (1, "block"), (2, "allow")]


def test_query(spark, check_sql):
    got = check_sql(spark, "op10_urls")
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert "Python" not in plan
    assert urlfilter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0
