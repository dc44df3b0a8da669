from urllib.parse import urlsplit

from pyspark.sql import functions as F

from pressdesk.llm import urls as U

PAGES = "page_id bigint, url string, host string, rule string, block int, lane_0 string"
LIST = [
    ("http://www.Example.com/a/?utm_source=x&p=1#top", "example.com/a?p=1"), ("https://m.example.com/a", "example.com/a"),
    ("https://example.com", "example.com"), ("no address", None), (None, None), ("", None), ("x://", None),
    ("http://h/?ref=1", "h"), ("http://h?q=1&utm_id=3", "h?q=1"), ("http://a/b//", "a/b"),
]


def frame(spark, found):
    return spark.createDataFrame([(i, u, "x", "x", 1, "x") for i, u in enumerate(found)], PAGES)


def test_canonical(spark):
    got = frame(spark, [u for u, _ in LIST]).select("page_id", U.canonical(F.col("url")).alias("c")).collect()
    assert {r.page_id: r.c for r in got} == {i: c for i, (_, c) in enumerate(LIST)}


def test_rules_and_list(spark):
    rules = [("allow", "org", "/"), ("block", "a.org", "/x/"), ("block", "com", "/de/")]
    found = ["http://q.a.org/x/1", "http://a.org/y", "http://ba.org/x/1", "http://b.com/de/", "http://b.com/fr",
             "http://listed.net/p/", "https://www.listed.net/p#z", "http://listed.net/p2", None, "http://A.ORG"]
    listed = spark.createDataFrame([("listed.net/p",)], "canonical string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(frame(spark, found), rules, listed, 1).collect()}
    assert got == {
        0: ("a.org/x/", "block"), 1: ("org/", "allow"), 2: ("org/", "allow"), 3: ("com/de/", "block"),
        4: (None, "allow"), 5: (None, "block"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"),
        9: (None, "allow"),
    }


def test_filter_passes_all_members_and_few_others(spark):
    listed = spark.range(4000).select((F.col("id") * 2).cast("string").alias("k"))
    asked = spark.range(8000).select(F.col("id").cast("string").alias("k"))
    blocks = U.block_count(4000)
    table = U.bloom_filter(listed, "k", blocks)
    assert table.count() <= blocks
    maybe = {r.k for r in U.probe(asked, "k", table, blocks).filter("_maybe").collect()}
    members = {r.k for r in listed.collect()}
    assert members <= maybe | {str(i) for i in range(8000, 8001)} | {k for k in members if int(k) >= 8000}
    assert len(maybe - members) < 0.02 * 4000


def test_a_full_filter_stays_exact(spark):
    listed = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    asked = spark.range(9000).select(F.col("id").cast("string").alias("k"))
    got = U.listed_hits(asked, "k", listed, "key", 1).filter("listed")
    assert got.count() == 3000
    assert U.listed_hits(asked, "k", listed.limit(0), "key", 1).filter("listed").count() == 0


def test_empty(spark):
    none = frame(spark, []).limit(0)
    assert U.judge(none, [], U.fetched_twice(none), 1).count() == 0


def test_host_against_urlsplit(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", U.host(F.col("url")).alias("h"))
    assert all(r.h == urlsplit(r.url).netloc.lower() for r in pages.collect())
