"""Hits against brute force, joins and caps under skew."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pressdesk.config import DEFAULT_SITE, SiteRules
from pressdesk.operators import joins as J
from pressdesk.operators import links as L
from pressdesk.operators import report as R
from pressdesk.sources import scan

BASE = DEFAULT_SITE.base_url
PAGES = "keyword string, page_no int, status int, html string"


def brute_hits(pages, site):
    """Page by page, link by link."""
    out = {}
    for keyword in {p[0] for p in pages}:
        of = {p[1]: p for p in pages if p[0] == keyword}
        urls = []
        for page_no in range(site.max_pages):
            if len(urls) >= site.max_articles or page_no not in of or of[page_no][2] != 200:
                break
            links = [h for h in of[page_no][3] if site.link_substring in h]
            if not links:
                break
            for href in links:
                url = BASE + href if href[:1] == "/" else href if href[:4] == "http" else BASE + "/" + href
                if url not in urls:
                    urls.append(url)
        if urls:
            out[keyword] = urls[: site.max_articles]
    return out


def make_pages(seed, keywords=12, hot=None):
    rng = random.Random(seed)
    pages = []
    for k in range(keywords):
        for page_no in range(7):
            if rng.random() < 0.1:
                continue
            count = 400 if k == hot else rng.choice([0, 1, 3, 8, 30]) if rng.random() < 0.9 else 0
            hrefs = [
                rng.choice(["/rd/p/{}.html", BASE + "/rd/p/{}.html", "x/rd/p/{}.html", "/company/{}", "//cdn/rd/p/{}.html"])
                .format(rng.randrange(4000 if k == hot else 40))
                for _ in range(count)
            ]
            pages.append((f"語{k}", page_no, 500 if rng.random() < 0.08 else 200, hrefs))
    return pages


def as_html(spark, pages):
    rows = [(k, p, s, "<ul>" + "".join(f'<li><a href="{h}">t</a>' for h in hrefs)) for k, p, s, hrefs in pages]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cap", [5, 100, 5000])
def test_hits_equal_brute_force(spark, seed, cap):
    site = replace(DEFAULT_SITE, max_articles=cap)
    pages = make_pages(seed, hot=3)
    hits = L.collect_hits(L.harvest_links(as_html(spark, pages), site), site).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.keyword, r.hit_pos)):
        got.setdefault(r.keyword, []).append((r.hit_pos, r.url))
    expected = {k: list(enumerate(urls, 1)) for k, urls in brute_hits(pages, site).items()}
    assert got == expected


def test_stop_rule(spark):
    rows = [
        ("a", 0, 200, "/rd/p/1"), ("a", 1, 500, "/rd/p/2"), ("a", 2, 200, "/rd/p/3"),
        ("b", 0, 200, "/rd/p/1"), ("b", 2, 200, "/rd/p/3"),
        ("c", 1, 200, "/rd/p/1"),
        ("d", 0, 200, "/rd/p/1"), ("d", 1, 200, "/rd/p/1"), ("d", 6, 200, "/rd/p/9"),
    ]
    links = spark.createDataFrame([(k, p, s, 0, h) for k, p, s, h in rows],
                                  "keyword string, page_no int, status int, pos int, href string")
    assert {r.keyword: r.stop_page for r in L.stop_pages(links).collect()} == {"a": 1, "b": 1, "c": 0, "d": 2}
    kept = {(r.keyword, r.page_no) for r in L.stop_prefix(links).collect()}
    assert kept == {("a", 0), ("b", 0), ("d", 0), ("d", 1)}


def test_dedupe_and_limit_are_idempotent(spark):
    pages = make_pages(7)
    links = L.harvest_links(as_html(spark, pages)).withColumn("url", L.resolve_href(F.col("href")))
    once = L.first_seen(links)
    assert sorted(once.collect()) == sorted(L.first_seen(once).collect())
    limited = L.first_per_keyword(once, 5, ["page_no", "pos"], "n")
    again = L.first_per_keyword(limited.drop("n"), 5, ["page_no", "pos"], "n")
    assert sorted(limited.collect()) == sorted(again.collect())


def test_resolve_href(spark):
    hrefs = ["/a", "a", "http://x/a", "https://x/a", "//x/a", "httpx", ""]
    df = spark.createDataFrame([(h,) for h in hrefs], "href string")
    urls = [r[0] for r in df.select(L.resolve_href(F.col("href"))).collect()]
    assert urls == [f"{BASE}/a", f"{BASE}/a", "http://x/a", "https://x/a", f"{BASE}//x/a", "httpx", f"{BASE}/"]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_hits_keep_every_row_of_a_hot_page(spark, broadcast):
    rows = [(f"k{i}", i, "hot" if i % 3 == 0 else f"u{i % 50}") for i in range(600)]
    hits = spark.createDataFrame(rows, "keyword string, hit_pos int, url string")
    made = [("hot", "H", "", "", "")] + [(f"u{i}", f"v{i}", "", "", "") for i in range(40)]
    contacts = spark.createDataFrame(made, "url string, company string, person string, email string, phone string")
    known = {r[0]: r[1] for r in made}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        got = R.hits_to_contacts(hits, contacts).select("keyword", "hit_pos", "url", "company").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, got)) == sorted((*r, known.get(r[2], "")) for r in rows)


def test_attach_per_key_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "keyword string, v int")
    side = rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    got = J.attach_per_key(rows, side, "keyword")
    assert got.count() == 900
    assert got.filter("keyword = 'hot' AND n = 600").count() == 600


def test_repeated_keyword_runs_twice(spark):
    keywords = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "none")], "kw_pos int, keyword string")
    hits = spark.createDataFrame([("a", 1, "u1"), ("a", 2, "u2"), ("b", 1, "u1")], "keyword string, hit_pos int, url string")
    contacts = spark.createDataFrame([("u1", "C", "", "a@b.jp", "")], "url string, company string, person string, email string, phone string")
    records = R.hits_to_contacts(L.hits_in_order(hits, keywords), contacts)
    assert [tuple(r)[:4] for r in R.keyword_order(records).collect()] == [
        ("a", 0, 1, "u1"), ("a", 0, 2, "u2"), ("b", 1, 1, "u1"), ("a", 2, 1, "u1"), ("a", 2, 2, "u2")]
    assert tuple(R.run_totals(keywords, records).first()) == (4, 5)
    assert tuple(R.field_coverage(records).first()) == (3, 0)
    counts = R.keyword_counts(keywords, records).orderBy("kw_pos").collect()
    assert [tuple(r) for r in counts] == [(0, "a", 4), (1, "b", 1), (2, "a", 4)]
    assert {tuple(r) for r in R.keyword_group_sizes(records).collect()} == {("a", 2), ("b", 1)}
    assert {r.kw_pos for r in R.last_runs(records).collect()} == {1, 2}
    assert records.filter("email IS NULL OR company IS NULL").count() == 0


def test_reports_on_no_records(spark):
    empty = spark.createDataFrame([], "keyword string, kw_pos int, email string, phone string")
    keywords = spark.createDataFrame([(0, "a")], "kw_pos int, keyword string")
    assert tuple(R.run_totals(keywords, empty).first()) == (1, 0)
    assert tuple(R.field_coverage(empty).first()) == (0, 0)
    assert R.keyword_counts(keywords, empty).collect() == []
    assert tuple(R.column_profile(empty).first()) == (12, 12, 12, 12)


def test_column_profile(spark):
    df = spark.createDataFrame([("ab", 1, "語" * 100), ("c", 12345, "")], "name_long string, n int, t string")
    assert tuple(R.column_profile(df).first()) == (11, 7, 50)
    by = R.column_profile(df, by="t").collect()
    assert {(r.t, r.n) for r in by} == {("語" * 100, 3), ("", 7)}


def test_batches_and_preview(spark):
    records = spark.createDataFrame([("k", 0, i, "c", "e", "p") for i in range(1, 13)],
                                    "keyword string, kw_pos int, hit_pos int, company string, email string, phone string")
    assert [r.batch for r in R.report_batches(records).orderBy("hit_pos").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    assert R.preview_per_keyword(records).count() == 5


def test_keyword_lists(spark):
    def rows(**kw):
        return [tuple(r) for r in scan.keyword_dim(spark, **kw).orderBy("kw_pos").collect()]

    assert rows(keywords=["b", "a", "b"], multiple=True) == [(0, "b"), (1, "a"), (2, "b")]
    assert rows(keywords=["b"], keyword="x") == [(0, "x")]
    assert rows(keywords=["b"], default="d") == [(0, "d")]
    assert rows(multiple=True) == [(0, "サプリ")]


def test_request_manifest(spark):
    keywords = scan.keyword_dim(spark, keyword="薄毛 a/b")
    urls = [r.url for r in scan.request_manifest(keywords).orderBy("page_no").collect()]
    first = f"{BASE}/search?search_word=%E8%96%84%E6%AF%9B%20a/b"
    assert urls == [first] + [f"{first}&search_page={i}" for i in range(1, 5)]


def test_request_manifest_encodes_a_keyword_once(spark):
    """The encoding stands below the step that makes five rows of one, and the columns are as they were."""
    keywords = spark.range(3).selectExpr("cast(id as int) AS kw_pos", "cast(id as string) || ' /' AS keyword")
    made = scan.request_manifest(keywords)
    assert made.columns == ["kw_pos", "keyword", "page_no", "url"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "UrlCodec" in plan and plan.index("UrlCodec") > plan.index("Generate explode")


def test_keyword_search_keeps_list_entries(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, "x")], "id int, text string")
    got = scan.keyword_search(docs, ["bc", "a", "bc"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "bc"), (1, 1, "a"), (1, 2, "bc"), (2, 0, "bc"), (2, 2, "bc")]


def test_site_rules_are_parameters(spark):
    site = SiteRules(base_url="https://s.example", link_substring="/n/", max_pages=1, max_articles=1)
    pages = as_html(spark, [("k", 0, 200, ["/n/1", "/n/2"]), ("k", 1, 200, ["/n/3"])])
    hits = L.collect_hits(L.harvest_links(pages, site), site).collect()
    assert [tuple(h) for h in hits] == [("k", 1, "https://s.example/n/1")]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_pages_hit_whatever_the_join(spark, threshold):
    pages = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", "c")], "url string, html string")
    hits = spark.createDataFrame([("k", "u1"), ("j", "u1"), ("k", "u9")], "keyword string, url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert [r.url for r in R.pages_hit(pages, hits).collect()] == ["u1"]
        assert R.pages_hit(pages, hits.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_page_that_landed_twice_gives_one_record_per_hit(spark):
    hits = spark.createDataFrame([("k", 0, 1, "u1"), ("j", 1, 1, "u1"), ("k", 0, 2, "u2")], "keyword string, kw_pos int, hit_pos int, url string")
    contacts = spark.createDataFrame([("u1", "b", "", "", ""), ("u1", "a", "p", "", "")], "url string, company string, person string, email string, phone string")
    joined = R.hits_to_contacts(hits, contacts)
    assert sorted((r.keyword, r.url, r.company, r.person) for r in joined.collect()) == [
        ("j", "u1", "a", "p"), ("k", "u1", "a", "p"), ("k", "u2", "", "")]
    assert "Generate" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 7, 10, 25, 1500])
def test_cap_against_sorting(spark, n):
    rows = [(k, f"u{i}", i % 4, (i * 37) % 1009) for k, m in (("hot", 2000), ("few", 3)) for i in range(m)]
    links = spark.createDataFrame(rows, "keyword string, url string, page_no int, pos bigint")
    once = L.first_seen(links)
    got = sorted((r.keyword, r.n, r.page_no, r.pos) for r in L.first_per_keyword(once, n, ["page_no", "pos"], "n").collect())
    expected = []
    for k in ("few", "hot"):
        places = sorted((r.page_no, r.pos) for r in once.filter(f"keyword = '{k}'").collect())
        expected += [(k, i + 1, *p) for i, p in enumerate(places[:n])]
    assert got == expected


def test_hot_keyword_in_a_long_list(spark):
    keywords = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(300)], "kw_pos int, keyword string")
    hits = spark.createDataFrame([("hot", p, f"u{p}") for p in (1, 2)] + [("k1", 1, "u1")], "keyword string, hit_pos int, url string")
    runs = L.hits_in_order(hits, keywords)
    assert runs.count() == 201
    assert runs.filter("keyword = 'hot'").groupBy("kw_pos").count().filter("count != 2").count() == 0
    counts = R.keyword_counts(keywords, runs).collect()
    assert len(counts) == 101 and {r.n for r in counts if r.keyword == "hot"} == {200}
    assert [tuple(r)[:3] for r in R.last_runs(runs).orderBy("keyword", "hit_pos").collect()] == [
        ("hot", 297, 1), ("hot", 297, 2), ("k1", 1, 1)]


def test_first_seen_orders_by_page_then_position_and_fails_loudly(spark):
    schema = "keyword string, url string, page_no int, pos bigint"
    rows = [("k", "u", 1, 0), ("k", "u", 0, 2**48 - 1), ("k", "v", 4, 7), ("k", "v", 4, 6)]
    links = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, L.first_seen(links).collect())) == [("k", "u", 0, 2**48 - 1), ("k", "v", 4, 6)]
    assert L.first_seen(links).dtypes == [("keyword", "string"), ("url", "string"), ("page_no", "int"), ("pos", "bigint")]
    with pytest.raises(Exception, match="out of range"):
        L.first_seen(spark.createDataFrame([("k", "u", 0, 2**48)], schema)).collect()
