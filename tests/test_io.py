"""Sources, sinks, the whole run and the stream."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressdesk import session
from pressdesk.operators.contacts import extract_contacts
from pressdesk.plans.run import run
from pressdesk.sources import derived as D
from pressdesk.sources import scan, sinks
from pressdesk.streaming.contacts import landed_pages, stream_contacts

SCHEMA = "keyword string, kw_pos int, hit_pos int, url string, company string, person string, email string, phone string"
ROWS = [
    ("a/b:c", 0, 1, "u1", ' 株式会社"X", ', "山田\n太郎", "", "03-1"),
    ("a/b:c", 0, 2, "u2", "", "", "", ""),
    ("語" * 40, 1, 1, "u1", "K'社\\", "", "a@b.jp", ""),
    ("語" * 35, 2, 1, "u3", "　K社　", "", "", ""),
    ("a/b:c", 3, 1, "u1", "last", "", "", ""),
]


@pytest.fixture
def records(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_csv_round_trip(spark, records, tmp_path):
    path = sinks.write_contacts_csv(records, str(tmp_path / "csv"))
    back = spark.read.schema(SCHEMA).csv(path, header=True, escape='"', multiLine=True)
    back = back.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in back.dtypes])
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    assert not open(os.path.join(path, part), "rb").read().startswith(b"\xef\xbb\xbf")


def test_by_keyword_round_trip(spark, records, tmp_path):
    path = sinks.write_contacts_by_keyword(records, str(tmp_path / "keyed"))
    back = spark.read.parquet(path).select("sheet_key", *[c for c in records.columns])
    got = sorted(map(tuple, back.collect()))
    expected = sorted((r[0][:31].replace("/", "_").replace(":", "_"), *r) for r in ROWS if r[1] != 0)
    assert got == expected
    assert sum(d.startswith("sheet_key=") for d in os.listdir(path)) == 2


def test_table_round_trip(spark, records, tmp_path):
    path = sinks.write_contacts_table(records, str(tmp_path / "table"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(ROWS)


@pytest.mark.parametrize("sink", [sinks.write_contacts_csv, sinks.write_contacts_by_keyword, sinks.write_contacts_table])
def test_nothing_is_written_without_records(spark, records, tmp_path, sink):
    assert sink(records.limit(0), str(tmp_path / "none")) is None
    assert not (tmp_path / "none").exists()


def test_scans(spark, tmp_path):
    rows = [("k", 0, 200, "<a>é"), ("k", 1, 404, "<b>語")]
    schema = "keyword string, page_no int, status int, html string"
    pages = spark.createDataFrame(rows, schema)
    pages.write.json(str(tmp_path / "json"))
    pages.withColumn("html", F.encode("html", "UTF-8")).write.parquet(str(tmp_path / "bytes"))
    assert sorted(map(tuple, scan.scan_search_pages(spark, str(tmp_path / "json"), "json").collect())) == rows
    assert sorted(map(tuple, scan.scan_search_pages(spark, str(tmp_path / "bytes")).collect())) == rows


def test_csv_scan_round_trip(spark, tmp_path):
    rows = [("k", 0, 200, 'a\nb "c", d\n'), ("k,\"x\"", 1, 404, " lead")]
    pages = spark.createDataFrame(rows, "keyword string, page_no int, status int, html string")
    pages.write.csv(str(tmp_path / "csv"), header=True, escape='"', ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False)
    assert sorted(map(tuple, scan.scan_search_pages(spark, str(tmp_path / "csv"), "csv").collect())) == sorted(rows)


def test_parquet_scan_casts_to_the_declared_types(spark, tmp_path):
    spark.sql("SELECT 'k' AS keyword, 1L AS page_no, 200L AS status, 'x' AS html").write.parquet(str(tmp_path / "p"))
    assert [t for _, t in scan.scan_search_pages(spark, str(tmp_path / "p")).dtypes] == ["string", "int", "int", "string"]


def test_raw_files_by_url(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "7.html").write_bytes(b"x")
    url = lambda path: F.concat(F.lit("https://s/rd/p/"), F.substring_index(path, "/", -1))
    assert [tuple(r) for r in scan.scan_raw_files(spark, str(tmp_path / "raw"), url).collect()] == [("https://s/rd/p/7.html", "x")]


def test_responses_join_their_requests(spark):
    keywords = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "kw_pos int, keyword string")
    manifest = scan.request_manifest(keywords)
    urls = {(r.keyword, r.page_no): r.url for r in manifest.collect()}
    responses = spark.createDataFrame(
        [(urls["a", 0], 200, bytearray("é".encode())), (urls["a", 0], 500, bytearray(b"")), (urls["b", 3], 404, None), ("other", 200, None)],
        "url string, status int, body binary")
    got = sorted(map(tuple, scan.landed_search_pages(manifest, responses).collect()))
    assert got == [("a", 0, 200, "é"), ("b", 3, 404, None)]


def test_empty_keyword_has_a_folder(spark, tmp_path):
    records = spark.createDataFrame([("", 0, 1, "u", "c", "", "", "")], SCHEMA)
    path = sinks.write_contacts_by_keyword(records, str(tmp_path / "keyed"))
    assert [(r.keyword, r.sheet_key) for r in spark.read.parquet(path).collect()] == [("", "_")]


def test_raw_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes("<article>担当：山田太郎</article>".encode())
    (tmp_path / "raw" / "b.html").write_bytes(b"<article>\xff</article>")
    got = extract_contacts(scan.scan_raw_files(spark, str(tmp_path / "raw"))).collect()
    assert {os.path.basename(r.url): r.person for r in got} == {"a.html": "山田太郎", "b.html": ""}


def test_whole_run(spark, tmp_path):
    search = spark.createDataFrame(
        [("x", 0, 200, '<a href="/rd/p/0.html">a</a><a href="/rd/p/9.html">b</a>'),
         ("x", 1, 200, '<a href="rd/p/0.html">a</a><a href="/rd/p/404.html">b</a>'),
         ("y", 0, 200, '<a href="/rd/p/0.html">a</a>'), ("z", 0, 200, "nothing")],
        "keyword string, page_no int, status int, html string")
    keywords = scan.keyword_dim(spark, keywords=["y", "x", "z"], multiple=True)
    articles = spark.range(0, 20).withColumnRenamed("id", "k").selectExpr(
        f"{D.url_sql('k')} AS url", f"{D.press_html_sql('k')} AS html")
    started = datetime(2024, 1, 2, 3, 4, 5)
    result = run(spark, search, articles, keywords, str(tmp_path / "run"), started=started)
    got = [(r.keyword, r.hit_pos, r.url.split("/")[-1], r.person) for r in result.records.orderBy("kw_pos", "hit_pos").collect()]
    assert got == [("y", 1, "0.html", "山田太郎"), ("x", 1, "0.html", "山田太郎"), ("x", 2, "9.html", "佐藤花子"), ("x", 3, "404.html", "")]
    assert tuple(result.totals.first()) == (3, 4)
    assert tuple(result.coverage.first()) == (3, 3)
    assert [tuple(r) for r in result.keyword_counts.orderBy("kw_pos").collect()] == [(0, "y", 1), (1, "x", 3)]
    assert [tuple(r) for r in result.links_per_page.orderBy("keyword", "page_no").collect()] == [
        ("x", 0, 2, 2), ("x", 1, 1, 3), ("y", 0, 1, 1)]
    assert sorted(map(tuple, result.group_sizes.collect())) == [("x", 3), ("y", 1)]
    assert result.preview.count() == 4 and result.flags.filter("none_found").count() == 1
    assert {r.batch for r in result.batches.collect()} == {0}
    assert result.label == "20240102_030405"
    assert sorted(os.listdir(tmp_path / "run")) == [
        "by_keyword_20240102_030405", "csv_20240102_030405", "hits", "links", "records"]


def test_run_without_hits_writes_no_output(spark, tmp_path):
    search = spark.createDataFrame([("x", 0, 404, "")], "keyword string, page_no int, status int, html string")
    articles = spark.createDataFrame([("u", "h")], "url string, html string")
    result = run(spark, search, articles, scan.keyword_dim(spark, keyword="x"), str(tmp_path / "run"))
    assert result.records.count() == 0
    assert sorted(os.listdir(tmp_path / "run")) == ["hits", "links", "records"]


def test_stream_equals_batch_over_two_landings(spark, tmp_path, sf_dir):
    pages = D.press_articles(spark, sf_dir).drop("k")
    landed, out, state = (str(tmp_path / d) for d in ("landed", "out", "state"))
    for half in (0, 1):
        pages.filter(F.pmod(F.xxhash64("url"), F.lit(2)) == half).write.mode("append").parquet(landed)
        stream_contacts(landed_pages(spark, landed), out, state).awaitTermination()
    streamed = spark.read.parquet(out).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, extract_contacts(pages).collect()))


def test_bad_bytes_are_replaced_as_in_python(spark):
    raw = [b"\xff", b"a\xe3\x81b", b"\xe3\x81\x82\x80", b"\xf0\x9f\x98", b"\xc0\xafx", b"\xed\xa0\x80"]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "html binary")
    got = [r[0] for r in df.select(scan.utf8(F.col("html"))).collect()]
    assert got == [r.decode("utf-8", "replace") for r in raw]


def test_scratch_path_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    path = session.scratch_path(spark, "x")
    assert not folder or path.startswith(folder.rstrip("/") + "/x-")
    assert path != session.scratch_path(spark, "x")
