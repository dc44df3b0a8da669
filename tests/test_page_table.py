"""Pages laid out by URL, and keyword lists of any length."""

import glob
import os
import random
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pressdesk.operators import report as R
from pressdesk.operators.contacts import extract_contacts
from pressdesk.operators.keywords import keyword_search
from pressdesk.sources import derived as D
from pressdesk.sources import page_table as T

BUCKETS = 16


@pytest.fixture(scope="module")
def landed(spark, sf_dir):
    return D.press_articles(spark, sf_dir).drop("k")


@pytest.fixture(scope="module")
def table(spark, landed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "by_url")
    return path, T.write_page_table(landed, path, "pages_" + uuid.uuid4().hex, BUCKETS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_holds_the_pages(landed, table):
    assert sorted(map(tuple, table[1].collect())) == sorted(map(tuple, landed.collect()))


def test_hits_meet_their_pages_in_place(spark, landed, table):
    """Neither a broadcast nor an exchange of the pages: only the hits are shuffled."""
    hits = landed.filter("url like '%3.html'").select("url").limit(10).union(spark.createDataFrame([("none",)], "url string"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.pages_hit(table[1], hits)
        text = plan(found)
        assert "Bucketed: true" in text
        pages_side = text[text.index("LeftSemi") : text.index("Bucketed: true")]
        assert "html" in pages_side and "Exchange" not in pages_side
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.pages_hit(landed, hits).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_url_reads_one_bucket(spark, landed, table):
    url = landed.first().url
    records = extract_contacts(table[1]).filter(F.col("url") == url)
    assert f"EqualTo(url,{url})" in plan(records)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task per file
    try:
        assert table[1].rdd.getNumPartitions() > 1
        assert table[1].filter(F.col("url") == url).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(map(tuple, records.collect())) == sorted(map(tuple, extract_contacts(landed).filter(F.col("url") == url).collect()))


def test_files_are_sorted_and_carry_bloom_filters(spark, tmp_path):
    """Many URLs: too many for a dictionary, which would do the filter's work in a small file."""
    pages = spark.range(60_000).selectExpr("concat('https://newswire.example/', sha2(cast(id as string), 256)) AS url", "'x' AS html")
    T.write_page_table(pages, str(tmp_path / "p"), "pages_" + uuid.uuid4().hex, 2)
    files = glob.glob(str(tmp_path / "p" / "*.parquet"))
    assert len(files) == 2
    for file in files:
        urls = pq.read_table(file, columns=["url"])["url"].to_pylist()
        assert urls == sorted(urls)
        groups = pq.ParquetFile(file).metadata
        assert groups.num_row_groups >= 2 and groups.row_group(0).column(0).path_in_schema == "url"
        held = os.path.getsize(file) - sum(groups.row_group(g).column(c).total_compressed_size
                                           for g in range(groups.num_row_groups) for c in range(2))
        assert held > T.GROUP_ROWS  # a Bloom filter has a byte and more per URL


def test_another_session_opens_the_table(spark, landed, table):
    name = "again_" + uuid.uuid4().hex
    again = T.open_page_table(spark, table[0], name, BUCKETS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, landed.collect()))
    assert spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first().data_type == str(BUCKETS)


# --- keyword lists ----------------------------------------------------------------------


def contained(texts, keywords):
    return sorted((i, p, k) for i, t in texts if t is not None for p, k in enumerate(keywords) if k in t)


@pytest.mark.parametrize("keywords", [
    ["a", "ab", "b", "a", "", "株式", "é"], [], [""], ["abc" * 20, "bc", "cab"], ["\x00", "😀", " "],
])
def test_keyword_search(spark, keywords):
    r = random.Random(2)
    texts = [(i, "".join(r.choices(["a", "b", "c", "株式", "e", "é", "😀", " ", "\x00"], k=r.randint(0, 12)))) for i in range(80)]
    texts += [(80, None), (81, ""), (82, "abc" * 2000)]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = keyword_search(docs, keywords)
    assert got.columns == ["id", "kw_pos", "keyword"]
    assert sorted(map(tuple, got.collect())) == contained(texts, keywords)


def test_many_keywords(spark):
    """Fifty thousand keywords: each text is walked once, whatever their number."""
    r = random.Random(3)
    keywords = ["".join(r.choices("abcdefgh", k=6)) for _ in range(50_000)]
    texts = [(i, "".join(r.choices("abcdefgh", k=400))) for i in range(200)]
    got = keyword_search(spark.createDataFrame(texts, "id int, text string"), keywords)
    windows = {}
    for p, k in enumerate(keywords):
        windows.setdefault(k, []).append(p)
    expected = sorted({(i, p, t[a : a + 6]) for i, t in texts for a in range(395) for p in windows.get(t[a : a + 6], ())})
    assert sorted(map(tuple, got.collect())) == expected
    assert "Exchange" not in plan(got)
