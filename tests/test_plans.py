"""Physical plans: what is read, shuffled and run in Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from pressdesk.operators import links as L
from pressdesk.operators import report as R
from pressdesk.operators.contacts import extract_contacts
from pressdesk.plans.registry import QUERIES
from pressdesk.sources import derived as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return D.read(spark, sf_dir, "pages")


def test_extraction_is_one_pass_without_shuffle(pages):
    text = plan(extract_contacts(pages.select("url", "html")))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<url:string,html:string>" in text


def test_region_definitions_stay_out_of_lambdas(pages):
    """Each stage reads columns of the one before: no stage repeats the parse or a filter of it."""
    text = plan(extract_contacts(pages.select("url", "html")))
    assert len(re.findall(r"\bmain, lambda", text)) <= 1
    assert text.count("プレスコンタクト") <= 4


def test_page_cap_is_pushed_to_the_scan(spark, tmp_path):
    schema = "keyword string, page_no int, status int, html string"
    spark.createDataFrame([("k", 0, 200, "")], schema).write.parquet(str(tmp_path / "p"))
    text = plan(L.harvest_links(spark.read.parquet(str(tmp_path / "p"))))
    assert "LessThan(page_no,5)" in text and "Exchange" not in text


def test_cap_cuts_groups_before_the_shuffle(spark, sf_dir):
    text = plan(L.collect_hits(D.search_links(spark, sf_dir)))
    limits = [m.start() for m in re.finditer("WindowGroupLimit", text)]
    assert len(limits) == 2
    assert "Exchange" in text[limits[0]: limits[1]]
    assert "SortAggregate" not in text


def test_reports_need_one_small_shuffle(spark, tmp_path):
    schema = "keyword string, kw_pos int, hit_pos int, url string, company string, person string, email string, phone string"
    spark.createDataFrame([("k", 0, 1, "u", "", "", "", "")], schema).write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    text = plan(R.field_coverage(records))
    assert text.count("Exchange") == 1 and "ReadSchema: struct<email:string,phone:string>" in text
    assert "Exchange" not in plan(R.report_batches(records))
    assert "PushedFilters: [IsNotNull(hit_pos), LessThanOrEqual(hit_pos,5)]" in plan(R.preview_per_keyword(records))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_uses_a_cross_join(spark, sf_dir, name):
    if name.startswith(("write_", "whole_run", "scan_", "extract_contacts_stream", "collect_hits", "empty_guard")):
        pytest.skip("reads back what it wrote")
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    """html_nodes link_filter element_text find_first company_from_html strip_boilerplate label_nodes
    contact_section contact_table choose_text table_pairs merge_candidates email_candidates phone_candidates
    email_pick_structural phone_pick_structural last_resort extract_contacts extract_contacts_pages coverage_flags
    hits_to_contacts field_coverage report_batches preview_per_keyword keyword_order""".split(),
)
def test_pages_are_parsed_once(spark, sf_dir, name):
    assert plan(QUERIES[name](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_link_harvest_parses_once(pages):
    search = pages.selectExpr("url AS keyword", "cast(page_id as int) AS page_no", "200 AS status", "html")
    assert plan(L.harvest_links(search)).count("ArrowEvalPython") == 1


def test_extraction_prunes_and_never_repeats_the_parse(pages):
    records = extract_contacts(pages.select("url", "html"))
    assert plan(records.filter("email <> '' AND phone <> ''")).count("ArrowEvalPython") == 1
    company = plan(records.select("url", "company"))
    assert company.count("ArrowEvalPython") == 1 and "java_method" not in company


def test_filters_on_records_reach_the_scan(spark, pages, tmp_path):
    """A URL and a day of landed pages: pushed into the scan, one parse, no exchange, the same rows."""
    landed = pages.selectExpr("url", "html", "cast(page_id % 3 as int) AS day")
    landed.write.partitionBy("day").parquet(str(tmp_path / "landed"))
    records = extract_contacts(spark.read.parquet(str(tmp_path / "landed")))
    url = pages.first().url
    one = records.filter((F.col("day") == 1) & (F.col("url") == url))
    text = plan(one)
    assert f"PushedFilters: [IsNotNull(url), EqualTo(url,{url})]" in text
    assert "PartitionFilters: [isnotnull(day" in text and "(day#" in text
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    expected = extract_contacts(landed.filter((F.col("day") == 1) & (F.col("url") == url)))
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r[c] for c in one.columns) for r in expected.collect())
    some = plan(records.filter("email <> '' AND url LIKE 'https%'"))
    assert "StringStartsWith(url,https)" in some and some.count("ArrowEvalPython") == 1
