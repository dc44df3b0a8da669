"""Rows dealt out by their number, whatever the splits of the files."""

import pytest
from pyspark.sql import functions as F

from pressdesk import session
from pressdesk.plans import contact_queries, text_queries  # noqa: F401
from pressdesk.plans.registry import QUERIES
from pressdesk.sources import derived as D


def _sizes(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_one_split_with_all_rows_among_many_is_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    lopsided = spark.range(1000).repartition(4 * cores, F.lit(1))
    dealt = session.spread(lopsided)
    assert max(_sizes(dealt)) <= 2 * 1000 / (2 * cores) + 2 * cores
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    rows = 50 * 10 * cores
    assert len(_sizes(session.spread(spark.range(rows).coalesce(1)))) == 10 * cores
    even = spark.range(0, rows, 1, 10 * cores)
    assert session.spread(even) is even
    assert session.spread(spark.range(0)).count() == 0


def test_derived_pages_are_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1, 4001).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 4001).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name")).coalesce(1).write.parquet(
        str(tmp_path / "part.parquet"))
    for made in (D.press_articles, D.table_articles, D.contact_texts, D.keyword_list):
        assert len(_sizes(made(spark, str(tmp_path)))) == 2 * cores


@pytest.mark.parametrize("name", [
    "table_pairs", "strip_boilerplate_table", "strip_boilerplate", "email_candidates", "merge_candidates",
    "company_from_html", "request_manifest",
])
def test_rows_are_dealt_out_before_the_work(spark, sf_dir, name):
    """The plan has twice as many tasks as cores before anything is made of a file of one row group."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = f"RoundRobinPartitioning({2 * spark.sparkContext.defaultParallelism})"
    assert dealt in plan
    assert "ArrowEvalPython" not in plan[plan.index(dealt):]


@pytest.mark.parametrize("name, table", [
    ("table_pairs", "customer"), ("strip_boilerplate_table", "customer"), ("strip_boilerplate", "customer"),
    ("email_candidates", "customer"), ("merge_candidates", "customer"), ("company_from_html", "customer"),
    ("request_manifest", "part"),
])
def test_a_larger_table_has_more_tasks(spark, sf_dir, monkeypatch, name, table):
    """What a task of the query works on stays the same when the table grows beyond the cores."""
    rows, wanted = D.read(spark, sf_dir, table).count(), 5 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "ROWS_PER_TASK", rows // wanted)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({-(-rows // (rows // wanted))})" in plan
