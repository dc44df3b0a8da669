"""Queries on corpora by name, and the SQL that states the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontaminate,
    importance,
    katz,
    language,
    neardup,
    pii,
    quality,
    rules,
    statements,
    urls,
    warc,
    whitening,
    wordbpe,
)
from .common import keep, remainder_column, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.load_ranks(RANK_FILE))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    left_out = remainder_column(F.col("doc_id"), 3) == 1
    profiles = language.prototypes(docs, ~left_out)
    return language.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", F.coalesce(left_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query("op2_quality_rules", statements.quality_rules())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op6_url_filter", statements.url_filter(URL_RULES))
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs that the crawl fetched under two or more addresses."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = keep(urls.fetched_twice(pages), "listed")
    return urls.judge(pages, URL_RULES, listed, urls.block_count(listed.count()))


@query("op5_warc_fixity", statements.warc_fixity(warc.PER_FILE))
def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of all pages as WARC files with flipped bytes and files cut off at the end."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = pages.withColumn("file_no", warc.file_of(F.col("page_id"), F.concat("url", "html")))
    replica = pages.filter(
        ~((F.col("file_no") % 5 == 2) & (F.col("page_id") % warc.PER_FILE >= warc.PER_FILE - 100))
    )
    flipped = (F.col("page_id") % 97 == 13) & (F.octet_length("html") > 0)
    replica = replica.withColumn(
        "html", F.when(flipped, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    )
    record = warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")
    return warc.audit(*[df.select("page_id", "file_no", record) for df in (pages, replica)])


@query("op1_near_duplicates", statements.near_duplicates())
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op10_katz")
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left_out = remainder_column(F.col("doc_id"), 7) == 2
    return katz.fit_and_score(docs, left_out)


@query("op7_pii_disclosure")
def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = remainder_column(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(left_out, F.lit(False)).alias("held_out"), "text"
    )
    return quality.classify(docs, table(spark, sf_dir, "labels"), ~left_out)


@query("op8_template_decontamination")
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))


@query("op11_word_bpe")
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.round_trip(table(spark, sf_dir, "documents"), wordbpe.load(WORD_FILE))


@query("op12_importance_resampling", statements.importance_resampling())
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
