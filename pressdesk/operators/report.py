"""Run reports over records ``(keyword, kw_pos, hit_pos, url, company, person, email, phone)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contacts import FIELDS
from .joins import attach_per_key

BATCH = 5
PREVIEW = 5
MAX_WIDTH = 50


def hits_to_contacts(hits: DataFrame, contacts: DataFrame) -> DataFrame:
    """One record per hit. A page is parsed once, however many keywords found it.

    A page that landed more than once gives the record that is smallest field by field. A hit
    whose page is not there keeps its row with empty fields. Adaptive execution splits the
    hits of a page that very many keywords found.
    """
    one = contacts.groupBy("url").agg(F.min(F.struct(*FIELDS)).alias("_record"))
    joined = hits.join(one.select("url", "_record.*"), "url", "left")
    return joined.select(*hits.columns, *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS])


def pages_hit(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Only the pages that a hit asks for; Spark chooses the join by the size of the URLs.

    Parsing a page costs far more than moving it. A corpus too large to be moved for each
    run is best kept as a table bucketed by ``url``, which this join then reads in place.
    """
    return pages.join(hits.select("url").distinct(), "url", "left_semi")


def union_all_keywords(runs: list[DataFrame]) -> DataFrame:
    """All runs in one table; a page found by two keywords has two rows."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def coverage_flags(records: DataFrame) -> DataFrame:
    """Which fields each record has; records with none are flagged, not dropped."""
    flags = {f"has_{f}": F.col(f) != "" for f in FIELDS}
    none = ~(flags["has_company"] | flags["has_person"] | flags["has_email"] | flags["has_phone"])
    return records.withColumns({**flags, "none_found": none})


def run_totals(keywords: DataFrame, records: DataFrame) -> DataFrame:
    """Keywords of the list, repeats counted, and records, in one row."""
    counted = keywords.select(F.lit(1).alias("k"), F.lit(0).alias("r")).unionAll(
        records.select(F.lit(0).alias("k"), F.lit(1).alias("r"))
    )
    return counted.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_keywords"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_articles"),
    )


def field_coverage(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(F.col("email") != "").alias("n_email"),
        F.count_if(F.col("phone") != "").alias("n_phone"),
    )


def keyword_counts(keywords: DataFrame, records: DataFrame) -> DataFrame:
    """Records per list entry; a repeated keyword counts all its runs and is listed again."""
    counts = records.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return keywords.join(counts, "keyword").select("kw_pos", "keyword", "n")


def keyword_group_sizes(records: DataFrame) -> DataFrame:
    """Records of the last run of each keyword, the one that a keyed output keeps."""
    runs = records.groupBy("keyword", "kw_pos").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("keyword").agg(F.max_by("n", "kw_pos").alias("n"))


def last_runs(records: DataFrame) -> DataFrame:
    """Records of the last run of each keyword."""
    last = records.groupBy("keyword").agg(F.max("kw_pos").alias("_last"))
    kept = attach_per_key(records, last, "keyword").filter(F.col("kw_pos") == F.col("_last"))
    return kept.select(*records.columns)


def column_profile(df: DataFrame, by: str | None = None) -> DataFrame:
    """Display width per column: longest value or header plus 2, at most 50."""

    def width(name: str) -> Column:
        longest = F.coalesce(F.max(F.length(F.col(name).cast("string"))), F.lit(10))
        return F.least(F.greatest(longest, F.lit(len(name))) + 2, F.lit(MAX_WIDTH)).alias(name)

    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(*[width(c) for c in df.columns if c != by])


def report_batches(records: DataFrame) -> DataFrame:
    """Batches of five records within a keyword's run."""
    return records.withColumn("batch", F.floor((F.col("hit_pos") - 1) / BATCH))


def preview_per_keyword(records: DataFrame) -> DataFrame:
    """Company, e-mail and phone of each keyword's first five records."""
    return records.filter(F.col("hit_pos") <= PREVIEW).select(
        "keyword", "kw_pos", "hit_pos", "company", "email", "phone"
    )


def keyword_order(records: DataFrame) -> DataFrame:
    """Records in keyword-list order, then hit order."""
    return records.orderBy("kw_pos", "hit_pos")
