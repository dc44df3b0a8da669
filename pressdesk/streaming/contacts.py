"""Contact extraction over pages as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_SITE, SiteRules
from ..operators.contacts import extract_contacts
from ..sources.scan import ARTICLE_PAGES


def landed_pages(
    spark: SparkSession, path: str, schema: str = ARTICLE_PAGES, files_per_batch: int = 10_000
) -> DataFrame:
    """New files under ``path``. A backlog is read in batches, each committed on its own."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_contacts(
    pages: DataFrame, out_path: str, state_path: str, site: SiteRules = DEFAULT_SITE
) -> StreamingQuery:
    """Extract from all pages landed so far, append the records, then stop.

    The rules look at one page at a time, so there is no state to keep but the file log: the
    next call goes on where this one ended, and a lost executor costs a retry.
    """
    return (
        extract_contacts(pages, site)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )
