"""Article pages as a table laid out by URL, so that runs find their pages without moving the rest.

Pages are written in buckets by ``url``, sorted within them, with a Bloom filter on ``url`` in every
Parquet row group. A join of hits with such a table moves the hits only; a filter on one URL reads
one bucket, and of it the row groups that may hold the URL.

Use as many buckets as shuffle partitions or more, and so many that a bucket's pages fit a task.
A URL that landed very often fills its bucket; its rows can't be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scan import ARTICLE_PAGES

# Rows of a row group; the Bloom filter of a row group is sized for as many URLs.
GROUP_ROWS = 20_000


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def write_page_table(pages: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """``pages`` under ``path`` as the new table ``name``, one file per bucket.

    One shuffle by URL, once per landing; no run has to repeat it.
    """
    writer = (
        pages.repartition(buckets, "url")
        .write.format("parquet")
        .bucketBy(buckets, "url")
        .sortBy("url")
        .option("path", path)
        .option("parquet.bloom.filter.enabled#url", "true")
        .option("parquet.bloom.filter.expected.ndv#url", str(GROUP_ROWS))
        .option("parquet.block.row.count.limit", str(GROUP_ROWS))
    )
    writer.saveAsTable(_quoted(name))
    return pages.sparkSession.table(_quoted(name))


def open_page_table(
    spark: SparkSession, path: str, name: str, buckets: int, schema: str = ARTICLE_PAGES
) -> DataFrame:
    """A page table that another session wrote: the same layout under the name given."""
    path = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({schema}) USING parquet "
        f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_quoted(name))
