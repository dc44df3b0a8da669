"""Landed pages and keyword lists as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, SiteRules
from ..functions import patterns as P
from ..functions.text import percent_encode
from ..operators.keywords import keyword_search  # noqa: F401 - part of the sources' interface

SEARCH_PAGES = "keyword string, page_no int, status int, html string"
ARTICLE_PAGES = "url string, html string"
RESPONSES = "url string, status int, body binary"
KEYWORDS = "kw_pos int, keyword string"


def utf8(html: Column) -> Column:
    """Bytes as UTF-8 whatever the page declares, bad bytes replaced."""
    return F.make_valid_utf8(html.cast("string"))


def _scan(spark: SparkSession, path: str, schema: str, fmt: str, **options) -> DataFrame:
    """A landed table in the declared columns and types. CSV has a header and quoted line breaks."""
    fields = [part.split() for part in schema.split(", ")]
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    if fmt in ("json", "csv"):
        landed = reader.schema(schema).load(path)
    else:
        landed = reader.load(path)
    types = dict(landed.dtypes)
    return landed.select(*[
        (utf8(F.col(c)) if c == "html" and types[c] == "binary" else F.col(c).cast(t)).alias(c) for c, t in fields
    ])


def scan_search_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Search-result pages by keyword and page number, with the status they came with."""
    return _scan(spark, path, SEARCH_PAGES, fmt)


def scan_article_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Article pages by URL. There is no status: an error page is read like any other."""
    return _scan(spark, path, ARTICLE_PAGES, fmt)


def scan_raw_files(spark: SparkSession, path: str, url: Callable[[Column], Column] | None = None) -> DataFrame:
    """Article pages kept as one HTML file each. ``url`` makes a page's URL from the file's path.

    Without it the path stands for the URL, and no hit asks for such a page.
    """
    files = spark.read.format("binaryFile").load(path)
    name = url(F.col("path")) if url else F.col("path")
    return files.select(name.alias("url"), utf8(F.col("content")).alias("html"))


def scan_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What a fetcher landed for a manifest: ``url, status, body``, the body as bytes."""
    return _scan(spark, path, RESPONSES, fmt)


def landed_search_pages(manifest: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses back onto their requests: ``keyword, page_no, status, html``.

    A keyword that the list holds twice has its pages once; an address that landed more than
    once gives the response with the smallest status, then body.
    """
    asked = manifest.select("keyword", "page_no", "url").distinct()
    one = responses.groupBy("url").agg(F.min(F.struct("status", "body")).alias("_response"))
    return asked.join(one, "url").select(
        "keyword", "page_no", F.col("_response.status").alias("status"),
        utf8(F.col("_response.body")).alias("html"),
    )


def keyword_dim(
    spark: SparkSession,
    keywords: list[str] | DataFrame | None = None,
    keyword: str | None = None,
    default: str = P.DEFAULT_KEYWORD,
    multiple: bool = False,
) -> DataFrame:
    """The ordered keyword list of a run: the list when ``multiple``, else one keyword.

    Without a list ``multiple`` is ignored. A list kept as a table, ``kw_pos, keyword``, stays one.
    """
    if multiple and isinstance(keywords, DataFrame):
        return keywords.select(F.col("kw_pos").cast("int").alias("kw_pos"), F.col("keyword").cast("string").alias("keyword"))
    chosen = keywords if multiple and keywords is not None else [keyword or default]
    return spark.createDataFrame(list(enumerate(chosen)), KEYWORDS)


def request_manifest(keywords: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Search addresses to fetch: every keyword's result pages in order."""
    search = F.concat(F.lit(site.base_url + site.search_path), percent_encode(F.col("keyword")))
    page = F.when(F.col("page_no") == 0, F.lit("")).otherwise(
        F.concat(F.lit(site.page_parameter), F.col("page_no").cast("string"))
    )
    # Made before the pages are, so that a keyword is encoded once.
    pages = keywords.withColumn("_search", search).withColumn(
        "page_no", F.explode(F.sequence(F.lit(0), F.lit(site.max_pages - 1)))
    )
    return pages.withColumn("url", F.concat("_search", page)).drop("_search")
