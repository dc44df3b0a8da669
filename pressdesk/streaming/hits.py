"""Hits and records over pages as they land.

``stream_hits`` keeps a table of the links that count while result pages arrive in any order:
each link once, by its keyword, page, status, place and URL, however often its page lands. The state
is those rows' keys, so it grows with the distinct links of the pages that count, and every link
has a key of its own: no task holds more of a keyword than of others. ``current_hits`` makes the
hits of all pages landed so far out of that table, by the rules of ``collect_hits``. Pages without
a keyword are left out, as the batch form does.

``join_records`` joins hits with contacts while both arrive.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_SITE, SiteRules
from ..operators.contacts import FIELDS
from ..operators.links import harvest_links, matching_links, resolved_hits
from ..sources import sinks

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = ["keyword", "page_no", "status", "pos", "url"]
UPDATES = "keyword string, page_no int, status int, pos int, url string, max_articles int, max_pages int"


def link_updates(links: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Links that count and did not land before, over a stream of links, and the caps they landed under."""
    matched = matching_links(links, site).filter(F.col("keyword").isNotNull())
    once = matched.select(
        "keyword", F.col("page_no").cast("int"), F.col("status").cast("int"), F.col("pos").cast("int"), "url"
    ).dropDuplicates(_KEY)
    caps = [F.lit(c).cast("int").alias(name) for name, c in (("max_articles", site.max_articles), ("max_pages", site.max_pages))]
    return once.select("*", *caps)


def stream_hits(search_pages: DataFrame, out_path: str, state_path: str,
                site: SiteRules = DEFAULT_SITE) -> StreamingQuery:
    """Bring the links up to all search pages landed so far, then stop.

    A batch is committed once under its number, so one that is repeated after a crash adds nothing.
    Sets the session's state store to RocksDB, which keeps keys on disk.
    """
    search_pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        link_updates(harvest_links(search_pages, site), site)
        .writeStream.outputMode("append")
        .foreachBatch(sinks.committed_batches(out_path, "links"))
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


def current_hits(spark: SparkSession, out_path: str) -> DataFrame:
    """``keyword, hit_pos, url`` of all pages landed so far, under the largest caps they landed under."""
    links = sinks.read_committed(spark, out_path, UPDATES)
    caps = links.agg(F.max("max_articles").alias("max_articles"), F.max("max_pages").alias("max_pages")).first()
    known = {name: cap for name, cap in caps.asDict().items() if cap is not None}
    return resolved_hits(links, replace(DEFAULT_SITE, **known))


def join_records(hits: DataFrame, contacts: DataFrame, found: str, landed: str, wait: str) -> DataFrame:
    """Streams of hits and contacts -> one record per hit and page of its URL that lands in time.

    ``found`` and ``landed`` are the event times of hits and contacts. A page counts if it lands
    within ``wait`` before or after the hit; the watermarks bound both states by that. A hit
    without such a page comes out once, with empty fields, when the watermark has passed it. A
    page that lands twice in that time gives two records, as no later one can be waited for;
    ``report.hits_to_contacts`` takes the smallest.
    """
    times = [c for c in (found, landed) if c in FIELDS]
    if times:
        raise ValueError(f"event times named like fields: {times}")
    left = hits.withWatermark(found, wait)
    page = contacts.select(F.col("url").alias("_url"), F.col(landed).alias("_landed"), *FIELDS)
    right = page.withWatermark("_landed", wait)
    span = F.expr(f"INTERVAL {wait}")
    near: Column = (F.col("_landed") >= F.col(found) - span) & (F.col("_landed") <= F.col(found) + span)
    joined = left.join(right, (F.col("url") == F.col("_url")) & near, "left_outer")
    return joined.select(*hits.columns, *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS])
