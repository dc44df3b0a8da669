"""Search results -> hits: link harvest, stop rule, ordered de-duplication, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT_SITE, SiteRules
from . import nodes as N
from .html import html_nodes
from .joins import attach_per_key

_POS_BITS = 48
_POS_MASK = (1 << _POS_BITS) - 1


def link_hrefs(nodes: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """Targets of all links that contain the site's link substring, in page order."""
    hits = F.filter(
        nodes,
        lambda n: N.is_tag("a")(n) & F.contains(n.attrs["href"], F.lit(site.link_substring)),
    )
    return F.transform(hits, lambda n: n.attrs["href"])


def resolve_href(href: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """Site-relative targets get the base address in front; nothing else is resolved."""
    return (
        F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(site.base_url), href))
        .when(~F.startswith(href, F.lit("http")), F.concat(F.lit(site.base_url + "/"), href))
        .otherwise(href)
    )


def page_cap(pages: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Only the first result pages count; a plain filter, so the scan can skip the rest."""
    return pages.filter(F.col("page_no") < site.max_pages)


def harvest_links(search_pages: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """``search_pages(keyword, page_no, status, html)`` -> one row per link, with its position."""
    parsed = page_cap(search_pages, site).withColumn("_nodes", html_nodes(F.col("html")))
    hrefs = link_hrefs(F.col("_nodes"), site)
    return N.rows_of(parsed.drop("html"), hrefs, "pos", "href").drop("_nodes")


def stop_pages(links: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Per keyword the first result page that is bad: not status 200, without links, missing.

    One aggregation with partial sums before the shuffle, whatever a keyword's share.
    """
    good = [
        F.coalesce(F.min(F.when(F.col("page_no") == p, F.col("status") == 200)), F.lit(False))
        for p in range(site.max_pages)
    ]
    flags = page_cap(links, site).groupBy("keyword").agg(
        *[flag.alias(f"_good_{p}") for p, flag in enumerate(good)]
    )
    first_bad = F.coalesce(
        *[F.when(~F.col(f"_good_{p}"), F.lit(p)) for p in range(site.max_pages)],
        F.lit(site.max_pages),
    )
    return flags.select("keyword", first_bad.alias("stop_page"))


def stop_prefix(links: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Links of the result pages before a keyword's first bad page."""
    kept = attach_per_key(page_cap(links, site), stop_pages(links, site), "keyword")
    return kept.filter(F.col("page_no") < F.col("stop_page")).drop("stop_page")


def first_seen(links: DataFrame) -> DataFrame:
    """Each keyword's distinct URLs with the place of the first occurrence.

    Page and position travel as one number, so that the minimum is a hash aggregate; that of
    a struct would sort all links on both sides of the shuffle.
    """
    page_no, pos = F.col("page_no").cast("bigint"), F.col("pos").cast("bigint")
    fits = pos.between(0, _POS_MASK) & page_no.between(0, (1 << 15) - 1)
    place = F.when(fits, F.shiftleft(page_no, _POS_BITS) + pos).otherwise(
        F.raise_error(F.lit("page number or link position out of range")).cast("bigint")
    )
    types = dict(links.dtypes)
    first = links.groupBy("keyword", "url").agg(F.min(place).alias("_place"))
    return first.select(
        "keyword",
        "url",
        F.shiftright("_place", _POS_BITS).cast(types["page_no"]).alias("page_no"),
        F.col("_place").bitwiseAND(F.lit(_POS_MASK)).cast(types["pos"]).alias("pos"),
    )


def first_per_keyword(rows: DataFrame, n: int, order: list[str], rank: str) -> DataFrame:
    """The first ``n`` rows of each keyword, numbered from 1; exact for any group size.

    The first column of ``order`` is the result page. Counts per page say how many rows lie
    before it; pages that begin beyond the cap are left out, and rows are numbered within
    their page. So no task holds more of a keyword than one of its result pages.
    """
    page, *within = order
    sizes = rows.groupBy("keyword", page).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy("keyword").orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "keyword", page, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    ).filter(F.col("_before") < n)
    in_page = W.partitionBy("keyword", page).orderBy(*within)
    leading = rows.withColumn(rank, F.row_number().over(in_page)).filter(F.col(rank) <= n)
    placed = leading.join(starts, ["keyword", page]).withColumn(
        rank, (F.col(rank) + F.col("_before")).cast("int")
    )
    return placed.filter(F.col(rank) <= n).select(*rows.columns, rank)


def resolved_hits(resolved: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """``keyword, page_no, status, pos, url`` of matching links on pages that count -> hits.

    The stop rule keeps a prefix of the same order in which the cap counts, so the cap may
    come first: then only capped rows meet the stop page, not all links of a keyword.
    """
    capped = first_per_keyword(
        first_seen(resolved), site.max_articles, ["page_no", "pos"], "hit_pos"
    )
    return (
        capped.join(stop_pages(resolved, site), "keyword")
        .filter(F.col("page_no") < F.col("stop_page"))
        .select("keyword", "hit_pos", "url")
    )


def matching_links(links: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Links with the site's link substring on pages that count, and their addresses."""
    matched = page_cap(links, site).filter(F.contains("href", F.lit(site.link_substring)))
    return matched.withColumn("url", resolve_href(F.col("href"), site))


def collect_hits(links: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Link rows -> ``hits(keyword, hit_pos, url)``."""
    return resolved_hits(matching_links(links, site), site)


def hits_in_order(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """One run of hits per entry of the keyword list; a repeated keyword runs again."""
    return keywords.join(hits, "keyword").select("keyword", "kw_pos", "hit_pos", "url")


def links_per_page(links: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Per result page that is read: its links, and the URLs kept so far up to the cap."""
    resolved = stop_prefix(
        links.filter(F.contains("href", F.lit(site.link_substring))), site
    ).withColumn("url", resolve_href(F.col("href"), site))
    raw = resolved.groupBy("keyword", "page_no").agg(F.count(F.lit(1)).alias("n_links"))
    new = first_seen(resolved).groupBy("keyword", "page_no").agg(F.count(F.lit(1)).alias("_new"))
    # At most max_pages rows per keyword from here on.
    so_far = W.partitionBy("keyword").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    counted = raw.join(new, ["keyword", "page_no"], "left").withColumn(
        "_total", F.sum(F.coalesce("_new", F.lit(0))).over(so_far)
    )
    before = F.col("_total") - F.coalesce("_new", F.lit(0))
    return counted.filter(before < site.max_articles).select(
        "keyword",
        "page_no",
        "n_links",
        F.least("_total", F.lit(site.max_articles).cast("bigint")).alias("n_kept"),
    )
