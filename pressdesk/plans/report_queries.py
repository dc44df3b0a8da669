"""Hits, joins, reports and keyed output as queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT_SITE
from ..operators import links as L
from ..operators import report as R
from ..operators.contacts import extract_contacts
from ..session import scratch_path, spread, stored
from ..sources import derived as D
from ..sources import page_table, scan, sinks
from ..streaming.contacts import landed_pages
from ..streaming.hits import current_hits, stream_hits
from . import run as whole_run
from .contact_queries import EXPECTED, press_contacts
from .registry import columns, query
from .text_queries import RESOLVE

# --- SQL building blocks: hits of the link table -----------------------------------------

_LINKS = f"links AS (SELECT {columns(D.search_link_columns('//'))} FROM orders)"


def _stops(links: str) -> str:
    """Per keyword the first of pages 0..4 that is not status 200 or has no link."""
    return (
        f"good AS (SELECT keyword, page_no FROM {links} WHERE page_no < 5 "
        "GROUP BY keyword, page_no HAVING min(CASE WHEN status = 200 THEN 1 ELSE 0 END) = 1), "
        "stops AS (SELECT k.keyword, min(p.page_no) AS stop_page FROM "
        f"(SELECT DISTINCT keyword FROM {links} WHERE page_no < 5) k, (SELECT unnest(range(0, 6)) AS page_no) p "
        "WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.keyword = k.keyword AND g.page_no = p.page_no) "
        "GROUP BY k.keyword)"
    )


def _hits(links: str) -> str:
    return (
        f"kept AS (SELECT l.*, {RESOLVE} AS url FROM {links} l JOIN stops USING (keyword) "
        f"WHERE page_no < stop_page AND contains(href, '{DEFAULT_SITE.link_substring}')), "
        "seen AS (SELECT keyword, url, min((page_no, pos)) AS place FROM kept GROUP BY keyword, url), "
        "ranked AS (SELECT keyword, url, place, row_number() OVER (PARTITION BY keyword ORDER BY place) AS hit_pos FROM seen)"
    )


_MATCHED = f"matched AS (SELECT * FROM links WHERE contains(href, '{DEFAULT_SITE.link_substring}'))"
_HITS = (
    f"WITH {_LINKS}, {_MATCHED}, {_stops('matched')}, {_hits('links')}, "
    "hits AS (SELECT keyword, CAST(hit_pos AS INT) AS hit_pos, url FROM ranked WHERE hit_pos <= 100)"
)
_KEYWORDS = (
    "firsts AS (SELECT o_orderpriority AS keyword, CAST(min(o_orderkey) AS INT) AS first_pos FROM orders GROUP BY 1), "
    "keywords AS (SELECT keyword, unnest(CASE WHEN keyword LIKE '1%' OR keyword LIKE '5%' "
    "THEN [first_pos, first_pos + 1000] ELSE [first_pos] END) AS kw_pos FROM firsts)"
)
_CONTACTS = f"contacts AS (SELECT {D.url_sql('c_custkey')} AS url, {EXPECTED} FROM customer)"
_FIELDS = ", ".join(f"coalesce({f}, '') AS {f}" for f in ("company", "person", "email", "phone"))
_RECORDS = (
    f"{_HITS}, {_KEYWORDS}, {_CONTACTS}, records AS (SELECT keyword, kw_pos, hit_pos, url, {_FIELDS} "
    "FROM hits JOIN keywords USING (keyword) LEFT JOIN contacts USING (url))"
)


def _hits_of_links(spark, sf_dir):
    return L.collect_hits(D.search_links(spark, sf_dir))


def _records(spark, sf_dir):
    """Records of the press pages found by the link table; repeated keywords run again."""
    hits = L.hits_in_order(_hits_of_links(spark, sf_dir), D.search_keywords(spark, sf_dir))
    hits = stored(hits, scratch_path(spark, "hits"))
    pages = R.pages_hit(D.press_articles(spark, sf_dir), hits)
    return R.hits_to_contacts(hits, extract_contacts(pages))


# --- hits -----------------------------------------------------------------------------


@query(
    "stop_prefix",
    f"WITH {_LINKS}, {_stops('links')} SELECT l.* FROM links l JOIN stops USING (keyword) WHERE page_no < stop_page",
)
def stop_prefix(spark, sf_dir):
    return L.stop_prefix(D.search_links(spark, sf_dir))


@query("page_cap", f"WITH {_LINKS} SELECT * FROM links WHERE page_no < 5")
def page_cap(spark, sf_dir):
    return L.page_cap(D.search_links(spark, sf_dir))


_RESOLVED = f"resolved AS (SELECT keyword, page_no, pos, {RESOLVE} AS url FROM links)"
_SEEN = (
    "seen AS (SELECT keyword, url, min((page_no, pos)) AS place FROM resolved GROUP BY keyword, url), "
    "firsts AS (SELECT r.keyword, r.url, r.page_no, r.pos FROM resolved r JOIN seen s "
    "ON r.keyword = s.keyword AND r.url = s.url AND (r.page_no, r.pos) = s.place)"
)


def _seen(spark, sf_dir):
    links = D.search_links(spark, sf_dir)
    return L.first_seen(links.withColumn("url", L.resolve_href(F.col("href"))))


@query("first_seen_dedupe", f"WITH {_LINKS}, {_RESOLVED}, {_SEEN} SELECT * FROM firsts")
def first_seen_dedupe(spark, sf_dir):
    return _seen(spark, sf_dir)


@query(
    "limit_per_keyword",
    f"""WITH {_LINKS}, {_RESOLVED}, {_SEEN} SELECT keyword, url, page_no, pos, CAST(n AS INT) AS hit_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY page_no, pos) AS n FROM firsts) WHERE n <= 100""",
)
def limit_per_keyword(spark, sf_dir):
    return L.first_per_keyword(_seen(spark, sf_dir), 100, ["page_no", "pos"], "hit_pos")


@query(
    "limit_per_keyword_wide",
    f"""WITH {_LINKS}, {_RESOLVED}, {_SEEN} SELECT keyword, url, page_no, pos, CAST(n AS INT) AS hit_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY page_no, pos) AS n FROM firsts) WHERE n <= 700""",
)
def limit_per_keyword_wide(spark, sf_dir):
    """A cap that ends on a later result page."""
    return L.first_per_keyword(_seen(spark, sf_dir), 700, ["page_no", "pos"], "hit_pos")


_SP = D.search_page_columns("//")
_PAGE_LINKS = (
    f"sp AS (SELECT keyword, page_no, status, o_custkey % 50 AS c, o_orderkey % 13 = 5 AS empty "
    f"FROM (SELECT *, {_SP['keyword']} AS keyword, CAST(o_orderkey % 7 AS INT) AS page_no, {_SP['status']} AS status FROM orders)), "
    "links AS (SELECT keyword, page_no, status, unnest([0, 1, 2]) AS pos, unnest(['/rd/p/' || c || '.html', "
    f"'rd/p/1' || c || '.html', '{D.BASE}/rd/p/' || c || '.html']) AS href FROM sp WHERE NOT empty)"
)
# The harvest matches the link substring, which the second link form lacks a slash for.
_PAGE_HITS = (
    f"WITH {_PAGE_LINKS}, {_MATCHED}, {_stops('matched')}, {_hits('links')}, "
    "hits AS (SELECT keyword, CAST(hit_pos AS INT) AS hit_pos, url FROM ranked WHERE hit_pos <= 100)"
)


@query("collect_hits", f"{_PAGE_HITS} SELECT * FROM hits")
def collect_hits(spark, sf_dir):
    """From search pages to hits: parse, harvest, resolve, stop, de-duplicate, cap."""
    pages = spread(D.search_pages(spark, sf_dir))
    links = stored(L.harvest_links(pages), scratch_path(spark, "links"))
    return L.collect_hits(links)


@query("collect_hits_stream", f"{_PAGE_HITS} SELECT * FROM hits")
def collect_hits_stream(spark, sf_dir):
    """The same pages in two landings, later result pages first, each brought up to date as a stream."""
    landed, out, state = (scratch_path(spark, d) for d in ("landed", "hits", "state"))
    pages = spread(D.search_pages(spark, sf_dir))
    for late in (F.col("page_no") >= 2, F.col("page_no") < 2):
        pages.filter(late).write.mode("append").parquet(landed)
        stream_hits(landed_pages(spark, landed, scan.SEARCH_PAGES), out, state).awaitTermination()
    return current_hits(spark, out)


@query("empty_guard", f"{_PAGE_HITS} SELECT keyword, count(*) AS n FROM hits GROUP BY keyword")
def empty_guard(spark, sf_dir):
    """Groups of the output: a keyword without hits has none."""
    return collect_hits(spark, sf_dir).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query(
    "links_per_page",
    f"""WITH {_LINKS}, {_MATCHED}, {_stops('matched')}, {_hits('links')},
        raw AS (SELECT keyword, page_no, count(*) AS n_links FROM kept GROUP BY 1, 2),
        new AS (SELECT keyword, place[1] AS page_no, count(*) AS n FROM seen GROUP BY 1, 2),
        total AS (SELECT keyword, page_no, n_links, coalesce(n, 0) AS n,
            sum(coalesce(n, 0)) OVER (PARTITION BY keyword ORDER BY page_no) AS t
            FROM raw LEFT JOIN new USING (keyword, page_no))
        SELECT keyword, page_no, n_links, CAST(least(t, 300) AS BIGINT) AS n_kept FROM total WHERE t - n < 300""",
)
def links_per_page(spark, sf_dir):
    return L.links_per_page(D.search_links(spark, sf_dir), replace(DEFAULT_SITE, max_articles=300))


# --- joins ----------------------------------------------------------------------------


@query("hits_to_contacts", f"{_RECORDS} SELECT * FROM records")
def hits_to_contacts(spark, sf_dir):
    return _records(spark, sf_dir)


@query(
    "pages_by_url",
    f"""{_HITS}, pages AS (SELECT {D.url_sql('c_custkey')} AS url, {D.press_html_sql('c_custkey')} AS html FROM customer)
        SELECT url, md5(html) AS html_md5 FROM pages WHERE url IN (SELECT url FROM hits)""",
)
def pages_by_url(spark, sf_dir):
    """Pages of all hits out of a table laid out by URL."""
    path = scratch_path(spark, "by_url")
    pages = D.press_articles(spark, sf_dir).drop("k")
    table = page_table.write_page_table(pages, path, "pages_" + path[-32:], buckets=16)
    found = R.pages_hit(table, stored(_hits_of_links(spark, sf_dir), scratch_path(spark, "hits")))
    return found.select("url", F.md5("html").alias("html_md5"))


_WORDS = ["tion", "ment ", "The ", "sch", "tion", "@", "株式"]
_WORD_ROWS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(_WORDS))


@query(
    "keyword_search",
    f"SELECT doc_id, lang, source, n_chars, kw_pos, keyword FROM documents, (VALUES {_WORD_ROWS}) k(kw_pos, keyword) WHERE contains(text, keyword)",
)
def keyword_search(spark, sf_dir):
    return scan.keyword_search(D.read(spark, sf_dir, "documents"), _WORDS)


# --- reports --------------------------------------------------------------------------


@query(
    "coverage_flags",
    f"""SELECT url, company, person, email, phone, company <> '' AS has_company, person <> '' AS has_person,
        email <> '' AS has_email, phone <> '' AS has_phone,
        company = '' AND person = '' AND email = '' AND phone = '' AS none_found
        FROM (SELECT {D.url_sql('c_custkey')} AS url, {EXPECTED} FROM customer)""",
)
def coverage_flags(spark, sf_dir):
    return R.coverage_flags(press_contacts(spark, sf_dir).drop("k"))


@query(
    "run_totals",
    f"{_RECORDS} SELECT (SELECT count(*) FROM keywords) AS n_keywords, (SELECT count(*) FROM records) AS n_articles",
)
def run_totals(spark, sf_dir):
    keywords = D.search_keywords(spark, sf_dir)
    return R.run_totals(keywords, L.hits_in_order(_hits_of_links(spark, sf_dir), keywords))


@query(
    "field_coverage",
    f"{_RECORDS} SELECT count_if(email <> '')::BIGINT AS n_email, count_if(phone <> '')::BIGINT AS n_phone FROM records",
)
def field_coverage(spark, sf_dir):
    return R.field_coverage(_records(spark, sf_dir))


@query(
    "keyword_counts",
    f"{_RECORDS} SELECT k.kw_pos, k.keyword, n FROM keywords k JOIN "
    "(SELECT keyword, count(*) AS n FROM records GROUP BY keyword) USING (keyword)",
)
def keyword_counts(spark, sf_dir):
    keywords = D.search_keywords(spark, sf_dir)
    records = L.hits_in_order(_hits_of_links(spark, sf_dir), keywords)
    return R.keyword_counts(keywords, records)


@query(
    "keyword_group_sizes",
    f"{_RECORDS} SELECT keyword, count(*) AS n FROM records r WHERE kw_pos = "
    "(SELECT max(kw_pos) FROM keywords k WHERE k.keyword = r.keyword) GROUP BY keyword",
)
def keyword_group_sizes(spark, sf_dir):
    keywords = D.search_keywords(spark, sf_dir)
    return R.keyword_group_sizes(L.hits_in_order(_hits_of_links(spark, sf_dir), keywords))


_PROFILED = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
}


def _profile_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
        f"CAST(least(greatest(max(length(CAST({c} AS VARCHAR))), {len(c)}) + 2, 50) AS INT) AS width FROM {table}"
        for c in _PROFILED[table]
    )


@query("column_profile", " UNION ALL ".join(_profile_sql(t) for t in _PROFILED))
def column_profile(spark, sf_dir):
    def profile(table):
        columns = list(_PROFILED[table])
        widths = R.column_profile(D.read(spark, sf_dir, table).select(*columns))
        return widths.unpivot([], columns, "column_name", "width").withColumn("table_name", F.lit(table))

    return R.union_all_keywords([profile(t) for t in _PROFILED])


@query("report_batches", f"{_RECORDS} SELECT *, CAST((hit_pos - 1) // 5 AS BIGINT) AS batch FROM records")
def report_batches(spark, sf_dir):
    return R.report_batches(_records(spark, sf_dir))


@query(
    "preview_per_keyword",
    f"{_RECORDS} SELECT keyword, kw_pos, hit_pos, company, email, phone FROM records WHERE hit_pos <= 5",
)
def preview_per_keyword(spark, sf_dir):
    return R.preview_per_keyword(_records(spark, sf_dir))


@query("keyword_order", f"{_RECORDS} SELECT * FROM records ORDER BY kw_pos, hit_pos")
def keyword_order(spark, sf_dir):
    return R.keyword_order(_records(spark, sf_dir))


@query("union_all_keywords", f"{_RECORDS} SELECT * FROM records")
def union_all_keywords(spark, sf_dir):
    """Runs of single and repeated keywords put together by column name."""
    keywords = D.search_keywords(spark, sf_dir)
    hits = _hits_of_links(spark, sf_dir)
    contacts = press_contacts(spark, sf_dir)
    runs = [keywords.filter("kw_pos < 1000"), keywords.filter("kw_pos >= 1000")]
    return R.union_all_keywords([R.hits_to_contacts(L.hits_in_order(hits, k), contacts) for k in runs])


# --- keyed output and whole runs ------------------------------------------------------------

_RECORD_SCHEMA = (
    "kw_pos int, keyword string, hit_pos int, url string, company string, person string, "
    "email string, phone string, sheet_key string"
)


@query(
    "write_contacts_by_keyword",
    f"{_RECORDS} SELECT *, keyword AS sheet_key FROM records r WHERE kw_pos = "
    "(SELECT max(kw_pos) FROM keywords k WHERE k.keyword = r.keyword)",
)
def write_contacts_by_keyword(spark, sf_dir):
    records = stored(_records(spark, sf_dir), scratch_path(spark, "records"))
    path = sinks.write_contacts_by_keyword(records, scratch_path(spark, "by_keyword"))
    return spark.read.schema(_RECORD_SCHEMA).parquet(path)


@query(
    "whole_run",
    f"""{_PAGE_HITS}, {_CONTACTS} SELECT keyword, CAST(split_part(keyword, ' ', 2) AS INT) AS kw_pos, hit_pos, url, {_FIELDS}
        FROM hits LEFT JOIN contacts USING (url)""",
)
def run_all(spark, sf_dir):
    """Search pages and press pages through the whole run; its records.

    Without keyed folders: the keywords grow with the orders here.
    """
    search = D.search_pages(spark, sf_dir)
    keywords = search.filter("page_no = 0").selectExpr(
        "cast(substring_index(keyword, ' ', -1) as int) AS kw_pos", "keyword"
    )
    articles = D.press_articles(spark, sf_dir).drop("k")
    out = scratch_path(spark, "run")
    return whole_run.run(spark, search, articles, keywords, out, by_keyword=False).records
