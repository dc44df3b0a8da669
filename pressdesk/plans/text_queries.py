"""Scans, predicates and text functions as queries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE
from ..functions import patterns as P
from ..functions import text as T
from ..operators import links as L
from ..operators import nodes as N
from ..operators import pickers as K
from ..operators import regions as R
from ..operators.html import html_nodes
from ..session import scratch_path, spread
from ..sources import archive, scan
from ..sources import derived as D
from .registry import (
    columns,
    decode_sql,
    first_email_sql,
    lit,
    phone_sql,
    query,
    rx,
    strip_sql,
    url_encode_sql,
    valid_person_sql,
    valid_phone_sql,
    wide_sql,
)

_BLOCKED = DEFAULT_SITE.blocked_email_substring
_PAGES = replace(DEFAULT_SITE, link_substring="/")


def _docs(spark, sf_dir):
    return spread(D.read(spark, sf_dir, "documents"))


def _pages(spark, sf_dir):
    return spread(D.read(spark, sf_dir, "pages"))


# --- scans ----------------------------------------------------------------------------

_SEARCH_PAGES = f"SELECT {columns(D.search_page_columns('//'))} FROM orders"


@query(
    "scan_search_pages",
    f"SELECT keyword, page_no, status, md5(html) AS html_md5 FROM ({_SEARCH_PAGES})",
)
def scan_search_pages(spark, sf_dir):
    path = scratch_path(spark, "search_pages")
    landed = D.search_pages(spark, sf_dir)
    landed.withColumn("html", F.encode("html", "UTF-8")).write.parquet(path)
    pages = scan.scan_search_pages(spark, path)
    return pages.select("keyword", "page_no", "status", F.md5("html").alias("html_md5"))


@query(
    "scan_article_pages",
    "SELECT url, length(html) AS n_chars, md5(html) AS html_md5 FROM pages",
)
def scan_article_pages(spark, sf_dir):
    pages = scan.scan_article_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select(
        "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("html_md5")
    )


_ARCHIVED = "SELECT coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages"


@query(
    "scan_page_archive",
    f"SELECT url, length(html) AS n_chars, md5(html) AS html_md5 FROM ({_ARCHIVED})",
)
def scan_page_archive(spark, sf_dir):
    """All pages written as record archives and read back in byte ranges."""
    path = archive.write_page_archive(D.read(spark, sf_dir, "pages"), scratch_path(spark, "archive"))
    pages = archive.scan_page_archive(spark, path, split=4 << 20)
    return pages.select(
        "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("html_md5")
    )


@query(
    "scan_page_archive_by_url",
    f"SELECT url, count(*) AS n, sum(length(html))::BIGINT AS n_chars FROM ({_ARCHIVED}) "
    "WHERE starts_with(url, 'https://') GROUP BY url",
)
def scan_page_archive_by_url(spark, sf_dir):
    """Pages with one start of their URL, of gzipped records: others are passed over in the file."""
    path = scratch_path(spark, "archive")
    archive.write_page_archive(D.read(spark, sf_dir, "pages"), path, compression="gzip")
    pages = archive.scan_page_archive(spark, path).filter(F.startswith("url", F.lit("https://")))
    return pages.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).cast("bigint").alias("n_chars")
    )


@query(
    "keyword_dim",
    """WITH listed AS (SELECT CAST(p_partkey AS INT) AS kw_pos, p_name AS keyword FROM part
            UNION ALL SELECT CAST(-p_partkey AS INT), p_brand FROM part)
        SELECT 'list' AS run, kw_pos, keyword FROM listed
        UNION ALL SELECT 'single', 0, 'brand' UNION ALL SELECT unnest(['default', 'no list']), 0, 'サプリ'""",
)
def keyword_dim(spark, sf_dir):
    """The keyword lists of four runs that differ in what the caller gave; the list is a table with repeats."""
    parts = D.read(spark, sf_dir, "part")
    listed = parts.select(F.col("p_partkey").alias("kw_pos"), F.col("p_name").alias("keyword")).unionAll(
        parts.select(-F.col("p_partkey"), "p_brand")
    )
    runs = {
        "list": scan.keyword_dim(spark, listed, multiple=True),
        "single": scan.keyword_dim(spark, listed, keyword="brand"),
        "default": scan.keyword_dim(spark, listed),
        "no list": scan.keyword_dim(spark, None, multiple=True),
    }
    named = [df.select(F.lit(run).alias("run"), "kw_pos", "keyword") for run, df in runs.items()]
    return reduce(DataFrame.unionAll, named)


_SEARCH = DEFAULT_SITE.base_url + DEFAULT_SITE.search_path


@query(
    "request_manifest",
    f"""SELECT kw_pos, keyword, CAST(page_no AS INT) AS page_no,
        '{_SEARCH}' || {url_encode_sql('keyword')} ||
        CASE WHEN page_no = 0 THEN '' ELSE '{DEFAULT_SITE.page_parameter}' || CAST(page_no AS VARCHAR) END AS url
        FROM (SELECT CAST(p_partkey AS INT) AS kw_pos, p_name || ' / 語~*+' AS keyword FROM part),
        (SELECT unnest(range(0, 5)) AS page_no)""",
)
def request_manifest(spark, sf_dir):
    keywords = D.keyword_list(spark, sf_dir)
    return scan.request_manifest(
        keywords.withColumn("keyword", F.concat("keyword", F.lit(" / 語~*+")))
    )


_ANSWERED = "kw_pos % 7 <> 3"
_BODY = "'<p>' || keyword || ' ' || cast(page_no as string) || '</p>'"


@query(
    "landed_search_pages",
    f"""SELECT DISTINCT keyword, CAST(page_no AS INT) AS page_no, CASE WHEN page_no = 4 THEN 404 ELSE 200 END AS status,
        md5({_BODY}) AS html_md5 FROM (SELECT CAST(p_partkey AS INT) AS kw_pos, p_name AS keyword FROM part),
        (SELECT unnest(range(0, 5)) AS page_no) WHERE {_ANSWERED}""",
)
def landed_search_pages(spark, sf_dir):
    """Manifest to search pages: what a fetcher landed, as bytes by address, joined to its requests."""
    manifest = scan.request_manifest(D.keyword_list(spark, sf_dir))
    path = scratch_path(spark, "responses")
    manifest.filter(_ANSWERED).selectExpr(
        "url", "CASE WHEN page_no = 4 THEN 404 ELSE 200 END AS status", f"encode({_BODY}, 'UTF-8') AS body"
    ).write.parquet(path)
    pages = scan.landed_search_pages(manifest, spread(scan.scan_responses(spark, path)))
    return pages.select("keyword", "page_no", "status", F.md5("html").alias("html_md5"))


@query(
    "html_nodes",
    """SELECT page_id, tag, count(*) AS n FROM (
        SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages
    ) GROUP BY page_id, tag""",
)
def nodes(spark, sf_dir):
    parsed = _pages(spark, sf_dir).select("page_id", html_nodes(F.col("html")).alias("nodes"))
    tags = F.transform(F.filter("nodes", lambda n: n.kind == "element"), lambda n: n.tag)
    return (
        N.rows_of(parsed, tags, item="tag")
        .groupBy("page_id", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "run_label",
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS label FROM events",
)
def run_label(spark, sf_dir):
    return D.read(spark, sf_dir, "events").select("event_id", T.run_label(F.col("ts")).alias("label"))


# --- predicates -----------------------------------------------------------------------


@query(
    "link_filter",
    """SELECT page_id, CAST(pos AS INT) AS pos, href FROM (
        SELECT page_id, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS pos FROM (
            SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
                lambda h: replace(h, '&amp;', '&')), lambda h: contains(h, '/')) AS hrefs FROM pages))""",
)
def link_filter(spark, sf_dir):
    parsed = _pages(spark, sf_dir).withColumn("nodes", html_nodes(F.col("html")))
    hrefs = L.link_hrefs(F.col("nodes"), _PAGES)
    return N.rows_of(parsed, hrefs, item="href").select("page_id", "pos", "href")


_LINKS = f"SELECT {columns(D.search_link_columns('//'))} FROM orders"
RESOLVE = (
    f"CASE WHEN href LIKE '/%' THEN '{D.BASE}' || href WHEN href NOT LIKE 'http%' "
    f"THEN '{D.BASE}/' || href ELSE href END"
)


@query("resolve_href", f"SELECT pos, href, {RESOLVE} AS url FROM ({_LINKS})")
def resolve_href(spark, sf_dir):
    links = D.search_links(spark, sf_dir)
    return links.select("pos", "href", L.resolve_href(F.col("href")).alias("url"))


_CO = D.company_sql("c_custkey")


@query(
    "find_first",
    f"""SELECT c_custkey AS k,
        CASE WHEN c_custkey % 8 = 0 THEN {_CO} ELSE '' END AS by_div_class,
        CASE WHEN c_custkey % 8 = 5 THEN {_CO} ELSE '' END AS by_link_class,
        CASE WHEN c_custkey % 8 IN (0, 5) THEN {_CO} ELSE '' END AS by_class_pattern,
        CASE WHEN c_custkey % 8 = 2 THEN {_CO} || ' (head)' ELSE '' END AS by_selector_list,
        CASE WHEN c_custkey % 8 = 1 THEN {_CO} || 'のプレスリリース' ELSE '' END AS by_meta
        FROM customer""",
)
def find_first(spark, sf_dir):
    n = F.col("nodes")
    head = f"concat('<body><p class=\"x content-header-sub-text\">', {D.company_sql('k')}, ' (head)</p>')"
    articles = D.press_articles(spark, sf_dir).selectExpr(
        "k", f"CASE WHEN k % 8 = 2 THEN replace(html, '<body>', {head}) ELSE html END AS html"
    )
    parsed = articles.withColumn("nodes", html_nodes(F.col("html")))
    any_of = lambda e: N.has_class("content-header-sub-text")(e) | N.has_class("release-header__company")(e)

    def text(predicate):
        return T.or_empty(T.let(N.find_first(n, predicate), lambda e: N.plain_text(n, e)))

    meta = N.find_first(n, lambda e: N.is_tag("meta")(e) & (e.attrs["property"] == P.SITE_NAME_PROPERTY))
    return parsed.select(
        "k",
        text(lambda e: N.is_tag("div")(e) & N.has_class("release-company")(e)).alias("by_div_class"),
        text(lambda e: N.is_tag("a")(e) & N.has_class("link-to-company")(e)).alias("by_link_class"),
        text(lambda e: N.is_tag("div", "span", "a")(e) & N.has_class_matching("company")(e)).alias("by_class_pattern"),
        text(any_of).alias("by_selector_list"),
        T.or_empty(meta["attrs"]["content"]).alias("by_meta"),
    )


_FLAGS = {
    "has_inquiry": "contains(text, 'お問い合わせ')",
    "has_person": "contains(text, '担当')",
    "has_phone": "contains(text, 'TEL') OR contains(text, '電話')",
    "has_at": "contains(text, '@')",
}


@query(
    "page_flags",
    f"""SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, {columns(_FLAGS)} FROM documents
        UNION ALL SELECT 'c' || CAST(k AS VARCHAR) AS id, {columns(_FLAGS)}
        FROM (SELECT c_custkey AS k, {D.contact_text_sql('c_custkey')} AS text FROM customer)""",
)
def page_flags(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    texts = D.contact_texts(spark, sf_dir).select(F.concat(F.lit("c"), "k").alias("id"), "text")
    return docs.unionByName(texts).select(
        "id", *[c.alias(name) for name, c in T.page_flags(F.col("text")).items()]
    )


_SPELLED = f"(SELECT c_custkey AS k, {D.phone_spelling_sql('c_custkey')} AS raw FROM customer)"


def _spellings(spark, sf_dir):
    return D.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", f"{D.phone_spelling_sql('c_custkey')} AS raw"
    )


@query("valid_phone", f"SELECT k, raw, {valid_phone_sql('raw')} AS valid FROM {_SPELLED}")
def valid_phone(spark, sf_dir):
    return _spellings(spark, sf_dir).withColumn("valid", T.valid_phone(F.col("raw")))


_ADDRESS = f"""SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(text, {rx(P.EMAIL_ASCII)})) AS email
    FROM documents UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id,
    CASE WHEN c_custkey % 3 = 0 THEN 'Desk@NewsWire.example' ELSE {D.email_sql('c_custkey')} END AS email FROM customer"""


@query("allowed_email", f"SELECT id, email, NOT contains(lower(email), '{_BLOCKED}') AS allowed FROM ({_ADDRESS})")
def allowed_email(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.explode(T.all_matches(F.col("text"), P.EMAIL_ASCII)).alias("email"),
    )
    made = D.read(spark, sf_dir, "customer").selectExpr(
        "'c' || cast(c_custkey as string) AS id",
        "CASE WHEN c_custkey % 3 = 0 THEN 'Desk@NewsWire.example' "
        f"ELSE {D.email_sql('c_custkey')} END AS email",
    )
    return docs.unionByName(made).withColumn("allowed", T.allowed_email(F.col("email")))


@query(
    "valid_person",
    f"SELECT k, name, {valid_person_sql('name')} AS valid FROM "
    f"(SELECT c_custkey AS k, {D.person_spelling_sql('c_custkey')} AS name FROM customer)",
)
def valid_person(spark, sf_dir):
    names = D.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", f"{D.person_spelling_sql('c_custkey')} AS name"
    )
    return names.withColumn("valid", T.valid_person(F.col("name")))


# --- text functions -------------------------------------------------------------------

_COLLAPSED = f"regexp_replace(nfc_normalize(text), {rx(f'[{P.WS}]+')}, ' ', 'g')"


# Compatibility characters and what Unicode says they stand for, written out by hand.
_WIDE = "ＡＢＣ１２３\u3000℡ ﬁn ㈱ ｶﾞ ① ½ Ⅳ e\u0301"
_PLAIN = "ABC123 TEL fin (株) ガ 1 1⁄2 IV é"


@query(
    "normalize_text",
    f"""SELECT doc_id, md5(trim({_COLLAPSED} || ' {_PLAIN}', ' ')) AS text_md5 FROM documents""",
)
def normalize_text(spark, sf_dir):
    """Every text with compatibility characters after it, which NFC would leave as they are."""
    text = F.concat("text", F.lit(" " + _WIDE))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_text(text)).alias("text_md5"))


@query("decode_email", f"SELECT doc_id, md5({decode_sql('text')}) AS text_md5 FROM documents")
def decode_email(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.decode_email(F.col("text"))).alias("text_md5"))


@query(
    "to_halfwidth",
    f"SELECT k, {wide_sql('raw')} AS half FROM (SELECT c_custkey AS k, "
    f"{D.wide_phone_sql('c_custkey')} || '（' || c_name || '）　x' AS raw FROM customer)",
)
def to_halfwidth(spark, sf_dir):
    raw = D.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", f"{D.wide_phone_sql('c_custkey')} || '（' || c_name || '）　x' AS raw"
    )
    return raw.select("k", T.to_halfwidth(F.col("raw")).alias("half"))


@query("normalize_phone", f"SELECT k, raw, {phone_sql('raw')} AS phone FROM {_SPELLED}")
def normalize_phone(spark, sf_dir):
    return _spellings(spark, sf_dir).withColumn("phone", T.normalize_phone(F.col("raw")))


_CLEANED = f"regexp_replace({wide_sql('raw')}, {rx(f'[{P.WS}()]')}, '', 'g')"


@query(
    "clean_phone_last_resort",
    f"SELECT k, raw, CASE WHEN length({_CLEANED}) >= 10 THEN {_CLEANED} ELSE '' END AS phone FROM {_SPELLED}",
)
def clean_phone_last_resort(spark, sf_dir):
    return _spellings(spark, sf_dir).withColumn("phone", T.clean_phone_last_resort(F.col("raw")))


_SITE_NAME = (
    "CASE c_custkey % 4 WHEN 0 THEN '　' || c_name || 'のプレスリリース ' WHEN 1 THEN 'NEWSWIRE' "
    "WHEN 2 THEN ' NEWSWIREのプレスリリース' ELSE c_mktsegment || c_name END"
)
_NAME_CLEANED = strip_sql("replace(raw, 'のプレスリリース', '')")


@query(
    "site_name_clean",
    f"SELECT k, CASE WHEN {_NAME_CLEANED} = 'NEWSWIRE' THEN '' ELSE {_NAME_CLEANED} END AS company "
    f"FROM (SELECT c_custkey AS k, {_SITE_NAME} AS raw FROM customer)",
)
def site_name_clean(spark, sf_dir):
    raw = D.read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{_SITE_NAME} AS raw")
    return raw.select("k", T.site_name_clean(F.col("raw")).alias("company"))


@query("contact_truncate", "SELECT doc_id, substr(text, 1, 500) AS head FROM documents")
def contact_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.contact_truncate(F.col("text")).alias("head"))


_SHEET_CHARS, _SHEET_TO = lit(P.SHEET_KEY_FROM), lit("_" * len(P.SHEET_KEY_FROM))


@query(
    "sheet_key",
    "SELECT doc_id, keyword, translate(substr(keyword, 1, 31), "
    f"{_SHEET_CHARS}, {_SHEET_TO}) AS sheet_key FROM (SELECT doc_id, "
    "source || '/[' || lang || ']:' || text AS keyword FROM documents)",
)
def sheet_key(spark, sf_dir):
    keywords = _docs(spark, sf_dir).selectExpr("doc_id", "source || '/[' || lang || ']:' || text AS keyword")
    return keywords.withColumn("sheet_key", T.sheet_key(F.col("keyword")))


@query(
    "percent_encode",
    f"SELECT conv_id, turn, {url_encode_sql('text')} AS encoded FROM conversations",
)
def percent_encode(spark, sf_dir):
    turns = D.read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.percent_encode(F.col("text")).alias("encoded"))


def page_text_sql(html: str) -> str:
    """Readable text of marked-up text: pieces between tags, stripped, with blanks between."""
    # A title cut off inside an entity leaves one without its semicolon.
    piece = "regexp_replace(replace(s, '&quot;', '\"'), '&amp;?', '&', 'g')"
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({html}, '<[^>]*>'), "
        f"lambda s: {strip_sql(piece)}), lambda s: s <> ''), ' ')"
    )


ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"


@query("element_text", f"SELECT page_id, {page_text_sql(ARTICLE)} AS text FROM pages")
def element_text(spark, sf_dir):
    n = F.col("nodes")
    parsed = _pages(spark, sf_dir).withColumn("nodes", html_nodes(F.col("html")))
    area = N.find_first(n, N.is_tag("article"))
    return parsed.select("page_id", T.let(area, lambda a: N.element_text(n, a)).alias("text"))


_NUMBER = r"\p{Nd}{3,}([-.]\p{Nd}+)?"


@query("first_match", f"SELECT doc_id, regexp_extract(text, {rx(_NUMBER)}) AS number FROM documents")
def first_match(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_match(F.col("text"), _NUMBER).alias("number"))


@query(
    "all_matches",
    f"SELECT doc_id, array_to_string(regexp_extract_all(text, {rx(_NUMBER)}), ' ') AS numbers FROM documents",
)
def all_matches(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(T.all_matches(F.col("text"), _NUMBER), " ").alias("numbers")
    )


_LINES = "string_split(text, chr(10))"


@query(
    "first_valid_match",
    f"""SELECT doc_id, coalesce(list_filter(flatten(list_transform({_LINES}, lambda l: flatten([
        regexp_extract_all(l, '0\\p{{Nd}}{{2,}}'), regexp_extract_all(l, '\\p{{Nd}}{{3,}}')]))),
        lambda m: length(m) <= 4)[1], '') AS number FROM documents""",
)
def first_valid_match(spark, sf_dir):
    lines = F.split(F.col("text"), "\n")
    picked = T.first_valid_match(lines, (r"0\p{Nd}{2,}", r"\p{Nd}{3,}"), lambda m: F.length(m) <= 4)
    return _docs(spark, sf_dir).select("doc_id", picked.alias("number"))


# --- pickers on text ------------------------------------------------------------------

CONTACT_TEXTS = f"(SELECT c_custkey AS k, {D.contact_text_sql('c_custkey')} AS text FROM customer)"


# The headings without look-ahead, which RE2 lacks and, being linear, does not need.
_H = "(?:問い?合わ?せ|連絡先|広報)"
_BLOCKS = [f"【[^】]*{_H}[^】]*】([^【]+)"]
_BLOCKS += [f"{m}[^{m}\\n]*{_H}[^{m}\\n]*([^{m}]+)" for m in "■▼●"]
_BLOCKS += [f"＜[^＞]*{_H}[^＞]*＞([^＜]+)"]


def _boost_sql(source: str) -> str:
    for p in _BLOCKS:
        source = (
            f"(SELECT k, CASE WHEN regexp_matches(text, {rx(p)}) THEN "
            f"substr(regexp_extract(text, {rx(p)}, 1), 1, 500) || ' ' || text ELSE text END AS text FROM {source})"
        )
    return source


@query("contact_boost", f"SELECT k, text FROM {_boost_sql(CONTACT_TEXTS)}")
def contact_boost(spark, sf_dir):
    return D.contact_texts(spark, sf_dir).select("k", R.contact_boost(F.col("text")).alias("text"))


@query(
    "company_from_text",
    f"SELECT k, regexp_extract(text, {rx(P.COMPANY_IN_TEXT)}, 1) AS company FROM {CONTACT_TEXTS}",
)
def company_from_text(spark, sf_dir):
    return D.contact_texts(spark, sf_dir).select("k", K.company_from_text(F.col("text")).alias("company"))


_PERSON = "[" + ", ".join(strip_sql(f"regexp_extract(text, {rx(p)}, 1)") for p in P.PERSON_LABELS) + "]"


@query(
    "person",
    f"SELECT k, coalesce(list_filter({_PERSON}, lambda n: {valid_person_sql('n')})[1], '') AS person FROM {CONTACT_TEXTS}",
)
def person(spark, sf_dir):
    return D.contact_texts(spark, sf_dir).select("k", K.person(F.col("text")).alias("person"))


CONTEXT_SQL = (
    f"coalesce(list_filter(list_transform(regexp_extract_all(decoded, {rx(P.EMAIL_WINDOW)}), "
    f"lambda w: {first_email_sql('w', _BLOCKED)}), lambda e: e <> '')[1], '')"
)
_DECODED = f"(SELECT doc_id, {decode_sql('text')} AS decoded FROM documents)"
# Documents hold few addresses, so half of the rows get one after a label.
_MAILED = (
    "(SELECT k, {decode} AS decoded FROM (SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN text ELSE "
    "substr(text, 1, 200) || ' E-MAIL: desk@newswire.example pr' || cast(doc_id as string) || '(at)ex(dot)jp ' || text END AS text "
    "FROM documents))"
)


def _mailed(spark, sf_dir):
    return _docs(spark, sf_dir).selectExpr(
        "doc_id AS k",
        "CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 200) || ' E-MAIL: desk@newswire.example pr' "
        "|| cast(doc_id as string) || '(at)ex(dot)jp ' || text END AS text",
    ).select("k", T.decode_email(F.col("text")).alias("decoded"))


@query("email_pick_context", f"SELECT k, {CONTEXT_SQL} AS email FROM {_MAILED.format(decode=decode_sql('text'))}")
def email_pick_context(spark, sf_dir):
    return _mailed(spark, sf_dir).select("k", K.email_pick_context(F.col("decoded")).alias("email"))


@query(
    "email_pick_full",
    f"SELECT k, {first_email_sql('decoded', _BLOCKED)} AS email FROM {_MAILED.format(decode=decode_sql('text'))}",
)
def email_pick_full(spark, sf_dir):
    return _mailed(spark, sf_dir).select("k", K.email_pick_full(F.col("decoded")).alias("email"))


def labelled_phone_sql(text: str) -> str:
    found = ", ".join(f"regexp_extract_all({text}, {rx(p)}, 1)" for p in P.PHONE_LABELLED)
    return (
        f"coalesce(list_filter(list_transform(flatten([{found}]), lambda m: {phone_sql('m')}), "
        f"lambda n: {valid_phone_sql('n')})[1], '')"
    )


@query("phone_pick_labelled", f"SELECT k, {labelled_phone_sql('text')} AS phone FROM {CONTACT_TEXTS}")
def phone_pick_labelled(spark, sf_dir):
    return D.contact_texts(spark, sf_dir).select("k", K.phone_pick_labelled(F.col("text")).alias("phone"))


def contact_phone_sql(text: str) -> str:
    match = f"regexp_extract({text}, {rx(P.PHONE_NEAR_CONTACT)}, 1)"
    return f"coalesce(list_filter([{phone_sql(match)}], lambda n: {valid_phone_sql('n')})[1], '')"


@query("phone_pick_contact", f"SELECT k, {contact_phone_sql('text')} AS phone FROM {CONTACT_TEXTS}")
def phone_pick_contact(spark, sf_dir):
    return D.contact_texts(spark, sf_dir).select("k", K.phone_pick_contact(F.col("text")).alias("phone"))
