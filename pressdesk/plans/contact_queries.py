"""Page regions, candidates, pickers and whole records as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT_SITE
from ..functions import patterns as P
from ..functions import text as T
from ..operators import candidates as C
from ..operators import contacts as X
from ..operators import intervals as I
from ..operators import nodes as N
from ..operators import pickers as K
from ..operators import regions as R
from ..operators.html import html_nodes
from ..session import scratch_path, spread, stored
from ..sources import derived as D
from ..sources import sinks
from ..streaming.contacts import landed_pages, stream_contacts
from .registry import (
    columns,
    decode_sql,
    first_email_sql,
    lit,
    phone_sql,
    query,
    rx,
    valid_phone_sql,
)
from .text_queries import (
    ARTICLE,
    CONTEXT_SQL,
    contact_phone_sql,
    labelled_phone_sql,
    page_text_sql,
)

_KEY = "c_custkey"
_V = f"{_KEY} % 8"
_PH, _PHW, _EM, _CO, _PE = (
    f"({f(_KEY)})" for f in (D.phone_sql, D.wide_phone_sql, D.email_sql, D.company_sql, D.person_sql)
)
_BLOCKED = DEFAULT_SITE.blocked_email_substring


def _layouts(texts: dict[int, str], otherwise: str = "''") -> str:
    branches = " ".join(f"WHEN {i} THEN {t}" for i, t in texts.items())
    return f"CASE {_V} {branches} ELSE {otherwise} END"


# Readable text of each page layout, as it is after boilerplate removal.
_TEXT = {
    0: f"{_CO} || ' TEL ' || {_PH} || ' Email ' || {_EM} || ' 担当：' || {_PE}",
    1: f"'電話番号：' || {_PH} || ' ' || replace({_EM}, '@', '[at]') || ' 広報担当：' || {_PE}",
    2: f"'【お問い合わせ先】' || {_CO} || ' 担当：' || {_PE} || ' TEL：' || {_PHW} || ' Email：' || "
       f"replace(replace({_EM}, '@', '(at)'), '.', '(dot)')",
    3: f"'連絡先：' || {_PE} || ' TEL ' || {_PH}",
    4: f"'Contact TEL ' || {_PH} || ' ' || {_EM}",
    5: f"{_CO} || ' Tel ' || {_PH}",
    6: f"'Mail: private' || cast({_KEY} as string) || '@ex' || cast({_KEY} % 5 as string) || '.co.jp'",
    7: f"'desk@newswire.example ' || {_EM}",
}
_AREA_TEXT = {
    **_TEXT,
    0: f"'TEL ' || {_PH} || ' Email ' || {_EM} || ' 担当：' || {_PE}",
    4: "'Contact'",
    5: f"'Tel ' || {_PH}",
}
_SECTION_TEXT = {
    1: f"'広報担当：' || {_PE}",
    2: _TEXT[2],
    3: f"'連絡先：' || {_PE}",
    4: "'Contact'",
}


def _press(spark, sf_dir):
    pages = D.press_articles(spark, sf_dir)
    return pages.withColumn("nodes", html_nodes(F.col("html"))).drop("html")


def _area(parsed):
    """Parsed pages after boilerplate removal, with their search area."""
    n = F.col("nodes")
    found = parsed.withColumns({"main": R.main_content(n), "body": R.page_body(n)})
    stripped = found.withColumn("nodes", R.strip_boilerplate(n, F.col("main"), F.col("body")))
    return stripped.withColumn("area", R.search_area(n, F.col("main"), F.col("body")))


def _text_of(node):
    return T.or_empty(N.element_text(F.col("nodes"), node))


# --- regions --------------------------------------------------------------------------


@query(
    "company_from_html",
    f"SELECT {_KEY} AS k, {_layouts({i: _CO for i in (0, 1, 5)})} AS company FROM customer",
)
def company_from_html(spark, sf_dir):
    return _press(spark, sf_dir).select("k", R.company_from_html(F.col("nodes")).alias("company"))


@query(
    "main_content",
    f"""SELECT 'p' || CAST(page_id AS VARCHAR) AS id, 'article' AS tag FROM pages
        UNION ALL SELECT 'c' || CAST({_KEY} AS VARCHAR) AS id,
        {_layouts({3: "''"}, "'article'")} AS tag FROM customer
        UNION ALL SELECT 't' || CAST({_KEY} AS VARCHAR) AS id, 'main' AS tag FROM customer""",
)
def main_content(spark, sf_dir):
    def pages(df, letter, key):
        return df.select(F.concat(F.lit(letter), F.col(key)).alias("id"), "html")

    every = (
        pages(spread(D.read(spark, sf_dir, "pages")), "p", "page_id")
        .unionByName(pages(D.press_articles(spark, sf_dir), "c", "k"))
        .unionByName(pages(D.table_articles(spark, sf_dir), "t", "k"))
    )
    parsed = every.withColumn("nodes", html_nodes(F.col("html")))
    return parsed.select("id", T.or_empty(R.main_content(F.col("nodes"))["tag"]).alias("tag"))


@query("strip_boilerplate", f"SELECT {_KEY} AS k, {_layouts(_TEXT)} AS text FROM customer")
def strip_boilerplate(spark, sf_dir):
    document = F.get(F.col("nodes"), F.lit(0))
    return _area(_press(spark, sf_dir)).select("k", T.let(document, _text_of).alias("text"))


@query("strip_boilerplate_table", f"SELECT {_KEY} AS k, {_layouts(_TEXT)} AS text FROM customer")
def strip_boilerplate_table(spark, sf_dir):
    rows = I.strip_boilerplate(I.node_table(_press(spark, sf_dir), ["k"]), ["k"])
    return I.element_texts(rows, ["k"], F.col("node.kind") == "document").select("k", "text")


def _each(tag, pattern):
    return (
        f"SELECT page_id, '{tag}' AS tag, n, {page_text_sql('part')} AS text FROM (SELECT page_id, "
        f"unnest(parts) AS part, CAST(generate_subscripts(parts, 1) AS INT) AS n FROM "
        f"(SELECT page_id, regexp_extract_all(html, '{pattern}', 1, 's') AS parts FROM pages))"
    )


@query("element_texts", " UNION ALL ".join(
    _each(*t) for t in (("nav", "<nav>(.*?)</nav>"), ("li", "<li>(.*?)</li>"), ("a", "<a [^>]*>(.*?)</a>"),
                        ("h1", "<h1>(.*?)</h1>"), ("article", "<article>(.*)</article>"))
))
def element_texts(spark, sf_dir):
    """Texts of all articles, headings, menus, their items and links: elements in elements."""
    parsed = spread(D.read(spark, sf_dir, "pages").select("page_id", "html"))
    rows = I.node_table(parsed.withColumn("nodes", html_nodes(F.col("html"))), ["page_id"])
    asked = N.is_tag("nav", "li", "a", "h1", "article")(F.col("node"))
    number = F.row_number().over(W.partitionBy("page_id", "tag").orderBy("ord"))
    return I.element_texts(rows, ["page_id"], asked).select("page_id", "tag", number.alias("n"), "text")


_WORD = {1: ("広報担当", 4), 2: ("問い合わせ先", 7), 3: ("連絡先", 12), 4: ("Contact", 14)}


@query(
    "label_nodes",
    f"""SELECT {_KEY} AS k, {_layouts({i: lit(w) for i, (w, _) in _WORD.items()})} AS word,
        CAST({_layouts({i: str(r) for i, (_, r) in _WORD.items()}, '0')} AS INT) AS rank
        FROM customer WHERE {_V} IN (1, 2, 3, 4)""",
)
def label_nodes(spark, sf_dir):
    labels = R.label_nodes(F.col("nodes"), F.col("area"))
    found = N.rows_of(_area(_press(spark, sf_dir)), labels, item="label")
    return found.select("k", "label.word", "label.rank")


@query("contact_section", f"SELECT {_KEY} AS k, {_layouts(_SECTION_TEXT)} AS text FROM customer")
def contact_section(spark, sf_dir):
    found = _area(_press(spark, sf_dir)).withColumn(
        "section", R.contact_section(F.col("nodes"), F.col("area"))
    )
    return found.select("k", _text_of(F.col("section")).alias("text"))


@query(
    "contact_table",
    f"SELECT {_KEY} AS k, CASE {_KEY} % 3 WHEN 0 THEN '連 絡 先 K' || cast({_KEY} as string) "
    "ELSE '' END AS text FROM customer",
)
def contact_table(spark, sf_dir):
    parsed = D.table_articles(spark, sf_dir).withColumn("nodes", html_nodes(F.col("html")))
    found = _area(parsed).withColumn("table", R.contact_table(F.col("nodes"), F.col("area")))
    return found.select("k", _text_of(F.col("table")).alias("text"))


@query(
    "choose_text",
    f"SELECT {_KEY} AS k, {_layouts({**_AREA_TEXT, **_SECTION_TEXT})} AS text FROM customer",
)
def choose_text(spark, sf_dir):
    n, area = F.col("nodes"), F.col("area")
    found = _area(_press(spark, sf_dir)).withColumns(
        {"section": R.contact_section(n, area), "table": R.contact_table(n, area)}
    )
    return found.select(
        "k", R.choose_text(n, F.col("section"), F.col("table"), area).alias("text")
    )


# --- candidates -----------------------------------------------------------------------

_CELL = f"'No ' || cast({_KEY} as string)"


@query(
    "table_pairs",
    f"""SELECT {_KEY} AS k, label, value, CAST(pos AS INT) AS pos FROM (
        SELECT {_KEY}, 0 AS pos, {_CELL} AS label, {_PH} AS value FROM customer WHERE {_KEY} % 3 < 2
        UNION ALL SELECT {_KEY}, 1, '連絡先', 'K' || cast({_KEY} as string) FROM customer WHERE {_KEY} % 3 = 0
        UNION ALL SELECT {_KEY}, 0, 'a', '電話' || {_PH} FROM customer WHERE {_KEY} % 3 = 2
        UNION ALL SELECT {_KEY}, 1, '電話' || {_PH}, '電話' FROM customer WHERE {_KEY} % 3 = 2
        UNION ALL SELECT {_KEY}, unnest([2, 3, 4]), '電話', {_PH} FROM customer WHERE {_KEY} % 3 = 2)""",
)
def table_pairs(spark, sf_dir):
    parsed = D.table_articles(spark, sf_dir).withColumn("nodes", html_nodes(F.col("html")))
    pairs = N.rows_of(parsed, C.table_pairs(F.col("nodes")), item="pair")
    return pairs.select("k", "pos", "pair.label", "pair.value")


_PHONE_CANDIDATES = {0: _PH, 1: f"'電話番号:' || {_PH}", 5: _PH}
_EMAIL_CANDIDATES = {
    0: _EM,
    1: _EM,
    7: f"'desk@newswire.example ' || {_EM}",
}


def _listed(spark, sf_dir):
    n = F.col("nodes")
    return _press(spark, sf_dir).withColumns(
        {"pairs": C.table_pairs(n), "items": C.list_items(n), "bold": C.after_bold_labels(n)}
    )


_PARTS = {
    0: f"'Email=' || {_EM} || '|TEL=' || {_PH}",
    1: f"'電話番号:' || {_PH} || '|' || replace({_EM}, '@', '[at]')",
    5: _PH,
    7: f"'desk@newswire.example ' || {_EM}",
}


@query("merge_candidates", f"SELECT {_KEY} AS k, {_layouts(_PARTS)} AS merged FROM customer")
def merge_candidates(spark, sf_dir):
    pairs = F.transform("pairs", lambda p: F.concat(p.label, F.lit("="), p.value))
    merged = C.merge_candidates(F.array_sort(pairs), F.col("items"), F.col("bold"))
    return _listed(spark, sf_dir).select("k", F.array_join(merged, "|").alias("merged"))


@query(
    "email_candidates",
    f"SELECT {_KEY} AS k, {_layouts(_EMAIL_CANDIDATES)} AS candidates FROM customer",
)
def email_candidates(spark, sf_dir):
    found = C.email_candidates(F.col("pairs"), F.col("items"))
    return _listed(spark, sf_dir).select("k", F.array_join(found, "|").alias("candidates"))


@query(
    "phone_candidates",
    f"SELECT {_KEY} AS k, {_layouts(_PHONE_CANDIDATES)} AS candidates FROM customer",
)
def phone_candidates(spark, sf_dir):
    found = C.phone_candidates(F.col("pairs"), F.col("items"), F.col("bold"))
    return _listed(spark, sf_dir).select("k", F.array_join(found, "|").alias("candidates"))


@query(
    "email_pick_structural",
    f"SELECT {_KEY} AS k, {_layouts({i: _EM for i in (0, 1, 7)})} AS email FROM customer",
)
def email_pick_structural(spark, sf_dir):
    found = C.email_candidates(F.col("pairs"), F.col("items"))
    return _listed(spark, sf_dir).select("k", K.email_pick_structural(found).alias("email"))


def _structural_phone_sql(text: str) -> str:
    found = ", ".join(f"regexp_extract_all({text}, {rx(p)}, 1)" for p in P.PHONE_PATTERNS)
    return (
        f"coalesce(list_filter(list_transform(flatten([{found}]), lambda m: {phone_sql('m')}), "
        f"lambda n: {valid_phone_sql('n')})[1], '')"
    )


@query(
    "phone_pick_structural",
    f"""SELECT {_KEY} AS k, {_structural_phone_sql(f"'電話: ' || {D.phone_spelling_sql(_KEY)}")} AS spelled,
        {_layouts({i: _PH for i in (0, 1, 5)})} AS phone FROM customer""",
)
def phone_pick_structural(spark, sf_dir):
    found = C.phone_candidates(F.col("pairs"), F.col("items"), F.col("bold"))
    spelled = F.concat(F.lit("電話: "), F.expr(D.phone_spelling_sql("k")))
    return _listed(spark, sf_dir).select(
        "k",
        K.phone_pick_structural(F.array(spelled)).alias("spelled"),
        K.phone_pick_structural(found).alias("phone"),
    )


@query(
    "last_resort",
    f"SELECT {_KEY} AS k, {_layouts({4: _EM})} AS email, {_layouts({4: _PH})} AS phone "
    f"FROM customer WHERE {_V} = 4",
)
def last_resort(spark, sf_dir):
    picked = X.with_fields(X.with_candidates(X.with_regions(_press(spark, sf_dir))))
    empty = X.fenced(picked, ["k", "nodes"]).filter("email = '' AND phone = '' AND person = ''")
    return X.with_last_resort(empty).select("k", "email", "phone")


# --- records --------------------------------------------------------------------------

EXPECTED = columns(D.expected_sql(_KEY))
_RECORDS = f"SELECT {_KEY} AS k, {D.url_sql(_KEY)} AS url, {EXPECTED} FROM customer"


def press_contacts(spark, sf_dir):
    return X.extract_contacts(D.press_articles(spark, sf_dir))


@query("extract_contacts", _RECORDS)
def extract_contacts(spark, sf_dir):
    return press_contacts(spark, sf_dir)


# The given pages have one article each, no tables, no contact words and no Japanese, so
# their records follow from the article's text and the first list items' labels.
_PAGE_RECORDS = f"""WITH t AS (
        SELECT url, {page_text_sql(ARTICLE)} AS text,
            {page_text_sql("regexp_extract(html, '<body>(.*)</body>', 1, 's')")} AS page_text FROM pages),
    d AS (SELECT *, {decode_sql('text')} AS decoded FROM t),
    e AS (SELECT *, CASE WHEN {CONTEXT_SQL} <> '' THEN {CONTEXT_SQL}
            ELSE {first_email_sql('decoded', _BLOCKED)} END AS found_email,
            CASE WHEN {labelled_phone_sql('text')} <> '' THEN {labelled_phone_sql('text')}
            ELSE {contact_phone_sql('text')} END AS found_phone FROM d)
    SELECT url, '' AS company, '' AS person,
        CASE WHEN found_email = '' AND found_phone = '' THEN regexp_extract(page_text, {rx(P.EMAIL_ASCII)})
        ELSE found_email END AS email, found_phone AS phone FROM e"""


@query("extract_contacts_pages", _PAGE_RECORDS)
def extract_contacts_pages(spark, sf_dir):
    return X.extract_contacts(_pages(spark, sf_dir))


def _pages(spark, sf_dir):
    return spread(D.read(spark, sf_dir, "pages").select("url", "html"))


@query("extract_contacts_stream", _PAGE_RECORDS)
def extract_contacts_stream(spark, sf_dir):
    """The same pages through a file stream that stops when all are read."""
    out, state = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_state")
    pages = landed_pages(
        spark, f"{sf_dir}/pages.parque[t]", "page_id bigint, url string, html string"
    )
    stream_contacts(pages.drop("page_id"), out, state).awaitTermination()
    return spark.read.schema("url string, company string, person string, email string, phone string").parquet(out)


# --- sinks ----------------------------------------------------------------------------

_FLAT = "url string, company string, person string, email string, phone string"


def _press_records(spark, sf_dir):
    return press_contacts(spark, sf_dir).drop("k")


@query("write_contacts_csv", f"SELECT {D.url_sql(_KEY)} AS url, {EXPECTED} FROM customer")
def write_contacts_csv(spark, sf_dir):
    records = stored(_press_records(spark, sf_dir), scratch_path(spark, "records"))
    path = sinks.write_contacts_csv(records, scratch_path(spark, "csv"))
    back = spark.read.schema(_FLAT).csv(path, header=True, escape='"', multiLine=True)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("write_contacts_table", f"SELECT {D.url_sql(_KEY)} AS url, {EXPECTED} FROM customer")
def write_contacts_table(spark, sf_dir):
    records = stored(_press_records(spark, sf_dir), scratch_path(spark, "records"))
    return spark.read.schema(_FLAT).parquet(
        sinks.write_contacts_table(records, scratch_path(spark, "table"))
    )
