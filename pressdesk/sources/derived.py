"""News-release pages, search results and phone spellings derived from the given tables.

The tables hold no Japanese pages, so the rules are run on pages made of customer and
order rows. Every expression is plain SQL that Spark and the SQL check both accept; the
expected values follow from the row, so the check needs no HTML parser. All personal data
is invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

BASE = "https://newswire.example"

_K = "cast({k} as string)"


def phone_sql(k: str) -> str:
    return (
        f"'03-' || lpad(cast({k} % 10000 as string), 4, '0') || '-' "
        f"|| lpad(cast(({k} * 7) % 10000 as string), 4, '0')"
    )


def wide_phone_sql(k: str) -> str:
    return f"translate({phone_sql(k)}, '0123456789-', '０１２３４５６７８９－')"


def email_sql(k: str) -> str:
    return f"'pr' || {_K.format(k=k)} || '@ex' || cast({k} % 5 as string) || '.co.jp'"


def company_sql(k: str) -> str:
    return f"'株式会社K' || {_K.format(k=k)}"


def person_sql(k: str) -> str:
    return (
        f"CASE {k} % 4 WHEN 0 THEN '山田太郎' WHEN 1 THEN '佐藤花子' "
        "WHEN 2 THEN '鈴木一郎' ELSE '高橋次郎' END"
    )


def url_sql(k: str) -> str:
    return f"'{BASE}/rd/p/' || {_K.format(k=k)} || '.html'"


def press_html_sql(k: str) -> str:
    ph, phw, em, co, pe = (
        f"({f(k)})" for f in (phone_sql, wide_phone_sql, email_sql, company_sql, person_sql)
    )
    bodies = {
        0: f"'<html><body><div class=\"release-company\">' || {co} || '</div><article><table>"
           f"<tr><th>TEL</th><td>' || {ph} || '</td></tr><tr><th>Email</th><td>' || {em} || "
           f"'</td></tr></table><p>担当：' || {pe} || '</p></article></body></html>'",
        1: f"'<html><head><meta property=\"og:site_name\" content=\"' || {co} || 'のプレスリリース\">"
           f"</head><body><article><ul><li>電話番号：' || {ph} || '</li><li>' || "
           f"replace({em}, '@', '[at]') || '</li></ul><p>広報担当：' || {pe} || "
           f"'</p></article></body></html>'",
        2: f"'<html><body><article><div>【お問い合わせ先】' || {co} || ' 担当：' || {pe} || "
           f"' TEL：' || {phw} || ' Email：' || replace(replace({em}, '@', '(at)'), '.', '(dot)') || "
           f"'</div></article></body></html>'",
        3: f"'<html><body><header>TEL 03-9999-9999</header><div class=\"sidebar\">x</div><div>"
           f"<p>連絡先：' || {pe} || '</p><p>TEL ' || {ph} || '</p></div>"
           f"<footer><p>Contact Copyright NEWSWIRE</p></footer></body></html>'",
        4: f"'<html><body><article><p>Contact</p></article><div>TEL ' || {ph} || ' ' || {em} || "
           f"'</div></body></html>'",
        5: f"'<html><body><a class=\"link-to-company x\">' || {co} || '</a><article><p><strong>Tel"
           f"</strong>' || {ph} || '</p></article></body></html>'",
        6: f"'<html><body><article><p>Mail: private' || {_K.format(k=k)} || '@ex' || "
           f"cast({k} % 5 as string) || '.co.jp</p></article></body></html>'",
        7: f"'<html><body><article><ul><li>desk@newswire.example ' || {em} || "
           f"'</li></ul></article></body></html>'",
    }
    branches = " ".join(f"WHEN {i} THEN {body}" for i, body in bodies.items() if i < 7)
    return f"CASE {k} % 8 {branches} ELSE {bodies[7]} END"


def expected_sql(k: str) -> dict[str, str]:
    """The contact record that the rules yield for the page of ``k``."""
    v = f"{k} % 8"
    return {
        "company": f"CASE WHEN {v} IN (0, 1, 2, 5) THEN {company_sql(k)} ELSE '' END",
        "person": f"CASE WHEN {v} IN (0, 1, 2, 3) THEN {person_sql(k)} ELSE '' END",
        "email": f"CASE WHEN {v} IN (0, 1, 2, 4, 7) THEN {email_sql(k)} "
                 f"WHEN {v} = 6 THEN 'e' || {_K.format(k=k)} || '@ex' || cast({k} % 5 as string) "
                 f"|| '.co.jp' ELSE '' END",
        "phone": f"CASE WHEN {v} IN (0, 1, 2, 4, 5) THEN {phone_sql(k)} ELSE '' END",
    }


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that pages are made of; they are dealt out first, as keys are small and pages are not."""
    return spread(read(spark, sf_dir, "customer").select("c_custkey"))


def press_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``press_articles(k, url, html)``: one page per customer, in eight layouts."""
    return customer_keys(spark, sf_dir).selectExpr(
        "c_custkey AS k", f"{url_sql('c_custkey')} AS url", f"{press_html_sql('c_custkey')} AS html"
    )


def search_link_columns(div: str) -> dict[str, str]:
    """Links of search pages, one per order; ``div`` is the engine's integer division."""
    form = f"(o_orderkey {div} 7) % 4"
    path = "'rd/p/' || cast(o_custkey % 400 as string) || '.html'"
    return {
        "keyword": "o_orderpriority",
        "page_no": "cast(o_orderkey % 7 as int)",
        "status": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 3 THEN 500 ELSE 200 END",
        "pos": "o_orderkey",
        "href": f"CASE {form} WHEN 0 THEN '/' || {path} WHEN 1 THEN '{BASE}/' || {path} "
                f"WHEN 2 THEN {path} ELSE '/company/' || cast(o_custkey as string) END",
    }


def search_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = search_link_columns("div")
    return read(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def search_page_columns(div: str) -> dict[str, str]:
    """Search pages, one per order: seven pages per keyword, some bad, some without links."""
    number = "cast(o_custkey % 50 as string)"
    links = (
        f"'<a href=\"/rd/p/' || {number} || '.html\">a</a> <a href=\"/company/7\">b</a>"
        f"<a class=\"x\" href=\"rd/p/1' || {number} || '.html\">c</a><p><a href=\"{BASE}/rd/p/' || "
        f"{number} || '.html\">d</a>'"
    )
    return {
        "keyword": f"'語 ' || cast(o_orderkey {div} 7 as string)",
        "page_no": "cast(o_orderkey % 7 as int)",
        "status": "CASE WHEN o_orderkey % 11 = 4 THEN 500 ELSE 200 END",
        "html": "'<html><body><ul><li>' || CASE WHEN o_orderkey % 13 = 5 THEN 'no hits' "
                f"ELSE {links} END || '</li></ul></body></html>'",
    }


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = search_page_columns("div")
    return read(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered keyword list with repeats: every part's name at its part key."""
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).selectExpr(
        "cast(p_partkey as int) AS kw_pos", "p_name AS keyword"
    )


def table_html_sql(k: str) -> str:
    """Pages with tables: a contact word split over tags, none at all, or in a nested table."""
    cell = f"'<tr><td>No ' || {_K.format(k=k)} || '</td><td>' || {phone_sql(k)} || '</td></tr>'"
    return (
        f"CASE {k} % 3 WHEN 0 THEN '<main><table>' || {cell} || '</table><table><tr><th>連<i>絡</i>先</th>"
        f"<td>K' || {_K.format(k=k)} || '</td></tr></table></main>' "
        f"WHEN 1 THEN '<main><table>' || {cell} || '</table></main>' "
        f"ELSE '<main><table><tr><td>a</td><td><table><tr><td>電<b>話</b></td><td>' || {phone_sql(k)} "
        f"|| '</td></tr></table></td></tr></table><p>x' || {_K.format(k=k)} || '</p></main>' END"
    )


def table_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_keys(spark, sf_dir).selectExpr(
        "c_custkey AS k", f"{table_html_sql('c_custkey')} AS html"
    )


def phone_spelling_sql(k: str) -> str:
    """Phone numbers in ten spellings, good and bad."""
    n = f"lpad(cast(({k} * 7919) % 100000000 as string), 8, '0')"
    return (
        f"CASE {k} % 10 WHEN 0 THEN {phone_sql(k)} WHEN 1 THEN {wide_phone_sql(k)} "
        f"WHEN 2 THEN '(03) ' || substr({n}, 1, 4) || '-' || substr({n}, 5, 4) "
        f"WHEN 3 THEN '03' || {n} WHEN 4 THEN '090' || {n} WHEN 5 THEN '01' || {n} "
        f"WHEN 6 THEN '+81 3 ' || {n} WHEN 7 THEN '--0120--' || substr({n}, 1, 6) || '-' "
        f"WHEN 8 THEN '１２３' || {n} ELSE '03 ' || substr({n}, 1, 5) || ' ext.' END"
    )


def person_spelling_sql(k: str) -> str:
    """Names and things that are not names."""
    return (
        f"CASE {k} % 7 WHEN 0 THEN {person_sql(k)} WHEN 1 THEN '営業部' WHEN 2 THEN '株式会社' "
        f"WHEN 3 THEN '林' WHEN 4 THEN '広報チーム' WHEN 5 THEN '山田 太郎' ELSE '一二三四五六七八九十百' END"
    )


def contact_text_sql(k: str) -> str:
    """Release text with contact headings of every kind, some over several lines."""
    pe, ph, co, key = person_sql(k), phone_sql(k), company_sql(k), _K.format(k=k)
    nl = "chr(10)"
    return (
        f"CASE {k} % 6 WHEN 0 THEN '概要 ' || {co} || ' 【お問い合わせ先】広報担当：' || {pe} || "
        f"' TEL：' || {ph} || ' 【その他】' || {key} "
        f"WHEN 1 THEN '■連絡先' || {nl} || {pe} || ' 様 ' || {ph} || '■' || {key} "
        f"WHEN 2 THEN '▼広報 ' || {pe} || '▼' || {nl} || '●問合せ' || {nl} || {ph} || '●' || {key} "
        f"WHEN 3 THEN '＜問い合わせ＞ご担当: 営業部 責任者：' || {pe} || '＜' || {key} "
        f"WHEN 4 THEN '担当者：株式会社 PR担当: ' || {pe} || ' Contact us at ' || {ph} || '。' || {key} "
        f"ELSE '広報の連絡先は' || {key} || 'です。TEL ' || {ph} || ' 山田 太郎 まで' END"
    )


def contact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_keys(spark, sf_dir).selectExpr(
        "c_custkey AS k", f"{contact_text_sql('c_custkey')} AS text"
    )


def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of ``search_links`` in order of first use, the first letter 1 and 5 twice."""
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        {"o_orderkey": "min"}
    ).selectExpr(
        "o_orderpriority AS keyword", "cast(`min(o_orderkey)` as int) AS first_pos"
    ).selectExpr(
        "keyword",
        "explode(CASE WHEN keyword LIKE '1%' OR keyword LIKE '5%' "
        "THEN array(first_pos, first_pos + 1000) ELSE array(first_pos) END) AS kw_pos",
    )
