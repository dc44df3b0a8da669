"""The node table against the array form."""

import time

import pytest
from pyspark.sql import functions as F
from test_extract import PAGES

from pressdesk.operators import intervals as I
from pressdesk.operators import nodes as N
from pressdesk.operators import regions as R
from pressdesk.operators.html import html_nodes

KEY = ["name"]
MORE = {
    "none": None, "empty": "", "text": "only text", "nested": "<b>a<b>b<b> c </b></b>d</b><b></b>",
    "menus in menus": "<body><nav>a<nav>b</nav><footer>c</footer></nav>d<div class='menu'><header>e</header></div>f</body>",
    "header outside": "<header>a</header><body class='nav'>b<header>c</header></body>d<nav>e</nav>",
    "two bodies": "<body>a<nav>b</nav></body><body>c<nav>d</nav></body>",
    "area": "<body><nav>a</nav><main>b<nav>c</nav></main></body>",
    "hidden": "<p>a<script>b</script><!-- c --><style>d</style>e <i> \n</i></p>",
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = {**{n: p[0] for n, p in PAGES.items()}, **MORE}
    pages = spark.createDataFrame(list(texts.items()), "name string, html string").repartition(5)
    return pages.withColumn("nodes", html_nodes(F.col("html"))).drop("html").cache()


def array_texts(df, asked):
    found = N.rows_of(df, N.find_all(F.col("nodes"), asked), "_pos", "el")
    return found.select("name", "el.ord", "el.tag", F.coalesce(N.element_text(F.col("nodes"), F.col("el")), F.lit("")).alias("text"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_texts_of_nested_elements(parsed):
    every = lambda n: n.kind.isin("element", "document")
    expected = rows(array_texts(parsed, every))
    assert len(expected) > 500
    assert rows(I.element_texts(I.node_table(parsed, KEY), KEY, every(F.col("node")))) == expected
    some = N.is_tag("b", "td", "p", "body")
    assert rows(I.element_texts(I.node_table(parsed, KEY), KEY, some(F.col("node")))) == rows(array_texts(parsed, some))


def test_boilerplate(parsed):
    n = F.col("nodes")
    found = parsed.withColumns({"main": R.main_content(n), "body": R.page_body(n)})
    stripped = found.withColumn("nodes", R.strip_boilerplate(n, F.col("main"), F.col("body")))
    left = N.rows_of(stripped, n, "_pos", "node").filter(F.col("node.kind") != "gone").select("name", "node.ord")
    before = N.rows_of(parsed, n, "_pos", "node").count()
    expected = rows(left)
    assert len(expected) < before
    assert rows(I.strip_boilerplate(I.node_table(parsed, KEY), KEY).select("name", "node.ord")) == expected


def test_one_exchange(parsed):
    """Both steps work on pages that are brought together once."""
    stripped = I.strip_boilerplate(I.node_table(parsed, KEY), KEY)
    texts = I.element_texts(stripped, KEY, N.is_tag("p")(F.col("node")))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning") == 1


def test_large_page(spark):
    """A page of 100,000 nodes, each element of it asked for, in elements that nest."""
    n = 25_000
    html = "<body>" + "".join(f"<div><nav>m</nav><p>t{i}</p></div>" for i in range(n // 5)) + "</body>"
    html += "<ul>" + "".join(f"<li>u{i}</li>" for i in range(n + n // 2)) + "</ul>"
    page = spark.createDataFrame([("x", html)], "name string, html string")
    table = I.node_table(page.withColumn("nodes", html_nodes(F.col("html"))), KEY).cache()
    assert table.count() >= 100_000
    start = time.monotonic()
    stripped = I.strip_boilerplate(table, KEY)
    got = {r.ord: r.text for r in I.element_texts(stripped, KEY, F.col("node.kind") == "element").collect()}
    assert time.monotonic() - start < 60
    assert got[1] == " ".join(f"t{i}" for i in range(n // 5))
    assert len(got) == 1 + n // 5 * 2 + 1 + n + n // 2
    assert "m" not in got.values() and f"u{n}" in got.values()
