"""Tree shape and node functions."""

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressdesk.functions.text import let
from pressdesk.operators import html as H
from pressdesk.operators import nodes as N
from pressdesk.operators.html import html_nodes, parse_pages


def tree(html):
    """Nested lists of (tag, children) and texts."""
    [nodes] = parse_pages([html]).to_pylist()
    children = {n["ord"]: [] for n in nodes}
    for n in nodes[1:]:
        item = (n["tag"], children[n["ord"]]) if n["kind"] == "element" else (
            n["text"] if n["kind"] == "text" else f"{n['kind']}:{n['text']}")
        children[n["parent"]].append(item)
    return children[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<p>b</p>c</p>d", [("p", ["a", ("p", ["b"]), "c"]), "d"]),
        ("<ul><li>a<li>b</ul>c", [("ul", [("li", ["a", ("li", ["b"])])]), "c"]),
        ("<div><b>a</div>c", [("div", [("b", ["a"])]), "c"]),
        ("a</p></div>b", ["a", "b"]),
        ("<br>a<br></br>b", [("br", []), "a", ("br", []), "b"]),
        ("<img src=x/>a", [("img", []), "a"]),
        ("<div/>a", [("div", []), "a"]),
        ("<br>a<br/>b", [("br", []), "a", ("br", ["b"])]),
        ("<P CLASS=X>a</P>", [("p", ["a"])]),
        ("<b> \n </b>", [("b", ["\n"])]),
        ("<b>   </b>", [("b", [" "])]),
        ("<b>　 </b>", [("b", ["　 "])]),
        ("<pre>  \n </pre>", [("pre", ["  \n "])]),
        ("<script>a<b>c</script>d", [("script", ["script:a<b>c"]), "d"]),
        ("<style>p{}</style>", [("style", ["style:p{}"])]),
        ("<ruby>a<rt>b<i>c</i></rt></ruby>", [("ruby", ["a", ("rt", ["ruby:b", ("i", ["ruby:c"])])])]),
        ("<template>a</template>b", [("template", ["template:a"]), "b"]),
        ("a<!-- c -->b", ["a", "comment: c ", "b"]),
        ("<!DOCTYPE html>a", ["doctype:html", "a"]),
        ("<?pi x>a", ["pi:pi x", "a"]),
        ("a&amp;b&#x41;&#64;&nope;&copy;", ["a&bA@&nope©"]),
        ("&#147;&#55296;&#0;", ["“�\x00"]),
        ("", []),
    ],
)
def test_tree(html, expected):
    assert tree(html) == expected


def test_intervals_and_blocks():
    [nodes] = parse_pages(["<div><p>a<b>b</b></p><span>c</span></div>d"]).to_pylist()
    assert [n["ord"] for n in nodes] == list(range(len(nodes)))
    by_tag = {n["tag"]: n for n in nodes if n["tag"]}
    assert (by_tag["div"]["end_ord"], by_tag["p"]["end_ord"]) == (7, 5)
    assert {n["text"]: n["block"] for n in nodes if n["kind"] == "text"} == {
        "a": by_tag["p"]["ord"], "b": by_tag["p"]["ord"], "c": by_tag["div"]["ord"], "d": None}


def test_attributes_and_classes():
    [nodes] = parse_pages(['<a class="x  y\tx" HREF="/a?b&amp;c" disabled class="z q">t</a>']).to_pylist()
    assert dict(nodes[1]["attrs"]) == {"class": "z q", "href": "/a?b&c", "disabled": ""}
    assert nodes[1]["classes"] == ["z", "q"]


def test_unreadable_pages_leave_their_neighbours_alone():
    pages = ["<b class=x>a</b>", None, "<i id=1>x</i><![broken[", "<u id=2>b</u>"]
    parsed = parse_pages(pages).to_pylist()
    assert [len(p) for p in parsed] == [3, 0, 0, 3]
    assert dict(parsed[3][1]["attrs"]) == {"id": "2"} and parsed[3][1]["classes"] == []


@pytest.fixture(scope="module")
def page(spark):
    def build(html):
        return spark.createDataFrame([(html,)], "html string").select(html_nodes(F.col("html")).alias("nodes"))

    return build


@pytest.fixture(scope="module")
def n(spark):
    return F.col("nodes")


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<b>x</b><p>a</p>", "<p>a</p>"),
        ('<b>x</b><a z="1" class=" q  r " b=\'"\'>t&lt;&amp;</a>', "<a b='\"' class=\"q r\" z=\"1\">t&lt;&amp;</a>"),
        ("<b>x</b><div>a<br><i>b<u></u></i>c<!--d--></div>", "<div>a<br/><i>b<u></u></i>c<!--d--></div>"),
        ("<b>x</b><div><p><i>deep</i></p></div>tail", "<div><p><i>deep</i></p></div>"),
        ("<b>x</b><script>a&&b</script>", "<script>a&&b</script>"),
        ("<b>x</b><img src=y>", '<img src="y"/>'),
    ],
)
def test_markup_of_next_sibling(page, n, html, expected):
    bold = N.find_first(n, N.is_tag("b"))
    sibling = let(bold, lambda b: N.next_sibling(n, b))
    [row] = page(html).withColumn("sibling", sibling).select(N.markup(n, F.col("sibling"))).collect()
    assert row[0] == expected


def test_next_sibling_skips_removed_nodes(page, n):
    html = "<body><b>x</b><nav>n</nav><p>a<nav>m</nav>b</p></body>"
    found = page(html).withColumn("body", N.find_first(n, N.is_tag("body")))
    found = found.withColumn("nodes", N.remove_nodes(n, F.col("body"), N.is_tag("nav")))
    sibling = let(N.find_first(n, N.is_tag("b")), lambda b: N.next_sibling(n, b))
    [row] = found.withColumn("s", sibling).select(N.markup(n, F.col("s"))).collect()
    assert row[0] == "<p>ab</p>"


def test_texts(page, n):
    html = "<div> a <b>b　</b><!--c--><script>d</script><i> </i>e\n</div>"
    div = F.col("div")
    found = page(html).withColumn("div", N.find_first(n, N.is_tag("div")))
    [row] = found.select(
        N.element_text(n, div), N.element_text(n, div, ""), N.plain_text(n, div)
    ).collect()
    assert tuple(row) == ("a b e", "abe", " a b　 e\n")


def test_normal_text_over_borders(spark):
    """Pieces that combine over tags: NFKC of the whole text, as Python has it."""
    r = random.Random(4)
    pieces = ["か", "\u3099", "ﾊ", "\uff9f", "e", "\u0301", "\u0323", "\u1100", "\u1161", "\u11a8", "①", "ＴＥＬ", "㈱", "y", "x"]
    cells = [["".join(r.choices(pieces, k=r.randint(1, 3))) for _ in range(r.randint(1, 5))] for _ in range(300)]
    whole = ["".join(cell) for cell in cells]
    html = [f"<td>{cell[0]}" + "".join(f"<i>{c}</i>" for c in cell[1:]) + "</td>" for cell in cells]
    rows = spark.createDataFrame(list(zip(html, whole)), "html string, whole string").withColumn("nodes", html_nodes(F.col("html")))
    n = F.col("nodes")
    got = rows.select("whole", N.normal_text(n, F.get(n, F.lit(1))).alias("t")).collect()
    assert [x.t for x in got] == [unicodedata.normalize("NFKC", x.whole) for x in got]


def test_normal_text_without_removed_parts(spark):
    html = "<body><div><table><tr><td>Ａ<nav>Ｂ</nav>Ｃ<i>か</i><i>\u3099</i></td></tr></table></div></body>"
    rows = spark.createDataFrame([(html,)], "html string").withColumn("nodes", html_nodes(F.col("html")))
    body = N.find_first(F.col("nodes"), N.is_tag("body"))
    cut = rows.withColumn("nodes", N.remove_nodes(F.col("nodes"), body, N.is_tag("nav")))
    cell = N.find_first(F.col("nodes"), N.is_tag("td"))
    assert rows.select(N.normal_text(F.col("nodes"), cell)).first()[0] == "ABCが"
    assert cut.select(N.normal_text(F.col("nodes"), cell)).first()[0] == "ACか\u3099"


# --- plain tokens and portions -------------------------------------------------------------

PARTS = [
    "<p>", "</p>", "<P CLASS=\"a B\">", "<div id=\"1\"\n class=\"x>y\">", "</div>", "<br>", "<br/>", "<br />", "</br>", "<a href=\"/x?a=1&amp;b=2\">",
    "<a href='q'>", "<a href=x>", "</a>", "<a b=\"1\" b=\"2\" C>", "text ", "\u3000Ｔ", " ", "\n", "&amp;", "&lt;", "&nope;", "&amp", "&#65;", "&#x42;", "&",
    "<", ">", "< p>", "</p >", "</ p>", "<!-- c -->", "<!doctype html>", "<![CDATA[x]]>", "<?pi?>", "<script>a<b</script>", "<title>t &amp; u</title>",
    "<style>p{}</style>", "<textarea> <p> </textarea>", "<table><tr><td>e\u0301</td></tr></table>", "<x-y>", "<a:b>", "<p", "</p", "<a href=\"", "<ruby>a<rt>b</rt></ruby>",
    "<li\x0bclass=\"v\">", "<pre> </pre>", "<noscript><p>n</p></noscript>", "<plaintext>", "<b/ >", "<i//>", "<i class=\"a\"id=\"b\">",
]


def test_plain_tokens_read_as_the_tokenizer_reads_them(monkeypatch):
    rng = random.Random(5)
    plain = PARTS[:7] + PARTS[14:18]
    pages = ["".join(rng.choices(PARTS if n % 2 else plain + rng.choices(PARTS, k=2), k=rng.randrange(1, 25))) for n in range(6000)] + PARTS
    fast = H.parse_pages(pages)
    monkeypatch.setattr(H._PageReader, "_read_plain", lambda self, html: 0)
    slow = H.parse_pages(pages)
    for page, a, b in zip(pages, fast.to_pylist(), slow.to_pylist(), strict=True):
        assert a == b, page


def test_portions_hold_a_bounded_number_of_bytes_and_every_page():
    pages = pa.array(["x" * 300_000, None, "é" * 400_000, "", "y" * 5_000_000, "z", "z" * 600_000, "z" * 600_000])
    parts = list(H.portions(pages))
    assert [p for part in parts for p in part.to_pylist()] == pages.to_pylist()
    sizes = [[len((p or "").encode()) for p in part.to_pylist()] for part in parts]
    assert all(sum(s) <= H.PORTION or len(s) == 1 for s in sizes) and len(parts) >= 4
    assert list(H.portions(pa.array([], pa.string()))) == []
