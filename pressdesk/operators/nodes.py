"""Column functions on the node array of a page.

``nodes[i].ord = i``, so a subtree is the slice after the node up to its ``end_ord``: its
cost is its own size, not the page's. Nodes taken out of a page keep their place with
``kind = 'gone'``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first, let, ustrip, word_list
from .html import VOID_TAGS

Predicate = Callable[[Column], Column]


def rows_of(df: DataFrame, items: Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per item of an array made from the node array, with its position.

    A plain explode makes the optimizer test the array for emptiness first, below the
    columns it comes from: the pages would be parsed twice.
    """
    exploded = df.select("*", F.posexplode_outer(items).alias(pos, item))
    return exploded.filter(F.col(pos).isNotNull())


def is_tag(*tags: str) -> Predicate:
    """Elements with one of these tags. Only elements carry a tag that can match."""
    if len(tags) == 1:
        return lambda n: (n.tag == tags[0]) & (n.kind == "element")
    return lambda n: F.array_contains(word_list(tags), n.tag) & (n.kind == "element")


def has_class(token: str) -> Predicate:
    return lambda n: F.array_contains(n.classes, token) & (n.kind == "element")


def has_class_matching(pattern: str) -> Predicate:
    return lambda n: F.exists(n.classes, lambda c: c.rlike(pattern)) & (n.kind == "element")


def is_text(n: Column) -> Column:
    """Readable text: not comments, scripts, styles, ruby or templates."""
    return n.kind.isin("text", "cdata")


def is_string(n: Column) -> Column:
    """Any text node, readable or not."""
    return ~n.kind.isin("element", "document", "gone")


def find_first(nodes: Column, predicate: Predicate) -> Column:
    """The first node in document order, NULL when there is none."""
    return first(F.filter(nodes, predicate))


def find_all(nodes: Column, predicate: Predicate) -> Column:
    return F.filter(nodes, predicate)


def descendants(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node.ord + 2, node.end_ord - node.ord)


def find_below(nodes: Column, node: Column, predicate: Predicate) -> Column:
    return F.filter(descendants(nodes, node), predicate)


def plain_text(nodes: Column, node: Column) -> Column:
    """All text of a subtree, put together as it is."""
    return F.array_join(F.transform(find_below(nodes, node, is_text), lambda n: n.text), "")


def normal_text(nodes: Column, node: Column) -> Column:
    """All text of a subtree in NFKC, white space as it is.

    The pieces' forms put together; the element's own where the parser made one. A combining
    character right behind an element that was taken out of the page stays on its own.
    """
    pieces = F.transform(find_below(nodes, node, is_text), lambda n: F.coalesce(n.norm, n.text))
    intact = ~F.exists(descendants(nodes, node), lambda n: n.kind == "gone")
    return F.when(node.norm.isNotNull() & intact, node.norm).otherwise(F.array_join(pieces, ""))


def element_text(nodes: Column, node: Column, separator: str = " ") -> Column:
    """The text of a subtree, each piece stripped, empty pieces left out."""
    pieces = F.transform(find_below(nodes, node, is_text), lambda n: ustrip(n.text))
    return F.array_join(F.filter(pieces, lambda s: s != ""), separator)


def remove_nodes(nodes: Column, within: Column, predicate: Predicate) -> Column:
    """Take matching elements below ``within`` and all that is in them out of the page.

    By set operations and one sort on node numbers, so a page full of such elements does
    not cost nodes times elements.
    """

    def mark(removed: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(nodes) - 1)

        def marks(ords: Column, gone: bool) -> Column:
            return F.transform(ords, lambda i: F.struct(i.alias("ord"), F.lit(gone).alias("gone")))

        in_order = F.array_sort(
            F.concat(marks(F.array_except(every, removed), False), marks(removed, True))
        )
        return F.transform(
            in_order,
            lambda m: let(
                F.get(nodes, m.ord),
                lambda n: F.when(m.gone, n.withField("kind", F.lit("gone"))).otherwise(n),
            ),
        )

    found = find_below(nodes, within, predicate)
    removed = F.flatten(F.transform(found, lambda r: F.sequence(r.ord, r.end_ord)))
    return let(F.array_distinct(removed), mark)


def next_sibling(nodes: Column, node: Column) -> Column:
    """The node right after ``node`` under the same parent, NULL when it is the last."""

    def after_removed() -> Column:
        parent_end = F.get(nodes, node.parent).end_ord
        rest = F.slice(nodes, node.end_ord + 2, parent_end - node.end_ord)
        return first(F.filter(rest, lambda n: (n.parent == node.parent) & (n.kind != "gone")))

    return let(
        F.get(nodes, node.end_ord + 1),
        lambda n: F.when(n.kind == "gone", after_removed()).when(n.parent == node.parent, n),
    )


def _void() -> Column:
    return word_list(sorted(VOID_TAGS))


def _escaped(text: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def _quoted(value: Column) -> Column:
    both = F.contains(value, F.lit('"')) & F.contains(value, F.lit("'"))
    return (
        F.when(both, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"')))
        .when(F.contains(value, F.lit('"')), F.concat(F.lit("'"), value, F.lit("'")))
        .otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    )


def _string_markup(n: Column) -> Column:
    return (
        F.when(n.kind == "comment", F.concat(F.lit("<!--"), n.text, F.lit("-->")))
        .when(n.kind == "cdata", F.concat(F.lit("<![CDATA["), n.text, F.lit("]]>")))
        .when(n.kind.isin("script", "style"), n.text)
        .otherwise(_escaped(n.text))
    )


def markup(nodes: Column, node: Column) -> Column:
    """An element written back as HTML: attributes by name, minimal escaping, void tags ``<br/>``.

    One pass over the subtree: after each node, as many end tags follow as the next node is
    less deep.
    """

    def attribute(key: Column, value: Column) -> Column:
        value = F.when(key == "class", F.regexp_replace(ustrip(value), r"\s+", " ")).otherwise(value)
        return F.concat(F.lit(" "), key, F.lit("="), _quoted(_escaped(value)))

    def start_tag(n: Column, leaf: Column) -> Column:
        attributes = F.transform(
            F.array_sort(F.map_keys(n.attrs)), lambda k: attribute(k, F.element_at(n.attrs, k))
        )
        end = F.when(leaf & F.array_contains(_void(), n.tag), F.lit("/>")).otherwise(F.lit(">"))
        return F.concat(F.lit("<"), n.tag, F.array_join(attributes, ""), end)

    def end_tags(n: Column, next_depth: Column, leaf: Column) -> Column:
        """End tags of ``n`` (if an element) and of its ancestors down to ``next_depth``."""
        void = leaf & F.array_contains(_void(), n.tag)
        start = F.when(n.kind == "element", n.ord).otherwise(n.parent)
        steps = F.when(n.kind == "element", n.depth).otherwise(n.depth - 1) - next_depth + 1
        walk = F.aggregate(
            F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
            F.struct(start.alias("at"), F.lit("").alias("tags")),
            lambda state, step: F.struct(
                F.get(nodes, state.at).parent.alias("at"),
                F.when((step == 1) & (n.kind == "element") & F.coalesce(void, F.lit(False)), state.tags)
                .otherwise(F.concat(state.tags, F.lit("</"), F.get(nodes, state.at).tag, F.lit(">")))
                .alias("tags"),
            ),
            lambda state: state.tags,
        )
        return walk

    def write(kept: Column) -> Column:
        def one(n: Column, i: Column) -> Column:
            next_depth = F.coalesce(F.get(kept, i + 1).depth, node.depth)
            leaf = next_depth <= n.depth
            head = F.when(n.kind == "element", start_tag(n, leaf)).otherwise(_string_markup(n))
            return F.concat(head, end_tags(n, next_depth, leaf))

        return F.array_join(F.transform(kept, one), "")

    below = F.slice(nodes, node.ord + 1, node.end_ord - node.ord + 1)
    return let(F.filter(below, lambda n: n.kind != "gone"), write)
