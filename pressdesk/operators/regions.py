"""Which part of a page to read: company element, content area, contact section, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, SiteRules
from ..functions import patterns as P
from ..functions.text import contact_truncate, contains_any, first, let, or_empty, site_name_clean, ustrip, word_list
from . import nodes as N


def company_element(nodes: Column) -> Column:
    """The element that names the company, by four rules in order."""
    header = lambda n: N.has_class(P.COMPANY_HEADER_CLASSES[0])(n) | N.has_class(
        P.COMPANY_HEADER_CLASSES[1]
    )(n)
    return F.coalesce(
        N.find_first(nodes, lambda n: N.is_tag("div")(n) & N.has_class(P.COMPANY_BLOCK_CLASS)(n)),
        N.find_first(nodes, lambda n: N.is_tag("a")(n) & N.has_class(P.COMPANY_LINK_CLASS)(n)),
        N.find_first(
            nodes,
            lambda n: N.is_tag("div", "span", "a")(n)
            & N.has_class_matching(P.COMPANY_ANY_CLASS)(n),
        ),
        N.find_first(nodes, header),
    )


def company_from_meta(nodes: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    meta = N.find_first(
        nodes, lambda n: N.is_tag("meta")(n) & (n.attrs["property"] == P.SITE_NAME_PROPERTY)
    )
    return or_empty(site_name_clean(meta["attrs"]["content"], site))


def company_from_html(nodes: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """Text of the company element; the meta tag counts only when there is no such element."""
    return let(
        company_element(nodes),
        lambda el: F.when(el.isNotNull(), or_empty(ustrip(N.plain_text(nodes, el)))).otherwise(
            company_from_meta(nodes, site)
        ),
    )


def main_content(nodes: Column) -> Column:
    """The content area by the first selector that matches anything, NULL when none does."""

    def select(selector: str) -> Column:
        if selector.startswith("."):
            return N.find_first(nodes, N.has_class(selector[1:]))
        return N.find_first(nodes, N.is_tag(selector))

    return F.coalesce(*[select(s) for s in P.AREA_SELECTORS])


def page_body(nodes: Column) -> Column:
    return N.find_first(nodes, N.is_tag("body"))


def strip_boilerplate(nodes: Column, main: Column, body: Column) -> Column:
    """Without a content area: the page less its headers, footers and menus."""
    boilerplate = lambda n: N.is_tag(*P.BOILERPLATE_TAGS)(n) | N.has_class_matching(
        P.BOILERPLATE_CLASS
    )(n)
    return F.when(
        main.isNull() & body.isNotNull(), N.remove_nodes(nodes, body, boilerplate)
    ).otherwise(nodes)


def search_area(nodes: Column, main: Column, body: Column) -> Column:
    """Content area, else body, else the whole page."""
    return F.coalesce(main, body, first(nodes))


def label_nodes(nodes: Column, area: Column) -> Column:
    """Contact words x text nodes of the area that hold them: word rank, node, its block.

    Sorted by the word's place in the list, then by document order.
    """
    labels = N.find_below(
        nodes, area, lambda n: N.is_string(n) & contains_any(n.text, P.CONTACT_WORD_STEMS)
    )
    def matches(n: Column) -> Column:
        every = F.transform(
            word_list(P.CONTACT_WORDS),
            lambda word, rank: F.struct(
                rank.alias("rank"), n.ord.alias("ord"), n.block.alias("block"), word.alias("word")
            ),
        )
        return F.filter(every, lambda m: F.contains(n.text, m.word))

    return F.array_sort(F.flatten(F.transform(labels, matches)))


def contact_section(nodes: Column, area: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """The block around the best contact word in the area, NULL when there is none.

    Words are tried in list order, and the text nodes that hold one in document order. The
    block may lie outside the area. A block that holds both guard words is a site footer.
    """

    def is_footer(block: Column) -> Column:
        return let(
            N.element_text(nodes, block, ""),
            lambda text: F.contains(text, F.lit(site.footer_guard[0]))
            & F.contains(text, F.lit(site.footer_guard[1])),
        )

    def step(state: Column, label: Column) -> Column:
        known = label.block.isNull() | F.array_contains(state.footers, label.block)
        block = let(F.get(nodes, label.block), is_footer)
        return F.when(state.found.isNotNull() | known, state).when(
            block,
            F.struct(
                state.found.alias("found"),
                F.array_append(state.footers, label.block).alias("footers"),
            ),
        ).otherwise(F.struct(label.block.alias("found"), state.footers.alias("footers")))

    # A block that was found to be a footer is not read again for its next label.
    accepted = F.aggregate(
        label_nodes(nodes, area),
        F.struct(
            F.lit(None).cast("int").alias("found"), F.array().cast("array<int>").alias("footers")
        ),
        step,
        lambda state: state.found,
    )
    return F.get(nodes, accepted)


def contact_table(nodes: Column, area: Column) -> Column:
    """The first table in the area whose text holds a contact word, also one split over tags."""
    return first(
        F.filter(
            N.find_below(nodes, area, N.is_tag("table")),
            lambda t: let(
                N.plain_text(nodes, t), lambda text: contains_any(text, P.CONTACT_WORD_STEMS)
            ),
        )
    )


def choose_text(nodes: Column, section: Column, table: Column, area: Column) -> Column:
    """The text to extract from: contact section or table, else the area."""
    return or_empty(N.element_text(nodes, F.coalesce(section, table, area)))


def contact_boost(text: Column) -> Column:
    """Put the body of each kind of contact heading in front of the text, in a fixed order."""

    def step(text: Column, pattern: str) -> Column:
        return let(
            text,
            # The body of a heading that is there is never empty.
            lambda t: let(
                F.regexp_extract(t, pattern, 1),
                lambda body: F.when(body != "", F.concat(contact_truncate(body), F.lit(" "), t)).otherwise(t),
            ),
        )

    for pattern in P.CONTACT_BLOCKS:
        text = step(text, pattern)
    return text
