"""Where a page states its e-mail and phone: labelled cells, list items, bold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, SiteRules
from ..functions import patterns as P
from ..functions.text import collapse_space, contains_any, decode_email, let, ustrip
from . import nodes as N


def is_phone_label(text: Column) -> Column:
    return let(F.lower(text), lambda lower: contains_any(lower, P.PHONE_LABELS))


def is_email_label(text: Column) -> Column:
    return contains_any(text, P.EMAIL_LABELS)


def table_pairs(nodes: Column) -> Column:
    """Neighbouring cells of every table row as (label, value), both normalised.

    A nested table's rows and cells count for the outer table as well.
    """

    def pairs(cells: Column) -> Column:
        return F.zip_with(
            F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0))),
            F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))),
            lambda label, value: F.struct(label.alias("label"), value.alias("value")),
        )

    def row_pairs(row: Column) -> Column:
        cells = F.transform(
            N.find_below(nodes, row, N.is_tag("td", "th")),
            lambda cell: collapse_space(N.normal_text(nodes, cell)),
        )
        return let(cells, pairs)

    rows = F.flatten(
        F.transform(
            N.find_all(nodes, N.is_tag("table")),
            lambda table: N.find_below(nodes, table, N.is_tag("tr")),
        )
    )
    return F.flatten(F.transform(rows, row_pairs))


def list_items(nodes: Column) -> Column:
    """Normalised text of every list item."""
    return F.transform(
        N.find_all(nodes, N.is_tag("li")), lambda li: collapse_space(N.normal_text(nodes, li))
    )


def after_bold_labels(nodes: Column) -> Column:
    """What follows a bold phone label: text as it is, an element as markup.

    The labels hold no white space, so the test can do without collapsing it.
    """

    def sibling(bold: Column) -> Column:
        return let(
            N.next_sibling(nodes, bold),
            lambda n: F.when(n.kind == "element", N.markup(nodes, n)).otherwise(n.text),
        )

    labels = F.filter(
        N.find_all(nodes, N.is_tag("strong", "b")),
        lambda bold: is_phone_label(N.normal_text(nodes, bold)),
    )
    return F.transform(
        F.filter(F.transform(labels, sibling), lambda s: s.isNotNull() & (s != "")), ustrip
    )


def merge_candidates(*parts: Column) -> Column:
    """Candidate lists one after the other, repeats kept."""
    return F.concat(*parts)


def email_candidates(pairs: Column, items: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    cells = F.transform(F.filter(pairs, lambda p: is_email_label(p.label)), lambda p: p.value)
    listed = F.filter(items, lambda li: contains_any(li, P.EMAIL_TOKENS))
    return F.transform(merge_candidates(cells, listed), lambda c: decode_email(c, site))


def phone_candidates(pairs: Column, items: Column, bold: Column) -> Column:
    cells = F.transform(F.filter(pairs, lambda p: is_phone_label(p.label)), lambda p: p.value)
    return merge_candidates(cells, F.filter(items, is_phone_label), bold)
