"""Page -> contact record: the regions, candidates and pickers in order, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, SiteRules
from ..functions.text import decode_email, let, or_empty
from . import candidates as C
from . import nodes as N
from . import pickers as K
from . import regions as R
from .html import html_nodes

FIELDS = ("company", "person", "email", "phone")


def with_nodes(pages: DataFrame) -> DataFrame:
    """Parse ``html`` once and drop it."""
    return pages.withColumn("nodes", html_nodes(F.col("html"))).drop("html")


def with_regions(parsed: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Company element, area and text. ``nodes`` becomes the page after boilerplate removal."""
    nodes = F.col("nodes")
    found = parsed.withColumns(
        {
            "company_html": R.company_from_html(nodes, site),
            "main": R.main_content(nodes),
            "body": R.page_body(nodes),
        }
    )
    stripped = found.withColumn("nodes", R.strip_boilerplate(nodes, F.col("main"), F.col("body")))
    area = stripped.withColumn("area", R.search_area(nodes, F.col("main"), F.col("body"))).drop(
        "main", "body"
    )
    section = area.withColumn("section", R.contact_section(nodes, F.col("area"), site))
    table = section.withColumn(
        "contact_table",
        F.when(F.col("section").isNull(), R.contact_table(nodes, F.col("area"))),
    )
    return table.withColumn(
        "text",
        R.contact_boost(
            R.choose_text(nodes, F.col("section"), F.col("contact_table"), F.col("area"))
        ),
    ).drop("section", "contact_table", "area")


def with_candidates(parsed: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Structural candidates of the whole page, wherever the area is."""
    nodes = F.col("nodes")
    listed = parsed.withColumns(
        {
            "pairs": C.table_pairs(nodes),
            "items": C.list_items(nodes),
            "bold": C.after_bold_labels(nodes),
        }
    )
    return listed.withColumns(
        {
            "emails": C.email_candidates(F.col("pairs"), F.col("items"), site),
            "phones": C.phone_candidates(F.col("pairs"), F.col("items"), F.col("bold")),
        }
    ).drop("pairs", "items", "bold")


def with_fields(ready: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Pick the four fields: structural candidates first, then the text."""
    text = F.col("text")
    email_in_text = let(
        decode_email(text, site),
        lambda decoded: K.fall_back(
            K.email_pick_context(decoded, site), K.email_pick_full(decoded, site)
        ),
    )
    return ready.withColumns(
        {
            "company": K.fall_back(F.col("company_html"), K.company_from_text(text)),
            "person": or_empty(K.person(text)),
            "email": K.fall_back(K.email_pick_structural(F.col("emails"), site), email_in_text),
            "phone": K.fall_back(
                K.phone_pick_structural(F.col("phones"), site),
                K.phone_pick_labelled(text, site),
                K.phone_pick_contact(text, site),
            ),
        }
    ).drop("company_html", "emails", "phones", "text")


def with_last_resort(picked: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """Read the whole page again, as it is, only where e-mail, phone and person are empty."""
    nodes = F.col("nodes")
    nothing = (F.col("email") == "") & (F.col("phone") == "") & (F.col("person") == "")
    page_text = F.when(nothing, or_empty(let(F.get(nodes, F.lit(0)), lambda d: N.element_text(nodes, d))))
    last = let(
        page_text,
        lambda t: F.struct(
            K.last_resort_email(t, site).alias("email"), K.last_resort_phone(t).alias("phone")
        ),
    )
    return picked.withColumn("last", last).withColumns(
        {
            f: F.when(nothing, or_empty(F.col("last")[f])).otherwise(F.col(f))
            for f in ("email", "phone")
        }
    ).drop("last")


def fenced(records: DataFrame, kept: list[str]) -> DataFrame:
    """``records`` such that filters on the fields stay above and those on ``kept`` pass through.

    A filter on a field that moved below the extraction would hold all its expressions again,
    the parser included. A row is made an array of one struct and taken out of it, which
    filters on the row's other columns pass on their way to the scan.
    """
    one = F.explode_outer(F.array(F.struct(*FIELDS))).alias("_record")
    return records.select(*kept, one).select(*kept, *[F.col(f"_record.{f}").alias(f) for f in FIELDS])


def extract_contacts(pages: DataFrame, site: SiteRules = DEFAULT_SITE) -> DataFrame:
    """``pages(url, html)`` -> ``contacts(url, company, person, email, phone)``, row by row.

    Missing values are ``''``. Columns other than ``html`` are kept, and a filter on them
    reaches the scan: one URL or day of landed pages is all that is read and parsed.
    """
    kept = [c for c in pages.columns if c != "html"]
    parsed = with_regions(with_nodes(pages), site)
    picked = with_fields(with_candidates(parsed, site), site)
    return fenced(with_last_resort(picked, site), kept)
