"""One whole run: landed search and article pages to records and reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT_SITE, SiteRules
from ..operators import report as R
from ..operators.contacts import extract_contacts
from ..operators.links import collect_hits, harvest_links, hits_in_order, links_per_page
from ..session import spread
from ..sources import sinks


@dataclass(frozen=True)
class Run:
    """Tables of a run, read from where they were written."""

    hits: DataFrame
    records: DataFrame
    totals: DataFrame
    coverage: DataFrame
    keyword_counts: DataFrame
    group_sizes: DataFrame
    links_per_page: DataFrame
    flags: DataFrame
    batches: DataFrame
    preview: DataFrame
    label: str


def run(
    spark: SparkSession,
    search_pages: DataFrame,
    article_pages: DataFrame,
    keywords: DataFrame,
    out_dir: str,
    site: SiteRules = DEFAULT_SITE,
    by_keyword: bool = True,
    started: datetime | None = None,
    resume: bool = False,
) -> Run:
    """Write links, hits and records under ``out_dir``, then the outputs.

    Links and hits are read more than once, so they are written first: each page is parsed
    once, and a lost executor repeats one step, not the run. ``by_keyword`` makes a folder
    per keyword, which suits lists of a length that someone goes through. The names of the
    outputs end in the run's label, the time it was ``started``.

    A folder that holds a run is refused. With ``resume`` the run of the same inputs and of the
    same ``started`` goes on in it: steps that are done are read back, outputs are written again.
    """
    if resume and started is None:
        raise ValueError("a run is resumed under the time it was started")

    def step(df: DataFrame, name: str) -> DataFrame:
        added = sinks.write_once(df, f"{out_dir}/{name}", name)
        if not added and not resume:
            raise FileExistsError(f"{out_dir}/{name} holds a run")
        return sinks.read_committed(spark, f"{out_dir}/{name}", df.schema)

    links = step(harvest_links(spread(search_pages), site), "links")
    hits = step(hits_in_order(collect_hits(links, site), keywords), "hits")
    contacts = extract_contacts(R.pages_hit(article_pages, hits), site)
    records = step(R.hits_to_contacts(hits, contacts), "records")
    label = f"{started or datetime.now():%Y%m%d_%H%M%S}"
    mode = "overwrite" if resume else "errorifexists"
    if by_keyword:
        sinks.write_contacts_by_keyword(records, f"{out_dir}/by_keyword_{label}", mode)
    sinks.write_contacts_csv(records, f"{out_dir}/csv_{label}", ("kw_pos", "hit_pos"), mode)
    return Run(
        hits,
        records,
        R.run_totals(keywords, records),
        R.field_coverage(records),
        R.keyword_counts(keywords, records),
        R.keyword_group_sizes(records),
        links_per_page(links, site),
        R.coverage_flags(records),
        R.report_batches(records),
        R.preview_per_keyword(records),
        label,
    )
