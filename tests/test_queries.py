"""Every query on pages and records against its SQL."""

import compare
import pytest

import __spark_entry__ as entry
from pressdesk.plans.registry import QUERIES, SQL

OPERATORS = """
scan_search_pages scan_article_pages keyword_dim request_manifest html_nodes write_contacts_csv
write_contacts_by_keyword write_contacts_table run_label link_filter resolve_href find_first page_flags
valid_phone allowed_email valid_person coverage_flags empty_guard hits_to_contacts keyword_search
label_nodes run_totals field_coverage keyword_counts keyword_group_sizes links_per_page column_profile
stop_prefix first_seen_dedupe table_pairs report_batches page_cap limit_per_keyword
preview_per_keyword keyword_order union_all_keywords merge_candidates normalize_text decode_email
to_halfwidth normalize_phone clean_phone_last_resort site_name_clean contact_truncate sheet_key
percent_encode element_text first_match all_matches first_valid_match company_from_html main_content
strip_boilerplate contact_section contact_table choose_text contact_boost company_from_text person
email_candidates email_pick_structural email_pick_context email_pick_full phone_candidates
phone_pick_structural phone_pick_labelled phone_pick_contact last_resort extract_contacts
""".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_operator_has_query_and_sql():
    assert len(OPERATORS) == 69
    assert not set(OPERATORS) - set(QUERIES)
    assert not set(QUERIES) - set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    result = compare.spark_rows(QUERIES[name](spark, sf_dir))
    assert result[1], "no rows"
    assert compare.difference(result, compare.sql_rows(con, SQL[name])) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
