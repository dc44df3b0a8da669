"""Corpus queries against their SQL, and the columns of all."""

import compare
import pytest

import __spark_entry__ as entry
from pressdesk.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1": "doc_id n_shingles component_id kept",
    "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3": "doc_id held_out score predicted",
    "op4": "doc_id held_out lang_pred score",
    "op6": "page_id host path rule verdict",
    "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12": "doc_id n_features weight score rank",
    "op13": "vec_id component n deviation whitened explained identity_error",
    "op10": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    result = compare.spark_rows(QUERIES[name](spark, sf_dir))
    assert result[1] or name == "op5_warc_fixity"
    assert compare.difference(result, compare.sql_rows(compare.connect(sf_dir), SQL[name])) is None


def test_registered():
    assert sorted(n.split("_")[0] for n in QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns(spark, sf_dir, start):
    name = next(n for n in QUERIES if n.startswith(start + "_"))
    assert QUERIES[name](spark, sf_dir).columns[: len(COLUMNS[start].split())] == COLUMNS[start].split()
