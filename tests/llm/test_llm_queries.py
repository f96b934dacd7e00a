"""The registered queries: against their SQL, and their columns where SQL can't express them."""

from __future__ import annotations

import pytest

from cohortspark.llm.oracles import ORACLES
from cohortspark.llm.queries import QUERIES
from compare import differences, tables

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert differences(spark, tables(SF), name, QUERIES[name], ORACLES[name], SF) is None


COLUMNS = {
    "op13_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op1_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_quality_rules": [
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    ],
}


def test_personal_data_of_the_given_documents(spark):
    """Pattern spans against plain searches, and few documents with spans of the field alone."""
    from test_personal_data import brute_digest

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, SF).collect()}
    for doc_id, text in docs:
        row = found[doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == brute_digest(text or "")


def test_words_of_the_given_documents(spark):
    """The whole query against counts and near words found one by one."""
    from test_spelling import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_spelling_variants"](spark, SF)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == brute([tuple(r) for r in docs])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_rare_answers_are_taken_over(spark):
    """A fingerprint's group, each removed byte and each token come from brute force in their own tests."""
    clusters = QUERIES["op6_simhash"](spark, SF)
    assert clusters.filter("component_id > doc_id").count() == 0
