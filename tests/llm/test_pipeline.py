"""Each stage of the pipeline on its own input, against a plain version."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import decontaminate, mixture, quality_rules
from helpers import no_documents, odd_documents
from test_decontaminate import brute as brute_hits
from test_shingle_dedup import brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and after each stage."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found.append(docs)
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas()) if len(found) < 5 else stage(spark, docs, SF)
    return [*found, docs]


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "near-duplicates",
        "decontamination",
        "source mix",
        "token output",
    ]
    assert all(rows.columns == COLUMNS for rows in stages[:-1])


def test_quality_drops_what_it_rejects(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = quality_rules.quality_rows(stages[0], quality_rules.fit(stages[0], labels))
    kept = {r.doc_id for r in verdict.filter("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()


def test_one_of_each_group_stays(stages):
    """Of the groups by 80 % of five-word shingles, found pair by pair."""
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    label = brute_groups([t for _, t in rows])
    assert {r.doc_id for r in stages[2].collect()} == {rows[n][0] for n in set(label)}


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    clean = {r[0] for r in brute_hits(rows, items) if not r[-1]}
    assert {r.doc_id for r in stages[3].collect()} == clean


def test_the_mix_is_what_is_taken(stages):
    words = stages[4].groupBy("doc_id").agg(F.sum(mixture.word_count(F.col("text"))).alias("n"))
    found = {r.doc_id: r.n for r in words.collect()}
    want = {r.doc_id: r.taken for r in mixture.taken_words(stages[3]).collect() if r.taken}
    assert found == want


def test_tokens_of_every_mixed_row(stages):
    assert stages[5].count() == stages[4].count()
    ordered = stages[5].orderBy("start").collect()
    at = 0
    for row in ordered:
        assert row.start == at
        at += row.n_tokens
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)


def test_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, SF)
            assert found.columns == docs.columns
            found.count()
    assert decontaminate.HIT_SHARE == 20
