"""The near-duplicate stage links fingerprints as operator 6 does before any band is looked at."""

from __future__ import annotations

import corpus_pipeline
from cohortspark.llm import shingle_dedup
from helpers import text


def bits_apart(a: str, b: str) -> int:
    one, other = (shingle_dedup.fingerprint(shingle_dedup.shingles(x.encode())) for x in (a, b))
    return ((one ^ other) & (1 << 64) - 1).bit_count()


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    taken = shingle_dedup._band_members
    monkeypatch.setattr(shingle_dedup, "_band_members", lambda values: taken(values).filter("false"))
    base = text(1, 2000)
    bodies = [base, base + " more", text(2, 2000), base.replace(" ", "\n") + " other words"]
    assert all(bits_apart(base, bodies[n]) <= 3 for n in (1, 3)) and bits_apart(base, bodies[2]) > 3
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {0, 2}


def test_close_fingerprints_of_unlike_sets_are_not_one_group(spark):
    """Of texts with one shingle in common the sets decide, not the fingerprints."""
    values = spark.createDataFrame([(1, 9, 0), (2, 9, 7), (3, 9, 255 << 20), (4, 9, 7)], "node long, n long, fp long")
    found = {r.node: r.key for r in shingle_dedup._fingerprint_members(values).collect()}
    assert found.keys() == {1, 2, 4} and len(set(found.values())) == 1
    assert not shingle_dedup.forest([(1, 1, shingle_dedup.shingles(b"a b c d e f")), (2, 2, shingle_dedup.shingles(b"a b c d e g h"))])
