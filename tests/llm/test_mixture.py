from __future__ import annotations

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixture
from helpers import no_documents, odd_documents, odd_rows

SF = "/root/testdata/sf0.001"


def brute_targets(sizes):
    """Targets by source, nulls last: the share by weight, capped, the excess dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        rest = left - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / free for s in order if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return {**{s: Fraction(2 * sizes[s]) for s in full}, **share}
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_word_count(spark):
    rows = odd_rows()
    found = odd_documents(spark).select("doc_id", "text", mixture.word_count(F.col("text")).alias("n"))
    assert all(r.n == words(r.text) for r in found.collect()) and len(rows) == found.count()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_exact(spark, size):
    index = spark.range(size).select(
        mixture.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(1), F.lit("s")).alias("p")
    )
    found = [r.p for r in index.collect()]
    assert sorted(found) == list(range(size))
    assert size < 64 or found != list(range(size))


SIZES = [
    {"a": 100, "b": 1, "c": 7, None: 50},
    {"a": 5, "b": 5, "c": 5, "d": 5, "é": 1000, "Z": 3},
    {"one": 9},
    {"a": 0, "b": 10},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixture.source_targets(frame).collect()}
    assert found == pytest.approx({k: float(v) for k, v in brute_targets(sizes).items()})


def check(docs, rows):
    found = mixture.taken_words(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + words(row[1])
    targets = {sizes[s]: t for s, t in brute_targets(sizes).items()}
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(float(targets[r.source_size]))
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for size, got in taken.items():
        assert abs(got - float(targets[size])) <= 2 * mixture.BLOCK_WORDS
    assert sorted(map(tuple, found), key=repr) == sorted(
        map(tuple, mixture.taken_words(docs.repartition(3)).collect()), key=repr
    )


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])


def test_odd_rows(spark):
    check(odd_documents(spark), odd_rows())
    assert mixture.taken_words(no_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixture.taken_words(blank).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_mixed_documents_hold_the_taken_words(spark):
    odd = odd_documents(spark)
    mixed = mixture.mixed_documents(odd)
    assert mixed.columns == odd.columns
    texts = [r[1] for r in odd_rows()]
    total = 0
    for r in mixed.collect():
        total += words(r.text)
        assert r.n_chars == len(r.text)
        parts = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert any(set(parts) <= set(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    assert total == sum(r.taken for r in mixture.taken_words(odd).collect())


def test_blocks_are_taken_evenly(spark):
    docs = spark.createDataFrame([(i, "w " * 640, "s") for i in range(20)], "doc_id long, text string, source string")
    mix = mixture.mix(docs)
    times = mix.slots.groupBy("block").count().select("count").collect()
    assert {r[0] for r in times} == {1, 2} and len(times) == 100
    shards = mix.slots.groupBy("shard").count().collect()
    assert all(r["count"] <= mixture.SHARD_SLOTS for r in shards)


def test_parts_of_a_long_text(spark):
    """A text of 200,000 words beside a small source is cut once, not for every part."""
    rows = [(1, " ".join(f"w{n}" for n in range(200_000)), "en", "a", 0), (2, "few words here", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixture.mixed_documents(docs).collect()
    want = {r.doc_id: r.taken for r in mixture.taken_words(docs).collect()}
    for number in want:
        assert sum(words(r.text) for r in found if r.doc_id == number) == want[number]
    inside = set(rows[0][1].split())
    assert all(set(r.text.split()) <= inside for r in found if r.doc_id == 1)
