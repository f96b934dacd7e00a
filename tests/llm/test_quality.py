"""Quality rules and the quality classifier: counts against brute force, verdicts against held-out labels."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import bytewords, quality_classifier, quality_rules
from helpers import no_documents, odd_documents, odd_rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside, seen, dup = set(), set(), 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if windows[window] > 1:
            inside.update((i, i + 1, i + 2))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
    }


def test_counts_against_brute_force():
    draw = random.Random(3)
    parts = [" ", "\n", "\t", "\x0b", "a", "bb", "é", "日", "#", "a b c ", "|x", "\xa0", "\x85", "\r", "\x1c"]
    for _ in range(1500):
        text = "".join(draw.choices(parts, k=draw.randint(0, 40)))
        assert quality_rules.base_counts(text.encode()) == brute_counts(text), repr(text)
    for row in odd_rows():
        assert quality_rules.base_counts((row[1] or "").encode()) == brute_counts(row[1])


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = ("word other " * 900).encode()
    whole = sum(map(len, bytewords.hashed_ngrams(text)))
    monkeypatch.setattr(bytewords, "PIECE_BYTES", 1000)
    assert b"".join(bytewords.pieces(text, 1000)) == text
    assert sum(map(len, bytewords.hashed_ngrams(text))) == pytest.approx(whole, rel=0.02)
    assert b"".join(bytewords.pieces(b"x" * 5000, 1000)) == b"x" * 5000


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = quality_classifier.held_out(F.col("doc_id"))
    return docs, labels.filter(~held), labels.filter(held).select("doc_id", "quality")


def accuracy(found, held, verdict):
    rows = found.join(held, "doc_id").select(verdict, "quality").collect()
    assert len(rows) > 50
    return np.mean([bool(r[0]) == bool(r[1]) for r in rows])


def test_classifier_on_held_out_labels(labelled):
    docs, learned, held = labelled
    found = quality_classifier.scores(docs, quality_classifier.fit(docs, learned))
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert accuracy(found, held, F.col("score") >= 0.5) > 0.95


def test_rules_on_held_out_labels(labelled):
    docs, learned, held = labelled
    found = quality_rules.quality_rows(docs, quality_rules.fit(docs, learned))
    assert accuracy(found.filter("NOT base_failed"), held, "kept") > 0.95


def test_dual_coordinate_descent_reaches_the_optimum():
    random_ = np.random.default_rng(1)
    n = 60
    labels = (random_.random(n) < 0.5).astype(np.int64)
    dense = random_.normal(size=(n, 4)) + labels[:, None]
    sample = quality_rules.Sample(
        np.tile(np.arange(4, dtype=np.uint32), n), dense.ravel(), np.arange(n) * 4, labels, np.zeros(n)
    )
    weights, bias = quality_classifier.fit_hinge(sample, cost=1.0, epochs=3000, tolerance=1e-9)
    sign = np.where(labels == 1, 1, -1)
    cost = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))

    def loss(w, b):
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - sign * (dense @ w + b))).sum()

    best = loss(weights[:4], bias)
    for _ in range(300):
        assert loss(weights[:4] + random_.normal(size=4) * 0.02, bias + random_.normal() * 0.02) >= best - 1e-6


def test_log_count_ratios():
    sample = quality_rules.Sample(
        np.array([0, 0, 1, 1], np.uint32), np.ones(4, np.float32), np.arange(4), np.array([1, 1, 1, 0]), np.zeros(4)
    )
    found = quality_classifier.log_count_ratios(sample, smoothing=1.0, least=2)
    assert found[0] == pytest.approx(np.log(3 / 3 / (1 / 1)))
    assert found[1] == pytest.approx(np.log(2 / 3 / (2 / 1)))
    assert not found[2:].any()


def test_labels_of_two_minds_teach_nothing(spark):
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (2, 1), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int"
    )
    assert [tuple(r) for r in quality_rules.clean_labels(labels).collect()] == [(2, 1)]


def test_odd_rows(spark, labelled):
    docs, learned, _ = labelled
    odd = odd_documents(spark)
    found = quality_rules.quality_rows(odd, quality_rules.fit(docs, learned))
    assert found.count() == len(odd_rows())
    assert found.filter("n_words = 0 AND NOT base_failed").count() == 0
    kept = quality_rules.kept_documents(odd, None)
    assert kept.columns == odd.columns
    scored = quality_classifier.scores(odd, quality_classifier.fit(docs, learned))
    assert scored.filter("score BETWEEN 0 AND 1").count() == len(odd_rows())
    assert quality_rules.quality_rows(no_documents(spark), None).count() == 0


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = odd_documents(spark)
    assert quality_rules.fit(odd, none) is None
    found = quality_classifier.scores(odd, quality_classifier.fit(odd, none))
    assert {r.score for r in found.collect()} == {0.5}
