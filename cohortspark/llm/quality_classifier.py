"""Naive Bayes support vectors on hashed n-gram indicators (operator 4).

A text is cut in passages of 512 bytes. An n-gram's indicator in a passage is scaled by the log ratio of its
smoothed shares in the two classes; a text's vector is the mean over its passages, brought to unit length, so
long and short texts compare. A linear hinge-loss model is fitted on those vectors by dual coordinate
descent, and its margins on held-back rows of the sample are mapped to scores from 0 to 1. The model is
fitted on a bounded sample of labelled rows; every row is scored over its whole text.

Defined cases: a null or empty text has no n-grams and gets the score of the bias alone; rows repeat as they
come, each with its score; labels other than 0 and 1, null ids and ids with both labels teach nothing; with
no learnable row of one class every score is that of the classes' even odds, 0.5. Empty tables give empty
results. Only ``doc_id`` and ``text`` are read of the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bytewords import placed_ngrams, raw_texts
from cohortspark.llm.files import shipped
from cohortspark.llm.quality_rules import (
    Sample,
    calibrated,
    clean_labels,
    gathered,
    label_sample,
    margins,
)

#: At most so many labelled documents of each class are learned from.
SAMPLE_PER_CLASS = 1_500
#: Indicators fall into 2**18 buckets.
BITS = 18
BUCKETS = 1 << BITS
#: A passage is 512 bytes of a text.
PASSAGE_BITS = 9
#: An n-gram that fewer sampled documents hold says nothing.
MIN_DOCUMENTS = 10


def indicators(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and the share of its passages that hold each."""
    keys = [
        (places >> PASSAGE_BITS << BITS) | buckets
        for buckets, places in placed_ngrams(raw, BITS, pairs=False)
    ]
    held = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
    passages = 1 + (max(len(raw) - 1, 0) >> PASSAGE_BITS)
    buckets, counts = np.unique(held & (BUCKETS - 1), return_counts=True)
    return buckets.astype(np.uint32), (counts / passages).astype(np.float32)


def excerpt(raw: bytes, id_: int) -> bytes:
    """4 to 60 words in a row of a text, chosen by its id: an example of a short text.

    Taken of texts of quality alone, as a part of a bad text may be fine.
    """
    words, draw = raw.split(), zlib.crc32(b"excerpt %d" % id_)
    length = 4 + draw % 57
    low = draw // 57 % max(1, len(words) - length)
    return b" ".join(words[low : low + length])


def log_count_ratios(
    sample: Sample, smoothing: float = 10.0, least: int = MIN_DOCUMENTS
) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of every bucket; p and q sum the indicators in the documents of a class.

    Zero where fewer than ``least`` documents of the sample hold it.
    """
    of_one = sample.labels[sample.owner] == 1
    p, q = (
        np.bincount(sample.buckets[rows], sample.values[rows], BUCKETS) for rows in (of_one, ~of_one)
    )
    held = np.bincount(sample.buckets, minlength=BUCKETS)
    shares = [
        (counts + smoothing) / max(1, (sample.labels == label).sum())
        for label, counts in ((1, p), (0, q))
    ]
    return np.where(held >= least, np.log(shares[0] / shares[1]), 0.0)


def scaled(sample: Sample, ratios: np.ndarray) -> Sample:
    """Indicators times ratios, each row brought to unit length."""
    values = ratios[sample.buckets] * sample.values
    lengths = np.sqrt(np.bincount(sample.owner, values**2, len(sample.labels)))
    lengths[lengths == 0] = 1.0
    return Sample(
        sample.buckets, values / lengths[sample.owner], sample.starts, sample.labels, sample.fold
    )


def fit_hinge(
    sample: Sample, cost: float = 1.0, epochs: int = 15, tolerance: float = 1e-2, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias minimising |w|^2 / 2 + sum of cost_i * max(0, 1 - y_i (w . x_i + b)).

    The dual has one bounded variable a row. Each step solves for one variable alone and moves the weights
    along that row; rows come in a new seeded order each epoch. Costs weigh both classes evenly. The bias
    is the weight of a constant 1.
    """
    n = len(sample.labels)
    sign = np.where(sample.labels == 1, 1.0, -1.0)
    ones = max(1, int((sample.labels == 1).sum()))
    upper = cost * np.where(sample.labels == 1, n / (2 * ones), n / (2 * max(1, n - ones)))
    ends = np.append(sample.starts[1:], len(sample.buckets))
    rows = [
        (sample.buckets[a:b].astype(np.intp), sample.values[a:b])
        for a, b in zip(sample.starts, ends)
    ]
    squares = np.array([float(v @ v) + 1.0 for _, v in rows])
    weights, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(n)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(n):
            buckets, values = rows[i]
            slope = sign[i] * (float(weights[buckets] @ values) + bias) - 1.0
            free = min(slope, 0.0) if dual[i] == 0 else max(slope, 0.0) if dual[i] == upper[i] else slope
            worst = max(worst, abs(free))
            if free:
                new = min(max(dual[i] - slope / squares[i], 0.0), upper[i])
                step = (new - dual[i]) * sign[i]
                weights[buckets] += step * values
                bias += step
                dual[i] = new
        if worst < tolerance:
            break
    return weights, bias


@dataclass
class Model:
    """Score = logistic(slope * (weights . scaled vector + bias) + shift)."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, raw: bytes) -> float:
        buckets, values = indicators(raw)
        x = self.ratios[buckets] * values
        length = float(np.sqrt(x @ x)) or 1.0
        margin = float(self.weights[buckets] @ x) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model of at most ``per_class`` labelled documents of each class.

    A third of the sample is held back from the weights and maps margins to scores.
    """
    sample = gathered(docs, label_sample(clean_labels(labels), per_class), indicators, excerpt)
    first, second = sample.rows(sample.fold > 0), sample.rows(sample.fold == 0)
    if len(set(sample.labels)) < 2 or len(set(first.labels)) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    ratios = log_count_ratios(first)
    weights, bias = fit_hinge(scaled(first, ratios))
    held = scaled(second if len(set(second.labels)) == 2 else first, ratios)
    slope, shift = calibrated(margins(held, weights, bias), held.labels)
    return Model(ratios, weights, bias, slope, shift)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; the model is one broadcast of fixed size."""
    shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(raw) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "score": pa.array(found, pa.float64())}
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, score double"
    )


def held_out(doc_id) -> F.Column:
    """Whether a row's label is never learned from: the checksum of its id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
