"""Quality rules: counted rules and a calibrated logistic regression on hashed n-grams (operator 10).

The regression sees the square roots of the relative frequencies of a text's hashed word and character
n-grams. It is fitted on a bounded sample of labelled rows; a second part of the sample maps its scores to
probabilities. Texts are scored in Arrow batches, and a fixed threshold on the probability decides.

Defined cases: a null text is empty: no words, so it fails the base rules; an empty text is scored like any
other (its n-grams are none). Rows repeat as they come. A label counts where it is 0 or 1; a ``doc_id`` with
both labels teaches nothing, nor does a null one. With no labelled row of one class the regression can't be
fitted and every text passes it. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.bytewords import (
    BUCKETS,
    LEADING,
    SPACE,
    hashed_ngrams,
    mixed,
    raw_texts,
    span_hashes,
    texts_of,
    with_rows,
    word_bounds,
)
from cohortspark.llm.files import shipped

#: At most so many labelled documents of each class are fitted on; the rest of the sample calibrates.
SAMPLE_PER_CLASS = 1_000
#: A text is kept when it is of quality with at least this probability.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def clean_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and label of every document that has one label alone."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("_most"))
        .filter(F.col("label") == F.col("_most"))
        .select("doc_id", "label")
    )


def label_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled documents of each class: those of the smallest hash of their id."""
    order = F.xxhash64("doc_id")
    parts = [
        labels.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


@dataclass
class Sample:
    """Rows of bucket numbers and values, one after the other, and their labels."""

    buckets: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    labels: np.ndarray
    #: Of each row, a third that its document falls into by its id.
    fold: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        lengths = np.diff(np.append(self.starts, len(self.buckets)))
        return np.repeat(np.arange(len(self.labels)), lengths)

    def rows(self, chosen: np.ndarray) -> Sample:
        keep = chosen[self.owner]
        lengths = np.diff(np.append(self.starts, len(self.buckets)))[chosen]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        return Sample(
            self.buckets[keep], self.values[keep], starts, self.labels[chosen], self.fold[chosen]
        )


def frequencies(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the square roots of their shares of its n-grams."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in hashed_ngrams(raw):
        counts += np.bincount(part, minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    shares = counts[buckets] / max(1, counts.sum())
    return buckets.astype(np.uint32), np.sqrt(shares).astype(np.float32)


def gathered(docs: DataFrame, sample: DataFrame, vector, excerpt=None) -> Sample:
    """The vectors of the sampled documents; bounded by the sample's size times the number of buckets.

    ``excerpt`` makes a second row of a part of each text of quality.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, label, raw in zip(batch.column(0), batch.column(1), raw_texts(batch.column(2))):
                texts = [raw]
                if excerpt and label.as_py() == 1:
                    texts.append(excerpt(raw, id_.as_py()))
                for buckets, values in map(vector, texts):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([id_.as_py()], pa.int64()),
                            "label": pa.array([label.as_py()], pa.int32()),
                            "buckets": [buckets.tobytes()],
                            "vals": [values.tobytes()],
                        }
                    )

    shipped(docs.sparkSession)
    chosen = sample.select("doc_id", F.col("label").cast("int").alias("label"))
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # the sample's size is a parameter
        .select("doc_id", "label", "text")
        .mapInArrow(vectors, "doc_id long, label int, buckets binary, vals binary")
        .toArrow()
        .to_pylist()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["buckets"], r["vals"]))
    buckets = [np.frombuffer(r["buckets"], dtype=np.uint32) for r in rows]
    lengths = np.array([0, *map(len, buckets)], dtype=np.int64)
    return Sample(
        np.concatenate([np.zeros(0, np.uint32), *buckets]),
        np.concatenate(
            [np.zeros(0, np.float32), *(np.frombuffer(r["vals"], dtype=np.float32) for r in rows)]
        ),
        np.cumsum(lengths)[:-1],
        np.array([r["label"] for r in rows], dtype=np.int64),
        np.array([zlib.crc32(b"fold %d" % r["doc_id"]) % 3 for r in rows], dtype=np.int64),
    )


def fit_logistic(
    sample: Sample, penalty: float = 2e-5, steps: int = 150
) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression with equally weighing classes.

    Accelerated gradient descent over the whole sample; vectors have unit length, which bounds the step.
    """
    owner, n = sample.owner, len(sample.labels)
    target = sample.labels.astype(np.float64)
    share = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, n - target.sum()))
    weights = np.zeros(BUCKETS + 1)
    ahead, momentum = weights.copy(), 1.0
    for _ in range(steps):
        margin = np.bincount(owner, ahead[sample.buckets] * sample.values, n) + ahead[-1]
        error = share * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target)
        slope = np.append(
            np.bincount(sample.buckets, error[owner] * sample.values, BUCKETS), error.sum()
        )
        slope[:-1] += penalty * ahead[:-1]
        new = ahead - 2.0 * slope
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / grown * (new - weights)
        weights, momentum = new, grown
    return weights[:-1], float(weights[-1])


def margins(sample: Sample, weights: np.ndarray, bias: float) -> np.ndarray:
    return (
        np.bincount(sample.owner, weights[sample.buckets] * sample.values, len(sample.labels)) + bias
    )


def calibrated(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities: a logistic fit of one variable.

    Targets are drawn in from 0 and 1 by the usual correction for few rows, so perfectly parted classes
    keep finite values. The slope is never negative.
    """
    ones, zeros = int((labels == 1).sum()), int((labels == 0).sum())
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    each = np.where(labels == 1, 0.5 / max(1, ones), 0.5 / max(1, zeros))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))
        curve = each * p * (1 - p)
        g = np.array([(each * (p - goal) * margin).sum(), (each * (p - goal)).sum()])
        h = np.array(
            [[(curve * margin**2).sum(), (curve * margin).sum()], [(curve * margin).sum(), curve.sum()]]
        )
        move = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        length = np.abs(move).max()
        move *= min(1.0, 5.0 / length) if length > 0 else 1.0
        slope, shift = slope - move[0], shift - move[1]
        if length < 1e-9:
            break
    return max(0.0, float(slope)), float(shift)


@dataclass
class Model:
    """Probability of quality = logistic(slope * (weights . vector + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: bytes) -> float:
        buckets, values = frequencies(raw)
        margin = float(self.weights[buckets] @ values) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model of at most ``per_class`` labelled documents of each class; None where a class has none.

    Two thirds of the sample fit the weights, the rest calibrates.
    """
    sample = gathered(docs, label_sample(clean_labels(labels), per_class), frequencies)
    first, second = sample.rows(sample.fold > 0), sample.rows(sample.fold == 0)
    if len(set(sample.labels)) < 2 or len(set(first.labels)) < 2:
        return None
    weights, bias = fit_logistic(first)
    held = second if len(set(second.labels)) == 2 else first
    return Model(weights, bias, *calibrated(margins(held, weights, bias), held.labels))


def base_counts(raw: bytes) -> dict[str, int]:
    """The counted rules of one text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    by_byte = np.bincount(data, minlength=256)
    starts, ends = word_bounds(data)
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif not line or line.isspace():
            continue
        else:
            seen.add(line)
    return {
        "n_words": len(starts),
        "word_chars": int(by_byte[LEADING & ~SPACE].sum()),
        "n_symbols": int(by_byte[list(SYMBOLS)].sum()),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeat_words(data, starts, ends),
    }


def _repeat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
    """Words inside a window of three words that the text has twice or more."""
    if len(starts) < 4:
        return 0
    words = span_hashes(data, starts, ends)
    windows = mixed(mixed(words[:-2]) + words[1:-1]) + words[2:]
    order = np.sort(mixed(windows))
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(mixed(windows), twice)
    marked = np.zeros(len(words), dtype=bool)
    for k in range(3):
        marked[k : len(words) - 2 + k] |= again
    return int(marked.sum())


def judged(
    docs: DataFrame, model: Model | None, keep: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    """``row`` (a struct of the kept columns), counts, ``base_failed``, ``probability`` and ``kept``.

    Needs ``text``. The model travels as one broadcast of fixed size.
    """
    shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, chances = [], []
            for raw in raw_texts(texts_of(batch)):
                rows.append(base_counts(raw))
                chances.append(model.probability(raw) if model else 1.0)
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(chances, pa.float64())],
                names=["row", *COUNTS, "probability"],
            )

    whole = with_rows(docs, keep)
    schema = T.StructType(
        [whole.schema["row"], *(T.StructField(k, T.LongType()) for k in COUNTS)]
        + [T.StructField("probability", T.DoubleType())]
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return (
        whole.mapInArrow(score, schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
    )


def quality_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, counts, ``base_failed``, ``kept`` and ``probability`` of every document."""
    found = judged(docs, model, ["doc_id"])
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), *COUNTS, "base_failed", "kept", "probability"
    )


def kept_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that pass, with their columns."""
    return judged(docs, model, docs.columns).filter("kept").select("row.*")
