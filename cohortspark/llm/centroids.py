"""Centroid clustering by a bisector tournament (operator 11).

A vector is kept if it has exactly ``dimensions`` components, none null or non-finite; component x counts as the
integer floor(scale * x). For centroids i < j the bisector is fixed beforehand: the normal 2 * (c_j - c_i) and the
threshold |c_j|**2 - |c_i|**2. A vector is nearer to j if its product with the normal passes the threshold; zero
favours i. So k - 1 sign tests, each of the champion so far against the next centroid, leave the nearest one, ties
to the smaller number, and only its distance is computed. All numbers are integers, so results are exact and do
not depend on the order of rows or on partitions.

Plan: a pass finds the first centroids (k rows from each task), a pass for each round sums the vectors of each
cluster in the task and sends one partial sum for each cluster and dimension, and the last pass writes the
assignments, narrow, whose distances are then summed. The driver holds k centroids and their k * k bisectors, a
bound set by parameters. No vector is moved. Sums travel in limbs of 40 bits, so no sum can overflow.

Defined cases: null or empty vectors, and those with a null, NaN or infinite component, have no row; repeated rows
each count and come back; of equal ids the smaller text of components starts first; a null id starts last. With
fewer than k kept vectors each of them starts a centroid; an empty table gives no rows. Components too large
for 64-bit products are handled as Python integers; a distance or sum of distances beyond a long is null. Further
columns are ignored unless ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.files import shipped
from cohortspark.session import tuned, written

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
LIMB = 40
_LONG = (1 << 63) - 1
#: Sorts after every hexadecimal digest.
_NO_ID = "~"

Centroids = list[list[int]]


def product_bound(dimensions: int) -> int:
    """Components up to this keep products with normals, and distances, within 64 bits."""
    return math.isqrt((1 << 59) // (4 * max(1, dimensions)))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; as Python integers where 64 bits may not do."""
    if not values.size or np.abs(values).max() < float(1 << 52) / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def kept_vectors(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column are kept, and those as rows of integers."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dimensions)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    rows = flat[starts[right][:, None] + np.arange(dimensions)]
    finite = np.isfinite(rows).all(axis=1)
    kept = np.zeros(len(column), dtype=bool)
    kept[right[finite]] = True
    return kept, integers(rows[finite], scale)


class Bisectors:
    """Normals and thresholds between each two of some centroids."""

    def __init__(self, centroids: Centroids) -> None:
        every = [abs(x) for centroid in centroids for x in centroid]
        self.bound = product_bound(len(centroids[0]))
        self.small = max(every, default=0) <= self.bound
        self.centroids = np.array(centroids, dtype=np.int64 if self.small else object)
        squares = (self.centroids**2).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def _decided(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        champion = np.zeros(len(rows), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            sides = (rows * self.normals[champion, rival]).sum(axis=1) - self.thresholds[champion, rival]
            champion[(sides > 0).astype(bool)] = rival
        return champion, ((rows - self.centroids[champion]) ** 2).sum(axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and the squared distance to it."""
        if self.small and rows.dtype != object and (not rows.size or np.abs(rows).max() <= self.bound):
            return self._decided(rows)
        large = (np.abs(rows) > self.bound).astype(bool).any(axis=1) | (not self.small)
        champion, distance = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=object)
        for part, kind in ((large, object), (~large, np.int64)):
            if part.any():
                champion[part], distance[part] = self._decided(rows[part].astype(kind))
        return champion, distance


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value in limbs of ``LIMB`` bits, the last of them signed: value = sum(limb << LIMB * place)."""
    place = 0
    while value not in (0, -1):
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    if value:
        yield place, value


def _rows(vectors: DataFrame, keep: Sequence[str], vector: str) -> DataFrame:
    shipped(vectors.sparkSession)
    return vectors.select(F.struct(*keep).alias("row"), F.col(vector).alias("vector"))


def first_centroids(
    vectors: DataFrame,
    k: int = CENTROIDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> Centroids:
    """The kept vectors with the smallest hashes of seed and id, in the order of the hashes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, str]] = []
        for batch in batches:
            kept, rows = kept_vectors(batch.column(1), dimensions, scale)
            ids = batch.column(0).field(0).filter(pa.array(kept)).to_pylist()
            digests = [_NO_ID if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
            last = max(heapq.nsmallest(k, digests), default="")
            near = [n for n, digest in enumerate(digests) if digest <= last]
            best = heapq.nsmallest(
                k, best + [(digests[n], ",".join(map(str, rows[n].tolist()))) for n in near]
            )
        yield pa.RecordBatch.from_pydict(
            {
                "digest": pa.array([d for d, _ in best], pa.string()),
                "components": pa.array([c for _, c in best], pa.string()),
            }
        )

    found = _rows(vectors, [id_column], vector).mapInArrow(first, "digest string, components string")
    chosen = found.orderBy("digest", "components").limit(k).collect()
    return [[int(x) for x in row.components.split(",")] for row in chosen]


def next_centroids(
    vectors: DataFrame,
    centroids: Centroids,
    scale: int = SCALE,
    vector: str = "embedding",
) -> Centroids:
    """Each centroid replaced by the exact floor of the mean of its vectors; one without vectors stays."""
    dimensions = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors, counts = Bisectors(centroids), [0] * len(centroids)
        totals: dict[int, list[int]] = {}
        for batch in batches:
            _, rows = kept_vectors(batch.column(0), dimensions, scale)
            if not len(rows):
                continue
            champion, _ = bisectors.nearest(rows)
            order = np.argsort(champion, kind="stable")
            numbers, starts = np.unique(champion[order], return_index=True)
            parts = np.add.reduceat(rows[order], starts, axis=0)
            sizes = np.diff(np.append(starts, len(order)))
            for number, part, size in zip(numbers.tolist(), parts.tolist(), sizes.tolist()):
                before = totals.get(number, [0] * dimensions)
                totals[number] = [a + b for a, b in zip(before, part)]
                counts[number] += size
        sent = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        for number, total in totals.items():
            sent += [(number, d, place, limb) for d, x in enumerate(total) for place, limb in limbs(x)]
        columns = list(zip(*sent)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ("cluster", "dimension", "place", "value")
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    shipped(vectors.sparkSession)
    found = (
        vectors.select(F.col(vector).alias("vector"))
        .mapInArrow(sums, "cluster int, dimension int, place int, value long")
        .groupBy("cluster", "dimension", "place")
        .agg(F.sum("value").alias("value"))
    )
    counts, totals = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    for row in found.collect():  # at most k * (dimensions * limbs + 1) rows
        if row.dimension < 0:
            counts[row.cluster] = row.value
        else:
            totals[row.cluster][row.dimension] += row.value << (LIMB * row.place)
    return [
        [x // n for x in total] if n else before for n, total, before in zip(counts, totals, centroids)
    ]


def assigned(
    vectors: DataFrame,
    centroids: Centroids,
    keep: Sequence[str] = ("vec_id",),
    scale: int = SCALE,
    vector: str = "embedding",
) -> DataFrame:
    """``row``, a struct of the kept columns, ``cluster`` and ``distance`` of every kept vector."""
    rows = _rows(vectors, list(keep), vector)
    dimensions = len(centroids[0])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        for batch in batches:
            kept, values = kept_vectors(batch.column(1), dimensions, scale)
            champion, distance = bisectors.nearest(values)
            exact = [d if d <= _LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(kept)),
                    pa.array(champion.astype(np.int32), pa.int32()),
                    pa.array(exact, pa.int64()),
                ],
                names=["row", "cluster", "distance"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(nearest, f"row {kind}, cluster int, distance long")


def clusters(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector: str = "embedding",
    keep: Sequence[str] = ("vec_id",),
) -> DataFrame:
    """``row``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every kept vector."""
    spark = tuned(vectors.sparkSession)
    centroids = first_centroids(vectors, k, dimensions, scale, seed, id_column, vector)
    if not centroids:  # no vector is kept, so any centroid gives no rows
        centroids = [[0] * dimensions]
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids, scale, vector)
    rows = written(assigned(vectors, centroids, keep, scale, vector), "assigned_vectors")
    sums = rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"),
        F.count_if(F.col("distance").isNull()).alias("beyond"),
    )
    total = {r.cluster: None if r.beyond else int(r.total) for r in sums.collect()}  # at most k rows
    whole = None if None in total.values() else sum(total.values())

    def fitting(value: int | None) -> int | None:
        return value if value is not None and value <= _LONG else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame(
        [(c, fitting(n), fitting(whole), digests[c]) for c, n in total.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(named), "cluster").select(  # k rows, a parameter
        "row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
