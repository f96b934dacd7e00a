from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from cohortspark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, row string, cluster int, distance long, vector string"


def brute(rows, k=16, rounds=3, dimensions=64):
    """The contract, one vector and one centroid at a time."""
    kept = []
    for vec_id, vector in rows:
        if vector is None or len(vector) != dimensions or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [int(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x) for x in vector]))

    def start(pair):
        digest = "~" if pair[0] is None else hashlib.sha256(f"1:{pair[0]}".encode()).hexdigest()
        return digest, ",".join(map(str, pair[1]))

    centres = [q for _, q in sorted(kept, key=start)[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, q in kept:
            members[nearest(q)[1]].append(q)
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centres)]
    found = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = sum(d for _, _, d in found)

    def fits(x):
        return x if x < 2**63 else None

    def digest(c):
        return hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()

    of = {c: sum(d for _, o, d in found if o == c) for _, c, _ in found}
    return sorted(
        ((i, c, fits(d), fits(of[c]), fits(inertia), digest(c)) for i, c, d in found),
        key=repr,
    )


def found(spark, rows, partitions=3, **options):
    wide = [(i, v, 1, "clash", 9, -1, "v") for i, v in rows]
    table = spark.createDataFrame(wide, SCHEMA).repartition(partitions)
    result = centroids.clusters(table, **options).selectExpr(
        "row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
    return sorted((tuple(r) for r in result.collect()), key=repr)


def vectors(seed, n, dimensions=64, spread=0.5):
    draw = random.Random(seed)
    return [(i, [draw.uniform(-spread, spread) for _ in range(dimensions)]) for i in range(n)]


def test_against_brute_force_with_odd_rows(spark):
    rows = vectors(3, 150)
    rows += [(rows[n][0], rows[n][1]) for n in (4, 9, 9)]  # repeated rows
    rows += [(500 + n, rows[n % 5][1]) for n in range(60)]  # many copies of five vectors
    rows += [(7, rows[30][1]), (None, rows[31][1]), (None, rows[32][1])]
    rows += [(800, None), (801, []), (802, [0.1] * 63), (803, [0.1] * 65), (804, [None] + [0.1] * 63)]
    rows += [(805, [math.nan] + [0.1] * 63), (806, [0.1] * 63 + [math.inf]), (807, [0.0] * 64), (808, [-0.0] * 64)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, partitions=7) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice((-1.0, 0.0, 1.0)) / 64 for _ in range(4)]) for i in range(200)]
    assert found(spark, rows, dimensions=4, k=9) == brute(rows, k=9, dimensions=4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(8, 5)
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [1.0])]) == []


def test_components_beyond_64_bit_products(spark):
    rows = vectors(9, 30) + [(100 + i, [x * 10.0 ** (6 * i) for x in v]) for i, (_, v) in enumerate(vectors(10, 12))]
    rows += [(200, [1e300] * 64), (201, [-1e308] + [0.0] * 63)]
    assert found(spark, rows) == brute(rows)


def test_limbs_sum_to_the_value():
    for value in (0, 1, -1, 2**40, -(2**40), 2**40 - 1, -(2**80) - 5, 3**90, -(3**200)):
        assert sum(limb << (centroids.LIMB * place) for place, limb in centroids.limbs(value)) == value


@pytest.mark.parametrize("large", [False, True])
def test_tournament_against_all_distances(large):
    draw = np.random.default_rng(4)
    centres = draw.integers(-6, 7, (12, 5)).tolist()
    rows = draw.integers(-9, 10, (400, 5))
    if large:
        rows[::7] *= 10**9
    champion, distance = centroids.Bisectors(centres).nearest(rows)
    for row, c, d in zip(rows.tolist(), champion.tolist(), distance.tolist()):
        assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(row, m)), n) for n, m in enumerate(centres))
