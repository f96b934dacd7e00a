"""The small linear algebra of a binomial fit: what is solved once the sums over the births are known.

A model's categories are numbered, 0 being the intercept. Sums over rows by category, and by pair of them, are
given; nothing here sees a row of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

Z = 1.959963984540054
#: A step below this is the last; so many passes are made at most.
SETTLED, PASSES = 1e-8, 60
#: A step is at most so long.
LONGEST = 4.0
#: A likelihood that is less by this part is one that rounding can't explain.
LESS = 1e-9
#: Linear predictors beyond this are on their way to infinity, where rows can be predicted exactly.
FAR = 20.0
#: A row of one outcome that is fitted this closely is predicted exactly: its estimate has no finite value.
EXACT = 1e-6
_NOTHING, _IN_PART = 1e-9, 1e-6

ACTIVE, DONE, LEFT = 0, 1, 2


def square(size: int, a: np.ndarray, b: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The symmetric matrix of sums by pair of categories a <= b."""
    found = np.zeros((size, size))
    found[a, b] = sums
    found[b, a] = sums
    return found


def eliminated(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns are independent, and which coefficients can be traded against others.

    ``products`` are cross products of the columns. Columns are eliminated one by one, that with the largest rest
    first, until nothing is left; what then remains of a column is its combination of the independent ones, and
    every column of such a combination has no coefficient of its own.
    """
    size = len(products)
    scale = np.sqrt(np.maximum(np.diag(products), 0))
    scale[scale == 0] = 1
    rest = products / np.outer(scale, scale)
    independent = np.zeros(size, dtype=bool)
    while not independent.all():
        left = np.where(independent, -1.0, np.diag(rest))
        pivot = int(left.argmax())
        if left[pivot] <= _NOTHING:
            break
        row = rest[pivot] / rest[pivot, pivot]
        rest = rest - np.outer(rest[:, pivot], row)
        rest[pivot] = row
        independent[pivot] = True
    combined = np.abs(rest[:, ~independent]) > _IN_PART
    loose = ~independent
    loose[independent] = combined[independent].any(axis=1)
    return independent, loose


class Point(NamedTuple):
    """A fit between two passes: ``at`` is to be rated next, ``accepted`` was rated best."""

    at: np.ndarray
    accepted: np.ndarray
    best: float
    status: int
    passes: int
    variance: np.ndarray
    independent: np.ndarray
    loose: np.ndarray
    #: No direction of the coefficients leaves all rows of both outcomes alone, so no row is predicted exactly.
    certain: bool


def begun(size, a, b, rows, mixed, births, cases) -> Point:
    """The first point, from sums by pair of categories: rows, rows of both outcomes, births and cases.

    With the intercept alone every row has the same share, so these sums give the first step too.
    """
    independent, loose = eliminated(square(size, a, b, rows))
    among_mixed, _ = eliminated(square(size, a, b, mixed))
    whole = int(np.flatnonzero((a == 0) & (b == 0))[0])
    share = cases[whole] / births[whole]
    at = np.zeros(size)
    at[0] = np.log(share / (1 - share))
    nothing = np.full(size, np.nan)
    certain = bool(among_mixed.sum() == independent.sum())
    start = Point(at, at, -np.inf, ACTIVE, 0, nothing, independent, loose, certain)
    likelihood = cases[whole] * np.log(share) + (births[whole] - cases[whole]) * np.log(1 - share)
    return moved(start, a, b, share * (1 - share) * births, cases - share * births, likelihood, abs(at[0]))


def moved(point: Point, a, b, information, score, likelihood, far) -> Point:
    """Newton's next point from the sums at ``at``; a step that lowers the likelihood is halved instead."""
    passes, size = point.passes + 1, len(point.at)
    if likelihood < point.best - LESS * abs(point.best):
        status = LEFT if passes >= PASSES else ACTIVE
        return point._replace(at=(point.at + point.accepted) / 2, passes=passes, status=status)
    independent = point.independent
    inner = square(size, a, b, information)[np.ix_(independent, independent)]
    inverse = np.linalg.pinv(inner, rcond=1e-13, hermitian=True)
    slope, own = np.zeros(size), a == b
    slope[a[own]] = score[own]
    step = np.zeros(size)
    step[independent] = inverse @ slope[independent]
    variance = np.full(size, np.nan)
    variance[independent] = np.diag(inverse)
    longest = float(np.abs(step).max())
    settled = longest < SETTLED
    over = settled or passes >= PASSES or (not point.certain and far > FAR)
    step *= min(1.0, LONGEST / longest) if longest else 1.0
    onward = point.at + step if settled or not over else point.at
    return point._replace(
        at=onward,
        accepted=onward if settled else point.at,
        best=likelihood,
        status=(DONE if settled else LEFT) if over else ACTIVE,
        passes=passes,
        variance=variance,
    )


def _points(rows: Iterator[tuple[str, Point]]) -> pd.DataFrame:
    return pd.DataFrame([(model, *point) for model, point in rows], columns=["model", *Point._fields])


def begin_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first point of each model."""
    for batch in batches:
        rows = batch.itertuples(index=False)
        yield _points(
            (row.model, begun(int(max(row.b)) + 1, row.a, row.b, row.s0, row.s1, row.s2, row.s3)) for row in rows
        )


def move_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The next point of each model."""

    def onward(row) -> Point:
        before = Point(*(getattr(row, name) for name in Point._fields))
        before = before._replace(independent=before.independent.astype(bool))
        return moved(before, row.a, row.b, row.s0, row.s1, row.total, row.most)

    for batch in batches:
        yield _points((row.model, onward(row)) for row in batch.itertuples(index=False))
