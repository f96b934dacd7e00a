"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's text."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, most: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; its last symbol must be 0 and the only 0.

    Every suffix is smaller (S) or larger (L) than the next one. An S after an L starts a leftmost-smaller
    substring; these are sorted by one induction, named, and, where names repeat, sorted by the names that
    follow. A second induction from their order gives the order of all suffixes. With ``most``, suffixes that
    share so many symbols may stand in any order among themselves.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _smaller(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if int(text.max()) < 1 << 16:
        text = text.astype(np.uint16)  # which numpy sorts by radix
    order = _induced(text, smaller, leftmost)
    starts = np.zeros(n, dtype=bool)
    starts[leftmost] = True
    by_substring = order[starts[order]]
    names, count = _names(text, leftmost, by_substring)
    if count < len(leftmost):
        # Leftmost-smaller substrings start two symbols apart or more.
        by_suffix = leftmost[_by_doubling(names, None if most is None else (most + 1) // 2)]
    else:
        by_suffix = by_substring
    return _induced(text, smaller, by_suffix)


def _by_doubling(names: np.ndarray, most: int | None) -> np.ndarray:
    """Starts of the suffixes of a string of names in order, by prefixes of 1, 2, 4, ... names.

    A suffix's rank is the first place of those that share its prefix; only such as share it move on.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    left, group, shared = np.arange(n), names[order], 1
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.append(True, group[1:] != group[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(left)))
        rank[order[left]] = np.repeat(left[first], sizes)
        left = left[np.repeat(sizes > 1, sizes)]
        if not len(left) or (most is not None and shared >= most):
            return order
        part = order[left]
        after = np.where(part + shared < n, rank[np.minimum(part + shared, n - 1)] + 1, 0)
        group = rank[part] * (n + 1) + after
        by_group = np.argsort(group, kind="stable")
        order[left], group = part[by_group], group[by_group]
        shared *= 2


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    steps = np.append(np.sign(np.diff(text.astype(np.int64))), 1)
    places = np.where(steps != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(places[::-1])[::-1]
    return steps[following] > 0


def _names(text: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings, in text order, and how many differ."""
    ends = np.empty(len(text), dtype=np.int64)
    ends[leftmost] = np.append(leftmost[1:], len(text) - 1)
    lengths = ends[order] - order + 1
    same = np.append(False, lengths[1:] == lengths[:-1])
    left = np.flatnonzero(same)
    offset = 0
    while len(left):
        left = left[lengths[left] > offset]
        unlike = text[order[left] + offset] != text[order[left - 1] + offset]
        same[left[unlike]] = False
        left = left[~unlike]
        offset += 1
    ranks = np.empty(len(text), dtype=np.int64)
    ranks[order] = np.cumsum(~same) - 1
    return ranks[leftmost], int((~same).sum())


def _edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the symbols' buckets, and the places after their last."""
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    return ends - counts, ends


def _runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, ranks among equals in that order, and the symbols with their counts."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(first, len(ordered)))
    return order, np.arange(len(ordered)) - np.repeat(first, counts), ordered[first], counts


def _induced(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Both inductions, a bucket at a time: what a bucket's suffixes induce is placed in one step.

    A suffix may induce one of its own bucket; such suffixes are the next step of the same bucket.
    """
    found = np.full(len(text), -1, dtype=np.int64)
    heads, ends = _edges(text)
    starts, tails = heads.copy(), ends.copy()
    # Leftmost-smaller suffixes stand at the ends of their buckets, in the given order.
    order, ranks, symbols, counts = _runs(text[leftmost])
    found[np.repeat(ends[symbols] - counts, counts) + ranks] = leftmost[order]
    firsts = ends.copy()
    firsts[symbols] -= counts

    def place(sources: np.ndarray, larger: bool) -> None:
        before = sources[sources > 0] - 1
        before = before[smaller[before] != larger]
        if not len(before):
            return
        order, ranks, symbols, counts = _runs(text[before])
        at = text[before[order]]
        if larger:
            found[heads[at] + ranks] = before[order]
            heads[symbols] += counts
        else:
            found[tails[at] - 1 - ranks] = before[order]
            tails[symbols] -= counts

    buckets = np.flatnonzero(ends > starts).tolist()
    for c in buckets:
        done = starts[c]
        while done < heads[c]:
            low, done = done, heads[c]
            place(found[low:done], True)
        place(found[firsts[c] : ends[c]], True)
    for c in reversed(buckets):
        done = ends[c]
        while done > tails[c]:
            high, done = done, tails[c]
            place(found[done:high][::-1], False)
        place(found[starts[c] : heads[c]][::-1], False)
    found[0] = len(text) - 1
    return found


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place, the symbols its suffix shares with the one before it in order, up to ``most``.

    Found in text order, all places one symbol at a time; a place leaves at its first difference. ``order`` may
    leave suffixes out, whose places get 0.
    """
    before = np.empty(len(text), dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(text), dtype=np.int64)
    left = np.sort(order[1:])
    for length in range(most):
        left = left[np.maximum(left, before[left]) + length < len(text)]
        left = left[text[left + length] == text[before[left] + length]]
        if not len(left):
            break
        shared[left] = length + 1
    return shared
