"""A bidirectional FM-index over a delimited list of words, searched for many patterns at once in numpy.

The text is the sorted words, each between delimiters. Rows of suffixes that start with a delimiter come in the order
of the words, so the rank of such a suffix names its word and no suffix array is kept. Two wavelet matrices, of the
Burrows-Wheeler transforms of the text and of its reverse, give for an interval of suffixes the interval of any
symbol before or after it, and keep both intervals in step.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

#: Symbols below the letters: the end of the text and the delimiter of words.
END, DELIMITER, FIRST_LETTER = 0, 1, 2


class States(NamedTuple):
    """Intervals of suffixes of many searches: ``pattern`` is the row of each in its list of patterns.

    ``low`` are the starts in the index that is read next and ``other`` those in the other one; ``size`` is common.
    """

    pattern: np.ndarray
    low: np.ndarray
    other: np.ndarray
    size: np.ndarray

    def only(self, rows: np.ndarray) -> States:
        return States(*(column[rows] for column in self))

    def turned(self) -> States:
        """The same intervals, to be extended in the other direction."""
        return States(self.pattern, self.other, self.low, self.size)


def joined(parts: Sequence[States]) -> States:
    return States(*(np.concatenate(columns) for columns in zip(*parts)))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes in their order; the last symbol occurs once and is the least."""
    size, bits = len(text), max(1, int(text.max()).bit_length())
    known = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(known, np.int64)])
    key = np.zeros(size, np.int64)
    for place in range(known):
        key = (key << bits) | padded[place : place + size]
    while True:
        order = np.argsort(key, kind="stable")
        placed = key[order]
        fresh = np.concatenate([[0], (placed[1:] != placed[:-1]).astype(np.int64)]).cumsum()
        if fresh[-1] == size - 1:
            return order
        rank = np.zeros(size + known, np.int64)
        rank[order] = fresh + 1
        key = rank[:size] * (size + 1) + rank[known : known + size] if known < size else rank[:size]
        known *= 2


class WaveletMatrix:
    """A sequence of symbols by bits, the highest first; zeros of each level are counted up to every place."""

    def __init__(self, symbols: np.ndarray, letters: int) -> None:
        self.levels = max(1, (letters - 1).bit_length())
        self.counts, self.zeros = [], []
        kept = symbols
        for level in reversed(range(self.levels)):
            ones = ((kept >> level) & 1).astype(bool)
            count = np.zeros(len(kept) + 1, np.int32)
            np.cumsum(~ones, out=count[1:])
            self.counts.append(count)
            self.zeros.append(int(count[-1]))
            kept = np.concatenate([kept[~ones], kept[ones]])
        total = np.bincount(symbols, minlength=letters)
        self.before = np.concatenate([[0], np.cumsum(total)[:-1]])
        every = np.arange(letters)
        start = np.zeros(letters, np.int64)
        for level, count, zeros in zip(reversed(range(self.levels)), self.counts, self.zeros):
            start = np.where((every >> level) & 1, zeros + start - count[start], count[start])
        self.shift = self.before - start

    def narrowed(self, states: States, symbol: np.ndarray) -> States:
        """The intervals one symbol further; empty ones and unknown symbols (-1) are left out."""
        if (symbol < 0).any():
            states, symbol = states.only(symbol >= 0), symbol[symbol >= 0]
        low, high, other = states.low, states.low + states.size, states.other
        pattern = states.pattern
        for level, count, zeros in zip(reversed(range(self.levels)), self.counts, self.zeros):
            a, b = count[low].astype(np.int64), count[high].astype(np.int64)
            one = ((symbol >> level) & 1).astype(bool)
            other = np.where(one, other + b - a, other)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
            some = high > low
            if not some.all():
                low, high, other, symbol, pattern = (x[some] for x in (low, high, other, symbol, pattern))
        return States(pattern, low + self.shift[symbol], other, high - low)

    def children(self, states: States) -> tuple[States, np.ndarray]:
        """The intervals one symbol further, for every symbol that occurs there, and those symbols."""
        low, high, other = states.low, states.low + states.size, states.other
        pattern, symbol = states.pattern, np.zeros(len(low), np.int64)
        for count, zeros in zip(self.counts, self.zeros):
            a, b = count[low].astype(np.int64), count[high].astype(np.int64)
            zero, one = b > a, (high - low) > (b - a)
            low, high, other = (
                np.concatenate([left[zero], right[one]])
                for left, right in (
                    (a, zeros + low - a),
                    (b, zeros + high - b),
                    (other, other + b - a),
                )
            )
            pattern = np.concatenate([pattern[zero], pattern[one]])
            symbol = np.concatenate([symbol[zero] * 2, symbol[one] * 2 + 1])
        return States(pattern, low + self.shift[symbol], other, high - low), symbol


class WordIndex:
    """Both directions over ``words``, sorted by code points and possibly repeated."""

    def __init__(self, words: Sequence[str]) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.alphabet = np.unique(points)
        letters = np.searchsorted(self.alphabet, points) + FIRST_LETTER
        #: Where each word starts in the text, and its length.
        self.starts, self.lengths = np.cumsum(lengths + 1) - lengths, lengths
        text = np.full(len(points) + len(words) + 2, DELIMITER, np.int64)
        text[np.repeat(self.starts, lengths) + _counted(lengths)] = letters
        text[-1] = END
        self.text, size = text, len(self.alphabet) + FIRST_LETTER
        backwards = np.append(text[-2::-1], END)
        self.leftwards, self.rightwards = (
            WaveletMatrix(part[suffix_order(part) - 1], size) for part in (text, backwards)
        )

    def symbols(self, words: Sequence[str]) -> np.ndarray:
        """The letters of words of one length, a row for each; -1 for a letter no indexed word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if not len(self.alphabet):
            return np.full((len(words), len(points) // max(1, len(words))), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        found = np.where(self.alphabet[at] == points, at + FIRST_LETTER, -1)
        return found.reshape(len(words), -1)

    def whole(self, patterns: int) -> States:
        """The empty pattern, once for each row of a list of patterns; to be extended leftwards first."""
        zeros = np.zeros(patterns, np.int64)
        return States(np.arange(patterns), zeros, zeros, zeros + len(self.text))

    def one_error(self, words: np.ndarray, half: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``words``, indexed word) that differ by exactly one error outside the exact half.

        ``words`` are symbols of words of one length. With ``first`` the exact half is the letters before ``half``:
        it is matched from its last letter leftwards to the delimiter, then the rest is read rightwards with one
        letter replaced, inserted or left out. Without, the exact half is the letters from ``half``, matched
        rightwards, and the rest is read leftwards. A pair may come more than once.
        """
        if first:
            exact, rest = words[:, :half][:, ::-1], words[:, half:]
            outward, inward = self.leftwards, self.rightwards
        else:
            exact, rest = words[:, half:], words[:, :half][:, ::-1]
            outward, inward = self.rightwards, self.leftwards
        states = self.whole(len(words))
        for place in range(exact.shape[1]):
            states = outward.narrowed(states, exact[states.pattern, place])
        states = outward.narrowed(states, np.full(len(states.low), DELIMITER)).turned()
        wrong = states.only(np.zeros(0, np.int64))
        for place in range(rest.shape[1] + 1):
            last = place == rest.shape[1]
            further, symbol = inward.children(states)
            letter = symbol >= FIRST_LETTER
            inserted = further.only(letter)
            wrong = joined([wrong, inserted])
            if last:
                break
            wrong = inward.narrowed(wrong, rest[wrong.pattern, place])
            replaced = further.only(letter & (symbol != rest[further.pattern, place]))
            wrong = joined([wrong, states, replaced])
            states = inward.narrowed(states, rest[states.pattern, place])
        wrong = inward.narrowed(wrong, np.full(len(wrong.low), DELIMITER))
        low = wrong.other if first else wrong.low
        # Ranks 0 and 1 are the end of the text and the delimiter before it.
        word = np.repeat(low - 2, wrong.size) + _counted(wrong.size)
        return np.repeat(wrong.pattern, wrong.size), word


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
