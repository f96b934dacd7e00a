"""A linear-chain conditional random field in numpy: fitted by its exact gradient, decoded by Viterbi in batches.

A token's emission score is the sum of the weights of its features; a move between tags has a score of its own.
Tags are O, and B and I of each kind; I follows B or I of its kind alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Steps, step size and penalty of the fit.
STEPS, RATE, PENALTY = 120, 0.15, 2e-3
#: Cells (tokens with padding) of one batch of sequences.
CELLS = 1 << 15
_NEVER = -1e9


def tags(kinds: Sequence[str]) -> list[str]:
    return ["O"] + [f"{place}-{kind}" for kind in kinds for place in "BI"]


def allowed_moves(names: Sequence[str]) -> np.ndarray:
    """Which tag may follow which."""
    return np.array([[b[0] != "I" or a[1:] == b[1:] for b in names] for a in names])


def padded_batches(lengths: Sequence[int]) -> Iterator[np.ndarray]:
    """Numbers of sequences of similar length, so that a batch has at most ``CELLS`` cells or one sequence."""
    order = np.argsort(np.asarray(lengths, np.int64), kind="stable")
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * max(1, lengths[order[high]]) <= CELLS:
            high += 1
        yield order[low:high]
        low = high


class Chain:
    """Weights of features by tag, row 0 of which stays zero for unknown features, and scores of moves."""

    def __init__(self, names: Sequence[str], features: int) -> None:
        self.names = list(names)
        self.allowed = allowed_moves(names)
        self.first = np.array([name[0] != "I" for name in names])
        self.weights = np.zeros((features + 1, len(names)), np.float32)
        self.moves = np.zeros((len(names),) * 2, np.float32)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of every tag for tokens, given as rows of feature numbers."""
        found = np.zeros((len(ids), len(self.names)), np.float32)
        for column in ids.T:
            found += self.weights[column]
        return found

    def fit(self, sequences: Sequence[np.ndarray], answers: Sequence[np.ndarray]) -> None:
        """Maximises the penalised likelihood of the answers by Adam over the whole table."""
        lengths = np.array([len(s) for s in sequences])
        count, longest, size = len(sequences), int(lengths.max()), len(self.names)
        ids = np.zeros((count, longest, sequences[0].shape[1]), np.int64)
        right = np.zeros((count, longest, size), np.float64)
        for n, (sequence, answer) in enumerate(zip(sequences, answers)):
            ids[n, : len(sequence)] = sequence
            right[n, np.arange(len(answer)), answer] = 1
        inside = np.arange(longest) < lengths[:, None]
        flat = ids[inside]
        order = np.argsort(flat.ravel(), kind="stable")
        token = order // flat.shape[1]
        number, starts = np.unique(flat.ravel()[order], return_index=True)
        seen = np.einsum("nta,ntb->ab", right[:, :-1], right[:, 1:])
        weights, moves = self.weights.astype(np.float64), self.moves.astype(np.float64)
        state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
        for step in range(1, STEPS + 1):
            expected, moved = self._expected(weights, moves, ids, lengths, inside)
            wrong = (right - expected)[inside]
            slope = np.zeros_like(weights)
            slope[number] = np.add.reduceat(wrong[token], starts, axis=0)
            slope = slope / count - PENALTY * weights
            slope[0] = 0
            bend = (seen - moved) / count - PENALTY * moves
            rate = RATE * (1 - step / (STEPS + 1)) ** 0.5
            for value, grown, part, whole in ((weights, slope, 0, 1), (moves, bend, 2, 3)):
                state[part] = 0.9 * state[part] + 0.1 * grown
                state[whole] = 0.99 * state[whole] + 0.01 * grown**2
                scale = np.sqrt(state[whole] / (1 - 0.99**step)) + 1e-8
                value += rate * state[part] / (1 - 0.9**step) / scale
        self.weights, self.moves = weights.astype(np.float32), moves.astype(np.float32)

    def _expected(self, weights, moves, ids, lengths, inside):
        """Expected tags of each token and moves in all, by scaled forward and backward sums."""
        score = weights[ids].sum(axis=2)
        score = np.exp(score - score.max(axis=2, keepdims=True))
        step = np.exp(moves) * self.allowed
        count, longest, size = score.shape
        ahead = np.empty_like(score)
        now = score[:, 0] * self.first
        ahead[:, 0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            now = (ahead[:, t - 1] @ step) * score[:, t]
            now /= now.sum(axis=1, keepdims=True)
            ahead[:, t] = np.where(inside[:, t, None], now, ahead[:, t - 1])
        back = np.ones((count, size))
        expected, moved = np.zeros_like(score), np.zeros_like(step)
        for t in range(longest - 1, -1, -1):
            live = inside[:, t, None]
            own = ahead[:, t] * back
            own /= own.sum(axis=1, keepdims=True)
            expected[:, t] = np.where(live, own, 0)
            if t:
                onward = np.where(live, score[:, t] * back, 0)
                total = ((ahead[:, t - 1] @ step) * onward).sum(axis=1, keepdims=True)
                onward = np.divide(onward, total, out=np.zeros_like(onward), where=total > 0)
                moved += (ahead[:, t - 1].T @ onward) * step
                behind = onward @ step.T
                behind /= np.maximum(behind.max(axis=1, keepdims=True), 1e-300)
                back = np.where(live, behind, back)
        return expected, moved

    def decode(self, sequences: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each sequence of feature rows; among equals the first tag."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        lengths = [len(s) for s in sequences]
        step = np.where(self.allowed, self.moves, np.float32(_NEVER))
        for batch in padded_batches(lengths):
            longest = max(lengths[i] for i in batch)
            if not longest:
                continue
            score = np.zeros((len(batch), longest, len(self.names)), np.float32)
            for n, i in enumerate(batch):
                score[n, : lengths[i]] = self.emissions(sequences[i])
            sizes = np.array([lengths[i] for i in batch])
            best = np.where(self.first, score[:, 0], np.float32(_NEVER))
            came = np.zeros((longest, len(batch), len(self.names)), np.int8)
            for t in range(1, longest):
                paths = best[:, :, None] + step
                came[t] = paths.argmax(axis=1)
                now = paths.max(axis=1) + score[:, t]
                best = np.where((t < sizes)[:, None], now - now.max(axis=1, keepdims=True), best)
            tag = best.argmax(axis=1)
            answer = np.zeros((len(batch), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                answer[:, t] = tag
                live = t < sizes
                tag = np.where(live, came[t, np.arange(len(batch)), tag], tag)
            for n, i in enumerate(batch):
                found[i] = answer[n, : lengths[i]]
        return found
