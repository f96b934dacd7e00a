from __future__ import annotations

import random
import sys

import numpy as np

from cohortspark.llm import suffix_array as module
from cohortspark.llm.suffix_array import permuted_common_prefixes, suffix_array


def repetitive(draw: random.Random, size: int) -> np.ndarray:
    """Segments that are mostly copies of one passage, as a shard holds them."""
    passage = [draw.randint(2, 9) for _ in range(120)]
    symbols = []
    while len(symbols) < size:
        low = draw.randrange(60)
        part = passage[low : low + 60]
        part[draw.randrange(60)] = draw.randint(2, 9)
        symbols += [*part, 1]
    return np.array([*symbols, 0])


def test_suffixes_stand_in_the_order_of_their_first_symbols():
    draw = random.Random(8)
    for most in (1, 2, 7, 50):
        data = repetitive(draw, 3_000)
        order = suffix_array(data, most).tolist()
        heads = [tuple(data[i : i + most].tolist()) for i in order]
        assert sorted(order) == list(range(len(data))) and heads == sorted(heads)
        chosen = np.array([i for i in order if i % 3])
        shared = permuted_common_prefixes(data, chosen, most)
        for a, b in zip(chosen.tolist(), chosen[1:].tolist()):
            same = 0
            while same < most and max(a, b) + same < len(data) and data[a + same] == data[b + same]:
                same += 1
            assert shared[b] == same
        assert not shared[::3].any()


def test_no_step_takes_a_symbol_at_a_time():
    """A shard has a million symbols: the lines run follow from the alphabet, not from the length."""
    data = repetitive(random.Random(9), 40_000)
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return trace if frame.f_code.co_filename == module.__file__ else None

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        suffix_array(data)
    finally:
        sys.settrace(before)
    assert lines < len(data) // 4
