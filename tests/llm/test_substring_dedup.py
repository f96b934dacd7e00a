from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cohortspark.llm import substring_dedup
from cohortspark.llm.suffix_array import permuted_common_prefixes, suffix_array
from helpers import no_documents, odd_documents, odd_rows, text

LENGTH = substring_dedup.LENGTH


def test_suffix_arrays_against_sorting():
    draw = random.Random(3)
    for _ in range(600):
        top = draw.choice([1, 2, 3, 8, 2000])
        symbols = [draw.randint(1, top) for _ in range(draw.randint(0, 60))] + [0]
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        data = np.array(symbols)
        assert suffix_array(data).tolist() == order
        shared = permuted_common_prefixes(data, np.array(order), 5)
        for a, b in zip(order, order[1:]):
            same = 0
            while same < 5 and max(a, b) + same < len(data) and data[a + same] == data[b + same]:
                same += 1
            assert shared[b] == same


def brute(docs):
    top = 1 << 62
    first = {}
    for doc_id, body in docs:
        raw = (body or "").encode()
        for p in range(len(raw) - LENGTH + 1):
            window = raw[p : p + LENGTH]
            first[window] = min(first.get(window, top), top if doc_id is None else doc_id)
    out = []
    for doc_id, body in docs:
        raw = (body or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - LENGTH + 1):
            if first[raw[p : p + LENGTH]] < (top if doc_id is None else doc_id):
                gone[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **options):
    rows = substring_dedup.removed_spans(docs, **options).drop("removed").collect()
    return sorted(map(tuple, rows), key=repr)


def planted(seed):
    draw = random.Random(seed)
    passages = [text(50 + n, 12 + 3 * n) for n in range(5)]
    docs = []
    for doc_id in draw.sample(range(1000), 40):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            parts.append(draw.choice(passages) if draw.random() < 0.5 else text(draw.randrange(10**6), 15))
        docs.append((doc_id, " ".join(parts)))
    docs += [(2000, "ab" * 200), (2001, "xab" + "ab" * 60), (2002, "a" * 300), (2003, "a" * 49), (2004, "a" * 60)]
    return docs


@pytest.mark.parametrize("hot_rows", [substring_dedup.HOT_ROWS, 0])
def test_against_brute_force(spark, hot_rows, monkeypatch):
    docs = planted(hot_rows)
    if not hot_rows:
        monkeypatch.setattr(substring_dedup, "HOT_DRAW", 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame, hot_rows=hot_rows) == brute(docs)


def test_texts_in_pieces_and_batches(monkeypatch):
    docs = planted(9)
    raw = " ".join(b for _, b in docs).encode()
    none = np.zeros(0, np.uint64)
    whole = substring_dedup.segments(raw, none)
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    cut = substring_dedup.segments(raw, none)
    for anchors, _, first, count in (whole, cut):
        assert int(count.sum()) == len(raw) - LENGTH + 1
        assert np.array_equal(np.sort(first)[1:], (np.sort(first) + count[np.argsort(first)])[:-1])
    spread = [np.repeat(p[0][np.argsort(p[2])], p[3][np.argsort(p[2])]) for p in (whole, cut)]
    assert np.array_equal(*spread)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 10_000]
    assert found(odd_documents(spark).filter("coalesce(length(text), 0) < 10000")) == brute([r[:2] for r in rows])
    assert substring_dedup.removed_spans(odd_documents(spark)).count() == len(odd_rows())
    assert found(no_documents(spark)) == []
