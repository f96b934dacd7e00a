from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from cohortspark.llm import spelling
from cohortspark.llm.fm_index import WordIndex
from helpers import SCHEMA, no_documents, odd_rows, row


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, cut=199):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % cut == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(rows, cut=199):
    n = brute_words(rows, cut)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    result = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return result


def documents(seed, count, words):
    """Texts of few stems with many misspellings, counts of very different size."""
    draw = random.Random(seed)
    stems = ["".join(draw.choices("abcdeéÿ", k=draw.randint(6, 11))) for _ in range(12)]
    stems += [stems[0][:5] + "x" + stems[0][5:], stems[0][:5] + "xy" + stems[0][6:], "aaaaaaa", "aaaaaaaa", "aaaaaab"]
    rows = []
    for i in range(count):
        body = []
        for _ in range(words):
            w = stems[min(draw.randrange(len(stems)), draw.randrange(len(stems)))]
            for _ in range(draw.choice((0, 0, 0, 0, 0, 0, 1, 2))):
                at = draw.randrange(len(w) + 1)
                w = draw.choice((w[:at] + w[at + 1 :], w[:at] + draw.choice("aAbé") + w[at:], w[:at] + "Ã" + w[at + 1 :]))
            body.append(w)
        rows.append(row(i, draw.choice((" ", ". ", "1", "—")).join(body)))
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    result = spelling.variants(docs, **options)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in result.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    chain = "maximum " * 200 + "Maximom " * 30 + "maxemom " * 6
    rows = documents(1, 60, 150) + odd_rows() + [row(10_001, chain)]
    wanted = brute(rows)
    assert any(w[1] and w[2] != w[1] for w in wanted)  # a chain of two forms
    assert found(spark, rows) == wanted


@pytest.mark.parametrize("shard_words", [1, 7, 40])
def test_groups_beyond_a_shard_are_dealt_in_pieces(spark, shard_words):
    rows = documents(2, 40, 120)
    assert found(spark, rows, shard_words=shard_words, cut=3) == brute(rows, cut=3)


def test_no_documents(spark):
    assert spelling.variants(no_documents(spark)).collect() == []


def test_long_words_and_pieces_of_texts(spark, monkeypatch):
    long = "ab" * 3000
    rows = [row(i, f"{long} {long}c {long[:-1]} {long}") for i in range(6)]
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "abcdefgh abcdefghijklmnop, xyz " * 5
    assert "".join(spelling._pieces(text)) == text
    assert all(len(p) < 30 for p in spelling._pieces(text))


def test_one_error_of_either_half_against_all_words():
    draw = random.Random(1)
    words = sorted({"".join(draw.choices("abé", k=draw.randint(4, 7))) for _ in range(700)})
    index = WordIndex(words)
    for length in (4, 5, 6, 7):
        queries = [w for w in words if len(w) == length] + ["zabab" + "a" * (length - 5)] * (length > 4)
        symbols, half = index.symbols(queries), length // 2
        pairs = set()
        for first in (True, False):
            for q, w in zip(*(x.tolist() for x in index.one_error(symbols, half, first))):
                kept = slice(0, half) if first else slice(half - length, None)
                assert words[w][kept] == queries[q][kept]
                pairs.add((queries[q], words[w]))
        assert pairs == {(a, b) for a in queries for b in words if is_near(a, b)}
