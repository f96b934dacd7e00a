from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import simhash
from helpers import no_documents, odd_documents, odd_rows

ALL = (1 << 64) - 1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    label = list(range(len(values)))
    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def test_fingerprints_against_brute_force():
    for _, text, *_ in odd_rows():
        if len(text or "") < 10_000:
            assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choices([" ", "A", "é ", "b\n", "\xa0", "\x1c", "日"], k=draw.randint(0, 30)))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_every_near_pair_meets_in_a_table():
    masks = simhash.covering_masks(ALL)
    assert len(masks) == 15
    for bits in combinations(range(64), 3):
        flipped = sum(1 << b for b in bits)
        assert any(mask & flipped == 0 for mask in masks)


def test_further_cuts_cover_too_and_end():
    draw = random.Random(1)
    for _ in range(20):
        kept = 0
        for depth in range(3):
            own = simhash.covering_masks(ALL & ~kept)
            free = [b for b in range(64) if not kept >> b & 1]
            for bits in combinations(draw.sample(free, min(len(free), 9)), 3):
                assert any(mask & sum(1 << b for b in bits) == 0 for mask in own)
            kept |= draw.choice(own)
        assert 64 - kept.bit_count() <= 9


def test_forest_connects_what_links():
    draw = random.Random(5)
    for _ in range(100):
        base = draw.getrandbits(64)
        values = {base ^ sum(1 << draw.randrange(12) for _ in range(draw.randrange(5))) & ALL for _ in range(30)}
        values = np.array(sorted(v & ALL for v in values), dtype=np.uint64)
        a, b = simhash.forest(values)
        label = brute_components([int(v) for v in values])
        assert len(a) == len(values) - len(set(label))
        assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b))


@pytest.mark.parametrize("most", [8192, 3])
def test_links_against_brute_force(spark, most):
    draw, values = random.Random(most), set()
    for _ in range(4):
        base = draw.getrandbits(64)
        for _ in range(60):
            value = base
            for _ in range(draw.randrange(6)):
                value ^= 1 << draw.randrange(64)
            values.add(value)
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = simhash.link_fingerprints(frame, most)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(((x ^ y) & ALL).bit_count() <= 3 for x, y in pairs)
    roots = {r.node: r.root for r in simhash.components(spark, links).collect()}
    signed = [simhash._signed(v) for v in values]
    found = {}
    for value in signed:
        found.setdefault(roots.get(value, value), set()).add(value)
    want = {}
    for value, label in zip(signed, brute_components(values)):
        want.setdefault(label, set()).add(value)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1060)] + [(5, 5)]
    links = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in simhash.components(spark, links).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1060)}} | {
        k: v for k, v in roots.items() if k == v
    }


def test_odd_rows(spark):
    odd = odd_documents(spark)
    found = simhash.clusters(odd).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id")
    rows = sorted(map(tuple, found.collect()), key=repr)
    ids = [r[0] for r in odd_rows()]
    values = [simhash.fingerprint((r[1] or "").encode()) for r in odd_rows()]
    label = brute_components(values)
    least = {
        n: min((i for i, k in zip(ids, label) if k == n and i is not None), default=None) for n in label
    }
    want = [(i, f"{v:016x}", least[n]) for i, v, n in zip(ids, values, label)]
    assert rows == sorted(want, key=repr)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(label))
    assert simhash.one_of_each(no_documents(spark)).count() == 0
