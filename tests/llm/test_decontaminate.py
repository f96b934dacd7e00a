from __future__ import annotations

import hashlib
import random
import re

import pytest

from cohortspark.llm import decontaminate
from helpers import LONG, no_documents, odd_documents, odd_rows, text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(value):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))


def brute(docs, items):
    windows = {}
    for item_id, body in items:
        own = words(body)
        size = min(13, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, body in docs:
        own, hit, named = words(body), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if (found := windows.get(tuple(own[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    named |= found
        named.discard(None)
        joined = ",".join(sorted(map(str, named)))
        contaminated = bool(hit) and 20 * len(hit) >= len(own)
        digest = hashlib.sha256(joined.encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(named), digest, contaminated))
    return sorted(out, key=repr)


ITEMS = [
    (1, text(5, 30)),
    (2, "WÖRDS, wörds"),
    (2, text(5, 20)),
    (10, text(7, 40)),
    (3, None),
    (4, "... --"),
    (None, text(8, 14)),
    (5, LONG[500:700]),
    (6, "c d"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_against_brute_force(spark, block_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    if block_bytes < 1000:
        assert len(decontaminate.window_blocks(benchmark, block_bytes)) > 1
    scanned = decontaminate.scanned(odd_documents(spark), benchmark, ["doc_id"], block_bytes)
    found = sorted(map(tuple, decontaminate.digest(scanned).collect()), key=repr)
    assert found == brute([r[:2] for r in odd_rows()], ITEMS)


def test_small_alphabet(spark):
    draw = random.Random(4)
    body = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    docs = [(i, body(draw.randrange(60))) for i in range(60)]
    items = [(i, body(draw.choice([1, 3, 13, 20]))) for i in range(6)]
    found = decontaminate.digest(
        decontaminate.scanned(
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"),
            ["doc_id"],
        )
    )
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)


def test_hits_map_to_the_original_text(spark):
    docs = spark.createDataFrame([(1, "Ä! One,  two THREE? four")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    found = decontaminate.scanned(docs, items).first()
    raw = "Ä! One,  two THREE? four".encode()
    assert [raw[s.start : s.end] for s in found.hit_bytes] == [b"two THREE"]
    assert found.items == [9]


def test_clean_documents_keep_their_columns(spark):
    docs = odd_documents(spark)
    kept = decontaminate.clean_documents(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    verdicts = brute([r[:2] for r in odd_rows()], ITEMS)
    assert kept.count() == sum(not v[-1] for v in verdicts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scanned(odd_documents(spark), none).filter("n_hit > 0").count() == 0
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.digest(decontaminate.scanned(no_documents(spark), some)).count() == 0
