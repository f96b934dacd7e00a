from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from cohortspark.llm import shingle_dedup
from helpers import no_documents, odd_documents, odd_rows, text


def brute_set(body):
    words = (body or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(bodies):
    sets, label = [brute_set(b) for b in bodies], list(range(len(bodies)))
    for i in range(len(sets)):
        for j in range(i):
            near = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) if sets[i] or sets[j] else True
            if near and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def planted(seed):
    """Copies with some edits, on both sides of the bound, and a passage that unlike texts share."""
    draw, docs, passage = random.Random(seed), [], text(1, 60)
    for group in range(12):
        base = text(100 * seed + group, draw.randrange(3, 260)).split()
        for _ in range(draw.choice([1, 3, 9])):
            words = list(base)
            for _ in range(draw.randrange(0, 2 + len(words) // 30)):
                words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            docs.append(" ".join(words).upper() if draw.random() < 0.2 else "\n".join(words))
    docs += [f"{passage} {text(seed + 900 + n, draw.randrange(5, 90))}" for n in range(20)]
    return docs


@pytest.mark.parametrize("small", [shingle_dedup.SMALL, 2])
def test_stage_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "SMALL", small)
    bodies = planted(small)
    docs = spark.createDataFrame([(n, b, "en", "a", 5) for n, b in enumerate(bodies)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect()}
    assert kept == set(brute_groups(bodies)) and len(kept) < len(bodies)


def test_odd_rows(spark):
    odd = odd_documents(spark)
    kept = shingle_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {(r["_tie"], r["_kept_id"]) for r in kept.collect()} == {(-1, -2)}
    assert kept.count() == len(set(brute_groups([r[1] for r in odd_rows()])))
    assert shingle_dedup.one_of_each(no_documents(spark)).count() == 0


def test_a_bucket_gives_a_forest():
    """Every two sets are judged, and the links of a bucket are fewer than its nodes."""
    bodies = planted(3)
    sets = list({shingle_dedup.node_of(x): x for x in map(shingle_dedup.shingles, map(str.encode, bodies))}.values())
    near = shingle_dedup.near_table(sets)
    two = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    assert all(near[i, j] == shingle_dedup.similar(sets[i], sets[j]) for i, j in two)
    bucket = [(n, n, own) for n, own in enumerate(sets)]
    links, label = shingle_dedup.forest(bucket), list(range(len(sets)))
    for a, b in links:
        assert near[a, b] and label[a] != label[b]
        label = [label[b] if x == label[a] else x for x in label]
    assert 0 < len(links) < len(sets) and all(label[i] == label[j] for i, j in two if near[i, j])


def test_what_is_written_is_dropped(spark, tmp_path):
    """Only the chosen ids stay of what the stage writes."""
    from cohortspark import session

    before, stored = session.shared_dir(spark), []
    real = session.run_path
    session.run_path = lambda s, name: stored.append(real(s, name)) or stored[-1]
    try:
        docs = spark.createDataFrame([(n, b) for n, b in enumerate(planted(1))], "doc_id long, text string")
        assert shingle_dedup.one_of_each(docs).count()
    finally:
        session.run_path = real
    left = [p.rpartition("/")[2] for p in stored if os.path.exists(p)]
    assert before and left == ["kept"] and len(stored) > 5
