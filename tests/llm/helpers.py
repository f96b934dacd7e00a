"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import random

WORDS = "the of and river stone light cold green house seven bright over under near far".split()


def text(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(words))


LONG = text(99, 150_000)
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, "
    "kept boolean, host string, fp long, bucket int, _tie long, _kept_id long, pass int, _mix_row long"
)


def row(doc_id, body, source="a"):
    return (doc_id, body, "en", source, len(body or ""), 7, "clash", True, "h", 5, 3, -1, -2, -3, -4)


def odd_rows() -> list[tuple]:
    shared = text(5, 120)
    return [
        row(1, shared, "a"),
        row(2, shared, "b"),
        row(2, shared, "b"),
        row(3, "intro words " + shared + " and an end", None),
        row(4, None, "a"),
        row(5, "", "b"),
        row(6, " \t\n ", None),
        row(None, text(6, 90), "a"),
        row(None, shared, None),
        row(7, "Ünïcödé wörds — 日本 語 " + text(7, 80), "ä"),
        row(8, LONG, "a"),
        row(9, "a\x00b C-D e.f,g", "z"),
        row(2, "another text of id two " + text(8, 60), "b"),
    ]


def odd_documents(spark, partitions: int = 4):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(partitions)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
