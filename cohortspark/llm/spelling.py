"""Spelling variant grouping by bidirectional FM-index search schemes (operator 12).

Words are counted over whole texts; a word is near another if they differ by one inserted, deleted or replaced code
point. Its form is the near word of the largest count that has at least ``RATIO`` times its own; forms lead on to a
root. One error leaves a half of a word as it is, so a search matches either half exactly in an FM-index of the
vocabulary (``fm_index.py``), from its inner end outwards, and extends across the other half allowing one error.
What the second search finds with the first half unchanged belongs to the first search, so no pair counts twice.

Plan: occurrences are counted in the task before they are shuffled. A shard of the vocabulary is one index. Words go
to groups by the letters at the outer end of the half that a search matches exactly, up to ``KEY`` of them; an indexed
word goes to the groups of the up to two key sizes that near words can have. Groups are counted before rows move. A
group beyond ``SHARD_WORDS`` is dealt in pieces by hash and its queries likewise, each piece against each; so no task
gets an unbounded group, and no pair is written: a task sends one row for each word with near words, their number and
the best one. Roots follow by pointer doubling; counts grow at least fivefold a step, so chains are short.

Defined cases: a null text has no words; a null ``doc_id`` counts as the empty text where occurrences are hashed;
repeated rows count each; an empty table gives no rows; words may be of any length; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bytewords import raw_texts
from cohortspark.llm.files import shipped
from cohortspark.llm.fm_index import WordIndex
from cohortspark.session import tuned, written

#: Letters of a run once A-Z are lower-cased, the divisor of the hashes that cut a letter, the least
#: length and count of a word, and how many times more frequent a form is.
LETTERS = "a-zÀ-ÿ"
CUT = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Letters of a half that name a group at most.
KEY = 5
#: Words of one index, and words searched at a time.
SHARD_WORDS = 1 << 15
#: Distinct words a task counts before it sends them on, and letters of a text it looks at at a time.
HELD_WORDS, PIECE = 1 << 17, 1 << 20

_OUTSIDE = re.compile(f"[^{LETTERS}]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end outside runs."""
    low = 0
    while len(text) - low > PIECE:
        end = _OUTSIDE.search(text, low + PIECE)
        high = end.end() if end else len(text)
        yield text[low:high]
        low = high
    yield text[low:]


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, cut: int = CUT) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``least_length`` code points."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            words, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())}
            )

        crc32 = zlib.crc32
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                before = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for text in _pieces(raw.lower().decode(errors="replace")):
                    for run, times in Counter(runs.findall(text)).items():
                        hashed = crc32(run.encode(), before)
                        if hashed % cut == 0:
                            at = hashed % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        held[run] += times
                    if len(held) > HELD_WORDS:
                        yield sent()
        yield sent()

    shipped(docs.sparkSession)
    return (
        docs.select("doc_id", "text")
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _placed(words: DataFrame, least_length: int, queries: bool) -> DataFrame:
    """Each word once for each of its groups: ``side`` 0 by first letters, 1 by last ones, and ``key``."""
    size = f"least({KEY}, (length(word) + {{}}) div 2)"
    own = f"array({size.format(0)})"
    if not queries:  # a query is as long, or a letter shorter or longer
        shorter = f"if(length(word) > {least_length}, array({size.format(-1)}), array())"
        own = f"array_distinct(concat({own}, array({size.format(1)}), {shorter}))"
    return words.selectExpr("word", "n", f"explode({own}) AS size").selectExpr(
        "word", "n", "inline(array(struct(0 AS side, left(word, size) AS key), struct(1 AS side, right(word, size) AS key)))"
    )


def _best(queries: np.ndarray, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By query, the number of distinct words found and the one with the largest count, the first of equals."""
    pairs = np.unique(np.stack([queries, found]), axis=1)
    order = np.lexsort((pairs[1], -counts[pairs[1]], pairs[0]))
    query, first, number = np.unique(pairs[0][order], return_index=True, return_counts=True)
    return query, number, pairs[1][order][first]


class _Shard:
    """The indexed words of one shard with their groups and counts; answers lists of queries."""

    def __init__(self, side: int, blocks: list[str], words: list[str], counts: list[int]) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        self.side, self.words = side, [words[i] for i in order]
        self.counts = np.array(counts, np.int64)[order]
        self.names: dict[str, int] = {}
        numbers = [self.names.setdefault(name, len(self.names)) for name in blocks]
        self.blocks = np.array(numbers, np.int64)[order]
        self.index = WordIndex(self.words)

    def answers(self, blocks: list[str], words: list[str]) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        asked = np.array([self.names.get(name, -1) for name in blocks], np.int64)
        sent: list[tuple[str, int, int, str]] = []
        for length in np.unique(lengths[asked >= 0]).tolist():
            rows = np.flatnonzero((lengths == length) & (asked >= 0))
            texts = [words[i] for i in rows.tolist()]
            symbols, half = self.index.symbols(texts), length // 2
            query, found = self.index.one_error(symbols, half, self.side == 0)
            kept = self.blocks[found] == asked[rows[query]]
            query, found = query[kept], found[kept]
            if self.side == 1:  # an unchanged first half is the other search's
                starts = self.index.starts[found][:, None] + np.arange(half)
                same = (self.index.text[starts] == symbols[query, :half]).all(axis=1)
                query, found = query[~same], found[~same]
            if not len(query):
                continue
            for q, number, best in zip(*(x.tolist() for x in _best(query, found, self.counts))):
                sent.append((texts[q], number, int(self.counts[best]), self.words[best]))
        columns = list(zip(*sent)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ("word", "n_near", "best_n", "best")
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the queries of each shard; a shard's rows come together, its indexed words first."""
    held: tuple[list[str], list[str], list[int]] = ([], [], [])
    current: int | None = None
    shard: _Shard | None = None
    indexed: tuple[list[str], list[str], list[int]] = ([], [], [])

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        if held[0] and indexed[0]:
            if shard is None:
                shard = _Shard(current % 2, *indexed)
            yield shard.answers(held[0], held[1])
        for column in held:
            column.clear()

    for batch in batches:
        for bucket, query, block, word, n in zip(*(column.to_pylist() for column in batch.columns)):
            if bucket != current:
                yield from flushed()
                current, shard = bucket, None
                indexed = ([], [], [])
            into = held if query else indexed
            for column, value in zip(into, (block, word, n)):
                column.append(value)
            if query and len(held[0]) >= SHARD_WORDS:
                yield from flushed()
    yield from flushed()


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``best`` and ``best_n`` of the distinct words of ``words`` that have near words."""
    shipped(words.sparkSession)
    indexed, queries = (_placed(words, least_length, asked) for asked in (False, True))
    sizes = written(indexed.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size")), "group_sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // (2 * shard_words)))
    large = sizes.filter(F.col("size") > shard_words).selectExpr(
        "side", "key", f"CAST(ceil(size / {shard_words}) AS int) AS pieces"
    )
    parts = []
    for rows, query in ((indexed, False), (queries, True)):
        own, other = ("i", "j") if not query else ("j", "i")
        dealt = rows.join(large, ["side", "key"], "left").selectExpr(
            "word", "n", "side", "key",
            f"pmod(xxhash64(word), coalesce(pieces, 1)) AS {own}",
            f"explode(sequence(0, coalesce(pieces, 1) - 1)) AS {other}",
        )
        parts.append(
            dealt.selectExpr("side", "concat_ws(':', i, j, key) AS block", f"{query} AS query", "word", "n")
        )
    return (
        parts[0]
        .unionByName(parts[1])
        .selectExpr(f"int(2 * pmod(xxhash64(block), {shards}) + side) AS bucket", "query", "block", "word", "n")
        .repartitionById(2 * shards, "bucket")
        .sortWithinPartitions("bucket", "query")
        .mapInArrow(_searched, "word string, n_near long, best_n long, best string")
        .groupBy("word")
        .agg(
            F.sum("n_near").alias("n_near"),
            F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"),
        )
        .selectExpr("word", "n_near", "b.w AS best", "-b.m AS best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last form it leads to, of every word with a ``form``."""
    paths = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = paths.join(onward, "root", "left")
        moved = doubled.filter("next IS NOT NULL")
        if moved.isEmpty():
            return paths
        paths = written(doubled.select("word", F.coalesce("next", "root").alias("root")), "forms")


def variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    cut: int = CUT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    tuned(docs.sparkSession)
    words = counted_words(docs, least_length, cut).filter(F.col("n") >= least_count)
    words = written(words, "vocabulary")
    near = near_words(words, least_length, shard_words)
    known = F.col("best_n") >= ratio * F.col("n")
    found = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(known, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(known, F.col("best_n")).alias("form_n"),
        ),
        "near_words",
    )
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
