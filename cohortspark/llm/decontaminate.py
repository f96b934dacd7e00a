"""Benchmark decontamination by one automaton over all benchmark windows (operator 2).

Texts are normalised byte by byte: A-Z to a-z, every ASCII byte that is no letter or digit to a space. Words
are what stands between spaces, so a word's place among the words maps back to its bytes in the original.
A window is 13 consecutive words of an item, or all words of a shorter one. The distinct windows, each with
its items, form an Aho-Corasick automaton; every document is scanned once against it.

Windows are cut in blocks of bounded size. Each block's windows travel as one broadcast and become one
automaton in a worker; with more than one block the documents pass through one scan after the other, and
hits are carried along as spans of words, so memory stays that of one block.

Defined cases: a null text has no words; a document without words has no hits and is clean; an item without
words, or with a null text, has no window; items with the same id count once; windows of an item with a null
id hit, but the item is not counted or named; repeated rows come back each; an empty benchmark hits nothing.
Further columns of either table are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.bytewords import raw_texts, texts_of, with_rows
from cohortspark.llm.files import shipped
from cohortspark.session import written

WINDOW_WORDS = 13
#: Bytes of windows in a block; an automaton takes some hundred times as many.
BLOCK_BYTES = 2 << 20
#: A document is contaminated when at least one of so many of its words is hit.
HIT_SHARE = 20

#: Lower case for A-Z, a space for other ASCII bytes but digits and a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_AUTOMATA: dict[str, "_Block"] = {}


def normal(raw: bytes) -> bytes:
    """The text with a space for each byte outside words; as long as the text."""
    return raw.translate(_NORMAL)


def windows(benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """``win`` (normalised words, a space between) and ``items``, the sorted distinct ids that have it."""
    shipped(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, raw in zip(batch.column(0), raw_texts(batch.column(1))):
                found = normal(raw).split()
                each = {
                    b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)) if found
                }
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_id": pa.array([id_.as_py()] * len(each), pa.int64()),
                        "win": pa.array(sorted(each), pa.binary()),
                    }
                )

    return (
        benchmark.select(F.col("item_id").cast("long"), "text")
        .mapInArrow(cut, "item_id long, win binary")
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


def window_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The windows of the benchmark in broadcasts of some ``block_bytes`` each."""
    spark = benchmark.sparkSession
    found = written(windows(benchmark), "windows")
    total = found.agg(F.sum(F.length("win") + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for block in range(blocks):
        own = found.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == block)
        parts.append(
            spark.sparkContext.broadcast([(bytes(r.win), list(r.items)) for r in own.toLocalIterator()])
        )
    return parts


class _Block:
    """The automaton of a block's windows, with the words and items of each."""

    def __init__(self, found: list[tuple[bytes, list[int]]]) -> None:
        import ahocorasick

        self.lengths = np.array([win.count(b" ") + 1 for win, _ in found], dtype=np.int64)
        self.items = [items for _, items in found]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, (win, _) in enumerate(found):
            # One letter a byte; spaces around it let a window match at whole words alone.
            self.automaton.add_word(f" {win.decode('latin-1')} ", number)
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Spans [low, high) of hit words, as rows, and the items whose windows occur."""
        text = b" %b " % b" ".join(words)
        found = list(self.automaton.iter(text.decode("latin-1"))) if self.items else []
        if not found:
            return np.zeros((0, 2), dtype=np.int64), set()
        ends, numbers = np.array(found, dtype=np.int64).T
        gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        high = np.searchsorted(gaps, ends)
        items = {item for number in np.unique(numbers) for item in self.items[number]}
        return joined(np.stack([high - self.lengths[numbers], high], axis=1)), items


def joined(spans: np.ndarray) -> np.ndarray:
    """The union of spans, in order, none touching another."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], axis=1)


def _block(key: str, part: Broadcast) -> _Block:
    """The automaton of a block, built once in a worker; a worker holds one at a time."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = _Block(part.value)
    return _AUTOMATA[key]


_ITEMS = pa.list_(pa.int64())
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(part: Broadcast, key: str, last: bool):
    """Scans texts for one block's windows; the last block's scan counts and places the hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(key, part)
        for batch in batches:
            held = batch.schema.get_field_index("spans")
            before = (
                zip(batch.column(held).to_pylist(), batch.column(held + 1).to_pylist()) if held >= 0 else None
            )
            counts, hit, spans, items, places = [], [], [], [], []
            for raw in raw_texts(texts_of(batch)):
                clean = normal(raw)
                words = clean.split()
                found, named = block.hits(words)
                if before:
                    packed, old = next(before)
                    found = joined(np.concatenate([np.frombuffer(packed, "<i8").reshape(-1, 2), found]))
                    named = named.union(old)
                items.append(sorted(named))
                if last:
                    counts.append(len(words))
                    hit.append(int((found[:, 1] - found[:, 0]).sum()))
                    places.append(_bytes_of(clean, found) if len(found) else [])
                else:
                    spans.append(found.astype("<i8").tobytes())
            if last:
                columns = {
                    "row": batch.column(0),
                    "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()),
                    "items": pa.array(items, _ITEMS),
                    "hit_bytes": pa.array(places, _PLACES),
                }
            else:
                columns = {n: batch.column(n) for n in batch.schema.names if n in ("row", "text")}
                columns |= {"spans": pa.array(spans, pa.binary()), "items": pa.array(items, _ITEMS)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def _bytes_of(clean: bytes, spans: np.ndarray) -> list[dict[str, int]]:
    """Spans of words as spans of bytes of the original, which the normalised text is as long as."""
    inside = np.zeros(len(clean) + 2, dtype=np.int8)
    inside[1:-1] = np.frombuffer(clean, dtype=np.uint8) != 32
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    return [{"start": int(starts[low]), "end": int(ends[high - 1])} for low, high in spans]


def scanned(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``row`` (a struct of the kept columns), ``n_words``, ``n_hit``, ``items`` and ``hit_bytes``.

    ``items`` are the sorted ids of items with windows in the document, ``hit_bytes`` the spans of hit words
    as bytes of the original text. No shuffle of the documents.
    """
    shipped(docs.sparkSession)
    rows = with_rows(docs, keep or docs.columns)
    through = list(rows.schema)
    items = T.StructField("items", T.ArrayType(T.LongType()))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    run, parts = uuid.uuid4().hex, window_blocks(benchmark, block_bytes)
    for number, part in enumerate(parts):
        last = number == len(parts) - 1
        if last:
            counts = [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit")]
            fields = [through[0], *counts, items, T.StructField("hit_bytes", T.ArrayType(span))]
        else:
            fields = [*through, T.StructField("spans", T.BinaryType()), items]
        rows = rows.mapInArrow(_scan(part, f"{run}-{number}", last), T.StructType(fields))
    return rows


def contaminated(share: int = HIT_SHARE) -> F.Column:
    """Whether a scanned document is contaminated."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document, its items as a count and a digest of their sorted, comma-joined ids."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "row.*",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return scanned(docs, benchmark).filter(~contaminated()).select("row.*")
