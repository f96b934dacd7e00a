"""Vectorised views of UTF-8 text: byte classes, words, hashes of spans, hashed n-grams.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. In UTF-8 no byte of a longer character is one of those, so byte runs are character runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes hashed at a time; longer texts are cut there, and the temporary arrays stay within some 100 MB.
PIECE_BYTES = 1 << 20
#: Hashed n-grams fall into this many buckets.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The first byte of a character: any but 10xxxxxx.
LEADING = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def with_rows(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``row``, a struct of the kept columns, and ``text`` beside it unless it is one of them."""
    beside = [] if "text" in keep else [F.col("text").alias("text")]
    return docs.select(F.struct(*keep).alias("row"), *beside)


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of ``with_rows``."""
    at = batch.schema.get_field_index("text")
    if at >= 0:
        return batch.column(at)
    row = batch.column(batch.schema.get_field_index("row"))
    return row.field(row.type.get_field_index("text"))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    limit = max(1 << 16, 1 << (size + 1).bit_length())
    if limit not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        grown = []
        for base in (_BASE, inverse):
            steps = np.full(limit, base, dtype=np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _POWERS[limit] = (grown[0], grown[1])
    return _POWERS[limit]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end) of ``data``; equal bytes give equal hashes."""
    powers, inverses = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers[: len(data)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverses[starts]
    return mixed(found + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def pieces(raw: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of some ``limit`` bytes, cut after white space where there is any."""
    low = 0
    while len(raw) - low > limit:
        high = max(raw.rfind(c, low, low + limit) for c in (b" ", b"\n")) + 1
        high = high if high > low else low + limit
        yield raw[low:high]
        low = high
    yield raw[low:]


def hashed_ngrams(raw: bytes, bits: int = BUCKET_BITS, pairs: bool = True) -> list[np.ndarray]:
    """Bucket numbers of a text's n-grams, one array for each kind and piece.

    Kinds: byte 3- and 4-grams; words; pairs of words, if asked for; whether a word equals the one before.
    """
    return [buckets for buckets, _ in placed_ngrams(raw, bits, pairs)]


def placed_ngrams(
    raw: bytes, bits: int = BUCKET_BITS, pairs: bool = True
) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same, each array with the places of its n-grams in the text."""
    narrow, wide_shift = np.uint32(32 - bits), np.uint64(64 - bits)

    def bucket(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> wide_shift).astype(np.intp)

    found, low = [], 0
    for piece in pieces(raw):
        data = np.frombuffer(piece, dtype=np.uint8)
        if len(data) >= 3:
            wide, places = data.astype(np.uint32), np.arange(low, low + len(data))
            three = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            found.append((((three * np.uint32(0x9E3779B1)) >> narrow).astype(np.intp), places[:-2]))
            four = (three[:-1] << np.uint32(8)) | wide[3:]
            found.append((((four * np.uint32(0x85EBCA6B)) >> narrow).astype(np.intp), places[:-3]))
        starts, ends = word_bounds(data)
        words = span_hashes(data, starts, ends)
        starts += low
        found.append((bucket(words), starts))
        if len(words) > 1:
            if pairs:
                found.append((bucket(mixed(words[:-1] * np.uint64(3) + words[1:])), starts[1:]))
            same = (words[:-1] == words[1:]).astype(np.uint64)
            found.append((bucket(mixed(same + np.uint64(0x5A5A5A5A))), starts[1:]))
        low += len(piece)
    return found
