"""Token ids in flat binary files with 64-bit document offsets (operator 1).

A data set is a folder of shards and a Parquet manifest. Each shard holds three files: ``.bin``, the ids as
little-endian unsigned integers of the narrowest width that holds the vocabulary; ``.off``, the documents'
n+1 offsets in ids as little-endian int64; ``.doc``, the document ids as an Arrow file. Shards follow
ascending ``doc_id``; the manifest's ``base`` is the prefix sum of the ids in the shards before.

Defined cases: a null text is an empty one, so its document has the end id alone; a null ``doc_id`` is kept
and comes first; repeated rows are documents of their own, equal ids in order of their text; an empty table
gives an empty data set; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.files import attempt_name, memory_mapped, new_folder, opened, shipped

#: Parts that an encoder remembers from a block to the next: those that came most often.
CACHE_WORDS = 100_000
#: Bytes of the texts that are cut and looked up together.
BLOCK_BYTES = 4 << 20
#: Code points that the library encodes in one call.
GROUP_CHARS = 1 << 17
#: Letters, then ASCII marks but the apostrophe: a byte-level tokenizer always cuts between the two.
_LETTERS = "".join(chr(x) for x in range(256) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", chr(x)))
_MARKS = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'")
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """The tokenizer of a file, with the ids of the parts it met lately.

    A byte-level tokenizer ends a piece wherever a single space stands between two other characters: the
    space opens the next piece. So a text cut there may be encoded part by part, and parts repeat. A text
    where a space stands beside other white space, and any text of other tokenizers, is encoded whole.
    """

    def __init__(self, file: str, literal_specials: bool = True) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = literal_specials
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.parted = _cuts_before_spaces(json.loads(self.tokenizer.to_str()))
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.letters = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.letters[number] = len(token)

    def _each(self, texts: pa.Array) -> pa.Array:
        """The ids of texts, each by itself."""
        found = []
        for group in _groups(texts):
            coded = self.tokenizer.encode_batch_fast(group.to_pylist(), add_special_tokens=False)
            found += [np.array(x.ids, dtype=self.dtype).tobytes() for x in coded]
        return pa.array(found, pa.large_binary())

    def _spaced(self, parts: pa.Array) -> pa.Array:
        """The ids of parts, each with a space before it.

        Many are encoded as one text; a byte-level token has one letter for each byte it stands for.
        """
        found = [pa.array([], pa.large_binary())]
        for group in _groups(parts):
            joined = " " + " ".join(group.to_pylist())
            coded = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0]
            ids, data = np.array(coded.ids, dtype=self.dtype), np.frombuffer(joined.encode(), np.uint8)
            ends = np.append(np.flatnonzero(data == 32)[1:], len(data))  # no part holds a space
            cuts = np.searchsorted(np.cumsum(self.letters[ids]), ends, side="left") + 1
            found.append(_binary(ids, np.append(0, cuts * self.dtype.itemsize)))
        return pa.concat_arrays(found)

    def _looked_up(self, parts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """For each part its row in a table, and the table: ids with a space before the part.

        They are null for a part beside other white space. Letters and the marks after them are encoded apart.
        """
        old = len(self.known)
        met = pa.chunked_array([self.known, parts]).dictionary_encode().chunks[-1]
        rows = met.indices.to_numpy()
        new = met.dictionary.slice(old)
        stems = pc.utf8_rtrim(new, characters=_MARKS)
        lettered = pc.and_(pc.not_equal(stems, ""), pc.equal(pc.utf8_ltrim(stems, characters=_LETTERS), ""))
        marked = pc.and_(lettered, pc.not_equal(stems, new))
        marks = pc.utf8_ltrim(new.filter(marked), characters=_LETTERS).dictionary_encode()
        words = pa.chunked_array([met.dictionary, stems.filter(marked)]).dictionary_encode()
        stem_rows = words.combine_chunks().indices.slice(len(met.dictionary))
        words, marked_rows = words.chunk(0).dictionary, old + np.flatnonzero(marked)
        new = words.slice(old)
        plain = ~_outer_white(new) & (pc.binary_length(new).to_numpy() > 0)
        plain[marked_rows - old] = False
        # The table is a choice from what is known, what is encoded now, and a null.
        ids = pa.concat_arrays([self.ids, self._spaced(new.filter(plain)), pa.nulls(1, pa.large_binary())])
        source = np.full(len(words), len(ids) - 1)
        source[:old] = np.arange(old)
        source[old:][plain] = np.arange(old, len(ids) - 1)
        with_marks = pc.binary_join_element_wise(
            ids.take(pa.array(source).take(stem_rows)),
            self._each(marks.dictionary).take(marks.indices),
            pa.scalar(b"", pa.large_binary()),
        )
        source[marked_rows] = len(ids) + np.arange(len(marked_rows))
        ids = pa.concat_arrays([ids, with_marks]).take(source)
        used = np.bincount(np.append(rows, stem_rows), minlength=len(words))
        often = np.sort(np.argsort(-used, kind="stable")[:CACHE_WORDS])
        self.known, self.ids = words.take(often), ids.take(often)
        return rows, ids

    def block(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """The ids of whole texts, an end after each, as the bytes of their file; and how many bytes each text has.

        A null is an empty text. Parts of all texts are looked up at once.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return pa.py_buffer(b""), np.zeros(0, dtype=np.int64)
        if self.parted:
            cut = pc.split_pattern(texts, " ")
            parts, counts = cut.flatten(), pc.list_value_length(cut).to_numpy().astype(np.int64)
            first = np.cumsum(counts) - counts
            heads = parts.take(first)
            del cut
            rows, table = self._looked_up(parts)
            del parts
            white = table.is_null().to_numpy(zero_copy_only=False)[rows]
            white[first] = _outer_white(heads, left=False)
            whole = np.logical_or.reduceat(white, first)
            # A text's first row stands for its head, or for all of it.
            begun = pc.if_else(whole, texts, heads).dictionary_encode()
            rows = rows.copy()
            rows[first] = len(table) + begun.indices.to_numpy()
            kept = ~np.repeat(whole, counts)
            kept[first] = True
            rows, counts = rows[kept], np.where(whole, 1, counts)
            table = pa.concat_arrays([table, self._each(begun.dictionary)])
        else:
            begun = texts.dictionary_encode()
            table, counts = self._each(begun.dictionary), np.ones(len(texts), dtype=np.int64)
            rows = begun.indices.to_numpy()
        lasts = np.cumsum(counts)
        rows = np.insert(rows, lasts, len(table))
        coded = pa.concat_arrays([table, pa.array([end], pa.large_binary())]).take(rows)
        ends = np.frombuffer(coded.buffers()[1], dtype=np.int64)[: len(rows) + 1]
        sizes = np.diff(ends[lasts + np.arange(1, len(texts) + 1)], prepend=0)
        return (coded.buffers()[2] or pa.py_buffer(b"")).slice(0, int(ends[-1])), sizes

    def __call__(self, text: str) -> bytes:
        """The ids of one whole text, as the bytes of its file."""
        return self.block(pa.array([text], pa.large_string()))[0].to_pybytes()


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


def _outer_white(texts: pa.Array, left: bool = True) -> np.ndarray:
    """Whether white space ends a text or, unless ``left`` is false, begins it."""
    trimmed = pc.utf8_trim_whitespace(texts) if left else pc.utf8_rtrim_whitespace(texts)
    return pc.not_equal(trimmed, texts).to_numpy(zero_copy_only=False).copy()


def _cuts_before_spaces(described: dict) -> bool:
    first = described.get("pre_tokenizer") or {}
    return (
        first.get("type") == "ByteLevel"
        and first.get("use_regex", True)
        and not first.get("add_prefix_space")
        and described.get("normalizer") is None
        and not any(
            x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"]
            for x in described.get("added_tokens", [])
        )
    )


def encoder(file: str, literal_specials: bool = True) -> Encoder:
    """The encoder of this worker process."""
    key = (file, literal_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(file, literal_specials)
    return _ENCODERS[key]


def _upto(sizes: np.ndarray, limit: int, spent: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of rows that end where their sizes reach the limit; of the first one some is spent."""
    low, done = 0, np.append(0, np.cumsum(sizes))
    while low < len(sizes):
        high = min(int(np.searchsorted(done, done[low] + limit - spent)), len(sizes))
        yield low, high
        low, spent = high, 0


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of some ``GROUP_CHARS``; a longer text ends its slice."""
    for low, high in _upto(pc.utf8_length(texts).to_numpy() + 1, GROUP_CHARS):
        yield texts.slice(low, high - low)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of all batches in tables of some ``BLOCK_BYTES``; a longer text ends its table."""
    joined, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 1
        for low, high in _upto(sizes, BLOCK_BYTES, size):
            joined.append(batch.slice(low, high - low))
            size += int(sizes[low:high].sum())
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(joined)
                joined, size = [], 0
    if joined:
        yield pa.Table.from_batches(joined)


def _one(texts: pa.ChunkedArray) -> pa.Array:
    """The chunks as one array, of any size."""
    return pa.concat_arrays([x.cast(pa.large_string()) for x in texts.chunks])


def _write_shard(folder: str, tokenizer_file: str, end_id: int, literal_specials: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, literal_specials)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        name = attempt_name(folder, f"shard-{shard:06d}")
        store, path = opened(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        sizes, ids, kind = [np.zeros(1, dtype=np.int64)], [], pa.int64()
        with store.open_output_stream(f"{path}.bin") as out:
            for block in _blocks(batches):
                kind = block.schema.field(0).type
                ids += block.column(0).chunks
                data, sizes_of = encode.block(_one(block.column(1)), end)
                out.write(data)
                sizes.append(sizes_of)
        pa.default_memory_pool().release_unused()  # a worker lives on, with other stages' work
        ends = np.cumsum(np.concatenate(sizes)) // encode.dtype.itemsize
        with store.open_output_stream(f"{path}.off") as out:
            out.write(ends.astype("<i8").tobytes())
        with store.open_output_stream(f"{path}.doc") as out:
            table = pa.table({"doc_id": pa.chunked_array(ids, type=kind)})
            with pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
        if len(ends) > 1:
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int64()),
                    "path": [name],
                    "dtype": [encode.dtype.str],
                    "documents": pa.array([len(ends) - 1], pa.int64()),
                    "tokens": pa.array(ends[-1:], pa.int64()),
                }
            )

    return write


def write_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    folder: str | None = None,
    end_id: int = 0,
    shards: int | None = None,
    literal_specials: bool = True,
) -> str:
    """Encode every document in ascending ``doc_id`` order; returns the data set's folder.

    One range shuffle of the texts puts the documents in order; a task writes one shard. ``shards`` None
    leaves their number to the session's shuffle partitions and adaptive coalescing. With
    ``literal_specials`` a special token's string in a text is ordinary text.
    """
    spark = docs.sparkSession
    shipped(spark)
    folder = folder or new_folder(spark, "tokens")
    order = [F.col("doc_id").asc_nulls_first()]
    rows = docs.select("doc_id", "text")
    rows = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order, "text").mapInArrow(
        _write_shard(folder, tokenizer_file, end_id, literal_specials),
        "shard long, path string, dtype string, documents long, tokens long",
    ).write.parquet(f"{folder}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard, so one task sums them.
    spark.read.parquet(f"{folder}/shards").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0))
    ).write.parquet(f"{folder}/manifest")
    return folder


def _read_shards(id_type: pa.DataType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(memory_mapped(row["path"] + ".bin"), dtype=row["dtype"])
                offsets = np.frombuffer(memory_mapped(row["path"] + ".off"), dtype="<i8")
                with pa.ipc.open_file(memory_mapped(row["path"] + ".doc")) as source:
                    doc_ids = source.read_all().column(0).combine_chunks()
                for low in range(0, len(offsets) - 1, 4096):
                    part = offsets[low : low + 4097]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": doc_ids.slice(low, 4096).cast(id_type),
                            "start": pa.array(part[:-1] + row["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(part), pa.int64()),
                            "ids_crc32": pa.array(
                                [
                                    zlib.crc32(ids[a:b].astype("<u4").tobytes())
                                    for a, b in zip(part[:-1], part[1:])
                                ],
                                pa.int64(),
                            ),
                        }
                    )

    return read


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a data set, read back from its mapped files.

    ``start`` counts the ids of all documents before; ``n_tokens`` holds the end id too; ``ids_crc32`` is
    the checksum of the document's ids as little-endian unsigned 32-bit integers.
    """
    shipped(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(
        _read_shards(pa.int64()), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
