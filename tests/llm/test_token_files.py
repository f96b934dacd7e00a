from __future__ import annotations

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import token_files
from cohortspark.llm.queries import tokenizer_file
from helpers import no_documents, odd_documents, odd_rows
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(tokenizer_file())
    found.encode_special_tokens = True
    return found


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_parts_give_the_ids_of_the_whole(tokenizer):
    encode, draw = token_files.Encoder(tokenizer_file()), random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "bc", "'s", "'", "é", "\xa0", "　", "1", ".", "word***", "x,"]
    pieces += ["<|endoftext|>", "\x1c", "​", "日", "\r\n", "THE!!", "don't", "a's,", "ß#"]
    for _ in range(4000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
        assert np.frombuffer(encode(text), encode.dtype).tolist() == whole(tokenizer, text), repr(text)


def test_a_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    encode, draw = token_files.Encoder(tokenizer_file()), random.Random(2)
    for _ in range(300):
        text = " ".join(f"w{draw.randrange(60)}{draw.choice(['', '.', '!!'])}" for _ in range(9))
        assert np.frombuffer(encode(text), encode.dtype).tolist() == whole(tokenizer, text)


def test_texts_of_a_block_keep_their_own_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 7)
    monkeypatch.setattr(token_files, "GROUP_CHARS", 20)
    encode, draw = token_files.Encoder(tokenizer_file()), random.Random(3)
    pieces = [" a", " bc!!", " bc", " don't", "  ", "\n", " x\ny,", "é", " 日", " \x1c", " THE***", "!", " 1.", "\u3000"]
    for _ in range(60):
        texts = ["".join(draw.choices(pieces, k=draw.randint(0, 9))) or None for _ in range(draw.randint(0, 40))]
        data, sizes = encode.block(pa.array(texts, pa.string()), b"\x07\x00")
        ids, ends = np.frombuffer(data, encode.dtype), np.cumsum(sizes) // 2
        found = [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
        assert found == [[*whole(tokenizer, x), 7] for x in texts]
        assert sum(sizes) == data.size


def test_blocks_are_bounded_and_lose_no_row(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 20)
    draw = random.Random(4)
    for _ in range(50):
        sizes = [[draw.choice([None, 0, 1, 7, 19, 45]) for _ in range(draw.randint(0, 30))] for _ in range(4)]
        texts = [[None if n is None else f"{draw.randrange(10)}" * n for n in x] for x in sizes]
        batches = [pa.record_batch({"doc_id": pa.array(range(len(x))), "text": pa.array(x, pa.string())}) for x in texts]
        blocks = [x.column(1).to_pylist() for x in token_files._blocks(iter(batches))]
        assert [t for x in blocks for t in x] == [t for x in texts for t in x]
        assert all(sum(len(t or "") + 1 for t in x[:-1]) < 20 for x in blocks)


def test_a_part_of_many_batches_is_encoded_once(tokenizer, monkeypatch, tmp_path):
    encode, given = token_files.Encoder(tokenizer_file()), []

    class Counted:
        def encode_batch_fast(self, texts, **further):
            given.append(sum(map(len, texts)))
            return tokenizer.encode_batch_fast(texts, **further)

    encode.tokenizer = Counted()
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(token_files, "TaskContext", task)
    monkeypatch.setattr(token_files, "encoder", lambda *_: encode)
    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    texts = ["of " + " ".join(f"word{'abc'[n % 3]}{chr(97 + i)}" for i in range(20)) for n in range(30)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [n], "text": [x]}) for n, x in enumerate(texts)]
    (manifest,) = token_files._write_shard(str(tmp_path), "", 0, True)(iter(batches))
    ids = np.frombuffer(token_files.memory_mapped(manifest["path"][0].as_py() + ".bin"), encode.dtype)
    assert ids.tolist() == [i for x in texts for i in [*whole(tokenizer, x), 0]]
    assert sum(given) <= sum(map(len, texts[:3])) + 10


def test_other_tokenizers_encode_whole_texts():
    encode = token_files.Encoder(tokenizer_file("word_bpe_49k.json"))
    assert not encode.parted
    want = encode.tokenizer.encode("Two words", add_special_tokens=False).ids
    assert np.frombuffer(encode("Two words"), encode.dtype).tolist() == want


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip(spark, tokenizer, shards):
    folder = token_files.write_tokens(odd_documents(spark), tokenizer_file(), shards=shards)
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows()))
    start = 0
    assert len(found) == len(rows)
    for got, (known, doc_id, text) in zip(found, rows):
        ids = [*whole(tokenizer, text), 0]
        data = np.array(ids, dtype="<u4").tobytes()
        assert got.doc_id == (doc_id if known else None)
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(data))
        start += len(ids)


def test_files_are_flat_and_bases_are_prefix_sums(spark, tokenizer):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    folder = token_files.write_tokens(docs, tokenizer_file(), shards=3)
    shards = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
    ids, base = [], 0
    for shard in shards:
        part = np.frombuffer(token_files.memory_mapped(shard.path + ".bin"), dtype="<u2")
        offsets = np.frombuffer(token_files.memory_mapped(shard.path + ".off"), dtype="<i8")
        assert shard.base == base and offsets[0] == 0 and offsets[-1] == len(part) == shard.tokens
        base += shard.tokens
        ids += part.tolist()
    assert ids == [i for n in range(20) for i in [*whole(tokenizer, f"word {n}"), 0]]


def test_no_documents(spark):
    folder = token_files.write_tokens(no_documents(spark), tokenizer_file())
    assert token_files.read_tokens(spark, folder).count() == 0
