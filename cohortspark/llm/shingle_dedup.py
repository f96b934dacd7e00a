"""Near copies by shared word shingles, for the pipeline: SimHash, then MinHash buckets, exact similarity of what meets.

Two texts are near copies when the sets of their ``SHINGLE_WORDS``-word shingles have a Jaccard similarity of
``SIMILAR`` or more; components of near copies are one group. Texts with equal sets are one node.

1. Each node gets a SimHash fingerprint of its shingles. Fingerprints link by covering tables, as operator 6 links its own
   (``simhash.link_fingerprints``: no pair within the radius is lost), and the nodes of each component of them are the
   buckets of the first wave.
2. Copies at the bound are some 10 bits apart, which no covering of 64 bits reaches. For these each node also gets
   ``BANDS`` keys, each of the minima of ``ROWS`` hashes of its shingles. A pair of similarity s agrees in a band with
   probability s**ROWS; at 0.8 all bands miss with probability (1 - 0.8**5)**56, some 2 in 10**10. They are the later waves.
3. Buckets are counted before a row moves to one. They are taken in waves, and groups are joined after each: a bucket
   that lies within one group by then, or whose nodes were judged together before, needs no work.
4. The shingle sets of an open bucket of up to ``SMALL`` nodes, ``SMALL_HASHES`` shingles and ``SMALL_WORK`` of both
   multiplied meet in a task. It compares them all, as a product of matrices in parts of bounded size, and emits links
   of a spanning forest, never all pairs, so rows grow with the nodes.
5. A larger bucket is compared with a few centres, the same in every band; what is not yet within one group goes on
   in the next round without its centres and with more of them, until it is small enough or no pair of two groups is
   left. The next round takes the next wave's buckets too.
6. All comparisons are of whole shingle sets, so no pair below the bound is ever linked.

Defined cases: A-Z count as a-z; a text of fewer words than a shingle has one shingle of them all; null, empty and
blank texts have the empty set, so they are one group and near no other text; a word of more than 1 MB counts as
several. Rows that repeat in id and text are one. Further columns are kept by ``one_of_each``, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import simhash
from cohortspark.llm.bytewords import mixed, pieces, raw_texts, span_hashes, word_bounds
from cohortspark.llm.files import shipped
from cohortspark.session import tuned, written

SHINGLE_WORDS = 5
#: Near copies share four fifths of their shingles or more.
SIMILAR = (4, 5)
BANDS, ROWS = 56, 5
#: How many bands each wave after that of the fingerprints takes.
WAVES = (8, 48)
#: Nodes and shingles of a bucket that one task compares, and the most of their product: they bound its memory (a
#: number for each two nodes) and its time.
SMALL, SMALL_HASHES, SMALL_WORK = 4096, 1 << 21, 1 << 32
#: Centres of a larger bucket in the first round, and by how many times they grow each round.
CENTRES, GROWTH = 1, 4
#: Cells of the table of sets and shingles that is multiplied at a time.
CELLS = 1 << 22
#: Shingles that are hashed for all bands at a time.
BLOCK = 256

_DRAW = np.random.default_rng(20240501)
_XOR = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TRIPLE = np.uint64(3)


def shingles(raw: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = []
    for piece in pieces(raw.lower()):
        data = np.frombuffer(piece, np.uint8)
        found.append(span_hashes(data, *word_bounds(data)))
    words = np.concatenate(found)
    size = min(size, len(words))
    if not size:
        return words
    count = len(words) - size + 1
    folded = words[:count]
    for n in range(1, size):
        folded = mixed(folded * _TRIPLE + words[n : n + count])
    return np.unique(folded)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, one for each band; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    narrow, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(narrow), BLOCK):
        block = narrow[low : low + BLOCK, None] ^ _XOR
        block *= _ODD
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(least, block.min(axis=0), out=least)
    rows, keys = least.reshape(BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for n in range(ROWS):
        keys = mixed(keys * _TRIPLE + rows[:, n] + np.uint64(1))
    return keys


def fingerprint(hashes: np.ndarray) -> int:
    """The signed fingerprint of a set of shingle hashes: the bits that more than half of them have."""
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), simhash.BATCH):
        part = hashes[low : low + simhash.BATCH].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def node_of(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set of shingle hashes."""
    total = mixed(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, prints, keys = [], [], [], []
        for raw in raw_texts(batch.column(2)):
            own = shingles(raw)
            nodes.append(node_of(own))
            sizes.append(len(own))
            prints.append(fingerprint(own))
            keys.append(band_keys(own).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(prints, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "tie", "node", "n", "fp", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(raw).tobytes() for raw in raw_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.binary())], names=["node", "hashes"]
        )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes are near copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def near_table(sets: Sequence[np.ndarray]) -> np.ndarray:
    """For every two different ones of some sets of distinct hashes, whether they are near copies."""
    count, sizes = len(sets), np.array([len(own) for own in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = times[place] > 1  # a shingle of one set alone is in no intersection
    column, row = (np.cumsum(times > 1) - 1)[place[held]], np.repeat(np.arange(count), sizes)[held]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both, step = np.zeros((count, count), dtype=np.float32), max(1, CELLS // count)  # exact below 2**24
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        part = slice(*np.searchsorted(column, [low, low + step]))
        block = np.zeros((count, step), dtype=np.float32)
        block[row[part], column[part] - low] = 1
        both += block @ block.T
    near = np.empty((count, count), dtype=bool)
    for i in range(count):
        near[i] = sum(SIMILAR) * both[i].astype(np.int64) >= SIMILAR[0] * (sizes[i] + sizes)
    return near


def forest(bucket: Sequence[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of a spanning forest of nodes with a label and a set; nodes of one label are joined already."""
    if len(bucket) < 2:
        return []
    nodes, labels, sets = zip(*bucket)
    if len(bucket) == 2:
        return [nodes] if labels[0] != labels[1] and similar(*sets) else []
    near, label, found = near_table(sets), np.array(labels), []
    for i in range(len(nodes) - 1):
        others = i + 1 + np.flatnonzero(near[i, i + 1 :] & (label[i + 1 :] != label[i]))
        if len(others):
            joined, first = np.unique(label[others], return_index=True)
            found += [(nodes[i], nodes[j]) for j in others[first]]
            label[np.isin(label, joined)] = label[i]
    return found


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition sorted by key."""
    at, bucket = None, []

    def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        sides = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sides], names=["a", "b"])

    for batch in batches:
        found, keys = [], (batch.column(n).to_pylist() for n in range(3))
        for key, node, label, own in zip(*keys, batch.column(3)):
            if key != at:
                found += forest(bucket)
                at, bucket = key, []
            bucket.append((node, label, np.frombuffer(own.as_buffer(), "<u8")))
        yield links(found)
    yield links(forest(bucket))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(n)] for n in (2, 3))
        near = pa.array([similar(a, b) for a, b in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(n).filter(near) for n in (0, 1)], names=["a", "b"]
        )


def _first_of(rows: DataFrame) -> DataFrame:
    """Each node once, with its keys and the document that stands for it."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")
    return rows.groupBy("node").agg(
        F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]
    )


def _fingerprint_members(values: DataFrame) -> DataFrame:
    """node, n, key and wave 0 of every node whose fingerprint is linked to that of another, or equal to it."""
    links = written(simhash.link_fingerprints(values.select("fp").distinct()), "fingerprint_links")
    roots = simhash.components(values.sparkSession, links).withColumnRenamed("node", "fp")
    placed = values.select("node", "n", "fp").join(roots, "fp", "left")
    placed = written(placed.select("node", "n", F.coalesce("root", "fp").alias("key")), "fingerprint_groups")
    return _of_two(placed).select("node", "n", "key", F.lit(0).alias("wave"))


def _band_members(values: DataFrame) -> DataFrame:
    """node, n, key and wave, from 1 on, of every node in a bucket of two or more."""
    wave = sum((F.col("band") >= sum(WAVES[: n + 1])).cast("int") for n in range(len(WAVES) - 1)) + 1
    placed = values.select("node", "n", F.posexplode("keys").alias("band", "key"))
    return _of_two(placed).select("node", "n", "key", wave.alias("wave"))


def _of_two(placed: DataFrame) -> DataFrame:
    """The rows whose key others have too."""
    sizes = written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket_sizes")
    return placed.join(sizes, "key")


def _shingle_sets(docs: DataFrame, values: DataFrame, members: DataFrame) -> DataFrame:
    """The shingle sets of the nodes that meet another in a bucket, from the texts that stand for them."""
    needed = values.join(members.select("node").distinct(), "node").select(
        "node", F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_of")
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_of"))
    found = texts.join(needed, same).select("node", "text").mapInArrow(_sets, "node long, hashes binary")
    return written(found.dropDuplicates(["node"]), "shingle_sets")


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members with the group they are in so far."""
    if roots is None:
        return members.withColumn("label", F.col("node"))
    return members.join(roots, "node", "left").select(*members.columns, F.coalesce("root", "node").alias("label"))


def _open_buckets(members: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Key and ``large`` of the buckets of more than one group, those of the same nodes once."""
    nodes = ["size", "nodes_hash", "other_hash"]
    sizes = (
        members.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("nodes_hash"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other_hash"),
            F.sum("n").alias("hashes"),
            (F.min("label") < F.max("label")).alias("open"),
        )
        .filter("open")
        .dropDuplicates(nodes)
    )
    if seen is not None:
        sizes = sizes.join(seen, nodes, "left_anti")
    large = (
        (F.col("size") > SMALL)
        | (F.col("hashes") > SMALL_HASHES)
        | (F.col("size") * F.col("hashes") > SMALL_WORK)
    )
    return written(sizes.select("key", large.alias("large"), *nodes), "open_buckets")


def _compared(large: DataFrame, sets: DataFrame, centres: int) -> tuple[DataFrame, DataFrame]:
    """Links of the nodes of large buckets with their centres, and the members without the centres."""
    slot = F.pmod(F.xxhash64("node"), F.lit(centres))
    chosen = written(
        large.groupBy("key", slot.alias("slot"))
        .agg(F.min(F.struct("node", "n", "label")).alias("centre"))
        .select("key", "centre.*")
        .toDF("key", "b", "n_b", "label_b"),
        "centres",
    )
    fits = F.least("n", "n_b") * SIMILAR[1] >= F.greatest("n", "n_b") * SIMILAR[0]
    pairs = large.join(chosen, "key").filter((F.col("label") != F.col("label_b")) & fits)
    pairs = written(pairs.select(F.col("node").alias("a"), "b").distinct(), "candidates")
    one, other = (
        sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in ("a", "b")
    )
    links = pairs.join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b").mapInArrow(_judged, "a long, b long")
    is_centre = [large["key"] == chosen["key"], large["node"] == chosen["b"]]
    return links, large.join(chosen, is_centre, "left_anti").select("node", "n", "key")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, ``tie`` (a hash of the text), ``node`` and ``root``, which names its group, of every document."""
    spark = tuned(docs.sparkSession)
    shipped(spark)
    rows = written(
        docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(
            _signatures, "doc_id long, tie long, node long, n long, fp long, keys array<long>"
        ),
        "signatures",
    )
    values = written(_first_of(rows), "nodes")
    members = written(_fingerprint_members(values).unionByName(_band_members(values)), "members")
    sets, roots, seen = _shingle_sets(docs, values, members), None, None
    turn, waiting, centres = 0, None, CENTRES
    while turn <= len(WAVES) or waiting is not None:
        left = members.filter(F.col("wave") == turn).select("node", "n", "key")
        if waiting is not None:
            left = left.unionByName(waiting) if turn <= len(WAVES) else waiting
        turn, waiting = turn + 1, None
        labelled = _labelled(left, roots)
        buckets = _open_buckets(labelled, seen)
        if buckets.isEmpty():
            continue
        held = written(labelled.join(buckets.select("key", "large"), "key"), "open_members")
        links = (
            held.filter("not large")
            .join(sets, "node")
            .select("key", "node", "label", "hashes")
            .repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(_bucket_links, "a long, b long")
        )
        large = held.filter("large")
        if not large.isEmpty():
            near, waiting = _compared(large, sets, centres)
            links, waiting, centres = links.unionByName(near), written(waiting, "members_left"), centres * GROWTH
        links = written(links, "links")
        if not links.isEmpty():
            if roots is not None:
                links = links.unionByName(roots.toDF("a", "b"))
            roots = written(simhash.components(spark, links), "roots")
        judged = buckets.filter("not large").drop("key", "large")
        seen = judged if seen is None else seen.unionByName(judged)
    return _labelled(rows.select("doc_id", "tie", "node"), roots).withColumnRenamed("label", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns, as ``simhash.one_of_each`` chooses it."""
    return simhash.one_of_each(docs, clusters)
