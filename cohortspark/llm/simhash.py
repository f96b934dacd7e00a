"""SimHash near-duplicates by covering locality-sensitive hashing (operator 6).

A fingerprint's bit is 1 when more than half of the text's shingle hashes have it. Fingerprints link at
``RADIUS`` or fewer differing bits. Bit i carries a nonzero vector m(i) of RADIUS + 1 bits; table v, for each
nonzero v, keeps the bits with an odd inner product of m(i) and v. The vectors of any RADIUS bits leave some v
orthogonal to all of them, so a pair within the radius agrees on all bits of that table: it surely meets in a
bucket. Equal fingerprints are one node, whatever number of documents has them.

Buckets are counted before any row moves to one. A bucket of one fingerprint is done; of two, compared at
once; up to ``MOST`` compared in a task, which emits links of a spanning forest, never all pairs. A larger
bucket is cut again by the same construction over the bits its table left free, until the free bits alone
bound the bucket; so no task ever gets an unbounded group and no link is lost.

Components follow from the links by alternating star contractions, each round written to the shared folder.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other;
repeated rows share a fingerprint and come back each; a null ``doc_id`` never names a component that has other ids.
An empty table gives no rows. Further columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.bytewords import raw_texts
from cohortspark.llm.files import shipped
from cohortspark.session import scratch, tuned, written

SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 3
#: Fingerprints of a bucket that one task compares; a larger bucket is cut by further bits.
MOST = 8192
#: The bits that are free after this cut, 9 at most, bound a bucket by themselves.
LAST_CUT, ANY = 2, 1 << 62
#: Shingles hashed at a time.
BATCH = 1 << 16


def fingerprint(raw: bytes, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text; A-Z count as a-z."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.append(0, ends[:-1])[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for low in range(0, len(starts), BATCH):
        part = slice(low, low + BATCH)
        hashes = np.array(
            [digest(text[a:b], HASH_SEED) for a, b in zip(starts[part], ends[part])], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(raw) for raw in raw_texts(batch.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0),
                "tie": batch.column(2),
                "fp": pa.array(found.view(np.int64), pa.int64()),
            }
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint, as a signed 64-bit number, of every document."""
    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(
        _fingerprints, "doc_id long, tie long, fp long"
    )


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """For each nonzero v, which of the bits of ``free`` its table keeps."""
    places = [i for i in range(64) if free >> i & 1]
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for n, bit in enumerate(places) if ((n % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tables(rows: DataFrame, depth: int) -> DataFrame:
    """Each row once for every table below its path: longer ``path``, ``mask`` and ``key``."""
    every, masks = (1 << 64) - 1, [0]
    for _ in range(depth + 1):  # the masks of all paths, in the order of their numbers
        masks = [mask | own for mask in masks for own in covering_masks(every & ~mask)]
    tables = F.array(*[F.lit(_signed(mask)) for mask in masks])
    count = (1 << (RADIUS + 1)) - 1
    first = (F.col("path") * count).cast("int")
    own = F.posexplode(F.slice(tables, first + 1, count)).alias("n", "mask")
    return rows.select("fp", first.alias("first"), own).select(
        "fp",
        (F.col("first") + F.col("n")).cast("long").alias("path"),
        F.col("fp").bitwiseAND(F.col("mask")).alias("key"),
    )


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of distinct fingerprints that link within the radius."""
    label = np.arange(len(values))
    low, high = [], []
    for i in range(len(values) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)
        others = near[label[near] != label[i]]
        if not len(others):
            continue
        roots, first = np.unique(label[others], return_index=True)
        low.append(np.full(len(roots), values[i]))
        high.append(values[others[first]])
        merged = np.zeros(len(values), dtype=bool)
        merged[roots] = True
        merged[label[i]] = True
        label[merged[label]] = label[i]
    if not low:
        return values[:0], values[:0]
    return np.concatenate(low), np.concatenate(high)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition sorted by path and key."""
    held = (np.zeros(0, np.int64),) * 3

    def links(path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        turns = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        found = [forest(part.view(np.uint64)) for part in np.split(fp, turns) if len(part) > 1]
        columns = [np.concatenate([np.zeros(0, np.uint64), *side]).view(np.int64) for side in zip(*found)]
        a, b = columns or (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held = tuple(
            np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip(held, batch.columns)
        )
        path, key, fp = held
        # The last bucket may go on in the next batch.
        last = np.flatnonzero((path != path[-1]) | (key != key[-1])) if len(path) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(path[:cut], key[:cut], fp[:cut])
        held = (path[cut:], key[cut:], fp[cut:])
    if len(held[0]):
        yield links(*held)


def link_fingerprints(values: DataFrame, most: int = MOST) -> DataFrame:
    """``a`` and ``b``: links that connect the distinct fingerprints ``fp`` as all pairs within the radius do."""
    shipped(values.sparkSession)
    rows, found = values.select("fp", F.lit(0).cast("long").alias("path")), []
    for depth in range(LAST_CUT + 1):
        placed = _tables(rows, depth)
        sizes = placed.groupBy("path", "key").agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        sizes = written(sizes.filter("n > 1"), "bucket_sizes")
        found.append(sizes.filter((F.col("n") == 2) & _near("a", "b")).select("a", "b"))
        most = most if depth < LAST_CUT else ANY  # its few free bits bound it
        some = sizes.filter((F.col("n") > 2) & (F.col("n") <= most)).select("path", "key")
        found.append(
            placed.join(some, ["path", "key"])
            .select("path", "key", "fp")
            .repartition("path", "key")
            .sortWithinPartitions("path", "key", "fp")
            .mapInArrow(_bucket_links, "a long, b long")
        )
        large = sizes.filter(F.col("n") > most).select("path", "key")
        if large.isEmpty():
            break
        rows = written(placed.join(large, ["path", "key"]).select("fp", "path").distinct(), "large_buckets")
    links = found[0]
    for part in found[1:]:
        links = links.unionByName(part)
    return links.distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it reaches, of every node with a link.

    Alternates two contractions until nothing changes: every node's larger neighbours are linked to the least of its
    neighbourhood; then its smaller neighbours are. Both halves of a join on a node are plain tables, so a
    hub's rows can be split.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "edges",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = written(large, "large_star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        new = written(small, "edges")
        mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))]
        if new.agg(*mark).first() == edges.agg(*mark).first():
            return new.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        edges = new


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, ``tie`` (a hash of the text), fp, ``root`` and component_id of every document.

    ``root`` names the component by its least fingerprint, ``component_id`` by its least doc_id.
    """
    spark = tuned(docs.sparkSession)
    rows = written(fingerprints(docs), "fingerprints")
    values = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    roots = components(spark, link_fingerprints(values))
    rooted = written(
        values.join(roots, values["fp"] == roots["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    ids = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component_ids")
    named = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def hexadecimal(fp) -> F.Column:
    """16 lower-case hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, group: Callable[[DataFrame], DataFrame] = clusters) -> DataFrame:
    """One document of each component, with its columns: that with the least id, and of those the least text hash.

    ``group`` gives doc_id, ``tie`` and ``root`` of every document; what it writes is dropped once the rows are chosen.
    A null id counts after all others; rows that repeat in both are one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")
    with scratch(docs.sparkSession) as staying:
        chosen = group(docs).groupBy("root").agg(F.min(order).alias("kept"))
        kept = staying(chosen.select("kept.doc_id", "kept.tie"), "kept")
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("tie").alias("_kept_tie"))
    # The row travels as one column, so its names meet no others.
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie")
    )
    return (
        rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_tie") == F.col("_kept_tie")))
        .dropDuplicates(["_id", "_tie"])
        .select("row.*")
    )
