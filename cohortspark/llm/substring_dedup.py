"""Removal of repeated substrings by suffix arrays over shards of what can repeat (operator 8).

A byte goes when some ``LENGTH``-byte string that covers it also starts in a document with a smaller id.

1. Every window of ``LENGTH`` bytes has an anchor: of the ``ANCHOR``-byte strings inside it, the leftmost of those with
   the least hash. Equal windows have equal anchors. Windows in a row with one anchor form a segment.
2. Segments meet by their anchor's hash. Equal segments of several documents are settled there: all but the
   least id's are repeated. A document's settled runs travel packed, one row for a bucket or batch.
3. Segments that share an anchor but differ, as at the ends of a copied passage, need a look at their bytes. They are cut
   from the texts and dealt to shards by anchor; a shard's suffix array and permuted common prefixes show its
   equal windows, and all but the least id's are repeated.
4. Each text meets its packed runs, dealt like it by a hash of the document, and is cut.

Equal segments of a batch shrink to one before the shuffle, so copies and common lines don't gather. An anchor found
in more than ``HOT_ROWS`` segments of an evenly drawn part of the documents is hot: its windows are dealt one by
one by their own hash, which spreads them and needs no shard. That choice moves work only; no result depends on it.

Defined cases: a null text is empty; a text of fewer bytes than ``LENGTH`` loses nothing; rows with the same id are
documents that are never copies of one another; a null id counts as larger than all others, and documents
with null ids are no copies of one another; rows that repeat in id and text come back each. Ids are integers
below 2**63 - 1. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bytewords import mixed, raw_texts, span_hashes
from cohortspark.llm.files import shipped
from cohortspark.llm.suffix_array import permuted_common_prefixes, suffix_array
from cohortspark.session import tuned, written

LENGTH = 50
ANCHOR = 24
#: Bytes of text whose segments are gathered before equal ones shrink to one.
BATCH_BYTES = 24 << 20
#: Bytes of text that a bucket of anchors, and of segments that a shard, stands for.
BUCKET_TEXT_BYTES = 32 << 20
SHARD_BYTES = 1 << 20
#: About the bytes of a segment.
SEGMENT_BYTES = 64
#: One of so many documents is drawn to find hot anchors, those of so many segments in that draw: about those whose
#: segments alone would fill a shard.
HOT_DRAW = 32
HOT_ROWS = SHARD_BYTES // SEGMENT_BYTES // HOT_DRAW
#: Windows of a text that are cut into segments at a time.
PIECE = 1 << 20
NO_ID = (1 << 63) - 1
_LOW48 = np.uint64((1 << 48) - 1)


def segments(raw: bytes, hot: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Anchor hashes, segment hashes, first windows and numbers of windows of a text's segments."""
    parts = []
    for low in range(0, len(raw) - length + 1, PIECE):
        data = np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - low), low)
        grams = np.arange(len(data) - anchor + 1)
        hashes = span_hashes(data, grams, grams + anchor)
        least, place, reach, span = hashes, grams, 1, length - anchor + 1
        while reach < span:  # the leftmost least of ever longer runs of grams
            step = min(reach, span - reach)
            a, b = least[:-step], least[step:]
            left = a <= b
            least, place = np.where(left, a, b), np.where(left, place[:-step], place[step:])
            reach += step
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(first, len(place)))
        anchors = hashes[place[first]] & _LOW48
        if len(hot) and (single := np.isin(anchors, hot)).any():
            windows = np.flatnonzero(np.repeat(single, count))
            own = span_hashes(data, windows, windows + length)
            first, count = first[~single], count[~single]
            anchors = np.append(anchors[~single], mixed(own + np.uint64(1)) & _LOW48)
            sums = np.append(span_hashes(data, first, first + count - 1 + length), own)
            first, count = np.append(first, windows), np.append(count, np.ones(len(windows), np.int64))
        else:
            sums = span_hashes(data, first, first + count - 1 + length)
        parts.append((anchors, sums, (first + low).astype(np.int32), count.astype(np.uint8)))
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32), np.zeros(0, np.uint8))
    return tuple(np.concatenate(side) for side in zip(*parts))


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted columns begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _packed_runs(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> dict[int, bytes]:
    """For each document, its runs of repeated windows, joined, as pairs of int32: start and end."""
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order].astype(np.int64), (first + count.astype(np.int64))[order]
    found = {}
    bounds = np.append(np.flatnonzero(_runs_of(doc)), len(doc))
    for low, high in zip(bounds[:-1], bounds[1:]):
        found[int(doc[low])] = _joined(first[low:high], end[low:high]).astype("<i4").tobytes()
    return found


def _joined(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of runs sorted by start, as rows of start and end; touching runs are one."""
    if not len(first):
        return np.zeros((0, 2), dtype=np.int64)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return np.stack([first[new], reach[np.append(new[1:] - 1, len(first) - 1)]], axis=1)


_ROW = "bucket int, ids binary, ties binary, counts binary, anchors binary, sums binary, firsts binary, wins binary, runs array<binary>"


def _batch_rows(texts: list, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The segments of a batch of (id, tie, text), in one packed row for each bucket, and its settled runs."""
    ids = np.array([t[0] for t in texts], dtype=np.int64)
    ties = np.array([t[1] for t in texts], dtype=np.int64)
    found = [segments(t[2], hot) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    anchors, sums, first, count = (np.concatenate(side) for side in zip(*found))
    del found
    order = np.lexsort((ids[doc], sums, anchors))
    anchors, sums, first, count, doc = (x[order] for x in (anchors, sums, first, count, doc))
    new = _runs_of(anchors, sums)
    least = ids[doc][new][np.cumsum(new) - 1] if len(new) else ids[:0]
    repeated = ids[doc] > least
    rows = {}
    if repeated.any():
        runs = _packed_runs(doc[repeated], first[repeated], count[repeated])
        for d, packed in runs.items():
            bucket = int(ids[d]) * 2654435761 % buckets
            rows.setdefault(bucket, ([], []))[0].append(d)
            rows[bucket][1].append(packed)
    keep = ~repeated
    anchors, sums, first, count, doc = (x[keep] for x in (anchors, sums, first, count, doc))
    bucket = (anchors % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, doc, bucket))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.union1d(np.unique(bucket), np.array(list(rows), dtype=np.int64)).tolist():
        own = order[bounds[b] : bounds[b + 1]]
        docs, per_doc = np.unique(doc[own], return_counts=True)
        settled, runs = rows.get(b, ([], []))
        listed = np.append(docs, settled).astype(np.int64)
        six = anchors[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        yield _record(
            b,
            ids[listed].tobytes(),
            ties[listed].tobytes(),
            per_doc.astype("<i4").tobytes(),
            np.ascontiguousarray(six).tobytes(),
            sums[own].tobytes(),
            first[own].tobytes(),
            count[own].tobytes(),
            runs,
        )


def _record(bucket: int, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([bucket], pa.int32()),
            *(pa.array([c], pa.binary()) for c in columns[:-1]),
            pa.array([columns[-1]], pa.list_(pa.binary())),
        ],
        names=[field.split()[0] for field in _ROW.split(", ")],
    )


def _segment_rows(buckets: int, hot: np.ndarray):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for batch in batches:
            for id_, tie, raw in zip(batch.column(0), batch.column(1), raw_texts(batch.column(2))):
                texts.append((id_.as_py(), tie.as_py(), raw))
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield from _batch_rows(texts, buckets, hot)
                    texts, size = [], 0
        if texts:
            yield from _batch_rows(texts, buckets, hot)

    return cut


#: What goes by document: ``kind`` and, for each of its documents, an item. Rows are dealt by ``part``, a
#: hash of the document, and sorted by kind, so a part's results come before its texts.
_BY_PART = "part int, kind int, ids binary, ties binary, items array<binary>"
RUNS, ASKED, TEXT = 0, 1, 2
#: An asked segment: its first window, its windows, its anchor.
_PLACE = np.dtype([("first", "<i4"), ("count", "<i4"), ("anchor", "<u8")])


def _by_part(kind: int, ids: np.ndarray, ties: np.ndarray, items: list[bytes], parts: int) -> pa.RecordBatch:
    """One row for each part that the documents fall into."""
    own = mixed(mixed(ids.view(np.uint64)) + ties.view(np.uint64)) % np.uint64(parts)
    order = np.argsort(own, kind="stable")
    bounds = np.append(np.flatnonzero(_runs_of(own[order])), len(order))
    groups = [order[low:high] for low, high in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(own[g[0]]) for g in groups], pa.int32()),
            pa.array([kind] * len(groups), pa.int32()),
            pa.array([ids[g].tobytes() for g in groups], pa.binary()),
            pa.array([ties[g].tobytes() for g in groups], pa.binary()),
            pa.array([[items[i] for i in g] for g in groups], pa.list_(pa.binary())),
        ],
        names=["part", "kind", "ids", "ties", "items"],
    )


def _with_texts(batches: Iterator[pa.RecordBatch]):
    """(id, tie, text, items) of every text of sorted parts, with the items of its document."""
    unpack, part, items = zstandard.ZstdDecompressor(), None, {}
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for n, (own, kind, ids, ties) in enumerate(zip(*columns)):
            if own != part:
                part, items = own, {}
            values = batch.column(4)[n].as_py()
            keys = zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(ties, "<i8").tolist())
            for key, value in zip(keys, values):
                if kind == TEXT:
                    yield *key, unpack.decompress(value), items.get(key, [])
                else:
                    items.setdefault(key, []).append(value)


def _settle(parts: int):
    """Settles equal segments of a bucket; asks for the bytes of unlike ones with the same anchor."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and held:
                    yield from _settled(held, parts)
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield from _settled(held, parts)

    return settle


def _settled(rows: list[dict], parts: int) -> Iterator[pa.RecordBatch]:
    ids, ties, doc, anchors, sums, first, count = [], [], [], [], [], [], []
    runs, before = [], 0
    for row in rows:
        own = np.frombuffer(row["ids"], "<i8")
        per_doc = np.frombuffer(row["counts"], "<i4")
        ids.append(own)
        ties.append(np.frombuffer(row["ties"], "<i8"))
        doc.append(before + np.repeat(np.arange(len(per_doc)), per_doc))
        wide = np.zeros((int(per_doc.sum()), 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(row["anchors"], np.uint8).reshape(-1, 6)
        anchors.append(wide.view("<u8")[:, 0])
        sums.append(np.frombuffer(row["sums"], "<u8"))
        first.append(np.frombuffer(row["firsts"], "<i4"))
        count.append(np.frombuffer(row["wins"], np.uint8))
        runs += zip(range(before + len(per_doc), before + len(own)), row["runs"])
        before += len(own)
    ids, ties, doc, anchors, sums, first, count = map(
        np.concatenate, (ids, ties, doc, anchors, sums, first, count)
    )
    order = np.lexsort((ids[doc], sums, anchors))
    doc, anchors, sums, first, count = (x[order] for x in (doc, anchors, sums, first, count))
    new = _runs_of(anchors, sums)
    least = ids[doc][new][np.cumsum(new) - 1] if len(new) else ids[:0]
    repeated = ids[doc] > least
    found = _packed_runs(doc[repeated], first[repeated], count[repeated])
    # An anchor is open when its segments' least ids differ.
    group = np.cumsum(_runs_of(anchors)) - 1 if len(anchors) else doc[:0]
    open_group = np.zeros(int(group[-1]) + 1 if len(group) else 0, dtype=bool)
    open_group[group[1:][(group[1:] == group[:-1]) & (least[1:] != least[:-1])]] = True
    asked = np.flatnonzero(open_group[group] & ~repeated)
    asked = asked[np.lexsort((first[asked], doc[asked]))]
    bounds = np.append(np.flatnonzero(_runs_of(doc[asked])), len(asked))
    places = np.zeros(len(asked), dtype=_PLACE)
    places["first"], places["count"], places["anchor"] = first[asked], count[asked], anchors[asked]
    wanted = {
        int(doc[asked[low]]): places[low:high].tobytes()
        for low, high in zip(bounds[:-1], bounds[1:])
        if high > low
    }
    runs += found.items()
    for kind, items in ((RUNS, runs), (ASKED, list(wanted.items()))):
        if items:
            which = np.array([d for d, _ in items], dtype=np.int64)
            yield _by_part(kind, ids[which], ties[which], [packed for _, packed in items], parts)


def _cut_segments(shards: int):
    """Bytes of the asked segments, dealt to shards by anchor."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["shard", "doc", "tie", "first", "bytes"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, tie, raw, items in _with_texts(batches):
            for item in items:
                for first, count, anchor in np.frombuffer(item, _PLACE).tolist():
                    rows.append((anchor % shards, doc, tie, first, raw[first : first + count - 1 + LENGTH]))
            if len(rows) >= 20_000:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)

    return cut


def _sort_shards(parts: int):
    """The repeated windows of each shard of a partition sorted by shard."""

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        runs = repeated_windows(rows)
        if runs:
            keys = np.array(list(runs), dtype=np.int64)
            yield _by_part(RUNS, keys[:, 0].copy(), keys[:, 1].copy(), list(runs.values()), parts)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[0] != shard and held:
                    yield from found(held)
                    held = []
                shard = row[0]
                held.append(row)
        if held:
            yield from found(held)

    return sort


def repeated_windows(rows: list[tuple], length: int = LENGTH) -> dict[tuple[int, int], bytes]:
    """By document, runs of windows of (shard, doc, tie, first, bytes) that also stand in a row of a smaller doc."""
    text = np.zeros(sum(len(r[4]) + 1 for r in rows) + 1, dtype=np.uint16)
    owner = np.full(len(text), -1, dtype=np.int64)  # the row, where a whole window starts
    starts, at = [], 0
    for n, row in enumerate(rows):
        size = len(row[4])
        text[at : at + size] = np.frombuffer(row[4], np.uint8)
        text[at : at + size] += 2
        text[at + size] = 1  # no window reaches past a segment
        owner[at : at + size - length + 1] = n
        starts.append(at)
        at += size + 1
    order = suffix_array(text, length)
    whole = order[owner[order] >= 0]  # equal windows are neighbours in order
    shared = permuted_common_prefixes(text, whole, length)
    group = np.cumsum(shared[whole] < length) - 1
    group -= group[0] if len(group) else 0
    ids = np.array([r[1] for r in rows], dtype=np.int64)
    of = owner[whole]
    least = np.minimum.reduceat(ids[of], np.flatnonzero(_runs_of(group))) if len(group) else ids[:0]
    ranks = np.cumsum(_runs_of(group)) - 1
    again = whole[ids[of] > least[ranks]]
    if not len(again):
        return {}
    of = owner[again]
    tie = np.array([r[2] for r in rows], dtype=np.int64)
    first = np.array([r[3] for r in rows], dtype=np.int64) - np.array(starts, dtype=np.int64)
    _, doc = np.unique(np.stack([ids, tie]), axis=1, return_inverse=True)
    doc = doc.reshape(-1)
    packed = _packed_runs(doc[of], again + first[of], np.ones(len(of), np.int64))
    example = {int(d): n for n, d in enumerate(doc)}
    return {(int(ids[example[d]]), int(tie[example[d]])): runs for d, runs in packed.items()}


_OUT = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    + [("kept_sha256", pa.string())]
    + [("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each text's repeated bytes."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT
        )

    rows = []
    for doc, _, raw, items in _with_texts(batches):
        pairs = np.frombuffer(b"".join(items), "<i4").reshape(-1, 2).astype(np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        spans = _joined(pairs[:, 0], pairs[:, 1] - 1 + LENGTH)
        edges = [0, *spans.ravel().tolist(), len(raw)]
        digest = hashlib.sha256()
        for low, high in zip(edges[::2], edges[1::2]):
            digest.update(raw[low:high])
        removed = [{"start": a, "end": b} for a, b in spans.tolist()]
        gone = int((spans[:, 1] - spans[:, 0]).sum())
        rows.append(
            (None if doc == NO_ID else doc, len(raw), gone, len(spans), digest.hexdigest(), removed)
        )
        if len(rows) >= 2_000:
            yield packed(rows)
            rows = []
    if rows:
        yield packed(rows)


def _pack(parts: int):
    """Texts compressed for their shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [packer.compress(raw) for raw in raw_texts(batch.column(2))]
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for n in range(0, len(texts), 64):
                part = slice(n, n + 64)
                yield _by_part(TEXT, ids[part].copy(), ties[part].copy(), texts[part], parts)

    return pack


def _hot_anchors(rows: DataFrame, hot_rows: int) -> np.ndarray:
    """The anchors of more than ``hot_rows`` segments in the draw: at most its segments over that bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.zeros(0, np.uint64)
            found = [segments(raw, none)[0] for raw in raw_texts(batch.column(2))]
            values, counts = np.unique(np.concatenate([none, *found]), return_counts=True)
            often = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))],
                names=["anchor", "n"],
            )

    drawn = rows.filter(F.pmod(F.xxhash64("tie", "doc"), F.lit(HOT_DRAW)) == 0)
    hot = (
        drawn.mapInArrow(count, "anchor long, n long")
        .groupBy("anchor")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > hot_rows)
        .select("anchor")
    )
    return np.array([r.anchor for r in hot.toLocalIterator()], dtype=np.int64).view(np.uint64)


def removed_spans(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every document."""
    spark = tuned(docs.sparkSession)
    shipped(spark)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("tie"),
        "text",
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_TEXT_BYTES)
    hot = _hot_anchors(rows, hot_rows)
    parts = buckets
    found = written(
        rows.mapInArrow(_segment_rows(buckets, hot), _ROW)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_settle(parts), _BY_PART),
        "settled",
    )
    texts = rows.mapInArrow(_pack(parts), _BY_PART)
    asked = found.filter(F.col("kind") == ASKED)
    size = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    asked_places = (asked.agg(F.sum(size)).first()[0] or 0) // _PLACE.itemsize
    shards = max(1, asked_places * SEGMENT_BYTES // SHARD_BYTES)

    def beside_texts(results: DataFrame) -> DataFrame:
        return (
            results.unionByName(texts)
            .repartition(parts, "part")
            .sortWithinPartitions("part", "kind")
        )

    sorted_runs = (
        beside_texts(asked)
        .mapInArrow(_cut_segments(shards), "shard int, doc long, tie long, first int, bytes binary")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_sort_shards(parts), _BY_PART)
    )
    runs = found.filter(F.col("kind") == RUNS).unionByName(sorted_runs)
    return beside_texts(runs).mapInArrow(
        _remove,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "removed array<struct<start: long, end: long>>",
    )
