"""WARC archives of pages, and a reader that salvages damaged ones (operator 9).

A record is a gzip member of its own. Of records with equal payloads the one with the largest page_id is the
response; the others are revisits that name it and keep the HTTP head, with the payload's length, but no body.

The reader checks members, version lines, lengths and digests. After a failed check it looks for the next
member or version line at which a whole record passes, goes on from there, and logs the bytes between as a
quarantined gap with the reason. A file cut short ends with a gap.

Defined cases: a null html is an empty payload; a null url is left out; a null page_id is written without a
number, counts as smaller than all others, and is read back as null; rows with the same page_id and payload
are all responses where that id is the largest, else revisits of one id; an empty table writes no archive
and gives no rows. Control characters of a url are percent-encoded, so a url can't end its line. Further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.bytewords import raw_texts
from cohortspark.llm.files import attempt_name, memory_mapped, new_folder, opened, shipped
from cohortspark.session import tuned, written

#: An archive is closed after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Payloads at least this long may be revisits.
LEAST_BYTES = 0
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _line_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str
) -> bytes:
    """One record, not compressed."""
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    ) + (b"" if revisits else payload)
    head = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _line_safe(url)))
    if revisits:
        head += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class Damaged(ValueError):
    """Why a record doesn't pass."""


@dataclass
class Record:
    head: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """Of the full payload, which a revisit's HTTP head still tells."""
        if self.head.get("warc-type") != "revisit":
            return len(self.payload)
        found = re.search(rb"(?i)\r\nContent-Length: *(\d+)\r\n", self.block)
        if not found:
            raise Damaged("no payload length")
        return int(found[1])

    @property
    def payload_digest(self) -> str:
        stated = self.head.get("warc-payload-digest", "").rpartition(":")[2]
        if self.head.get("warc-type") == "revisit":
            return stated
        found = base32_sha1(self.payload)
        if stated and stated != found:
            raise Damaged("payload digest")
        return found


def parsed(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that begins at a place, and where the next one may; raises ``Damaged``."""
    line = _LINE.match(data, at)
    if not line:
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Damaged("record head")
    head = {}
    for text in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("record head")
        head[name.strip().lower()] = value.strip()
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("content length")
    low, high = end + 4, end + 4 + int(length)
    if data[high : high + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    record = Record(head, data[low:high])
    stated = head.get("warc-block-digest", "").rpartition(":")[2]
    if stated and stated != base32_sha1(record.block):
        raise Damaged("block digest")
    record.payload_bytes, record.payload_digest  # noqa: B018 - both raise where they don't pass
    return record, high + 4


def _unpacked(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and its end."""
    unpacker, parts, low = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if low >= len(data):
                raise Damaged("member cut short")
            parts.append(unpacker.decompress(data[low : low + (1 << 16)]))
            low += 1 << 16
    except zlib.error as error:
        raise Damaged("member check") from error
    return b"".join(parts), min(low, len(data)) - len(unpacker.unused_data)


def _records_at(data: memoryview, at: int) -> tuple[list[Record], int]:
    """The records of the member, or the bare record, at a place, and its end."""
    if data[at : at + 3] == MEMBER:
        content, end = _unpacked(data, at)
        found, inner = [], 0
        while inner < len(content):
            record, inner = parsed(content, inner)
            found.append(record)
        if not found:
            raise Damaged("empty member")
        return found, end
    record, end = parsed(data.obj, at)
    return [record], end


def salvaged(content: bytes) -> Iterator[tuple[int, int, list[Record] | str]]:
    """Start, end and records, or start, end and the reason of a gap, in the order of an archive's bytes."""
    data, at, gap, reason = memoryview(content), 0, None, ""
    while at < len(content):
        try:
            found, end = _records_at(data, at)
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _START.search(content, at + 1)
            at = following.start() if following else len(content)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, end, found
        at = end
    if gap is not None:
        yield gap, len(content), reason


_ROW = ["page_id", "url", "html", "refers_to", "revisits"]


def _write_archives(folder: str, date: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, None
        name, size, count = "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())}
            )

        for batch in batches:
            ids, urls, _, refers, revisits = (c.to_pylist() for c in batch.columns)
            for id_, url, payload, target, again in zip(ids, urls, raw_texts(batch.column(2)), refers, revisits):
                if out is None:
                    name = attempt_name(folder, f"pages-{part:05d}-{number:05d}") + ".warc.gz"
                    store, path = opened(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    # Archives are compressed by record; the store must not do so again.
                    out, size, count, number = store.open_output_stream(path, compression=None), 0, 0, number + 1
                packed = member(record_bytes(id_, url, payload, again, target, date))
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
    least_bytes: int = LEAST_BYTES,
) -> str:
    """Archives of all pages; returns their folder, whose table ``archives`` names each file.

    Payload classes are counted by digest before anything moves; only classes of several rows are joined.
    """
    spark = tuned(pages.sparkSession)
    shipped(spark)
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumns(
        {"digest": F.sha1(F.col("html").cast("binary")), "long": F.octet_length("html") >= least_bytes}
    )
    classes = written(
        rows.filter("long")
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "largest", F.lit(True).alias("shared")),
        "payload_classes",
    )
    again = F.coalesce(F.col("shared"), F.lit(False)) & F.col("long") & ~F.col("page_id").eqNullSafe(F.col("largest"))
    rows.join(classes, "digest", "left").select(
        "page_id", "url", "html", F.when(again, F.col("largest")).alias("refers_to"), again.alias("revisits")
    ).mapInArrow(
        _write_archives(folder, date, archive_bytes), "path string, bytes long, records long"
    ).write.parquet(f"{folder}/archives")
    return folder


_ENTRY = (
    "path string, start long, end long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string"
)


def _read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in _ENTRY.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, _ENTRY.split(", "))])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for start, end, found in salvaged(memory_mapped(path).to_pybytes()):
                if isinstance(found, str):
                    rows.append((path, start, end, found, *[None] * 6))
                    continue
                for record in found:
                    head = record.head
                    rows.append(
                        (
                            path,
                            start,
                            end,
                            None,
                            _number(head.get("warc-record-id")),
                            head.get("warc-target-uri"),
                            head.get("warc-type"),
                            _number(head.get("warc-refers-to")),
                            record.payload_bytes,
                            record.payload_digest,
                        )
                    )
            for low in range(0, len(rows), 4096):
                columns = zip(*rows[low : low + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
                )


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """A row for each record of the archives in ``path``, and one with a ``reason`` for each gap.

    An archive is read by one task; the writer bounds its size.
    """
    shipped(spark)
    return (
        paths.select("path").repartition(max(1, paths.count())).mapInArrow(_read_archives, _ENTRY)
    )


def records(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("reason").isNull()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def gaps(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("reason").isNotNull()).select("path", "start", "end", "reason")
