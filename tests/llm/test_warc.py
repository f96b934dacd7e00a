from __future__ import annotations

import random

import pytest

from cohortspark.llm import warc
from cohortspark.llm.files import opened


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash") for r in rows], "page_id long, url string, html string, digest string"
    ).repartition(3)


ROWS = [
    (1, "http://a/", "same"),
    (2, "http://b/", "same"),
    (3, "http://c/\r\nWARC-Type: x", None),
    (4, None, ""),
    (5, "http://é/ x", "Ünï\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3),
    (None, "http://n/", "same"),
    (None, "http://n/", "alone"),
    (6, "http://long/", "<p>" + "x y z " * 200_000),
    (2, "http://again/", "same"),
]


def brute(rows):
    largest = {}
    for page_id, _, html in rows:
        key = html or ""
        if page_id is not None:
            largest[key] = max(largest.get(key, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw, top = (html or "").encode(), largest.get(html or "")
        again = page_id != top
        out.append((page_id, len(raw), warc.base32_sha1(raw), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 300])
def test_round_trip(spark, archive_bytes):
    folder = warc.write_archives(pages(spark, ROWS), archive_bytes=archive_bytes)
    archives = spark.read.parquet(f"{folder}/archives")
    entries = warc.read_archives(spark, archives)
    assert sorted(map(tuple, warc.records(entries).collect()), key=repr) == brute(ROWS)
    assert warc.gaps(entries).count() == 0
    assert archives.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_no_pages(spark):
    folder = warc.write_archives(pages(spark, []))
    assert warc.read_archives(spark, spark.read.parquet(f"{folder}/archives")).count() == 0


def archive(n=30):
    draw, members = random.Random(n), []
    for i in range(n):
        body = bytes(draw.choices(range(256), k=draw.randrange(200)))
        members.append(warc.member(warc.record_bytes(i, f"http://x/{i}", body, False, None, "2024-01-01T00:00:00Z")))
    return members


def ids(content):
    records, gaps = [], []
    for start, end, found in warc.salvaged(content):
        if isinstance(found, str):
            gaps.append((start, end))
        else:
            records += [warc._number(r.head["warc-record-id"]) for r in found]
    return records, gaps


def test_damaged_members_are_left_out_and_logged():
    members, draw = archive(), random.Random(8)
    for trial in range(60):
        bad = set(draw.sample(range(len(members)), 3))
        parts = []
        for n, packed in enumerate(members):
            if n in bad:
                changed = bytearray(packed)
                for _ in range(4):
                    changed[draw.randrange(len(changed))] ^= 1 + draw.randrange(255)
                packed = bytes(changed)
            parts.append(packed)
        content = b"".join(parts)
        found, gaps = ids(content)
        assert set(range(len(members))) - bad <= set(found)
        starts = [sum(map(len, parts[:n])) for n in range(len(parts) + 1)]
        lost = set(range(len(members))) - set(found)
        assert all(any(a <= starts[n] and b >= starts[n + 1] for a, b in gaps) for n in lost)


def test_cut_short_and_foreign_bytes():
    members = archive(5)
    content = b"".join(members)
    assert ids(content[:-3]) == ([0, 1, 2, 3], [(len(content) - len(members[4]), len(content) - 3)])
    assert ids(b"junk" + content) == ([0, 1, 2, 3, 4], [(0, 4)])
    mixed = members[0] + b"\x1f\x8b\x08junk WARC/1.0\r\n nothing" + members[1]
    assert ids(mixed)[0] == [0, 1]
    assert ids(b"") == ([], [])


def test_bare_records_and_wrong_lengths():
    bare = [warc.record_bytes(n, None, b"body %d" % n, False, None, "d") for n in range(3)]
    assert ids(b"".join(bare))[0] == [0, 1, 2]
    assert ids(bare[0] + bare[1].replace(b"body", b"bodi") + bare[2])[0] == [0, 2]
    assert ids(bare[0] + bare[1].replace(b"Content-Length", b"Content-Size") + bare[2])[0] == [0, 2]
    whole = warc.member(b"".join(bare))
    assert ids(whole)[0] == [0, 1, 2]


def test_gaps_of_a_damaged_file(spark):
    folder = warc.write_archives(pages(spark, ROWS).coalesce(1))
    path = spark.read.parquet(f"{folder}/archives").first().path
    store, local = opened(path)
    with store.open_input_file(local) as source:
        content = bytearray(source.read())
    content[40] ^= 255
    with store.open_output_stream(local, compression=None) as out:
        out.write(bytes(content))
    entries = warc.read_archives(spark, spark.createDataFrame([(path,)], "path string"))
    assert warc.records(entries).count() == len(ROWS) - 1
    assert warc.gaps(entries).count() == 1
