import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from notelattice.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


PAGES = [
    (5, "http://a/x", "same"),
    (3, "http://a/y\r\nEvil: 1", "same"),
    (9, None, None),
    (4, "http://b/", ""),
    (7, "http://b/2", "long " * 60_000),
    (8, "http://b/3", "größe"),
    (None, "http://b/4", "same"),
    (3, "http://a/y again", "same"),
]


@pytest.fixture(scope="module")
def manifest(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, _payload string")
    return warc.write_warc(pages.repartition(2), max_file_bytes=600)


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 26])
def test_round_trip_at_any_split(manifest, split):
    rows = warc.read_warc(manifest, split_bytes=split, with_payload=True).collect()
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in rows), key=str)
    want = []
    for page, _, html in PAGES:
        html = html or ""
        first = {"same": 3, "": 4}.get(html)
        again = first is not None and page != first
        want.append((
            None if page is None else str(page),
            "revisit" if again else "response",
            str(first) if again else None,
            digest(html),
            len(html.encode()),
        ))
    assert got == sorted(want, key=str)
    payloads = {r.record_id: bytes(r.payload) for r in rows if r.payload is not None}
    assert payloads["8"] == "größe".encode() and payloads["7"] == b"long " * 60_000


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "u", "ab") for i in range(3)], "page_id long, url string, html string")
    rows = warc.read_warc(warc.write_warc(pages, min_revisit_bytes=3)).collect()
    assert {r.record_type for r in rows} == {"response"} and len(rows) == 3


def test_members_are_plain_gzip(manifest):
    path = warc.filesystem(manifest.first()["path"])[1]
    with gzip.open(path) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_an_archive_inside_a_payload_is_not_a_record(spark):
    inner = gzip.compress(warc.record_bytes("99", None, b"inner", None, "1970-01-01T00:00:00Z", "X"), 0)
    outer = gzip.compress(
        warc.record_bytes("1", None, b"before" + inner + b"after" * 20, None, "1970-01-01T00:00:00Z", "X"), 0
    )
    data = outer + gzip.compress(warc.record_bytes("2", None, b"", None, "1970-01-01T00:00:00Z", "X"))
    for start in range(0, len(data), 10):
        scan = warc.ByteRange(pa.BufferReader(data), start, start + 10, len(data))
        found = [f["warc-record-id"] for f, _ in scan.records()]
        assert found == (["<urn:x-record:1>"] if start == 0 else ["<urn:x-record:2>"] if start <= len(outer) < start + 10 else [])


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages)).count() == 0


def write_archive(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return spark.createDataFrame([(f"file:{tmp_path / name}", len(data))], "path string, n_bytes long")


def record(number, payload=b"x"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:{number}>\r\nContent-Length: {len(payload) + 4}\r\n\r\n"
    return head.encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


@pytest.mark.parametrize("split", [37, 1 << 20])
def test_what_stands_between_members(spark, tmp_path, split):
    """Padding, junk and damaged members cost no record; members inside stored bytes are none."""
    members = [gzip.compress(record(i, b"payload %d" % i)) for i in range(5)]
    inner = gzip.compress(record(98)) + b"junk" + gzip.compress(record(99)) + b"junk"
    stored_member = gzip.compress(record(5, inner * 3), compresslevel=0)
    damaged = bytearray(gzip.compress(record(97)))
    damaged[len(damaged) // 2] ^= 0xFF
    data = members[0] + b"\0" * 600 + members[1] + b"junk\x1f\x8b\x08 more junk" + members[2] + bytes(damaged) + members[3]
    data += stored_member + b"\r\n" + members[4] + b"!"
    got = warc.read_warc(write_archive(spark, tmp_path, "a.warc.gz", data), split_bytes=split).collect()
    assert sorted(r.record_id for r in got) == [str(i) for i in range(6)]


def test_a_stray_byte_at_the_end(spark, tmp_path):
    data = b"".join(gzip.compress(record(i)) for i in range(3)) + b"\x1f"
    for split in (1, 50, 1 << 20):
        got = warc.read_warc(write_archive(spark, tmp_path, f"{split}.warc.gz", data), split_bytes=split).collect()
        assert sorted(r.record_id for r in got) == ["0", "1", "2"]
