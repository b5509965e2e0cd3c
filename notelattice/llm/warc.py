"""WARC archives: write records as gzip members, read them back from byte ranges.

Writing: one member per record. Of records with equal payloads (of a least length), the one with the smallest id is a
``response``; the others are ``revisit`` records that name it and carry no payload. Groups of copies are counted by
digest with a combine before the shuffle; only groups of two and more are kept and joined back, broadcast by Spark
when their stored size allows and by a sort-merge join with split skew otherwise.

Reading: a file is cut into byte ranges. The task of a range looks for the gzip magic, validates every candidate by
decoding the record header behind it, and owns the records that start inside its range, to their end beyond it. Padding,
junk and damaged members between records cost no other record. A range may begin inside the stored bytes of a record
whose payload is an archive itself; a member there is told apart by what follows it, or by looking back for the record
around it. Only an archive of several adjacent members, stored without compression, can pass for records there.

Files go through ``pyarrow.fs`` below the shared folder. A task writes to a file of its own attempt; only the files
of the attempts that Spark committed are in the returned manifest, so a lost executor leaves no double records.

Defined cases: a null payload is an empty one; a null id gives a record without id, after all others; rows that share
the smallest id and the payload are all responses; a null address leaves the header out; control characters in an
address are percent-encoded. No rows give no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, filesystem, ship, stored
from notelattice.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-record:"
CHUNK = 1 << 16

MANIFEST = "path string, n_bytes long, n_records long"
RECORDS = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long"
)


def with_copies_marked(records: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Adds ``_payload``, ``_first`` (smallest id with this payload, null unless several) and ``_copies``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    keyed = records.withColumn("_payload", payload).withColumn("_sha1", F.sha1("_payload"))
    groups = (
        keyed.where(F.octet_length("_payload") >= min_bytes)
        .groupBy("_sha1")
        .agg(F.min(id_col).alias("_first"), F.count("*").alias("_copies"))
        .where("_copies > 1")
    )
    return keyed.join(stored(groups, "copies"), "_sha1", "left")


def record_bytes(
    record_id: str | None, uri: str | None, payload: bytes, first: str | None, date: str, digest: str
) -> bytes:
    """One uncompressed record. ``first``: the record that holds the payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
    ]
    if uri is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
        head.append(f"WARC-Target-URI: {clean}")
    if first is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{first}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(
    records: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    max_file_bytes: int = 1 << 28,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 6,
) -> DataFrame:
    """Write the records; returns the manifest ``(path, n_bytes, n_records)`` of the committed files."""
    check_columns(records, [id_col, uri_col, payload_col], [])
    spark = records.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    plain = records.select(
        F.col(id_col).alias("_id"), F.col(uri_col).alias("_uri"), F.col(payload_col).alias("_body")
    )
    marked = with_copies_marked(plain, "_id", "_body", min_revisit_bytes)
    rows = marked.select(
        F.col("_id").cast("string").alias("id"),
        F.col("_uri").cast("string").alias("uri"),
        F.col("_payload").alias("payload"),
        F.when(F.col("_copies").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))
        .cast("string")
        .alias("first"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        task = TaskContext.get()
        out, name, size, count, number, done = None, "", 0, 0, 0, []
        for batch in batches:
            for rid, uri, text, first in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    size, count, number = 0, 0, number + 1
                payload = text.encode("utf-8")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(rid, uri, payload, first, date, digest)) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= max_file_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", size, count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            paths, sizes, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["path", "n_bytes", "n_records"],
            )

    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def warc_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, n_bytes)`` of archives that something else wrote."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return listed.select("path", F.col("length").alias("n_bytes"))


#: What writers put between members.
PADDING = b"\0 \r\n\t"


class ByteRange:
    """Scans one byte range of a file for records that start inside it."""

    def __init__(self, source, start: int, end: int, size: int):
        self.source, self.start, self.end, self.size = source, start, end, size

    def _at(self, position: int, n: int) -> bytes:
        self.source.seek(position)
        return self.source.read(n)

    def _next_magic(self, position: int) -> int:
        """The first magic at or after ``position`` that begins inside the range, or -1."""
        while position < self.end:
            block = self._at(position, CHUNK + len(MAGIC) - 1)
            found = block.find(MAGIC)
            if found >= 0:
                return position + found if position + found < self.end else -1
            if len(block) < CHUNK:
                return -1
            position += CHUNK
        return -1

    def _member(self, position: int) -> tuple[bytes, int] | None:
        """The record at ``position`` and where its member ends; None if no record begins there."""
        unpack, parts, n, at = zlib.decompressobj(31), [], 0, position
        checked = False
        try:
            while not unpack.eof:
                block = self._at(at, CHUNK)
                if not block:
                    return None
                part = unpack.decompress(block)
                parts.append(part)
                n, at = n + len(part), at + len(block)
                if not checked and n >= 8:
                    parts = [b"".join(parts)]
                    if not parts[0].startswith(b"WARC/1."):
                        return None
                    checked = True
        except zlib.error:
            return None
        return b"".join(parts), at - len(unpack.unused_data)

    def _followed(self, end: int) -> bool:
        """Whether a member or the end of the file comes next, padding aside."""
        while end < self.size:
            block = self._at(end, CHUNK)
            rest = block.lstrip(PADDING)
            end += len(block) - len(rest)
            if rest or not block:
                return self._at(end, len(MAGIC)) == MAGIC
        return True

    def _alone(self, position: int) -> bool:
        """Whether no record that begins earlier reaches over ``position``: looks back to the first sure one."""
        at = position
        while at > 0:
            begin = max(0, at - CHUNK)
            block = self._at(begin, at - begin + len(MAGIC) - 1)
            found = block.rfind(MAGIC)
            while found >= 0:
                member = self._member(begin + found)
                if member and parse_record(member[0]):
                    if member[1] > position:
                        return False
                    if self._followed(member[1]):
                        return True
                found = block.rfind(MAGIC, 0, found + len(MAGIC) - 1)
            at = begin
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(header fields by lower-case name, block) of every owned record.

        The first one of a range may lie inside the stored bytes of another; behind one that doesn't, all others are
        found from end to start, whatever stands between them.
        """
        position, sure = self._next_magic(self.start), self.start == 0
        while position >= 0:
            found = self._member(position)
            parsed = found and parse_record(found[0])
            if parsed and (sure or self._followed(found[1]) or self._alone(position)):
                sure = True
                yield parsed
                position = self._next_magic(found[1])
            else:
                position = self._next_magic(position + 1)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block, or None if the header isn't one of a WARC record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.\d", lines[0]):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not length.isdigit() or len(rest) < int(length):
        return None
    return fields, rest[: int(length)]


def described(fields: dict[str, str], block: bytes) -> tuple:
    """The row of RECORDS for one record, with the payload at the end."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if kind == "response":
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    else:
        digest, size = declared, int(stated[1]) if stated else None

    def name(field: str) -> str | None:
        return fields.get(field, "").strip("<>").removeprefix(ID_PREFIX) or None

    row = (name("warc-record-id"), kind, fields.get("warc-target-uri"), name("warc-refers-to"), digest, size)
    return (*row, payload if kind == "response" else None)


def read_warc(files: DataFrame, split_bytes: int = 1 << 26, with_payload: bool = False) -> DataFrame:
    """Records of ``files(path, n_bytes)``, one task per ``split_bytes`` of a file.

    Digest and length of a response are those of the payload read; a revisit's are the stated ones.
    """
    if split_bytes < 1:
        raise ValueError("split_bytes must be positive")
    ship(files.sparkSession)
    ranges = files.where("n_bytes > 0").select(
        "path",
        "n_bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias(
            "start"
        ),
    )
    tasks = files.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    schema = RECORDS + ", payload binary" * with_payload
    keep = 7 if with_payload else 6
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kinds[i]) for i in range(keep)], names=names[:keep]
            )

        for batch in batches:
            for x in batch.to_pylist():
                store, path = filesystem(x["path"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    scan = ByteRange(source, x["start"], min(x["start"] + split_bytes, x["n_bytes"]), x["n_bytes"])
                    for fields, block in scan.records():
                        rows.append(described(fields, block))
                        held += len(block) if with_payload else 200
                        if held > 1 << 23:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return ranges.repartition(int(tasks)).mapInArrow(read, schema)
