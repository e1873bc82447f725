"""WARC archives: gzip member per record, payload de-duplication, a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import filesystem, pick, put_in_place, shared_dir, shuffle_partitions, table

#: Fixed values of the formats.
GZIP_MAGIC, WARC_MAGIC = b"\x1f\x8b\x08", b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES, DECODE_BYTES = 1 << 20, 1 << 14
FILES_SCHEMA = "part int, path string, bytes bigint, records bigint"
RECORDS_SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, "
    "refers_to string, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(text: str) -> str:
    """Header values hold no line ends."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def member(page_id: int | None, url: str, payload: bytes, original: int | None, level: int) -> bytes:
    """One gzip member: a response, or a revisit that keeps the HTTP head (with the full length) and the digest only."""
    revisit = original is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(original)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    plain = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload and original: the smallest page_id of an equal payload, null for responses.

    Payloads below min_bytes are all responses. A null page_id is never an
    original while another page has the payload; repeated rows of the smallest
    page_id are all responses. Only digests are grouped, with partial sums, so
    a payload that a third of all pages share stays cheap; the join on digests
    may be split where one digest is hot.
    """
    rows = pick(pages, page_id="bigint", url="string", html="string").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1 and first is not null").select("digest", "first")
    original = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", original.alias("original"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Archives of all pages, one file per task; returns part, path, bytes, records of each file.

    Null html is an empty payload. A task writes under its attempt's own name
    and renames the whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        task = TaskContext.get()
        part, attempt, sink, records = task.partitionId(), task.taskAttemptId(), None, 0
        for b in batches:
            for page_id, url, payload, original in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/_{part:06d}.{attempt}", compression=None)
                sink.write(member(page_id, url, payload.encode("utf-8"), original, level))
                records += 1
        if sink is None:
            return
        size = sink.tell()
        sink.close()
        put_in_place(fs, f"{root}/_{part:06d}.{attempt}", path := f"{root}/part-{part:06d}.warc.gz")
        scheme = folder[: len(folder) - len(folder.split("://", 1)[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{scheme}{path}"]), pa.array([size]), pa.array([records])], names=["part", "path", "bytes", "records"])

    return with_originals(pages, min_bytes).mapInArrow(run, FILES_SCHEMA)


class Window:
    """Bytes of a file from a position on, read in steps; skipped bytes are only passed over until the next read."""

    def __init__(self, source, at: int, size: int):
        self.source, self.start, self.size, self.held, self.passed = source, at, size, b"", 0

    @property
    def at(self) -> int:
        return self.start + self.passed

    def more(self) -> bool:
        """Appends further bytes; False at the end of the file."""
        end = self.start + len(self.held)
        if end >= self.size:
            return False
        self.source.seek(end)
        self.held, self.start, self.passed = self.held[self.passed :] + self.source.read(min(READ_BYTES, self.size - end)), self.at, 0
        return True

    def skip(self, n: int) -> None:
        self.passed += n

    def find(self, mark: bytes) -> int:
        """Place of the mark from here, or -1."""
        k = self.held.find(mark, self.passed)
        return k - self.passed if k >= 0 else -1

    def view(self, at: int, n: int) -> memoryview:
        return memoryview(self.held)[self.passed + at : self.passed + at + n]

    def left(self) -> int:
        return len(self.held) - self.passed


def _is_member(window: Window, k: int) -> bool:
    """Whether the bytes at offset k decode as a gzip member that begins with a WARC version line."""
    while window.left() - k < 1024 and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.view(k, 1024), 16).startswith(WARC_MAGIC)
    except zlib.error:
        return False


def _decode(window: Window) -> bytes:
    """The member at the window's start, a step at a time; the window then stands behind it."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        if not window.left() and not window.more():
            raise ValueError("a record is cut off at the end of the file")
        step = window.view(0, DECODE_BYTES)
        out.append(unpack.decompress(step))
        window.skip(len(step) - len(unpack.unused_data))
    return b"".join(out)


def members(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records of the members that start in [start, end); the last one may run past the end."""
    window = Window(source, start, size)
    while window.at < end:
        k = window.find(GZIP_MAGIC)
        if k < 0:
            window.skip(max(0, window.left() - 2))
            if not window.more():
                return
        elif window.at + k >= end:
            return
        elif _is_member(window, k):
            window.skip(k)
            yield _decode(window)
        else:
            window.skip(k + 1)


def parse_record(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8")
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields[b"warc-type"] == "revisit"
    digest = fields[b"warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (length != len(payload) or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields[b'warc-record-id']} does not match its header")
    return (
        fields[b"warc-record-id"], fields[b"warc-type"], fields.get(b"warc-target-uri"), length, digest,
        fields.get(b"warc-refers-to"), None if revisit else payload,
    )


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """Records of the archives in `files` (path, bytes), by byte ranges of split_bytes.

    A range finds its first member by scanning for the gzip magic and decoding
    what follows; it owns the records that start inside. Responses are checked
    against length and digest.
    """
    ranges = files.select(
        "path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start")
    ).where("bytes > 0")
    ranges = ranges.repartition(4 * shuffle_partitions(spark), "path", "start")
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORDS_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for r in b.to_pylist():
                fs, path = filesystem(r["path"])
                with fs.open_input_file(path) as source:
                    rows, held = [], 0
                    for raw in members(source, r["bytes"], r["start"], min(r["bytes"], r["start"] + split_bytes)):
                        record = parse_record(raw)
                        rows.append(record if payloads else (*record[:-1], None))
                        held += len(raw) if payloads else 200
                        if held > 1 << 23:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return ranges.mapInArrow(run, RECORDS_SCHEMA)


def page_number(record: str) -> F.Column:
    return F.nullif(F.regexp_extract(record, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("bigint")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    files = spark.createDataFrame([tuple(r) for r in written.collect()], FILES_SCHEMA)  # a row for each file
    return read_warc(spark, files, payloads=False).select(
        page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )


#: DuckDB has no base32; five bits at a time from the digest's 160.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
    list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) AS nibbles
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (
      ((nibbles[(5 * k) // 4 + 1] * 16 + coalesce(nibbles[(5 * k) // 4 + 2], 0)) >> (3 - (5 * k) % 4)) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
