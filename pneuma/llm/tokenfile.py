"""Token files: independent zstandard frames, a document index, a trailing seek table with checksums.

Layout of a file (all integers little-endian):
  one zstandard frame for each document: its ids as unsigned 32-bit integers
  one zstandard frame: the index (doc_id int64, null flag uint8, tokens int64 for each document)
  the seek table of the public seekable format: a skippable frame with, for each
  frame, compressed size, decompressed size and the low 32 bits of the XXH64 of
  its content, then the number of frames, a flag byte and the closing magic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import filesystem, pick, put_in_place, shared_dir, shuffle_partitions, table
from .tokenize import BYTE_BPE, BYTE_RANKS, rank_encoder, vocabulary_path

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, ENTRY = struct.Struct("<IBI"), np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])
#: One frame's content must fit a 32-bit size; longer documents take several frames.
FRAME_BYTES = 1 << 24


class FrameWriter:
    def __init__(self, sink, level: int = 1):
        self.sink, self.zstd, self.frames = sink, zstandard.ZstdCompressor(level=level), []

    def frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.sink.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        table = np.array(self.frames, dtype=ENTRY).tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER.size) + table)
        self.sink.write(FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - FOOTER.size - n * ENTRY.itemsize)
        self.table = np.frombuffer(source.read(n * ENTRY.itemsize), ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()
        index_frames = struct.unpack("<I", self.frame(n - 1))[0]
        raw = b"".join(self.frame(k) for k in range(n - 1 - index_frames, n - 1))
        m = len(raw) // 17
        self.doc_ids = np.frombuffer(raw, "<i8", m)
        self.nulls = np.frombuffer(raw, "u1", m, 8 * m)
        self.tokens = np.frombuffer(raw, "<i8", m, 9 * m)
        per_doc = np.maximum(1, -(-4 * self.tokens // FRAME_BYTES))
        self.first = np.concatenate([[0], np.cumsum(per_doc)])

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        content = self.zstd.decompress(self.source.read(int(self.table["packed"][k])), int(self.table["plain"][k]) or 1)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table["sum"][k]:
            raise ValueError(f"checksum of frame {k} does not match")
        return content

    def document(self, d: int) -> bytes:
        return b"".join(self.frame(k) for k in range(self.first[d], self.first[d + 1]))


def _pieces(content: bytes) -> Iterator[bytes]:
    for at in range(0, max(1, len(content)), FRAME_BYTES):
        yield content[at : at + FRAME_BYTES]


def write_token_files(docs: DataFrame, folder: str, encode: Callable[[], Callable[[pa.Array], Iterator[bytes]]], end_id: int = 0) -> DataFrame:
    """Write documents in ascending doc_id order (nulls first, ties by text), one file per range of doc_id.

    encode() makes, inside a task, the function from a column of texts to the
    bytes of the 32-bit ids of each. Null texts are empty: their document is the end id alone.
    Returns one row per file: part, path, bytes, docs, tokens. A task writes
    under a name of its own attempt and renames it when whole, so a retried
    task leaves the same file.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    parts = max(shuffle_partitions(docs.sparkSession), rows.rdd.getNumPartitions())
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        writer, column_ids = None, encode()
        index: list[tuple[int, int, int]] = []
        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), column_ids(b.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/_{part:06d}.{attempt}")
                    writer = FrameWriter(sink)
                content += end
                for piece in _pieces(content):
                    writer.frame(piece)
                index.append((doc_id or 0, doc_id is None, len(content) // 4))
        if writer is None:
            return
        ids, nulls, tokens = (np.array(c, dtype=t) for c, t in zip(zip(*index, strict=True), ("<i8", "u1", "<i8"), strict=True))
        pieces = list(_pieces(ids.tobytes() + nulls.tobytes() + tokens.tobytes()))
        for piece in pieces:
            writer.frame(piece)
        writer.frame(struct.pack("<I", len(pieces)))
        writer.close()
        size = sink.tell()
        sink.close()
        put_in_place(fs, f"{root}/_{part:06d}.{attempt}", path := f"{root}/part-{part:06d}.zst")
        scheme = folder[: len(folder) - len(folder.split("://", 1)[-1])]
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "path": [f"{scheme}{path}"], "bytes": [size], "docs": [len(index)], "tokens": [int(tokens.sum())]},
            schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    return ranged.mapInArrow(run, "part int, path string, bytes bigint, docs bigint, tokens bigint")


def read_token_files(spark: SparkSession, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that write_token_files listed.

    files: its rows (one per file, not per document). start counts the tokens
    of all documents before, over all files in order of their part.
    """
    rows, start = [], 0
    for f in sorted(files, key=lambda f: f["part"]):
        rows.append((f["path"], f["bytes"], start))
        start += f["tokens"]
    listed = spark.createDataFrame(rows, "path string, bytes bigint, start bigint")
    listed = listed.repartition(max(1, len(rows)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                fs, path = filesystem(f["path"])
                with fs.open_input_file(path) as source:
                    file = TokenFile(source, f["bytes"])
                    starts = f["start"] + np.concatenate([[0], np.cumsum(file.tokens)[:-1]])
                    for lo in range(0, len(starts), 10_000):
                        some = slice(lo, lo + 10_000)
                        sums = [zlib.crc32(file.document(d)) for d in range(len(starts))[some]]
                        ids = pa.array(file.doc_ids[some], mask=file.nulls[some].astype(bool))
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array(starts[some]), pa.array(file.tokens[some]), pa.array(sums, pa.int64())], schema=schema
                        )

    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ranks = vocabulary_path(BYTE_BPE), vocabulary_path(BYTE_RANKS)
    files = write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), lambda: rank_encoder(path, ranks).stream)
    return read_token_files(spark, files.collect())
