"""Token files: independent zstandard frames, a document index, and a trailing seek table with checksums.

A file is a run of zstandard frames. Each data frame holds the ids of whole documents as little-endian unsigned
32-bit integers; the last frame before the table is the index (doc ids, token counts, frame numbers, and bits for null ids). The table
is a skippable frame in the public seekable layout: compressed size, content size and checksum (low half of XXH64 of
the content) of every frame, then a nine-byte footer. So any zstandard reader can unpack a file, and a reader that
wants some documents reads footer, table, index and the frames that hold them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch, small_batches, tidy
from chronotext.llm.tokens import encoder, forget_words, pack

FRAME_BYTES = 1 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Write documents in order; memory is one frame and the index of the file."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.frame_bytes, self.held, self.size = frame_bytes, [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.none: list[bool] = []
        self.counts: list[int] = []
        self.where: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.ids.append(doc_id or 0)
        self.none.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.where.append(len(self.frames))
        self.held.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        self._frame(b"".join(self.held))
        self.held, self.size = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self.flush()
        self._frame(b"".join([struct.pack("<Q", len(self.ids)), np.array(self.ids, "<i8").tobytes(),
                              np.array(self.counts, "<u8").tobytes(), np.array(self.where, "<u4").tobytes(),
                              np.packbits(np.array(self.none, dtype=bool)).tobytes()]))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to a file that ``Writer`` wrote; a damaged frame raises ``ValueError``."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        index = self.frame(n - 1)
        docs = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8)
        self.counts = np.frombuffer(index, "<u8", docs, 8 + 8 * docs).astype(np.int64)
        self.where = np.frombuffer(index, "<u4", docs, 8 + 16 * docs).astype(np.int64)
        self.none = np.unpackbits(np.frombuffer(index, np.uint8, -(-docs // 8), 8 + 20 * docs), count=docs).astype(bool)
        self.before = np.concatenate([[0], np.cumsum(self.counts)])

    def frame(self, i: int) -> bytes:
        packed, content, check = self.frames[i]
        self.source.seek(int(self.starts[i]))
        out = zstandard.ZstdDecompressor().decompress(self.source.read(int(packed)), max_output_size=int(content))
        if len(out) != content or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return out

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, ids); only frames that hold a wanted document are unpacked."""
        rows = np.arange(len(self.doc_ids)) if wanted is None else np.flatnonzero(
            np.isin(self.doc_ids, np.array(list(wanted), dtype=np.int64)) & ~self.none)
        at, content, base = -1, b"", 0
        for i in rows:
            if self.where[i] != at:
                at = self.where[i]
                content, base = self.frame(int(at)), int(self.before[np.searchsorted(self.where, at)])
            a = 4 * (int(self.before[i]) - base)
            yield None if self.none[i] else int(self.doc_ids[i]), int(self.before[i]), content[a:a + 4 * int(self.counts[i])]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending key order; returns the files (part, file, docs, tokens).

    A null text is empty (its end id alone). Null keys come last, equal keys in the order of a hash of the text;
    repeated rows are written as often as they occur. An empty table gives no rows. A key's rows may spread over
    files. Each attempt of a task writes a file of its own name, and the result names those of the attempts that
    counted, so a lost executor leaves at most a file that no reader is told of.
    """
    order = [F.col(key).asc_nulls_last(), F.col("_h").asc(), F.col("_n").asc()]
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text"),
                       F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_n"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "_text")
    end = pack([end_id])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, store, writer, name = encoder(tokenizer), None, None, ""
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    files, path = open_fs(folder)
                    files.create_dir(path, recursive=True)
                    name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.zst"
                    store = files.open_output_stream(f"{path}/{name}", compression=None)
                    writer = Writer(store)
                writer.add(doc, encode(words) + end)
        if writer is not None:
            writer.close()
            store.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [f"{folder}/{name}"],
                "docs": pa.array([len(writer.ids)], pa.int64()),
                "tokens": pa.array([sum(writer.counts)], pa.int64())})

    small_batches(docs.sparkSession)
    return dealt.mapInArrow(tidy(write, forget_words), "part long, file string, docs long, tokens long")


def read_token_files(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of the documents in the files, or of the wanted ones; start counts the ids before it.

    ``files`` is what ``write_token_files`` returned, as a stored table. One window over the files, no more.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["file"])
                with store.open_input_file(path) as source:
                    out: list[tuple] = []
                    held = 0
                    for doc in Reader(source, source.size()).documents(wanted):
                        out.append((doc[0], row["base"] + doc[1], doc[2]))
                        held += len(doc[2])
                        if held > 8 * FRAME_BYTES or len(out) >= 5000:
                            yield _batch(out)
                            out, held = [], 0
                    if out:
                        yield _batch(out)

    # a count of partitions, so that adaptive execution does not merge the short rows into one task
    dealt = placed.select("file", "base").repartition(max(1, files.count()), "file")
    return dealt.mapInArrow(
        read, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(content, pa.binary())],
        names=["doc_id", "start", "ids"])


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write token files to the shared folder, read them back, and digest each document's ids."""
    scratch = Scratch(spark, "token-files")
    files = scratch.write(write_token_files(docs, f"{scratch.root}/files", tokenizer, end_id), "manifest")
    return read_token_files(files).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(pack(ids))
