"""Token ids in seekable Zstandard files.

A file is a row of independent Zstandard frames, one per document in ascending doc_id order, whose content is the
document's ids as little-endian integers of ``width`` bytes. Two skippable frames follow. The first holds the
doc_ids: ``TSID``, the width (1 byte), the number of documents (8 bytes) and a Zstandard frame of 64-bit integers.
The last is the seek table of the public seekable format: for each frame its compressed size, its size and a checksum
(the lower half of the content's XXH64), each 4 bytes, then the number of frames, a descriptor and the magic number.
A reader takes the end of the file first and then decompresses the frames of the documents asked for, no others.

Nulls: a null text has only the end id; a null doc_id sorts first and is stored as the least 64-bit integer. Rows with
equal doc_id follow each other in the order of their frames' bytes. An empty table writes no file. Columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import files, tokens
from tessera.llm.common import blocks, scratch

SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(2**63)
#: Rows that a reader returns at a time, and bytes that it reads at a time.
ROWS, READ = 4096, 8 << 20


class Writer:
    """Frames one after the other; only their sizes, checksums and ids are kept until the end."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.ids, self.entries = sink, width, [], []

    def add(self, doc_id: int | None, frame: bytes, size: int, checksum: int) -> None:
        self.sink.write(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.entries.append((len(frame), size, checksum))

    def close(self) -> None:
        ids = zstandard.compress(np.array(self.ids, "<i8").tobytes())
        head = b"TSID" + struct.pack("<BQ", self.width, len(self.ids))
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(head) + len(ids)) + head + ids)
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        foot = struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + len(foot)) + table + foot)
        self.sink.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        system, inside = files.opened(path)
        self.source = system.open_input_file(inside)
        end = self.source.size()
        count, descriptor, magic = struct.unpack("<IBI", self.source.read_at(9, end - 9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        at = end - 9 - 12 * count
        table = np.frombuffer(self.source.read_at(12 * count, at), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.checksums = table[:, 1], table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        extra = self.source.read_at(at - 8 - int(self.offsets[-1]), int(self.offsets[-1]))
        self.width, held = struct.unpack("<BQ", extra[12:21])
        self.doc_ids = np.frombuffer(zstandard.decompress(extra[21:]), "<i8")
        if extra[8:12] != b"TSID" or not len(self.doc_ids) == held == count:
            raise ValueError(f"{path} has no list of doc_ids")
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def tokens(self, k: int) -> int:
        return int(self.sizes[k]) // self.width

    def _decoded(self, k: int, frame: bytes) -> np.ndarray:
        data = self.unpack.decompress(frame, max_output_size=int(self.sizes[k]))
        if len(data) != self.sizes[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(data, f"<u{self.width}")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; one frame is read and decompressed."""
        a, b = map(int, self.offsets[k : k + 2])
        return self._decoded(k, self.source.read_at(b - a, a))

    def find(self, doc_id: int) -> range:
        """The places of a doc_id."""
        return range(*(int(np.searchsorted(self.doc_ids, doc_id, side)) for side in ("left", "right")))

    def all(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, read in large pieces."""
        k = 0
        while k < len(self):
            last = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + READ)) - 1)
            a = int(self.offsets[k])
            data = memoryview(self.source.read_at(int(self.offsets[last]) - a, a))
            for k in range(k, last):
                yield k, self._decoded(k, data[int(self.offsets[k]) - a : int(self.offsets[k + 1]) - a])
            k = last


def frames(docs: DataFrame, tokenizer: str, end_id: int, bounds: np.ndarray, level: int = 3) -> DataFrame:
    """file, doc_id, frame, size, checksum of every document; ``bounds``: the first doc_id of each file but the first."""
    # eight bytes for each file; a file has thousands of documents
    first = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        for batch, texts in blocks(batches, "text", 4 << 20):
            content = [encode(t or b"").tobytes() + end for t in texts]
            doc_ids = batch.column("doc_id")
            file = np.searchsorted(first.value, pc.fill_null(doc_ids, NO_ID).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file, pa.int32()),
                    doc_ids,
                    pa.array([pack.compress(x) for x in content], pa.binary()),
                    pa.array([len(x) for x in content], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in content], pa.int64()),
                ],
                ["file", "doc_id", "frame", "size", "checksum"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), "text")
    return chosen.mapInArrow(run, "file int, doc_id long, frame binary, size long, checksum long")


def file_bounds(docs: DataFrame, rows_per_file: int) -> np.ndarray:
    """The least doc_id of each file but the first. Only the doc_id column is read and dealt out by range; the driver gets
    one number for each file."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"))
    count = -(-ids.count() // rows_per_file)
    if count < 2:
        return np.zeros(0, np.int64)
    parts = ids.repartitionByRange(count, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"))
    return np.array(sorted(r.first for r in parts.select("first").collect())[1:], np.int64)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, rows_per_file: int = 16384) -> list[tuple]:
    """Writes the files and returns (path, documents, tokens) of each, in doc_id order.

    The bounds of the files come from the doc_id column, read alone; only compressed frames are shuffled, and the file
    of a frame is looked up in the sorted bounds."""
    width = tokens.encoder(tokenizer).dtype.itemsize
    bounds = file_bounds(docs, rows_per_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = path = None
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                path = files.attempt(folder, f"tokens-{batch.column('file')[0].as_py():06d}", ".zst")
                system, inside = files.opened(path)
                writer = Writer(system.open_output_stream(inside, compression=None), width)
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "frame", "size", "checksum"))
            for doc_id, frame, size, checksum in zip(*columns, strict=True):
                writer.add(doc_id, frame, size, checksum)
                total += size // width
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "docs": [len(writer.ids)], "tokens": [total]})

    dealt = (
        frames(docs, tokenizer, end_id, bounds)
        .repartitionById(len(bounds) + 1, "file")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame")
    )
    # one row per file; it holds no id and no token
    done = dealt.mapInArrow(run, "path string, docs long, tokens long").collect()
    return sorted(map(tuple, done), key=lambda x: x[0].rsplit("/", 1)[1])


def read(spark: SparkSession, written: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    starts, total = [], 0
    for path, _, n in written:
        starts.append((path, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows = Reader(path), []
                for k, ids in reader.all():
                    doc_id = int(reader.doc_ids[k])
                    rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    start += len(ids)
                    if len(rows) == ROWS or k == len(reader) - 1:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        rows = []

    listed = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(spark, write(docs, scratch(spark, "tokens"), tokens.default_path()))
