"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``n + quadratic * n * n``: linear layers and attention, which stays inside a piece. In a
block of about ``block_tokens`` tokens there are as many sequences as the tokens need. Every full ``length`` tokens of
a document fill a sequence alone. What is left of the documents is taken by descending cost, and goes to the sequence
of lowest cost among those with room for it; where none has room for all of it, the one of lowest cost with any room
takes what fits and the rest goes on. So a block wastes less than one sequence.

Blocks are made inside the partitions of the input, in their order: no shuffle, and memory follows the block or the
longest document. The number of a sequence holds the partition's number in its upper bits, so a task that runs again
gives the same rows.

Nulls: a null text has only the end id; a null doc_id is kept. Ties in cost go to the earlier document and the earlier
sequence. Repeated rows are packed each for itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import tokens
from tessera.llm.common import blocks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(sizes: list[int], length: int, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, tokens, sequence, offset) and the number of sequences."""
    pieces, used = [], 0
    rest = []
    for k, size in enumerate(sizes):
        full = size // length
        for i in range(full):
            pieces.append((k, i * length, length, used, 0))
            used += 1
        if size % length:
            rest.append((-(size % length), k, full * length))
    rest.sort()
    total = -sum(n for n, _, _ in rest)
    count = -(-total // length)
    room, cost = np.full(count, length), np.zeros(count)
    for n, k, start in rest:
        left = -n
        while left:
            fits = room >= left
            s = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            n_here = min(left, int(room[s]))
            pieces.append((k, start, n_here, used + s, length - int(room[s])))
            room[s] -= n_here
            cost[s] += n_here + quadratic * n_here * n_here
            left, start = left - n_here, start + n_here
    return pieces, used + count


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    length: int = 2048,
    quadratic: float = 1 / 4096,
    block_tokens: int = 1 << 19,
) -> DataFrame:
    """One row per piece; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        end = np.array([end_id], encode.dtype)
        first = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            pieces, count = pack([len(ids) for _, ids in held], length, quadratic)
            rows = []
            for k, start, n, sequence, offset in pieces:
                doc_id, ids = held[k]
                crc = zlib.crc32(ids[start : start + n].astype("<u4"))
                rows.append((doc_id, start, n, crc, len(ids), first + sequence, offset))
            first += count
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch, texts in blocks(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                held.append((doc_id, np.concatenate([encode(text or b""), end])))
                size += len(held[-1][1])
                if size >= block_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokens.default_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.default_path())
