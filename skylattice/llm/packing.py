"""Packing: documents' token ids into sequences of bounded length, balanced by attention cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.shared import small_batches
from skylattice.llm.tokens import Encoder, default_path

#: Token ids that a task holds before it packs them; packing needs no rows of other tasks.
BLOCK_TOKENS = 4_000_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, cost double"
)


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[list[tuple[int, int, int]]]:
    """Deal documents out to sequences; returns sequences of (document, start, length).

    A piece of n tokens costs ``linear * n + quadratic * n**2``: attention stays within a piece.
    Parts of ``capacity`` tokens are sequences of their own. What is left of each document is
    taken in descending order and goes to the sequence of least cost that has room; what does
    not fit there goes on to the next. All sequences are open from the start, just as many as
    the tokens fill. The tokens that are then short of a full sequence are cut out as sequences
    whose lengths are powers of two, which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        full = n // capacity * capacity
        out.extend([(i, at, capacity)] for at in range(0, full, capacity))
        if n > full:
            rest.append((n - full, i))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tail = sum(n for n, _ in rest) % capacity
    room = [capacity] * (sum(n for n, _ in rest) // capacity)
    room += [1 << b for b in range(tail.bit_length()) if tail >> b & 1]
    bins: list[list[tuple[int, int, int]]] = [[] for _ in room]
    heap = [(0.0, -r, k) for k, r in enumerate(room)]
    heapq.heapify(heap)
    for n, i in rest:
        at = lengths[i] - n
        while n:
            cost, _, k = heap[0]
            take = min(n, room[k])
            bins[k].append((i, at, take))
            room[k] -= take
            at, n = at + take, n - take
            if room[k]:
                heapq.heapreplace(heap, (cost + linear * take + quadratic * take * take, -room[k], k))
            else:
                heapq.heappop(heap)
    return out + bins


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    path: str | None = None,
    end_id: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens; one row per piece.

    A document's tokens are its text's ids and then ``end_id`` (a null or empty text: that id
    alone). Columns: doc_id, start (tokens of the document before the piece), length,
    ids_crc32 (CRC-32 of the piece's ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset (the piece's place in its sequence) and cost (of the whole sequence).
    Each task packs blocks of about ``block_tokens`` tokens of its own rows, so nothing is
    shuffled and memory is bounded; a longer document is a block of its own. A sequence's id is
    the task's partition in the upper bits and a count in the lower 36. Repeated rows are packed
    as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        at = TaskContext.get().partitionId() << 36
        keys: list[int] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal at
            rows: list[tuple] = []
            for pieces in assign([len(x) // 4 for x in ids], capacity):
                cost = float(sum(n + n * n / 1024 for _, _, n in pieces))
                offset = 0
                for i, start, n in pieces:
                    crc = zlib.crc32(memoryview(ids[i])[4 * start : 4 * (start + n)])
                    rows.append((keys[i], start, n, crc, len(ids[i]) // 4, at, offset, cost))
                    offset += n
                at += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.float64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= block_tokens:
                    yield flush()
                    keys, ids, held = [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
