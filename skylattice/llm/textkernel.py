"""Vectorised text kernels over Arrow string columns.

Words and lines are found on the UTF-8 bytes of a whole block of texts with NumPy, so no Python
string is built per word. A short span's hash takes its bytes eight at a time, one scrambling
round each, for all spans of the block at once; a span of more than ``LONG`` bytes is hashed by
BLAKE2b. Hashes depend on the span's bytes alone; A-Z count as a-z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
#: Bytes of a span beyond which it is hashed by BLAKE2b.
LONG = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(_BASE)
    x = x ^ (x >> _U(29))
    x = x * _U(_GOLDEN)
    return x ^ (x >> _U(32))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    return table


_LOWER = _lower_table()
#: Masks that keep the first 0 to 8 bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def byte_class(separators: bytes) -> np.ndarray:
    """A 256-entry table, true for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


@dataclass
class Block:
    """Some rows' texts: ``data`` holds their bytes, row i at ``offsets[i]:offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of member bytes, and each row's first run.

        Runs end at row borders. Row i's runs are ``first[i]:first[i + 1]``.
        """
        n = len(self.data)
        inside = member[self.data]
        border = np.zeros(n + 1, bool)
        border[self.offsets] = True
        begins, finishes = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | border[1:n]
            finishes[:-1] &= ~inside[1:] | border[1:n]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(finishes) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans. Spans of up to seven bytes never collide with each other, nor do those of eight."""
        lower = np.zeros(len(self.data) + 8, np.uint8)
        lower[: len(self.data)] = _LOWER[self.data]
        eight = np.ndarray(len(self.data) + 1, "<u8", lower, strides=(1,))
        size = ends - starts
        out = eight[starts] & _FIRST[np.minimum(size, 8)]
        # a short span's length fills its free top byte, so that zero bytes at its end count
        out = mix(np.where(size < 8, out | (size.astype(np.uint64) << _U(56)), out ^ _U(_GOLDEN)))
        more = np.flatnonzero(size > 8)
        at = 8
        while len(more):
            long = size[more]
            if at >= LONG:
                for i in more[long > LONG].tolist():
                    digest = hashlib.blake2b(lower[starts[i] : ends[i]].tobytes(), digest_size=8, person=b"span").digest()
                    out[i] = int.from_bytes(digest, "little")
                break
            part = eight[starts[more] + at] & _FIRST[np.minimum(long - at, 8)]
            # a round for each eight bytes; the length tells spans apart that end in zero bytes
            out[more] = mix((out[more] ^ (out[more] << _U(23))) + (part ^ _U(at * _GOLDEN % (1 << 64))) + long.astype(np.uint64))
            at += 8
            more = more[long > at]
        return out

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the spans' 128-bit BLAKE2b digests."""
        lower = _LOWER[self.data].tobytes()
        raw = b"".join([hashlib.blake2b(lower[a:z], digest_size=16).digest() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
        both = np.frombuffer(raw, "<u8").reshape(-1, 2) if raw else np.zeros((0, 2), np.uint64)
        return both[:, 0].copy(), both[:, 1].copy()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``limit`` bytes; a longer text is a block of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes (those over row borders included)."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, (seed * _GOLDEN) % (1 << 64), np.uint64)
    for i in range(n):
        out = out * _U(_BASE) + words[i : i + count]
        out ^= out >> _U(31)
    return mix(out)


def row_index(first: np.ndarray) -> np.ndarray:
    """For each run, the row it lies in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
