"""PLIO line lists: run-length instructions in 16-bit words, for masks of non-negative integers."""

from __future__ import annotations

import numpy as np

from skylattice.errors import DecompressionError


def decode(words: np.ndarray | bytes, count: int) -> np.ndarray:
    """``count`` pixels of a line list, as runs of (value, length) that are repeated at once.

    Instructions (upper four bits of a word): 0 a run of zeros, 4 a run of the current value,
    5 zeros that end in one pixel of the value, 1 set the value (with the next word's upper part),
    2 and 3 raise or lower it, 6 and 7 do that and give one pixel.
    """
    if isinstance(words, bytes | bytearray | memoryview):
        if len(words) % 2:
            raise DecompressionError("a PLIO list has 16-bit words")
        words = np.frombuffer(words, ">i2")
    w = [int(x) for x in words]
    if len(w) < 3:
        return np.zeros(count, np.int32)
    if w[2] > 0:
        length, first = w[2], 3
    else:
        if len(w) < 5:
            raise DecompressionError("a PLIO list without a length")
        length, first = (w[4] << 15) + (w[3] & 0x7FFF), w[1]
    values, lengths = [], []
    value, done, at = 1, 0, first
    stop = min(length, len(w))
    while at < stop and done < count:
        op, n = w[at] >> 12 & 15, w[at] & 4095
        at += 1
        if op == 1:
            value = ((w[at] if at < len(w) else 0) << 12) + n
            at += 1
        elif op in (2, 3):
            value += n if op == 2 else -n
        elif op in (6, 7):
            value += n if op == 6 else -n
            values.append(value)
            lengths.append(1)
            done += 1
        elif op in (0, 4, 5):
            fits = min(n, count - done)
            ends = op == 5 and fits == n and n > 0
            values += [value if op == 4 else 0] + ([value] if ends else [])
            lengths += [fits - ends] + ([1] if ends else [])
            done += fits
    out = np.repeat(np.array(values, np.int64), lengths)[:count]
    return np.concatenate([out, np.zeros(count - len(out), np.int64)]).astype(np.int32)


def encode(pixels: np.ndarray) -> np.ndarray:
    """A line list of non-negative pixels below 2**27, as 16-bit words."""
    x = np.asarray(pixels, np.int64)
    words: list[int] = []
    value = 1
    cuts = np.flatnonzero(np.diff(x)) + 1
    for run in np.split(x, cuts) if len(x) else []:
        v, n = int(run[0]), len(run)
        if v and v != value:
            step = v - value
            if abs(step) < 4096:
                words.append((2 if step > 0 else 3) << 12 | abs(step))
            else:
                words += [1 << 12 | v & 4095, v >> 12]
            value = v
        while n:
            part = min(n, 4095)
            words.append((4 if v else 0) << 12 | part)
            n -= part
    total = len(words) + 7
    return np.array([0, 7, -100, total & 0x7FFF, total >> 15, 0, 0, *words], np.int64).astype(np.int16)
