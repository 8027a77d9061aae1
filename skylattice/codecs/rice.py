"""Rice coding of integer tiles (FITS tiled-image convention)."""

from __future__ import annotations

import numpy as np

from skylattice.errors import DecompressionError

# Fixed values, by bytes of a pixel: bits of a block's code number, and the number that means "stored as they are".
_PARAMETERS = {1: (3, 6), 2: (4, 14), 4: (5, 25)}
_TYPES = {1: np.uint8, 2: np.int16, 4: np.int32}


def decode(data: bytes, count: int, blocksize: int = 32, bytepix: int = 4) -> np.ndarray:
    """``count`` pixels: the first is stored whole, then zigzag differences in blocks of one code each.

    The stream is taken as an array of bits. The position of each next set bit is known in
    advance, so a pixel costs one step; the low bits of all pixels are then gathered at once.
    """
    if bytepix not in _PARAMETERS:
        raise DecompressionError(f"Rice with {bytepix} bytes a pixel")
    code_bits, stored = _PARAMETERS[bytepix]
    if len(data) < bytepix:
        raise DecompressionError("Rice stream ends early")
    first = int.from_bytes(data[:bytepix], "big")
    raw = np.frombuffer(data[bytepix:] + bytes(8), np.uint8)
    bits = np.unpackbits(raw)
    end = len(bits)
    next_one = np.minimum.accumulate(np.where(bits == 1, np.arange(end), end)[::-1])[::-1].tolist()
    words = np.zeros(len(raw) - 7, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | raw[i : i + len(words)].astype(np.uint64)

    def field(at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The numbers in ``width`` bits from the bit positions ``at``; widths of up to 32."""
        shift = 64 - (at & 7) - width
        return (words[at >> 3] >> shift.astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))

    high = np.zeros(count, np.uint64)
    low_at, low_bits = np.zeros(count, np.int64), np.zeros(count, np.int64)
    at = done = 0
    while done < count:
        n = min(blocksize, count - done)
        if at + code_bits > end - 64 + 8 * 8:
            raise DecompressionError("Rice stream ends early")
        code = int(field(np.array([at]), np.array([code_bits]))[0]) - 1
        at += code_bits
        if code == stored:
            width = 8 * bytepix
            low_at[done : done + n] = at + width * np.arange(n)
            low_bits[done : done + n] = width
            at += n * width
        elif code >= 0:
            starts, ones, step = [], [], 1 + code
            for _ in range(n):
                one = next_one[at] if at < end else end
                if one >= end:
                    raise DecompressionError("Rice stream ends early")
                starts.append(one - at)
                ones.append(one + 1)
                at = one + step
            high[done : done + n] = np.array(starts, np.uint64) << np.uint64(code)
            low_at[done : done + n] = ones
            low_bits[done : done + n] = code
        if at > end - 64 + 7 + 64:
            raise DecompressionError("Rice stream ends early")
        done += n
    if count and int((low_at + low_bits).max(initial=0)) > 8 * (len(raw) - 8):
        raise DecompressionError("Rice stream ends early")
    mapped = (high | field(np.minimum(low_at, 8 * (len(words) - 1)), low_bits)).astype(np.int64)
    steps = np.where(mapped & 1, ~(mapped >> 1), mapped >> 1)
    total = (first + np.cumsum(steps)) & ((1 << 8 * bytepix) - 1)
    return total.astype(np.uint64).astype({1: np.uint8, 2: np.uint16, 4: np.uint32}[bytepix]).view(_TYPES[bytepix])


def encode(pixels: np.ndarray, blocksize: int = 32, bytepix: int = 4) -> bytes:
    """Rice-code pixels; each block takes the code that makes it shortest."""
    code_bits, stored = _PARAMETERS[bytepix]
    width = 8 * bytepix
    x = np.asarray(pixels).astype(np.int64) & ((1 << width) - 1)
    if not len(x):
        return b""
    steps = np.diff(x, prepend=x[:1])
    half = 1 << (width - 1)
    steps = ((steps + half) & ((1 << width) - 1)) - half  # the shortest way round
    mapped = np.where(steps < 0, -2 * steps - 1, 2 * steps)
    out = [format(int(x[0]), f"0{width}b")]
    for i in range(0, len(mapped), blocksize):
        block = mapped[i : i + blocksize]
        if not block.any():
            out.append("0" * code_bits)
            continue
        sizes = [int((block >> k).sum()) + len(block) * (1 + k) for k in range(stored)]
        k = int(np.argmin(sizes))
        if sizes[k] >= width * len(block):
            out.append(format(stored + 1, f"0{code_bits}b"))
            out.extend(format(int(v), f"0{width}b") for v in block)
        else:
            out.append(format(k + 1, f"0{code_bits}b"))
            for v in block.tolist():
                out.append("0" * (v >> k) + "1" + (format(v & (1 << k) - 1, f"0{k}b") if k else ""))
    text = "".join(out)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
