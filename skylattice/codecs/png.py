"""PNG bytes of 8-bit images, with zlib and NumPy alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from skylattice.errors import HipsError

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels by colour type.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode(pixels: np.ndarray) -> bytes:
    """Gray (h, w) or colour (h, w, 3 or 4) bytes."""
    x = np.asarray(pixels, np.uint8)
    x = x[..., None] if x.ndim == 2 else x
    height, width, channels = x.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), x.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) of an 8-bit gray, gray-alpha, RGB or RGBA image that isn't interlaced."""
    if data[:8] != _SIGNATURE:
        raise HipsError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise HipsError("this kind of PNG is not read")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * n + 1)
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].reshape(width, n).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line, axis=0)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        above = line & 255
        out[y] = above
    return out
