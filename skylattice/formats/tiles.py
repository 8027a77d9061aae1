"""Tiled compressed images: tile layout, decoding by codec, dithering, and a writer."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from skylattice.codecs import hcompress, plio, rice
from skylattice.errors import DecompressionError, FitsDataError
from skylattice.formats import fits

# Fixed values of the convention.
NULL_VALUE, ZERO_VALUE = -2147483647, -2147483646
RANDOMS = 10_000

#: Tile decoders that users have registered: name -> function(bytes, pixels, header) -> integers.
_DECODERS: dict[str, Callable[[bytes, int, fits.Header], np.ndarray]] = {}


def register_tile_decoder(name: str, decode: Callable[[bytes, int, fits.Header], np.ndarray] | None) -> None:
    """Make a decoder for a ZCMPTYPE known in this process, or forget it (None)."""
    if decode is None:
        _DECODERS.pop(name, None)
    else:
        _DECODERS[name] = decode


@lru_cache(maxsize=1)
def dither_sequence() -> np.ndarray:
    """The convention's random numbers: seeds are multiplied by 16807 modulo 2**31 - 1."""
    seed, out = 1, np.empty(RANDOMS, np.float32)
    for i in range(RANDOMS):
        seed = seed * 16807 % 2147483647
        out[i] = seed / 2147483647
    return out


def dither_values(tile: int, dither0: int, count: int) -> np.ndarray:
    """The random number of each pixel of a tile (numbered from 1): runs of the sequence, each begun where its seed says."""
    randoms = dither_sequence()
    seed, parts, have = (tile + dither0 - 2) % RANDOMS, [], 0
    while have < count:
        start = int(randoms[seed] * 500)
        parts.append(randoms[start : start + count - have])
        have += len(parts[-1])
        seed = (seed + 1) % RANDOMS
    return np.concatenate(parts) if parts else randoms[:0]


def dequantize(values: np.ndarray, scale: float, zero: float, method: str = "NO_DITHER", tile: int = 1, dither0: int = 1) -> np.ndarray:
    """Stored integers as float32: NULL_VALUE is NaN, ZERO_VALUE is 0, others are scaled, with dithering undone."""
    v = np.asarray(values, np.float64)
    if method.startswith("SUBTRACTIVE_DITHER"):
        out = (v - dither_values(tile, dither0, len(v)).astype(np.float64) + 0.5) * scale + zero
    else:
        out = v * scale + zero
    out[np.asarray(values) == NULL_VALUE] = np.nan
    out[np.asarray(values) == ZERO_VALUE] = 0
    return out.astype(np.float32)


def layout(width: int, height: int, tile_width: int, tile_height: int) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the tiles in row order; those at the edges are cut."""
    return [
        (x, y, min(tile_width, width - x), min(tile_height, height - y))
        for y in range(0, height, max(tile_height, 1))
        for x in range(0, width, max(tile_width, 1))
    ]


def parameters(header: fits.Header) -> dict[str, object]:
    out, i = {}, 1
    while f"ZNAME{i}" in header:
        out[str(header.get(f"ZNAME{i}")).strip()] = header.get(f"ZVAL{i}")
        i += 1
    return out


def decode_tile(data: bytes, count: int, header: fits.Header, shape: tuple[int, int] | None = None) -> np.ndarray:
    """The stored numbers of one tile."""
    name = header.string("ZCMPTYPE").strip()
    options, bitpix = parameters(header), int(header.number("ZBITPIX"))
    if name == "RICE_1":
        return rice.decode(data, count, int(options.get("BLOCKSIZE", 32)), int(options.get("BYTEPIX", 4)))
    if name in ("GZIP_1", "GZIP_2"):
        raw = gzip.decompress(data)
        size = abs(bitpix) // 8
        if bitpix < 0 and len(raw) >= 4 * count and len(raw) != size * count:
            size, bitpix = 4, 32  # quantised numbers
        if len(raw) < size * count:
            raise DecompressionError("GZIP tile is too short")
        if name == "GZIP_2":
            raw = np.frombuffer(raw, np.uint8, size * count).reshape(size, -1).T.tobytes()
        return fits.decode_pixels(raw[: size * count], bitpix)
    if name == "PLIO_1":
        return plio.decode(data, count)
    if name == "HCOMPRESS_1":
        out = hcompress.decode(data, bool(options.get("SMOOTH", 0))).ravel()
        if len(out) < count:
            raise DecompressionError("HCOMPRESS tile is too short")
        return out[:count]
    if name in _DECODERS:
        return np.asarray(_DECODERS[name](data, count, header))
    raise DecompressionError(f"ZCMPTYPE {name!r}")


def decode_image(data: bytes, header: fits.Header) -> np.ndarray:
    """A tiled image as float32, height by width."""
    width, height = int(header.number("ZNAXIS1")), int(header.number("ZNAXIS2", 1))
    tile_w, tile_h = int(header.number("ZTILE1", width)), int(header.number("ZTILE2", 1))
    names = [c.name for c in fits.columns(header)]
    rows, heap = fits.split_table(data, header)
    at = {c.name: c for c in fits.columns(header)}

    def column(name: str):
        return fits.decode_column(rows, heap, at[name]) if name in names else None

    packed, plain, zipped = column("COMPRESSED_DATA"), column("UNCOMPRESSED_DATA"), column("GZIP_COMPRESSED_DATA")
    scales, zeros = column("ZSCALE"), column("ZZERO")
    method, dither0 = header.string("ZQUANTIZ", "NO_DITHER").strip(), int(header.number("ZDITHER0", 1))
    code = at["COMPRESSED_DATA"].code if "COMPRESSED_DATA" in at else "B"
    out = np.full((height, width), np.nan, np.float32)
    tiles = layout(width, height, tile_w, tile_h)
    if len(rows) < len(tiles):
        raise FitsDataError("a tile is missing")
    for i, (x, y, w, h) in enumerate(tiles):
        scale = (float(scales[i]) if scales is not None else header.number("ZSCALE", 0)) or header.number("BSCALE", 1)
        zero = (float(zeros[i]) if zeros is not None else header.number("ZZERO", 0)) or header.number("BZERO", 0)
        if packed is not None and len(packed[i]):
            raw = np.asarray(packed[i], ">i2" if code == "I" else np.uint8).tobytes()
            values = dequantize(decode_tile(raw, w * h, header), scale, zero, method, i + 1, dither0)
        elif plain is not None and len(plain[i]):
            values = np.asarray(plain[i], np.float32)
        elif zipped is not None and len(zipped[i]):
            bitpix = int(header.number("ZBITPIX"))
            values = fits.decode_pixels(gzip.decompress(bytes(zipped[i])), bitpix).astype(np.float32)
        else:
            continue
        out[y : y + h, x : x + w] = values.reshape(h, w)
    return out


def encode_tile(values: np.ndarray, name: str, bitpix: int, blocksize: int = 32) -> bytes:
    if name == "RICE_1":
        return rice.encode(values.ravel(), blocksize, abs(bitpix) // 8)
    if name == "GZIP_1":
        return gzip.compress(fits.encode_pixels(values.ravel(), bitpix), mtime=0)
    if name == "PLIO_1":
        return plio.encode(values.ravel()).astype(">i2").tobytes()
    if name == "HCOMPRESS_1":
        return hcompress.encode(values)
    raise DecompressionError(f"ZCMPTYPE {name!r}")


def image_hdu(image: np.ndarray, name: str, bitpix: int = 32, tile: tuple[int, int] | None = None) -> tuple[fits.Cards, bytes]:
    """A compressed-image unit of an integer image, a table row per tile (tile: width, height; a row of pixels unless given)."""
    height, width = image.shape
    tile_w, tile_h = tile or (width, 1)
    packed = [list(encode_tile(image[y : y + h, x : x + w], name, bitpix)) for x, y, w, h in layout(width, height, tile_w, tile_h)]
    extra: list = [("ZIMAGE", True), ("ZCMPTYPE", name), ("ZBITPIX", bitpix), ("ZNAXIS", 2), ("ZNAXIS1", width), ("ZNAXIS2", height), ("ZTILE1", tile_w), ("ZTILE2", tile_h)]
    if name == "RICE_1":
        extra += [("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", abs(bitpix) // 8)]
    return fits.table_hdu(["COMPRESSED_DATA"], ["1PB"], [packed], extra)
