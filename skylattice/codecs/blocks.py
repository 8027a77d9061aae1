"""Byte-block codecs: zlib, LZ4 blocks, Zstandard, byte shuffling, sub-blocks, base64, hex and checksums."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable

import numpy as np

from skylattice.errors import XisfChecksumError, XisfParseError, XisfValidationError

#: Codecs that users have registered by name: (compress, decompress with the size of the result).
_REGISTERED: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]]] = {}


def register_codec(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes, int], bytes]) -> None:
    """Make a codec known by name in this process; pass it inside functions that run on executors."""
    _REGISTERED[name] = compress, decompress


def lz4_decompress(data: bytes, size: int) -> bytes:
    """A raw LZ4 block of known size."""
    out = bytearray()
    at, end = 0, len(data)

    def more(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                if at >= end:
                    raise XisfParseError("LZ4 block ends early")
                byte = data[at]
                at += 1
                n += byte
                if byte != 255:
                    break
        return n

    while at < end:
        token = data[at]
        at += 1
        n = more(token >> 4)
        if at + n > end:
            raise XisfParseError("LZ4 block ends early")
        out += data[at : at + n]
        at += n
        if at >= end:
            break
        if at + 2 > end:
            raise XisfParseError("LZ4 block ends early")
        back = data[at] | data[at + 1] << 8
        at += 2
        n = more(token & 15) + 4
        if not 0 < back <= len(out):
            raise XisfParseError("LZ4 offset outside the block")
        start = len(out) - back
        chunk = bytes(out[start : start + n])
        out += (chunk * (n // len(chunk) + 1))[:n]
    if len(out) != size:
        raise XisfParseError(f"LZ4 block has {len(out)} bytes, not {size}")
    return bytes(out)


def _lz4_length(n: int) -> bytes:
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def lz4_compress(data: bytes) -> bytes:
    """A raw LZ4 block; matches of four bytes or more are found by their first four."""
    out = bytearray()
    seen: dict[bytes, int] = {}
    at = anchor = 0
    last = len(data) - 12  # the format wants literals at the end
    while at < last:
        key = data[at : at + 4]
        before = seen.get(key)
        seen[key] = at
        if before is None or at - before > 65535:
            at += 1
            continue
        n = 4
        while at + n < len(data) - 5 and data[before + n] == data[at + n]:
            n += 1
        literals = data[anchor:at]
        out.append(min(len(literals), 15) << 4 | min(n - 4, 15))
        out += _lz4_length(len(literals)) + literals + (at - before).to_bytes(2, "little") + _lz4_length(n - 4)
        at += n
        anchor = at
    literals = data[anchor:]
    out.append(min(len(literals), 15) << 4)
    return bytes(out + _lz4_length(len(literals)) + literals)


def shuffle(data: bytes, item: int) -> bytes:
    """Group the first bytes of all items, then the second ones, ...; bytes beyond whole items stay at the end."""
    whole = len(data) // item * item if item > 1 else 0
    return np.frombuffer(data, np.uint8, whole).reshape(-1, max(item, 1)).T.tobytes() + data[whole:] if whole else data


def unshuffle(data: bytes, item: int) -> bytes:
    whole = len(data) // item * item if item > 1 else 0
    return np.frombuffer(data, np.uint8, whole).reshape(item, -1).T.tobytes() + data[whole:] if whole else data


def compress(data: bytes, codec: str, level: int = 6) -> bytes:
    if codec in _REGISTERED:
        return _REGISTERED[codec][0](data)
    if codec == "zlib":
        return zlib.compress(data, level)
    if codec in ("lz4", "lz4hc"):
        return lz4_compress(data)
    if codec == "zstd":
        raise XisfValidationError("zstd is decoded only")
    raise XisfValidationError(f"codec {codec!r}")


def decompress(data: bytes, codec: str, size: int) -> bytes:
    if codec in _REGISTERED:
        out = _REGISTERED[codec][1](data, size)
    elif codec == "zlib":
        out = zlib.decompress(data)
    elif codec in ("lz4", "lz4hc"):
        out = lz4_decompress(data, size)
    elif codec == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    else:
        raise XisfValidationError(f"codec {codec!r}")
    if len(out) != size:
        raise XisfParseError(f"block has {len(out)} bytes, not {size}")
    return out


_SPEC = re.compile(r"(?P<codec>[a-z0-9-]+?)(?P<sh>\+sh)?:(?P<size>\d+)(?::(?P<item>\d+))?\Z")


def parse_compression(text: str) -> tuple[str, bool, int, int]:
    """(codec, shuffled, uncompressed size, item size) of ``zlib+sh:4096:2``."""
    m = _SPEC.match(text.strip().lower())
    if not m:
        raise XisfParseError(f"compression {text!r}")
    return m["codec"], bool(m["sh"]), int(m["size"]), int(m["item"] or 1)


def parse_subblocks(text: str) -> list[tuple[int, int]]:
    """(compressed, uncompressed) sizes of ``c,u:c,u``."""
    return [(int(a), int(b)) for a, b in (x.split(",") for x in text.split(":") if x)]


def encode_block(data: bytes, codec: str, item: int = 1, level: int = 6) -> tuple[bytes, str]:
    """(stored bytes, compression attribute): shuffled if items have several bytes."""
    mixed = item > 1
    stored = compress(shuffle(data, item) if mixed else data, codec, level)
    return stored, f"{codec}{'+sh' if mixed else ''}:{len(data)}" + (f":{item}" if mixed else "")


def decode_block(data: bytes, spec: str, subblocks: str | None = None) -> bytes:
    codec, mixed, size, item = parse_compression(spec)
    if subblocks:
        parts, at = [], 0
        for stored, full in parse_subblocks(subblocks):
            parts.append(decompress(data[at : at + stored], codec, full))
            at += stored
        out = b"".join(parts)
        if len(out) != size:
            raise XisfParseError(f"sub-blocks have {len(out)} bytes, not {size}")
    else:
        out = decompress(data, codec, size)
    return unshuffle(out, item) if mixed else out


# Checksum names of the format and of hashlib.
_SUMS = {"sha-1": "sha1", "sha1": "sha1", "sha-256": "sha256", "sha256": "sha256", "sha-512": "sha512", "sha512": "sha512", "sha3-256": "sha3_256", "sha3-512": "sha3_512"}


def checksum(data: bytes, algorithm: str) -> str:
    name = _SUMS.get(algorithm.strip().lower())
    if not name:
        raise XisfValidationError(f"checksum {algorithm!r}")
    return hashlib.new(name, data).hexdigest()


def verify_checksum(data: bytes, spec: str) -> None:
    algorithm, _, digest = spec.partition(":")
    if checksum(data, algorithm) != digest.strip().lower():
        raise XisfChecksumError(f"{algorithm} differs")


def from_base64(text: str) -> bytes:
    """Bytes of base64 in any dress: white space is skipped, the URL alphabet and missing padding are taken."""
    clean = re.sub(r"\s+", "", text).replace("-", "+").replace("_", "/").rstrip("=")
    if not re.fullmatch(r"[A-Za-z0-9+/]*", clean) or len(clean) % 4 == 1:
        raise XisfParseError("bad base64")
    return base64.b64decode(clean + "=" * (-len(clean) % 4))


def to_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def from_hex(text: str) -> bytes:
    clean = re.sub(r"\s+", "", text)
    try:
        return bytes.fromhex(clean)
    except ValueError as e:
        raise XisfParseError("bad hex") from e
