"""SER bytes: planetary video sequences. Header, frames, timestamps, colour filter arrays and a writer."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from skylattice.errors import SerParseError, SerValidationError

HEADER = 178
TICKS_AT_EPOCH = 621_355_968_000_000_000  # 100 ns steps from year 1 to 1970
_LAYOUT = struct.Struct("<14s7i40s40s40sQQ")

# Colour ids.
COLORS = {
    0: "MONO", 8: "BAYER_RGGB", 9: "BAYER_GRBG", 10: "BAYER_GBRG", 11: "BAYER_BGGR", 16: "BAYER_CYYM", 17: "BAYER_YCMY",
    18: "BAYER_YMCY", 19: "BAYER_MYYC", 100: "RGB", 101: "BGR",
}


@dataclass
class SerHeader:
    file_id: str
    lu_id: int
    color_id: int
    little_endian_flag: int
    width: int
    height: int
    pixel_depth: int
    frame_count: int
    observer: str = ""
    instrument: str = ""
    telescope: str = ""
    start_ticks: int = 0
    start_utc_ticks: int = 0
    byte_order: str = "little"
    warnings: list[tuple[str, str]] = field(default_factory=list)

    @property
    def channels(self) -> int:
        return 3 if self.color_id >= 100 else 1

    @property
    def sample_bytes(self) -> int:
        return 1 if self.pixel_depth <= 8 else 2

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * self.channels * self.sample_bytes


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def relaxed_frames(declared: int, payload: int, frame: int) -> int:
    """Frames of a file that is shorter than its header says."""
    if frame <= 0:
        return 0
    return max(0, min(declared, max(payload // (frame + 8), 1), payload // frame))


def endianness_score(samples: np.ndarray) -> tuple[int, float, float]:
    """(distinct low bytes, share of values that aren't multiples of 256, mean step): of the right order more, more and smaller."""
    s = samples[:4096].astype(np.int64)
    if not len(s):
        return 0, 0.0, 0.0
    return int(np.count_nonzero(np.bincount(s & 255))), float(np.mean(s % 256 != 0)), float(np.abs(np.diff(s)).mean()) if len(s) > 1 else 0.0


def byte_order(flag: int, policy: str, sample: bytes = b"") -> str:
    """Sample order by policy: ``compat`` takes flag 0 as little, ``spec`` as big, ``auto`` looks at samples."""
    if policy == "compat":
        return "little" if flag == 0 else "big"
    if policy == "spec":
        return "little" if flag != 0 else "big"
    if policy != "auto":
        raise SerValidationError(f"endianness policy {policy!r}")
    raw = sample[: len(sample) // 2 * 2]
    little, big = (endianness_score(np.frombuffer(raw, f)) for f in ("<u2", ">u2"))
    votes = (little[0] > big[0]) - (little[0] < big[0]) + (little[1] > big[1]) - (little[1] < big[1]) + (little[2] < big[2]) - (little[2] > big[2])
    return "little" if votes > 0 or votes == 0 and flag == 0 else "big"


@dataclass
class SerFile:
    header: SerHeader
    frames: int
    timestamps: list[int]

    def offset(self, i: int) -> int:
        return HEADER + i * self.header.frame_bytes


def parse(read: Callable[[int, int], bytes], size: int, strict: bool = True, policy: str = "compat") -> SerFile:
    """Read header and trailer only; frames stay where they are. Not strict: odd values become warnings."""
    raw = read(0, HEADER)
    if len(raw) < HEADER:
        raise SerParseError("SER header is too short")
    f = _LAYOUT.unpack(raw)
    h = SerHeader(_text(f[0]), *f[1:8], *(_text(x) for x in f[8:11]), f[11], f[12])

    def bad(code: str, message: str) -> None:
        if strict:
            raise SerValidationError(message)
        h.warnings.append((code, message))

    if h.file_id != "LUCAM-RECORDER":
        bad("FILE_ID", f"file id {h.file_id!r}")
    if h.color_id not in COLORS:
        bad("COLOR_ID", f"colour id {h.color_id}")
    if h.width <= 0 or h.height <= 0 or h.frame_count < 0:
        raise SerValidationError("bad size or frame count")
    if not 1 <= h.pixel_depth <= 16:
        raise SerValidationError(f"pixel depth {h.pixel_depth}")
    frames, payload = h.frame_count, size - HEADER
    if payload < frames * h.frame_bytes:
        bad("TRUNCATED", "file is shorter than its frames")
        frames = relaxed_frames(frames, payload, h.frame_bytes)
    stamps: list[int] = []
    left = payload - frames * h.frame_bytes
    if left >= 8 * frames > 0:
        stamps = list(struct.unpack(f"<{frames}Q", read(HEADER + frames * h.frame_bytes, 8 * frames)))
        if any(b < a for a, b in zip(stamps, stamps[1:], strict=False)):
            h.warnings.append(("TIMESTAMP_ORDER", "timestamps go back"))
    elif left:
        bad("TRAILER", f"{left} bytes after the frames")
    sample = read(HEADER, min(8192, h.frame_bytes)) if policy == "auto" and h.sample_bytes == 2 and frames else b""
    h.byte_order = byte_order(h.little_endian_flag, policy, sample) if h.sample_bytes == 2 else "little"
    return SerFile(h, frames, stamps)


def samples(raw: bytes, header: SerHeader) -> np.ndarray:
    """A frame's samples in file order."""
    if header.sample_bytes == 1:
        return np.frombuffer(raw, np.uint8)
    return np.frombuffer(raw, "<u2" if header.byte_order == "little" else ">u2").astype(np.uint16)


# The channels that each cell of the repeating 2 by 2 pattern measures.
_CELLS = {"R": "R", "G": "G", "B": "B", "C": "GB", "M": "RB", "Y": "RG"}


def to_rgb(values: np.ndarray, header: SerHeader) -> np.ndarray:
    """(height, width, 3): mono is repeated, BGR turned round, a filter array filled from the nearest cells that have a channel."""
    h, w = header.height, header.width
    kind = COLORS.get(header.color_id, "MONO")
    if header.channels == 3:
        x = values.reshape(h, w, 3)
        return x[..., ::-1] if kind == "BGR" else x
    x = values.reshape(h, w)
    if kind == "MONO":
        return np.repeat(x[..., None], 3, axis=2)
    pattern = kind.removeprefix("BAYER_")
    yy, xx = np.mgrid[0:h, 0:w]
    cell = (yy % 2) * 2 + xx % 2
    out = np.zeros((h, w, 3), x.dtype)
    for c, channel in enumerate("RGB"):
        has = np.array([channel in _CELLS[p] for p in pattern])[cell]
        done = has.copy()
        out[..., c][has] = x[has]
        for radius in range(1, 4):
            if done.all():
                break
            for dy in range(-radius, radius + 1):  # a growing square, row by row
                for dx in range(-radius, radius + 1):
                    ny, nx = yy + dy, xx + dx
                    inside = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w) & ~done
                    ys, xs = np.where(inside, ny, 0), np.where(inside, nx, 0)
                    take = inside & has[ys, xs]
                    out[..., c][take] = x[ys[take], xs[take]]
                    done |= take
    return out


def planar(values: np.ndarray, width: int, height: int, channels: int) -> np.ndarray:
    """Interleaved samples as (channels, height, width)."""
    return values.reshape(height, width, channels).transpose(2, 0, 1)


def write(frames: list[bytes], width: int, height: int, pixel_depth: int, color_id: int = 0, timestamps: list[int] | None = None, observer: str = "", instrument: str = "", telescope: str = "", start_ticks: int = 0, start_utc_ticks: int = 0, lu_id: int = 0, little_endian_flag: int = 0, strict: bool = True) -> bytes:
    """A file of frames; without ``strict``, frames of a wrong size are cut or filled with zeros."""
    size = width * height * (3 if color_id >= 100 else 1) * (1 if pixel_depth <= 8 else 2)
    if strict and any(len(x) != size for x in frames):
        raise SerValidationError(f"a frame has {size} bytes")
    if timestamps is not None and len(timestamps) != len(frames):
        raise SerValidationError("a timestamp per frame")
    text = lambda s, n: s.encode()[:n].ljust(n, b"\0")
    head = _LAYOUT.pack(
        b"LUCAM-RECORDER", lu_id, color_id, little_endian_flag, width, height, pixel_depth, len(frames),
        text(observer, 40), text(instrument, 40), text(telescope, 40), start_ticks, start_utc_ticks,
    )
    body = b"".join(x[:size].ljust(size, b"\0") for x in frames)
    return head + body + (struct.pack(f"<{len(timestamps)}Q", *timestamps) if timestamps is not None else b"")
