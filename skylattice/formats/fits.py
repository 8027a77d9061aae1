"""FITS bytes: header cards, HDUs, images and tables, read and written with NumPy. No Spark here."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from skylattice.errors import FitsDataError, FitsError, FitsHeaderError

BLOCK = 2880
CARD = 80
MAX_HEADER_LINES = 600

#: Keywords whose values are logical.
_LOGICAL = ("SIMPLE", "EXTEND", "GROUPS", "INHERIT", "ZIMAGE", "ZSIMPLE", "ZEXTEND", "ZTENSION")


def padding(n: int) -> int:
    """Bytes that fill ``n`` up to a whole block."""
    return -n % BLOCK


@dataclass(frozen=True)
class Card:
    index: int
    key: str
    raw: str  # the text between the value indicator and the comment
    kind: str  # string, integer, number, bool or undefined
    value: str | int | float | bool | None
    comment: str


@dataclass
class Header:
    """Cards by keyword (of repeated ones the last counts), comment and history lines."""

    cards: dict[str, Card] = field(default_factory=dict)
    comments: list[str] = field(default_factory=list)
    history: list[str] = field(default_factory=list)

    def get(self, key: str, default=None):
        card = self.cards.get(key)
        return default if card is None or card.value is None else card.value

    def __contains__(self, key: str) -> bool:
        return key in self.cards

    def ordered(self) -> list[Card]:
        return sorted(self.cards.values(), key=lambda c: c.index)

    def _typed(self, key: str, default, kinds: tuple[type, ...], name: str):
        value = self.get(key)
        if value is None:
            return default
        if isinstance(value, bool) and bool not in kinds or not isinstance(value, kinds):
            raise FitsHeaderError(f"{key} is not a {name}: {value!r}")
        return value

    def number(self, key: str, default: float = 0):
        return self._typed(key, default, (int, float), "number")

    def string(self, key: str, default: str = "") -> str:
        return self._typed(key, default, (str,), "string")

    def boolean(self, key: str, default: bool = False) -> bool:
        return self._typed(key, default, (bool,), "boolean")

    @property
    def axes(self) -> list[int]:
        return [int(self.number(f"NAXIS{i + 1}")) for i in range(int(self.number("NAXIS")))]

    @property
    def has_data(self) -> bool:
        return any(self.axes)

    @property
    def data_length(self) -> int:
        if not self.has_data:
            return 0
        return int(np.prod(self.axes, dtype=object)) * abs(int(self.number("BITPIX"))) // 8 + int(self.number("PCOUNT"))

    @property
    def kind(self) -> str:
        """What the data unit is: image, table, binary_table, compressed_image or other; none without data."""
        extension = str(self.get("XTENSION", "")).strip()
        if extension == "BINTABLE":
            return "compressed_image" if self.get("ZIMAGE") is True else "binary_table"
        if extension == "TABLE":
            return "table"
        if extension in ("", "IMAGE"):
            return "image" if self.has_data else "none"
        return "other"


_QUOTED = re.compile(r"\s*'((?:[^']|'')*)'\s*(?:/ ?(.*))?\Z", re.S)
_INTEGER = re.compile(r"[-+]?\d+\Z")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][-+]?\d+)?")


def parse_value(text: str) -> tuple[str, str, object, str]:
    """(raw, kind, value, comment) of what follows the value indicator."""
    quoted = _QUOTED.match(text)
    if quoted:
        return quoted[0].split("/")[0].strip() if quoted[2] is None else f"'{quoted[1]}'", "string", quoted[1].replace("''", "'").strip(), (quoted[2] or "").strip()
    raw, _, comment = text.partition(" /") if not text.startswith("/") else ("", "", text[1:])
    raw, comment = raw.strip(), comment.strip()
    if not raw:
        return raw, "undefined", None, comment
    if raw in ("T", "F"):
        return raw, "bool", raw == "T", comment
    if _INTEGER.match(raw):
        return raw, "integer", int(raw), comment
    number = _NUMBER.match(raw)
    return raw, "number", float(number[0].replace("D", "E").replace("d", "e")) if number else float("nan"), comment


def parse_header(block: str | bytes, max_lines: int = MAX_HEADER_LINES) -> Header:
    """Read cards of 80 characters up to END; lines beyond ``max_lines`` are left out."""
    text = block.decode("latin-1") if isinstance(block, bytes | bytearray | memoryview) else block
    out = Header()
    for i in range(min(max_lines, -(-len(text) // CARD))):
        line = text[CARD * i : CARD * (i + 1)]
        key = line[:8].strip()
        if key == "END" and not line[8:].strip():
            break
        if line[8:10] == "= ":
            out.cards[key] = Card(i, key, *parse_value(line[10:]))
        elif key == "COMMENT":
            out.comments.append(line[8:].rstrip())
        elif key == "HISTORY":
            out.history.append(line[8:].rstrip())
    return out


def split_index(key: str) -> tuple[str, int | None]:
    """The base of an indexed keyword and its number: NAXIS2 is (NAXIS, 2)."""
    m = re.search(r"(\D+)(\d+)", key)
    return (m[1], int(m[2])) if m else (key, None)


# -- verification

# What the standard allows for mandatory and reserved keywords.
_BITPIX = (8, 16, 32, 64, -32, -64)
_TILE_CODECS = ("GZIP_1", "RICE_1", "PLIO_1", "HCOMPRESS_1")
_NUMERIC = ("BSCALE", "BZERO", "DATAMIN", "DATAMAX", "ZDITHER0")
_COUNTED = ("EXTVER", "EXTLEVEL", "ZPCOUNT", "ZGCOUNT", "BLANK", "PCOUNT", "GCOUNT")


def verify(header: Header) -> list[tuple[str, str, str]]:
    """(level, code, keyword) of what a header does against the standard; level is error or warning."""
    out: list[tuple[str, str, str]] = []
    extension = str(header.get("XTENSION", "")).strip()
    tables = extension in ("TABLE", "BINTABLE")
    say = lambda bad, level, code, key: out.append((level, code, key)) if bad else None
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    for card in header.ordered():
        key, v = card.key, card.value
        base, number = split_index(key)
        if key in ("SIMPLE", "EXTEND", "ZSIMPLE", "ZIMAGE"):
            say(card.kind != "bool", "error", "TYPE", key)
            say(key == "SIMPLE" and card.index != 0, "warning", "ORDER", key)
            say(key == "EXTEND" and bool(extension), "warning", "PLACE", key)
        elif key == "XTENSION":
            say(card.index != 0, "warning", "ORDER", key)
        elif key in ("BITPIX", "ZBITPIX"):
            say(v not in _BITPIX, "error", "RANGE", key)
            say(key == "BITPIX" and card.index != 1, "warning", "ORDER", key)
        elif key in ("NAXIS", "ZNAXIS"):
            say(not whole(v) or not 0 <= v <= 999, "error", "RANGE", key)
            say(key == "NAXIS" and tables and v != 2, "error", "RANGE", key)
            say(key == "NAXIS" and card.index != 2, "warning", "ORDER", key)
        elif base in ("NAXIS", "ZNAXIS", "ZTILE") and number is not None:
            say(not whole(v) or v < 0, "error", "RANGE", key)
        elif key == "TFIELDS":
            say(not whole(v) or not 0 <= v <= 999, "error", "RANGE", key)
        elif base == "TBCOL" and number is not None:
            say(number > header.number("TFIELDS", 0), "error", "INDEX", key)
        elif key == "ZCMPTYPE":
            say(v not in _TILE_CODECS, "error", "RANGE", key)
        elif key in _NUMERIC:
            say(not isinstance(v, int | float) or isinstance(v, bool), "error", "TYPE", key)
        if key in _COUNTED:
            say(not whole(v), "error", "TYPE", key)
            say(key == "PCOUNT" and extension in ("IMAGE", "TABLE") and v != 0, "error", "RANGE", key)
            say(key == "GCOUNT" and v != 1, "error", "RANGE", key)
            say(key == "BLANK" and header.number("BITPIX", 8) <= 0, "warning", "PLACE", key)
    return out


# -- HDUs


@dataclass
class Hdu:
    index: int
    header: Header
    header_offset: int
    data_offset: int

    @property
    def data_length(self) -> int:
        return self.header.data_length


Read = Callable[[int, int], bytes]


def reader_of(data: bytes) -> Read:
    return lambda offset, length: data[offset : offset + length]


def scan(read: Read, size: int, max_lines: int = MAX_HEADER_LINES) -> Iterator[Hdu]:
    """Walk the HDUs, reading headers only. A header ends in the block whose last line is END; without one the walk stops."""
    offset = index = 0
    while offset < size:
        start, parts = offset, []
        while True:
            block = read(offset, BLOCK)
            if len(block) < CARD:
                return
            parts.append(block)
            offset += BLOCK
            text = block.decode("latin-1")
            lines = [text[i : i + CARD] for i in range(0, len(text), CARD)]
            last = next((x for x in reversed(lines) if x[:1].strip()), "")
            if last[:8].strip() == "END":
                break
            if offset >= size:
                return
        hdu = Hdu(index, parse_header(b"".join(parts), max_lines), start, offset)
        yield hdu
        offset += hdu.data_length + padding(hdu.data_length)
        index += 1


def hdus(data: bytes, max_lines: int = MAX_HEADER_LINES) -> list[Hdu]:
    return list(scan(reader_of(data), len(data), max_lines))


def data_of(data: bytes, hdu: Hdu) -> bytes:
    return data[hdu.data_offset : hdu.data_offset + hdu.data_length]


# -- writing

Value = str | int | float | bool | None


def format_value(value: Value) -> str:
    if isinstance(value, bool | np.bool_):
        return f"{'T' if value else 'F':>20}"
    if isinstance(value, str):
        return f"'{value.replace(chr(39), chr(39) * 2):<8}'"
    if value is None:
        return ""
    if isinstance(value, int | np.integer):
        return f"{value:>20}"
    if float(value).is_integer() and abs(value) < 1e15:
        return f"{int(value):>20}"
    return f"{float(value):>20.15E}"


def format_card(key: str, value: Value = None, comment: str = "") -> str:
    """A card of 80 characters; keywords in upper case and 8 characters, the end is cut off beyond 80."""
    key = key.upper()[:8]
    if key in ("COMMENT", "HISTORY", "END", ""):
        return f"{key:<8}{comment or value or ''}"[:CARD].ljust(CARD)
    text = f"{key:<8}= {format_value(value)}"
    return (f"{text} / {comment}" if comment else text)[:CARD].ljust(CARD)


Cards = Sequence[tuple[str, Value] | tuple[str, Value, str]]


def format_header(cards: Cards) -> bytes:
    text = "".join(format_card(*c) for c in cards) + "END".ljust(CARD)
    return text.encode("latin-1", "replace").ljust(len(text) + padding(len(text)))


def write(units: Sequence[tuple[Cards, bytes]]) -> bytes:
    """A file of (cards, data) units; headers are padded with blanks, data with zeros."""
    return b"".join(part for cards, data in units for part in (format_header(cards), data, bytes(padding(len(data)))))


def empty_primary(extra: Cards = ()) -> tuple[Cards, bytes]:
    return [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), *extra], b""


# -- images

_PIXEL = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def encode_pixels(values: np.ndarray, bitpix: int) -> bytes:
    """Big-endian samples; whole numbers wrap around at the type's width."""
    kind = np.dtype(_PIXEL[bitpix])
    values = np.asarray(values)
    if bitpix > 0:
        if values.dtype.kind == "f":
            values = np.trunc(np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0)).astype(np.int64)
        values = values.astype(np.int64) if values.dtype != np.uint64 else values
        return values.astype(kind.newbyteorder("=")).astype(kind).tobytes()
    return values.astype(kind).tobytes()


def image_hdu(values: np.ndarray, bitpix: int, extension: bool = False, bscale: float | None = None, bzero: float | None = None, name: str | None = None, extra: Cards = ()) -> tuple[Cards, bytes]:
    """An image unit of an array whose last axis is x."""
    shape = values.shape[::-1]
    cards: list = [("XTENSION", "IMAGE")] if extension else [("SIMPLE", True)]
    cards += [("BITPIX", bitpix), ("NAXIS", len(shape)), *((f"NAXIS{i + 1}", n) for i, n in enumerate(shape))]
    cards += [("PCOUNT", 0), ("GCOUNT", 1)] if extension else [("EXTEND", True)]
    cards += [(k, v) for k, v in (("BSCALE", bscale), ("BZERO", bzero), ("EXTNAME", name)) if v is not None]
    return [*cards, *extra], encode_pixels(values, bitpix)


def decode_pixels(data: bytes, bitpix: int, bscale: float = 1, bzero: float = 0, blank: int | None = None) -> np.ndarray:
    """Samples as ``bzero + bscale * raw``.

    Without scaling the type is the stored one; whole offsets and scales of 8 and 16 bits give
    int32, of 32 bits float64, of 64 bits int64 if only an offset is added (it wraps around),
    else float64; other scales of 8 and 16 bits give float32; float32 stays float32.
    """
    if bitpix not in _PIXEL:
        raise FitsDataError(f"BITPIX {bitpix}")
    raw = np.frombuffer(data, _PIXEL[bitpix])
    raw = raw.astype(raw.dtype.newbyteorder("="))
    holes = raw == blank if blank is not None and bitpix > 0 else None
    plain = bscale == 1 and bzero == 0
    whole = float(bscale).is_integer() and float(bzero).is_integer()
    if plain:
        out = raw
    elif bitpix == 64 and bscale == 1 and whole:
        out = (raw.view(np.uint64) + np.uint64(int(bzero) % (1 << 64))).view(np.int64)
    elif bitpix in (8, 16):
        out = (bzero + bscale * raw.astype(np.float64)).astype(np.int32 if whole else np.float32)
    elif bitpix == -32:
        out = (bzero + bscale * raw.astype(np.float64)).astype(np.float32)
    else:
        out = bzero + bscale * raw.astype(np.float64)
    if holes is not None and holes.any():
        out = out.astype(np.float32 if bitpix in (8, 16) else np.float64)
        out[holes] = np.nan
    return out


def frame(data: bytes, header: Header, index: int, apply_blank: bool = False) -> np.ndarray:
    """One plane of an image, height by width; planes are counted through all axes beyond the second."""
    axes = header.axes
    width, height = (axes[0] if axes else 0), (axes[1] if len(axes) > 1 else 1)
    bitpix = int(header.number("BITPIX"))
    step = width * height * abs(bitpix) // 8
    if not 0 <= index < frame_count(header):
        raise FitsDataError(f"no frame {index}")
    part = data[index * step : (index + 1) * step]
    if len(part) < step:
        raise FitsDataError("the data unit is too short")
    blank = int(header.number("BLANK")) if apply_blank and "BLANK" in header else None
    return decode_pixels(part, bitpix, header.number("BSCALE", 1), header.number("BZERO", 0), blank).reshape(height, width)


def frame_count(header: Header) -> int:
    """Planes of an image: the third axis says how many."""
    axes = header.axes
    return 0 if not header.has_data else axes[2] if len(axes) > 2 else 1


# -- binary tables

_TFORM = re.compile(r"(\d*)([PQ]?)([LXBIJKAEDCM])(?:\(\d+\))?\Z")
# Bytes and storage of an element of each code.
_CODES = {
    "L": (1, "u1"), "X": (1, "u1"), "B": (1, "u1"), "I": (2, ">i2"), "J": (4, ">i4"), "K": (8, ">i8"),
    "A": (1, "S1"), "E": (4, ">f4"), "D": (8, ">f8"), "C": (8, ">f4"), "M": (16, ">f8"),
}


@dataclass(frozen=True)
class Column:
    name: str
    code: str
    repeat: int
    variable: str  # P or Q for elements in the heap, else empty
    offset: int
    width: int  # bytes in the row


def parse_tform(text: str) -> tuple[int, str, str]:
    """(repeat, P or Q or nothing, code)."""
    m = _TFORM.match(text.strip())
    if not m:
        raise FitsError(f"TFORM {text!r}")
    return (int(m[1]) if m[1] else 1), m[2], m[3]


def columns(header: Header) -> list[Column]:
    """Columns of a binary table; a column without TTYPE is named by its number."""
    out, at = [], 0
    for i in range(1, int(header.number("TFIELDS")) + 1):
        repeat, variable, code = parse_tform(header.string(f"TFORM{i}"))
        if variable:
            width = repeat * (8 if variable == "P" else 16)
        else:
            width = -(-repeat // 8) if code == "X" else repeat * _CODES[code][0]
        out.append(Column(header.string(f"TTYPE{i}", f"col{i}").strip(), code, repeat, variable, at, width))
        at += width
    return out


def kind_of(code: str) -> str:
    """The NumPy kind of a binary table's elements; complex ones are pairs of it."""
    return _CODES[code][1]


def size_of(code: str) -> int:
    return _CODES[code][0]


def descriptors(part: np.ndarray, column: Column) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of elements, their places in the heap) of a variable column's bytes."""
    pairs = np.frombuffer(part.tobytes(), ">i4" if column.variable == "P" else ">i8").reshape(len(part), -1)[:, :2].astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def heap_span(rows: np.ndarray, wanted: Sequence[Column]) -> tuple[int, int]:
    """The first and last byte of the heap that some rows' variable columns need."""
    low, high = None, 0
    for c in wanted:
        if c.variable and c.width and len(rows):
            counts, at = descriptors(np.ascontiguousarray(rows[:, c.offset : c.offset + c.width]), c)
            some = counts > 0
            if some.any():
                size = -(-counts // 8) if c.code == "X" else counts * _CODES[c.code][0]
                low = int(at[some].min()) if low is None else min(low, int(at[some].min()))
                high = max(high, int((at + size)[some].max()))
    return (low or 0), high


@dataclass(frozen=True)
class Encoded:
    """A column in the bytes of its form: a row each, or (number, place) pairs and a heap."""

    rows: np.ndarray
    heap: bytes | None = None


def _elements(raw: np.ndarray, code: str, count: int) -> list:
    """Python values of ``count`` elements in contiguous bytes."""
    data = raw.tobytes()
    if code == "X":
        return np.unpackbits(np.frombuffer(data, np.uint8))[:count].tolist()
    if code == "A":
        return [data.decode("latin-1").rstrip("\0").strip()]
    x = np.frombuffer(data, _CODES[code][1])
    if code == "L":
        return (x == 84).tolist()
    if code in "CM":
        return [{"re": a, "im": b} for a, b in x.reshape(-1, 2).tolist()]
    return x.tolist()


def decode_column(rows: np.ndarray, heap: bytes, column: Column, base: int = 0) -> list | np.ndarray:
    """A column's values from rows given as a matrix of bytes: scalars, lists, or strings. ``heap`` begins ``base`` bytes into the table's."""
    part = np.ascontiguousarray(rows[:, column.offset : column.offset + column.width])
    size = _CODES[column.code][0]
    if column.variable:
        kind = ">i4" if column.variable == "P" else ">i8"
        pairs = np.frombuffer(part.tobytes(), kind).reshape(len(part), -1)[:, :2].tolist() if column.width else [(0, 0)] * len(part)
        out = []
        for count, at in pairs:
            n = -(-count // 8) if column.code == "X" else count * size
            at = at - base if n else 0
            if at < 0 or at + n > len(heap):
                raise FitsDataError(f"column {column.name} points outside the heap")
            found = _elements(np.frombuffer(heap, np.uint8, n, at) if n else np.zeros(0, np.uint8), column.code, count)
            out.append(found[0] if column.code == "A" else found)
        return out
    if column.code == "A":
        flat = part.tobytes()
        return [flat[i * column.width : (i + 1) * column.width].decode("latin-1").rstrip("\0").strip() for i in range(len(part))]
    if column.code == "X":
        bits = np.unpackbits(part, axis=1)[:, : column.repeat] if column.width else np.zeros((len(part), 0), np.uint8)
        return bits.tolist()
    x = np.frombuffer(part.tobytes(), _CODES[column.code][1])
    if column.code in "CM":
        values = [{"re": a, "im": b} for a, b in x.reshape(-1, 2).tolist()]
        return values if column.repeat == 1 else [values[i * column.repeat : (i + 1) * column.repeat] for i in range(len(part))]
    x = x == 84 if column.code == "L" else x.astype(x.dtype.newbyteorder("="))
    return x if column.repeat == 1 else x.reshape(len(part), -1).tolist()


def split_table(data: bytes, header: Header) -> tuple[np.ndarray, bytes]:
    """(rows as a matrix of bytes, heap). The heap begins after the rows, or where THEAP says."""
    width, count = (*header.axes, 0, 0)[:2]
    rows = np.frombuffer(data, np.uint8, width * count).reshape(count, width)
    return rows, data[int(header.number("THEAP", width * count)) :]


def decode_table(data: bytes, header: Header, names: Sequence[str] | None = None, start: int = 0, count: int | None = None, scale: bool = False) -> dict[str, list | np.ndarray]:
    """Columns of rows ``start`` to ``start + count``; only ``names`` are decoded. TSCAL and TZERO apply if ``scale``."""
    rows, heap = split_table(data, header)
    rows = rows[start : None if count is None else start + count]
    out = {}
    for i, c in enumerate(columns(header), 1):
        if names is None or c.name in names:
            values = decode_column(rows, heap, c)
            if scale and isinstance(values, np.ndarray) and values.dtype.kind in "iuf" and (f"TSCAL{i}" in header or f"TZERO{i}" in header):
                values = header.number(f"TZERO{i}", 0) + header.number(f"TSCAL{i}", 1) * values.astype(np.float64)
            out[c.name] = values
    return out


def _encode_fixed(values: Sequence, code: str, repeat: int) -> np.ndarray:
    """Values as a matrix of bytes, a row each."""
    n = len(values)
    if code == "A":
        return np.frombuffer(b"".join(str("" if v is None else v).encode("latin-1", "replace")[:repeat].ljust(repeat, b" ") for v in values), np.uint8).reshape(n, repeat)
    if code == "L":
        x = np.where(np.asarray(values, bool), 84, 70).astype(np.uint8)
    elif code == "X":
        bits = np.asarray(values, np.uint8).reshape(n, repeat)
        return np.packbits(bits, axis=1)
    elif code in "CM":
        x = np.array([(v["re"], v["im"]) if isinstance(v, dict) else (v.real, v.imag) for v in np.asarray(values, object).ravel()], _CODES[code][1])
    else:
        x = np.asarray(values).astype(_CODES[code][1])
    return np.frombuffer(x.tobytes(), np.uint8).reshape(n, -1)


def table_hdu(names: Sequence[str], forms: Sequence[str], values: Sequence[Sequence], extra: Cards = (), name: str | None = None) -> tuple[Cards, bytes]:
    """A binary table of columns; variable ones (P or Q) go to the heap."""
    parts, heap = [], bytearray()
    count = len(values[0].rows if isinstance(values[0], Encoded) else values[0]) if len(values) else 0
    for form, column in zip(forms, values, strict=True):
        repeat, variable, code = parse_tform(form)
        if isinstance(column, Encoded):
            if column.heap is None:
                parts.append(column.rows)
            else:
                pairs = column.rows + [0, len(heap)]
                heap += column.heap
                parts.append(np.frombuffer(pairs.astype(">i4" if variable == "P" else ">i8").tobytes(), np.uint8).reshape(len(pairs), -1))
            continue
        if not variable:
            parts.append(_encode_fixed(column, code, repeat))
            continue
        pairs = []
        for v in column:
            raw = str(v).encode("latin-1", "replace") if code == "A" else _encode_fixed([v], code, len(v)).tobytes() if len(v) else b""
            pairs.append((len(v), len(heap)))
            heap += raw
        parts.append(np.frombuffer(np.array(pairs, ">i4" if variable == "P" else ">i8").tobytes(), np.uint8).reshape(count, -1))
    rows = np.concatenate(parts, axis=1) if parts else np.zeros((0, 0), np.uint8)
    cards: list = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.shape[1]), ("NAXIS2", count), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(names))]
    for i, (n, f) in enumerate(zip(names, forms, strict=True), 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", f)]
    if name:
        cards.append(("EXTNAME", name))
    return [*cards, *extra], rows.tobytes() + bytes(heap)


# -- ASCII tables

_ASCII_FORM = re.compile(r"([AIFED])(\d+)(?:\.(\d+))?")


@dataclass(frozen=True)
class AsciiColumn:
    name: str
    code: str
    start: int | None  # first character, or null if the table says no places
    width: int


def ascii_columns(header: Header) -> list[AsciiColumn]:
    out = []
    for i in range(1, int(header.number("TFIELDS")) + 1):
        m = _ASCII_FORM.match(header.string(f"TFORM{i}").strip())
        if not m:
            raise FitsError(f"TFORM{i}")
        start = int(header.number(f"TBCOL{i}")) - 1 if f"TBCOL{i}" in header else None
        out.append(AsciiColumn(header.string(f"TTYPE{i}", f"col{i}").strip(), m[1], start, int(m[2])))
    return out


def decode_ascii(data: bytes, header: Header, rows: int | None = None) -> dict[str, list]:
    """Columns by their places in the line, or split at white space; numbers that can't be read are NaN (null for whole ones).

    ``rows`` says how many lines ``data`` has if it isn't the whole table.
    """
    width, count = (*header.axes, 0, 0)[:2]
    count = count if rows is None else rows
    cols = ascii_columns(header)
    lines = [data[i * width : (i + 1) * width].decode("latin-1") for i in range(count)]
    out: dict[str, list] = {}
    for k, c in enumerate(cols):
        if c.start is None:
            cells = [(x.split() + [""] * len(cols))[k] for x in lines]
        else:
            cells = [x[c.start : c.start + c.width].strip() for x in lines]
        if c.code == "A":
            out[c.name] = cells
        elif c.code == "I":
            out[c.name] = [int(m[0]) if (m := re.match(r"[-+]?\d+", x)) else None for x in cells]
        else:
            out[c.name] = [float(m[0].upper().replace("D", "E")) if (m := _NUMBER.match(x)) else float("nan") for x in cells]
    return out


def ascii_hdu(names: Sequence[str], forms: Sequence[str], values: Sequence[Sequence], places: bool = True) -> tuple[Cards, bytes]:
    """An ASCII table, cells right-aligned for numbers; columns stand one blank apart."""
    widths, texts = [], []
    for form, column in zip(forms, values, strict=True):
        m = _ASCII_FORM.match(form)
        width, digits = int(m[2]), int(m[3] or 0)
        if m[1] == "A":
            texts.append([str(v)[:width].ljust(width) for v in column])
        elif m[1] == "I":
            texts.append([str(int(v)).rjust(width) for v in column])
        else:
            texts.append([f"{v:>{width}.{digits}{'f' if m[1] == 'F' else 'E'}}" for v in column])
        widths.append(width)
    count = len(values[0]) if values else 0
    lines = [" ".join(t[i] for t in texts) for i in range(count)]
    width = sum(widths) + len(widths) - 1
    cards: list = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", count), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(names))]
    at = 1
    for i, (n, f, w) in enumerate(zip(names, forms, widths, strict=True), 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", f)] + ([(f"TBCOL{i}", at)] if places else [])
        at += w + 1
    return cards, "".join(lines).encode("latin-1", "replace")
