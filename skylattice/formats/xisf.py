"""XISF bytes: container, XML header, data blocks, properties, tables and images, read and written."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np

from skylattice.codecs import blocks
from skylattice.errors import XisfParseError, XisfResourceError, XisfSignatureError, XisfValidationError

NAMESPACE = "http://www.pixinsight.com/xisf"
_MAGIC = b"XISF0100"
_INDEX_MAGIC = b"XISB0100"

# NumPy kinds of scalar types, and other names of them.
SCALARS = {
    "Int8": "i1", "Int16": "i2", "Int32": "i4", "Int64": "i8", "UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "UInt64": "u8",
    "Float32": "f4", "Float64": "f8", "Complex32": "c8", "Complex64": "c16",
}
ALIASES = {"Byte": "UInt8", "Short": "Int16", "UShort": "UInt16", "Int": "Int32", "UInt": "UInt32", "Float": "Float32", "Double": "Float64"}
_SHORT = {"I8": "i1", "UI8": "u1", "I16": "i2", "UI16": "u2", "I32": "i4", "UI32": "u4", "I64": "i8", "UI64": "u8", "I": "i4", "UI": "u4", "F32": "f4", "F64": "f8", "C32": "c8", "C64": "c16"}
_ARRAYS = {f"{k}{what}": v for k, v in _SHORT.items() for what in ("Vector", "Matrix")} | {"ByteArray": "u1", "Vector": "f8", "ByteMatrix": "u1", "Matrix": "f8"}
SAMPLES = {k: SCALARS[k] for k in ("UInt8", "UInt16", "UInt32", "UInt64", "Float32", "Float64", "Complex32", "Complex64")}

Resolver = Callable[[str, str], bytes]  # (url or path, target) -> bytes


@dataclass
class Property:
    id: str
    type: str
    value: object
    comment: str | None = None
    format: str | None = None


@dataclass
class Image:
    geometry: list[int]  # width, height, ..., channels
    sample_format: str
    color_space: str = "Gray"
    pixel_storage: str = "Planar"
    bounds: tuple[float, float] | None = None
    data: bytes | None = None
    byte_order: str = "little"
    id: str | None = None
    properties: list[Property] = field(default_factory=list)
    keywords: list[tuple[str, str, str]] = field(default_factory=list)
    elements: dict[str, dict[str, object]] = field(default_factory=dict)  # by name, their attributes; data under "data"
    thumbnail: Image | None = None

    @property
    def channels(self) -> int:
        return self.geometry[-1]

    def samples(self) -> np.ndarray:
        """Samples as (channels, ..., height, width), whatever their storage."""
        kind = np.dtype(SAMPLES[self.sample_format]).newbyteorder("<" if self.byte_order == "little" else ">")
        x = np.frombuffer(self.data or b"", kind)
        shape = self.geometry[-2::-1]
        if self.pixel_storage == "Normal":
            return np.moveaxis(x.reshape(*shape, self.channels), -1, 0)
        return x.reshape(self.channels, *shape)


@dataclass
class Table:
    id: str
    fields: list[tuple[str, str]]
    rows: list[list[Property]]


@dataclass
class Unit:
    metadata: list[Property] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    signed: bool = False
    warnings: list[tuple[str, str]] = field(default_factory=list)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


# What an image's descriptive elements hold if their attributes are left out.
_DESCRIPTIVE = {
    "RGBWorkingSpace": {"gamma": "sRGB", "x": "0:0:0", "y": "0:0:0", "Y": "0:0:0", "name": None},
    "DisplayFunction": {"m": "0.5:0.5:0.5:0.5", "s": "0:0:0:0", "h": "1:1:1:1", "l": "0:0:0:0", "r": "1:1:1:1", "name": None},
    "ColorFilterArray": {"pattern": "", "width": "0", "height": "0", "name": None},
    "Resolution": {"horizontal": "72", "vertical": "72", "unit": "inch"},
}
_CFA_PATTERN = re.compile(r"[0RGBWCMY]+")
_WHOLE_ATTRIBUTES, _REAL_ATTRIBUTES = ("width", "height"), ("horizontal", "vertical")


def _descriptive(e: ET.Element, strict: bool) -> dict[str, object]:
    """A descriptive element's values: lists of numbers, numbers and text, with the defaults for what is left out."""
    kind, out = _name(e), {}
    for key, default in _DESCRIPTIVE[kind].items():
        text = e.get(key, default)
        try:
            if default is not None and ":" in default:
                out[key] = [float(x) for x in text.split(":")]
            else:
                out[key] = int(text) if key in _WHOLE_ATTRIBUTES else float(text) if key in _REAL_ATTRIBUTES else text
        except ValueError as error:
            raise XisfValidationError(f"{kind} {key} {text!r}") from error
        if strict and isinstance(out[key], list) and len(out[key]) != default.count(":") + 1:
            raise XisfValidationError(f"{kind} {key} has {len(out[key])} numbers")
    if kind == "Resolution":
        out["unit"] = "cm" if out["unit"] == "cm" else "inch"
        if strict and not (0 < out["horizontal"] < float("inf") and 0 < out["vertical"] < float("inf")):
            raise XisfValidationError("a resolution is positive")
    if kind == "ColorFilterArray" and strict:
        if out["width"] <= 0 or out["height"] <= 0 or not _CFA_PATTERN.fullmatch(out["pattern"]) or len(out["pattern"]) != out["width"] * out["height"]:
            raise XisfValidationError("a filter pattern has a known letter for each of its cells")
    return out


# -- locations and blocks

_LOCATION = re.compile(r"(?:(inline):(\w+)|(embedded)|(?:attachment|attached):(\d+):(\d+)|(url|path)\((.*)\)(?::(\w+))?)\Z", re.S)


@dataclass(frozen=True)
class Location:
    type: str
    encoding: str | None = None
    position: int | None = None
    size: int | None = None
    target: str | None = None
    index_id: int | None = None


def parse_location(text: str) -> Location:
    m = _LOCATION.match(text.strip())
    if not m:
        raise XisfParseError(f"location {text!r}")
    if m[1]:
        if m[2] not in ("base64", "hex"):
            raise XisfParseError(f"encoding {m[2]!r}")
        return Location("inline", encoding=m[2])
    if m[3]:
        return Location("embedded")
    if m[4]:
        return Location("attachment", position=int(m[4]), size=int(m[5]))
    return Location(m[6], target=m[7], index_id=int(m[8], 0) if m[8] else None)


def resolve_header_dir(target: str, directory: str) -> str:
    """``@header_dir`` at the beginning of a target stands for the header file's folder."""
    return f"{directory.rstrip('/')}{target[len('@header_dir'):]}" if target.startswith("@header_dir") else target


def _inline(text: str, encoding: str) -> bytes:
    return blocks.from_base64(text) if encoding == "base64" else blocks.from_hex(text)


def parse_index(data: bytes) -> dict[int, tuple[int, int, int]]:
    """Blocks of a data-block file by id: (position, stored size, uncompressed size). Cycles of nodes are an error."""
    if data[:8] != _INDEX_MAGIC:
        raise XisfParseError("not a data-block file")
    found: dict[int, tuple[int, int, int]] = {}
    at, seen = 16, set()
    while at:
        if at in seen:
            raise XisfParseError("the block index has a cycle")
        seen.add(at)
        if at + 16 > len(data):
            raise XisfParseError("the block index ends early")
        count, _, follow = struct.unpack_from("<IIQ", data, at)
        if at + 16 + 40 * count > len(data):
            raise XisfParseError("the block index ends early")
        for i in range(count):
            uid, position, size, full, _ = struct.unpack_from("<5Q", data, at + 16 + 40 * i)
            if not position:
                continue  # a free element
            if position + size > len(data):
                raise XisfParseError("a block lies outside the file")
            found[uid] = position, size, full
        at = follow
    return found


def build_index(parts: Sequence[tuple[bytes, int]]) -> bytes:
    """A data-block file of (stored bytes, uncompressed size or 0), with ids from 1 on in one index node."""
    at, elements = 16 + 16 + 40 * len(parts), []
    for i, (data, full) in enumerate(parts):
        elements.append(struct.pack("<5Q", i + 1, at, len(data), full, 0))
        at += len(data)
    return _INDEX_MAGIC + bytes(8) + struct.pack("<IIQ", len(parts), 0, 0) + b"".join(elements) + b"".join(x for x, _ in parts)


def _block(e: ET.Element, whole: bytes, resolve: Resolver | None, directory: str, verify: bool) -> tuple[bytes | None, str]:
    """(bytes, byte order) of an element's data block; null if it has none."""
    where = e.get("location")
    if where is None:
        return None, "little"
    place, holder = parse_location(where), e
    if place.type == "embedded":
        holder = next((c for c in e if _name(c) == "Data"), None)
        if holder is None:
            raise XisfParseError("an embedded block without Data")
        raw = _inline(holder.text or "", holder.get("encoding", "base64"))
    elif place.type == "inline":
        raw = _inline(e.text or "", place.encoding)
    elif place.type == "attachment":
        raw = whole[place.position : place.position + place.size]
        if len(raw) < place.size:
            raise XisfParseError("an attachment lies outside the file")
    else:
        if resolve is None:
            raise XisfResourceError(f"nothing resolves {place.target!r}")
        raw = resolve(place.type, resolve_header_dir(place.target, directory))
        if place.index_id is not None:
            index = parse_index(raw)
            if place.index_id not in index:
                raise XisfResourceError(f"no block {place.index_id}")
            position, size, _ = index[place.index_id]
            raw = raw[position : position + size]
    get = lambda k: holder.get(k) or e.get(k)
    if verify and get("checksum"):
        blocks.verify_checksum(raw, get("checksum"))
    if get("compression"):
        raw = blocks.decode_block(raw, get("compression"), get("subblocks"))
    return raw, e.get("byteOrder", "little")


# -- properties


def _complex(text: str) -> complex:
    a, b = re.split(r"[:,]", text.strip("() "), maxsplit=1)
    return complex(float(a), float(b))


def parse_scalar(kind: str, text: str) -> object:
    kind = ALIASES.get(kind, kind)
    text = text.strip()
    if kind == "Boolean":
        return text.lower() in ("true", "1")
    if kind in ("String", "TimePoint"):
        return text
    if kind.startswith("Complex"):
        return _complex(text)
    if kind.startswith("Float"):
        return float(text)
    if kind in SCALARS:
        return int(text, 0) if not re.fullmatch(r"[-+]?0\d+", text) else int(text)
    raise XisfValidationError(f"type {kind!r}")


def _property(e: ET.Element, context) -> Property:
    kind = e.get("type", "String")
    raw, order = _block(e, *context)
    text = e.get("value")
    if kind in _ARRAYS:
        x = np.frombuffer(raw or b"", np.dtype(_ARRAYS[kind]).newbyteorder("<" if order == "little" else ">"))
        if kind.endswith("Matrix"):
            rows, cols = int(e.get("rows", 0)), int(e.get("columns", 0))
            if rows * cols != len(x):
                raise XisfValidationError(f"matrix {e.get('id')} has {len(x)} elements")
            x = x.reshape(rows, cols)
        elif e.get("length") and int(e.get("length")) != len(x):
            raise XisfValidationError(f"vector {e.get('id')} has {len(x)} elements")
        value: object = x.tolist()
    elif kind == "String" and text is None:
        value = raw.decode() if raw is not None else (e.text or "")
    elif text is None and raw is not None:
        value = np.frombuffer(raw, np.dtype(SCALARS[ALIASES.get(kind, kind)]).newbyteorder("<" if order == "little" else ">"))[0].item()
    else:
        value = parse_scalar(kind, text or "")
    return Property(e.get("id", ""), kind, value, e.get("comment"), e.get("format"))


def value_columns(p: Property) -> dict[str, object]:
    """A property's value by kind: text, number, exact whole number, vector and its shape."""
    v = p.value
    out: dict[str, object] = {"value_str": None, "value_num": None, "value_exact": None, "vec": None, "rows": None, "cols": None}
    if isinstance(v, bool):
        out |= {"value_str": str(v).lower(), "value_num": float(v)}
    elif isinstance(v, int):
        out |= {"value_num": float(v), "value_exact": Decimal(v)}
    elif isinstance(v, float):
        out["value_num"] = v
    elif isinstance(v, list):
        if v and isinstance(v[0], list):
            out |= {"rows": len(v), "cols": len(v[0]), "vec": [float(x) for row in v for x in row]}
        else:
            out["vec"] = [float(x) for x in v if not isinstance(x, complex)]
    elif v is not None:
        out["value_str"] = f"{v.real}:{v.imag}" if isinstance(v, complex) else str(v)
    return out


# -- reading


def header_of(data: bytes) -> str:
    """The XML text of a monolithic file or of a header file."""
    if data[:8] == _MAGIC:
        size = struct.unpack_from("<I", data, 8)[0]
        if 16 + size > len(data):
            raise XisfParseError("the header ends early")
        return data[16 : 16 + size].decode().rstrip("\0")
    text = data.lstrip()
    if text[:5] != b"<?xml" and text[:5] != b"<xisf":
        raise XisfParseError("not an XISF file")
    return data.decode()


def read(data: bytes, resolve: Resolver | None = None, directory: str = "", strict: bool = True, verify: bool = True, decode_images: bool = True, signature_policy: str = "require") -> Unit:
    """Read a unit. ``signature_policy``: require a signature that is there to hold, warn if it doesn't, or ignore it."""
    text = header_of(data)
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise XisfParseError(str(e)) from e
    if _name(root) != "xisf" or root.get("version") != "1.0":
        raise XisfParseError("the root is not xisf 1.0")
    by_uid = {e.get("uid"): e for e in root.iter() if e.get("uid")}
    context = (data, resolve, directory, verify)
    unit = Unit()

    def real(e: ET.Element) -> ET.Element:
        if _name(e) != "Reference":
            return e
        found = by_uid.get(e.get("ref"))
        if found is None or _name(found) == "Reference" and strict:
            raise XisfValidationError(f"reference {e.get('ref')!r}")
        return found

    def image(e: ET.Element, thumbnail: bool = False) -> Image:
        geometry = [int(x) for x in e.get("geometry", "").split(":") if x]
        kind = e.get("sampleFormat", "")
        if len(geometry) < 2 or min(geometry) < 1:
            raise XisfValidationError("bad geometry")
        if kind not in SAMPLES:
            raise XisfValidationError(f"sample format {kind!r}")
        if thumbnail and strict and (kind not in ("UInt8", "UInt16") or len(geometry) != 3):
            raise XisfValidationError("a thumbnail is a plane image of 8 or 16 bits")
        bounds = tuple(float(x) for x in e.get("bounds").split(":")) if e.get("bounds") else None
        if bounds and not bounds[0] < bounds[1]:
            raise XisfValidationError("bad bounds")
        if kind.startswith("Float") and bounds is None and strict:
            raise XisfValidationError("images of reals need bounds")
        raw, order = _block(e, *context) if decode_images else (None, e.get("byteOrder", "little"))
        size = int(np.prod(geometry)) * np.dtype(SAMPLES[kind]).itemsize
        if raw is not None and len(raw) != size and strict:
            raise XisfValidationError(f"image data has {len(raw)} bytes, not {size}")
        out = Image(geometry, kind, e.get("colorSpace", "Gray"), e.get("pixelStorage", "Planar"), bounds, raw, order, e.get("id"))
        for c in map(real, e):
            if _name(c) == "Property":
                out.properties.append(_property(c, context))
            elif _name(c) == "FITSKeyword":
                out.keywords.append((c.get("name", ""), c.get("value", ""), c.get("comment", "")))
            elif _name(c) in _DESCRIPTIVE:
                out.elements[_name(c)] = _descriptive(c, strict)
            elif _name(c) == "ICCProfile":
                out.elements["ICCProfile"] = {"data": _block(c, *context)[0]}
            elif _name(c) == "Thumbnail":
                if thumbnail and strict:
                    raise XisfValidationError("a thumbnail within a thumbnail")
                out.thumbnail = image(c, True)
        return out

    def table(e: ET.Element) -> Table:
        fields, rows = [], []
        for c in map(real, e):
            if _name(c) == "Structure":
                fields = [(f.get("id", ""), f.get("type", "String")) for f in c if _name(f) == "Field"]
            elif _name(c) == "Row":
                cells = []
                for k, cell in enumerate(x for x in c if _name(x) == "Cell"):
                    if k < len(fields) and not cell.get("type"):
                        cell.set("type", fields[k][1])
                    p = _property(cell, context)
                    p.id = fields[k][0] if k < len(fields) else ""
                    cells.append(p)
                if strict and len(cells) != len(fields):
                    raise XisfValidationError("a row has as many cells as the table has fields")
                rows.append(cells)
        if strict and e.get("rows") and int(e.get("rows")) != len(rows):
            raise XisfValidationError("the table has another number of rows")
        return Table(e.get("id", ""), fields, rows)

    for e in root:
        name = _name(e)
        if name == "Metadata":
            unit.metadata = [_property(c, context) for c in map(real, e) if _name(c) == "Property"]
        elif name == "Image":
            unit.images.append(image(e))
        elif name == "Property":
            unit.properties.append(_property(e, context))
        elif name == "Table":
            unit.tables.append(table(e))
        elif name == "Signature":
            unit.signed = True
    if unit.signed and signature_policy != "ignore":
        problem = check_signature(text)
        if problem and signature_policy == "require":
            raise XisfSignatureError(problem)
        if problem:
            unit.warnings.append(("SIGNATURE", problem))
    return unit


# Hash algorithms by name, with the bytes that PKCS 1 puts before a digest (DigestInfo); names of algorithms.
_DIGESTS = {
    "sha1": bytes.fromhex("3021300906052b0e03021a05000414"),
    "sha256": bytes.fromhex("3031300d060960864801650304020105000420"),
    "sha384": bytes.fromhex("3041300d060960864801650304020205000430"),
    "sha512": bytes.fromhex("3051300d060960864801650304020305000440"),
}
_DSIG = "http://www.w3.org/2000/09/xmldsig#"
_ENVELOPED = f"{_DSIG}enveloped-signature"
_CANONICAL = ("http://www.w3.org/2001/10/xml-exc-c14n#", "http://www.w3.org/TR/2001/REC-xml-c14n-20010315")


def check_signature(text: str, key: tuple[int, int] | None = None) -> str | None:
    """What is wrong with an enveloped RSA signature (PKCS 1); null if it holds.

    There must be one Signature, a child of the root, with one Reference, to the whole document
    (an empty URI), by the enveloped transform and a canonical form without comments. The digest
    is of the canonical document without the signature; the signature value must open to exactly
    the padded digest of the canonical SignedInfo. ``key`` is the trusted (modulus, exponent);
    without it the document's own key is taken, which shows that nothing was changed since the
    key's owner signed, but not who that is. Everything else is reported as unsupported.
    """
    scopes: list[dict[str, str]] = []
    prefixes: dict[str, str] = {}
    for event, value in ET.iterparse(io.StringIO(text), ("start-ns", "start")):
        if event == "start-ns":
            prefixes[value[0]] = value[1]
        elif value.tag == f"{{{_DSIG}}}SignedInfo":
            scopes.append(dict(prefixes))
    root = ET.fromstring(text)
    holders = [e for e in root.iter() if _name(e) == "Signature"]
    if not holders:
        return "no signature"
    if len(holders) > 1 or holders[0] not in list(root) or holders[0].tag != f"{{{_DSIG}}}Signature":
        return "unsupported place of a signature"
    holder = holders[0]
    child = lambda e, name: [x for x in (e if e is not None else ()) if x.tag == f"{{{_DSIG}}}{name}"]
    one = lambda e, name: found[0] if len(found := child(e, name)) == 1 else None
    algorithm = lambda e: e.get("Algorithm", "") if e is not None else ""
    info, value = one(holder, "SignedInfo"), one(holder, "SignatureValue")
    reference = one(info, "Reference")
    if info is None or value is None or reference is None or len(scopes) != 1:
        return "unsupported signature: not one reference"
    if reference.get("URI") != "":
        return "unsupported reference"
    forms = [algorithm(x) for x in child(one(reference, "Transforms"), "Transform")]
    form = algorithm(one(info, "CanonicalizationMethod"))
    if forms[:1] != [_ENVELOPED] or len(forms) > 2 or not {*forms[1:], form} <= {*_CANONICAL}:
        return "unsupported transform"
    # the inclusive form also writes names that aren't used, which the library's doesn't
    inclusive = _CANONICAL[1] in (form, *(forms[1:] or _CANONICAL[1:]))
    if inclusive and any(p for p in scopes[0]):
        return "unsupported name prefixes"
    method = algorithm(one(reference, "DigestMethod")).rpartition("#")[2]
    if method not in _DIGESTS:
        return f"unsupported digest {method!r}"
    canon = ET.canonicalize(text, exclude_tags=[f"{{{_DSIG}}}Signature"])
    stated = one(reference, "DigestValue")
    if stated is None or hashlib.new(method, canon.encode()).digest() != blocks.from_base64(stated.text or ""):
        return "digest differs"
    if key is None:
        pair = one(one(one(holder, "KeyInfo"), "KeyValue"), "RSAKeyValue")
        numbers = [one(pair, k) for k in ("Modulus", "Exponent")]
        if None in numbers:
            return "unsupported key"
        key = tuple(int.from_bytes(blocks.from_base64(x.text or ""), "big") for x in numbers)
    n, e = key
    kind = algorithm(one(info, "SignatureMethod")).rpartition("#")[2].removeprefix("rsa-")
    if kind not in _DIGESTS or not algorithm(one(info, "SignatureMethod")).rpartition("#")[2].startswith("rsa-"):
        return f"unsupported signature {kind!r}"
    # SignedInfo as it stands, with the name space that it stands in
    raw = re.search(r"<SignedInfo\b[^>]*>.*?</SignedInfo\s*>", text, re.S)
    if raw is None:
        return "unsupported name prefixes"
    signed_info = raw[0] if re.match(r"<SignedInfo\b[^>]*\sxmlns=", raw[0]) else raw[0].replace("<SignedInfo", f'<SignedInfo xmlns="{_DSIG}"', 1)
    info.tail = None
    if len({ET.canonicalize(ET.tostring(x, encoding="unicode")) for x in (info, ET.fromstring(signed_info))}) > 1:
        return "unsupported name prefixes"
    digest = _DIGESTS[kind] + hashlib.new(kind, ET.canonicalize(signed_info).encode()).digest()
    size = (n.bit_length() + 7) // 8
    given = blocks.from_base64(value.text or "")
    if size < len(digest) + 11 or len(given) != size or e < 3:
        return "signature differs"
    wanted = b"\0\1" + b"\xff" * (size - len(digest) - 3) + b"\0" + digest
    return None if pow(int.from_bytes(given, "big"), e, n).to_bytes(size, "big") == wanted else "signature differs"


# -- writing


def _format_scalar(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, complex):
        return f"({value.real!r},{value.imag!r})"
    return repr(value) if isinstance(value, float) else str(value)


_MARKUP = re.compile(r"[&<>\"\r\n\t]")
_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_ATTRIBUTE = _TEXT | str.maketrans({'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


def _xml(root: ET.Element) -> bytes:
    """What ``ET.tostring`` gives for elements whose names have no name space, in a fraction of its time."""
    out: list[str] = []

    def put(e: ET.Element) -> None:
        out.append(f"<{e.tag}")
        for k, v in e.items():
            out.append(f' {k}="{v.translate(_ATTRIBUTE) if _MARKUP.search(v) else v}"')
        if not e.text and not len(e):
            out.append(" />")
            return
        text = e.text or ""
        out.append(f">{text.translate(_TEXT) if _MARKUP.search(text) else text}")
        for c in e:
            put(c)
        out.append(f"</{e.tag}>")

    put(root)
    return "".join(out).encode("us-ascii", "xmlcharrefreplace")


class _Writer:
    """Collects elements and attachments; positions are filled in once the header's length is known."""

    def __init__(self, codec: str | None, level: int, checksum: str | None, inline: int, align: int) -> None:
        self.codec, self.level, self.checksum, self.inline, self.align = codec, level, checksum, inline, align
        self.attached: list[tuple[ET.Element, bytes, int]] = []

    def attach(self, e: ET.Element, data: bytes, item: int, image: bool = False) -> None:
        if not image and len(data) <= self.inline:
            e.set("location", "inline:base64")
            e.text = blocks.to_base64(data)
            return
        full = 0
        if image and self.codec:
            full = len(data)
            data, spec = blocks.encode_block(data, self.codec, item, self.level)
            e.set("compression", spec)
        if image and self.checksum:
            e.set("checksum", f"{self.checksum}:{blocks.checksum(data, self.checksum)}")
        self.attached.append((e, data, full))

    def property(self, parent: ET.Element, p: Property, tag: str = "Property") -> None:
        e = ET.SubElement(parent, tag, {"id": p.id, "type": p.type} if tag == "Property" else {"type": p.type})
        for k, v in (("comment", p.comment), ("format", p.format)):
            if v:
                e.set(k, v)
        if p.type in _ARRAYS:
            x = np.array(p.value, np.dtype(_ARRAYS[p.type]).newbyteorder("<"))
            if p.type.endswith("Matrix"):
                e.set("rows", str(x.shape[0]))
                e.set("columns", str(x.shape[1]))
            else:
                e.set("length", str(len(x)))
            self.attach(e, x.tobytes(), x.dtype.itemsize)
        elif p.type == "String":
            e.text = str(p.value)
        else:
            e.set("value", _format_scalar(p.value))

    def build(self, unit: Unit) -> ET.Element:
        root = ET.Element("xisf", {"version": "1.0", "xmlns": NAMESPACE})
        for image in unit.images:
            self.image(root, image)
        for p in unit.properties:
            self.property(root, p)
        for t in unit.tables:
            e = ET.SubElement(root, "Table", {"id": t.id, "rows": str(len(t.rows)), "columns": str(len(t.fields))})
            s = ET.SubElement(e, "Structure")
            for name, kind in t.fields:
                ET.SubElement(s, "Field", {"id": name, "type": kind})
            for row in t.rows:
                r = ET.SubElement(e, "Row")
                for cell in row:
                    self.property(r, cell, "Cell")
        meta = ET.SubElement(root, "Metadata")
        for p in unit.metadata:
            self.property(meta, p)
        return root

    def image(self, parent: ET.Element, image: Image, tag: str = "Image") -> None:
        e = ET.SubElement(parent, tag, {"geometry": ":".join(map(str, image.geometry)), "sampleFormat": image.sample_format, "colorSpace": image.color_space})
        for k, v in (("id", image.id), ("pixelStorage", image.pixel_storage if image.pixel_storage != "Planar" else None), ("bounds", ":".join(map(repr, image.bounds)) if image.bounds else None), ("byteOrder", image.byte_order if image.byte_order != "little" else None)):
            if v:
                e.set(k, v)
        self.attach(e, image.data or b"", np.dtype(SAMPLES[image.sample_format]).itemsize, image=True)
        for name, value, comment in image.keywords:
            ET.SubElement(e, "FITSKeyword", {"name": name, "value": value, "comment": comment})
        for p in image.properties:
            self.property(e, p)
        for name, values in image.elements.items():
            if name == "ICCProfile":
                self.attach(ET.SubElement(e, name), values["data"], 1)
            else:
                text = {k: ":".join(map(repr, v)) if isinstance(v, list) else str(v) for k, v in values.items() if v is not None}
                ET.SubElement(e, name, text)
        if image.thumbnail:
            self.image(e, image.thumbnail, "Thumbnail")


def write(unit: Unit, compression: str | None = None, level: int = 6, checksum: str | None = "sha1", max_inline: int = 3072, alignment: int = 4096) -> bytes:
    """A monolithic file; images are attachments at multiples of ``alignment``."""
    w = _Writer(compression, level, checksum, max_inline, alignment)
    root = w.build(unit)
    mark = f"place-{uuid.uuid4().hex}"  # stands for positions until they are known, so that the elements are written once
    for e, data, _ in w.attached:
        e.set("location", f"attachment:{mark}:{len(data)}")
    parts = (b'<?xml version="1.0" encoding="UTF-8"?>\n' + _xml(root)).split(mark.encode())
    order = {id(e): i for i, e in enumerate(e for e in root.iter() if mark in (e.get("location") or ""))}
    size = 0
    while True:  # positions have digits, and so move the positions
        at = 16 + size
        places, numbers = [], [b""] * len(w.attached)
        for e, data, _ in w.attached:
            at = -(-at // alignment) * alignment
            places.append(at)
            numbers[order[id(e)]] = b"%d" % at
            at += len(data)
        text = b"".join(x for pair in zip(parts, [*numbers, b""], strict=True) for x in pair)
        if len(text) <= size:
            break
        size = len(text)
    out = bytearray(_MAGIC + struct.pack("<II", size, 0) + text.ljust(size))
    for place, (_, data, _) in zip(places, w.attached, strict=True):
        out += bytes(place - len(out)) + data
    return bytes(out)


def write_distributed(unit: Unit, compression: str | None = None, level: int = 6, checksum: str | None = "sha1", max_inline: int = 3072, name: str = "blocks.xisb") -> tuple[bytes, bytes]:
    """(header file, data-block file): blocks are found through the index of the second."""
    w = _Writer(compression, level, checksum, max_inline, 1)
    root = w.build(unit)
    for i, (e, _, _) in enumerate(w.attached):
        e.set("location", f"path(@header_dir/{name}):0x{i + 1:x}")
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + _xml(root), build_index([(data, full) for _, data, full in w.attached])
