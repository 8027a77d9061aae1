"""Conversions between whole files in bytes. Frames, timestamps, keywords and types survive a way and back."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

from skylattice.errors import FitsDataError, SerValidationError, XisfValidationError
from skylattice.formats import fits, ser, xisf

# Keywords that say how a FITS unit is laid out; they are made anew and never copied.
_STRUCTURE = ("SIMPLE", "XTENSION", "BITPIX", "NAXIS", "EXTEND", "PCOUNT", "GCOUNT", "BSCALE", "BZERO", "END", "TFIELDS", "GROUPS")
_OFFSETS = {"UInt16": (16, 1 << 15), "UInt32": (32, 1 << 31), "UInt64": (64, 1 << 63)}


def _is_structure(key: str) -> bool:
    return key in _STRUCTURE or fits.split_index(key)[0] in ("NAXIS", "TTYPE", "TFORM", "TBCOL")


def _stored(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(values to store, BITPIX, BZERO) of unsigned or other samples."""
    name = x.dtype.name.replace("uint", "UInt")
    if name in _OFFSETS:
        bits, offset = _OFFSETS[name]
        kind = np.dtype(f"i{bits // 8}")
        return (x ^ x.dtype.type(offset)).astype(x.dtype.newbyteorder("=")).view(kind), bits, offset
    return x, {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}[x.dtype.str[1:]], 0


# -- SER and FITS


def ser_to_fits(data: bytes, layout: str = "cube", timestamps: bool = True) -> bytes:
    """A cube (frames by y by x; colours become planes) or an image unit per frame, and a table of timestamps."""
    f = ser.parse(fits.reader_of(data), len(data))
    h = f.header
    planes = [ser.planar(ser.samples(data[f.offset(i) : f.offset(i) + h.frame_bytes], h), h.width, h.height, h.channels) for i in range(f.frames)]
    cards = [
        ("SERCOLOR", h.color_id), ("SERPDEP", h.pixel_depth), ("SERFRMS", f.frames), ("SERCHANS", h.channels), ("SERLUID", h.lu_id), ("SERBYORD", h.byte_order),
        ("SEROBS", h.observer), ("SERINST", h.instrument), ("SERTEL", h.telescope), ("SERSTRT", str(h.start_ticks)), ("SERSTUTC", str(h.start_utc_ticks)),
    ]
    units: list = []
    if layout == "cube":
        x, bits, zero = _stored(np.concatenate(planes) if planes else np.zeros((0, h.height, h.width), np.uint8))
        units.append(fits.image_hdu(x, bits, bscale=1 if zero else None, bzero=zero or None, extra=cards))
    else:
        for i, p in enumerate(planes):
            for c, plane in enumerate(p):
                x, bits, zero = _stored(plane)
                extra = [*(cards if not units else []), ("SERFRAME", i), ("SERCHORD", c)]
                units.append(fits.image_hdu(x, bits, extension=bool(units), bscale=1 if zero else None, bzero=zero or None, extra=extra))
    if timestamps and f.timestamps:
        signed = np.array(f.timestamps, np.uint64).view(np.int64)
        units.append(fits.table_hdu(["TIMESTAMP"], ["1K"], [signed], name="SER_TSTP"))
    return fits.write(units or [fits.empty_primary()])


def fits_to_ser(data: bytes, strict: bool = True) -> bytes:
    """Frames of the image units that share the first one's shape and type (others are an error, or left out)."""
    found = fits.hdus(data)
    images = [h for h in found if h.header.kind == "image"]
    if not images:
        raise SerValidationError("no image")
    shape = lambda h: (h.header.axes[:2], h.header.number("BITPIX"))
    same = [h for h in images if shape(h) == shape(images[0])]
    if strict and len(same) < len(images):
        raise SerValidationError("images of different shapes")
    first = images[0].header
    planes = [fits.frame(fits.data_of(data, h), h.header, i) for h in same for i in range(fits.frame_count(h.header))]
    channels = int(first.number("SERCHANS", 1))
    color = int(first.number("SERCOLOR", 0))
    depth = int(first.number("SERPDEP", 8 if first.number("BITPIX") == 8 else 16))
    kind = np.uint8 if depth <= 8 else "<u2"
    if any((p < 0).any() or (p > (255 if depth <= 8 else 65535)).any() for p in planes):
        raise SerValidationError("samples outside the depth's range")
    groups = [planes[i : i + channels] for i in range(0, len(planes) // channels * channels, channels)]
    frames = [np.stack(g, axis=-1).astype(kind).tobytes() for g in groups]
    stamps = next((fits.decode_table(fits.data_of(data, h), h.header)["TIMESTAMP"] for h in found if h.header.get("EXTNAME") == "SER_TSTP"), None)
    ticks = [int(x) for x in np.asarray(stamps, np.int64).view(np.uint64)] if stamps is not None and len(stamps) == len(frames) else None
    return ser.write(
        frames, first.axes[0], first.axes[1], depth, color, ticks, first.string("SEROBS"), first.string("SERINST"), first.string("SERTEL"),
        int(first.string("SERSTRT", "0")), int(first.string("SERSTUTC", "0")), int(first.number("SERLUID", 0)),
    )


# -- SER and XISF


def ser_to_xisf(data: bytes, **options) -> bytes:
    """A unit with an image per frame and the sequence's header as properties."""
    f = ser.parse(fits.reader_of(data), len(data))
    h = f.header
    kind = "UInt8" if h.sample_bytes == 1 else "UInt16"
    images = []
    for i in range(f.frames):
        x = ser.planar(ser.samples(data[f.offset(i) : f.offset(i) + h.frame_bytes], h), h.width, h.height, h.channels)
        images.append(xisf.Image([h.width, h.height, h.channels], kind, "RGB" if h.channels == 3 else "Gray", data=x.astype(x.dtype.newbyteorder("<")).tobytes(), id=f"frame{i}"))
    meta = [("ColorId", "Int32", h.color_id), ("PixelDepth", "Int32", h.pixel_depth), ("LuId", "Int32", h.lu_id), ("Observer", "String", h.observer), ("Instrument", "String", h.instrument),
            ("Telescope", "String", h.telescope), ("StartTicks", "UInt64", h.start_ticks), ("StartUtcTicks", "UInt64", h.start_utc_ticks)]
    properties = [xisf.Property(f"SER:{k}", t, v) for k, t, v in meta]
    if f.timestamps:
        properties.append(xisf.Property("SER:Timestamps", "UI64Vector", f.timestamps))
    return xisf.write(xisf.Unit(metadata=[xisf.Property("XISF:CreatorApplication", "String", "skylattice")], images=images, properties=properties), **options)


def xisf_to_ser(data: bytes, image_index: int | None = None) -> bytes:
    """All images of the first one's shape as frames, or the one at ``image_index``; properties of an image count before the unit's."""
    unit = xisf.read(data)
    images = unit.images if image_index is None else unit.images[image_index : image_index + 1]
    if not images:
        raise SerValidationError("no image")
    first = images[0]
    if first.sample_format not in ("UInt8", "UInt16"):
        raise SerValidationError(f"samples of {first.sample_format}")
    found = {p.id: p.value for p in (*unit.metadata, *unit.properties, *first.properties)}
    width, height, channels = first.geometry[0], first.geometry[1], first.channels
    depth = int(found.get("SER:PixelDepth", 8 if first.sample_format == "UInt8" else 16))
    frames = [np.moveaxis(i.samples().reshape(channels, height, width), 0, -1).astype("u1" if depth <= 8 else "<u2").tobytes() for i in images if i.geometry == first.geometry]
    stamps = found.get("SER:Timestamps")
    return ser.write(
        frames, width, height, depth, int(found.get("SER:ColorId", 100 if channels == 3 else 0)), stamps if stamps and len(stamps) == len(frames) else None,
        found.get("SER:Observer", ""), found.get("SER:Instrument", ""), found.get("SER:Telescope", ""), found.get("SER:StartTicks", 0), found.get("SER:StartUtcTicks", 0), found.get("SER:LuId", 0),
    )


# -- XISF and FITS


def xisf_to_fits(data: bytes, meta_extension: bool = True) -> bytes:
    """An image unit per image, complex ones as tables of 1C or 1M, and the unit's properties as JSON in a table."""
    unit = xisf.read(data)
    units: list = []
    for image in unit.images:
        x = image.samples()
        extra: list = [(k.upper()[:8], _typed(v), c) for k, v, c in image.keywords if not _is_structure(k.upper()) and k]
        extra.append(("XISFSFMT", image.sample_format))
        if image.sample_format.startswith("Complex"):
            if not units:
                units.append(fits.empty_primary())
            extra += [("XISFCPLX", True), ("XISFWID", image.geometry[0]), ("XISFHEI", image.geometry[1]), ("XISFCHN", image.channels)]
            units.append(fits.table_hdu(["COMPLEX"], ["1C" if image.sample_format == "Complex32" else "1M"], [x.ravel()], extra))
            continue
        stored, bits, zero = _stored(x.astype(x.dtype.newbyteorder("=")))
        planes = stored.reshape(-1, *stored.shape[-2:])
        units.append(fits.image_hdu(planes[0] if len(planes) == 1 else planes, bits, extension=bool(units), bscale=1 if zero else None, bzero=zero or None, extra=extra))
    if not units:
        units.append(fits.empty_primary())
    kept = {p.id: p.value for p in unit.properties}
    layout = json.loads(kept.get("FITS:PreservedHDULayout") or "[]")
    if layout:
        return _with_kept_units(units, [(x["index"], bytes(kept[f"FITS:HDU{x['index']}"])) for x in layout if f"FITS:HDU{x['index']}" in kept])
    if meta_extension:
        rows = [{"id": p.id, "type": p.type, "value": str(p.value) if isinstance(p.value, complex) else p.value} for p in (*unit.metadata, *unit.properties)]
        text = json.dumps(rows)
        units.append(fits.table_hdu(["JSON"], [f"{max(len(text), 1)}A"], [[text]], name="XISF_META"))
    return fits.write(units)


def _with_kept_units(images: list, kept: list[tuple[int, bytes]]) -> bytes:
    """A file of image units with units that were kept whole at the places where they stood. A first unit that is no primary one follows an empty one."""
    out: list[bytes] = []
    raw, places = dict(kept), iter([fits.write([x]) for x in images])
    for i in range(len(images) + len(kept)):
        if i in raw:
            out.append(raw[i])
        elif (unit := next(places, None)) is not None:
            out.append(unit)
    out += [x for x in places] + [x for i, x in sorted(raw.items()) if i >= len(images) + len(kept)]
    if out and not out[0].startswith(b"SIMPLE"):
        out.insert(0, fits.write([fits.empty_primary()]))
    return b"".join(out)


def _typed(text: str) -> fits.Value:
    return fits.parse_value(text)[2]


def fits_to_xisf(data: bytes, **options) -> bytes:
    """An image per image unit; keywords keep their text; other units are kept whole in a property with their places."""
    images, others, properties = [], [], []
    for h in fits.hdus(data):
        head = h.header
        if head.kind == "image":
            body = fits.data_of(data, h)
            zero, bits = head.number("BZERO", 0), int(head.number("BITPIX"))
            raw = np.frombuffer(body, fits._PIXEL[bits])
            name = next((k for k, (b, o) in _OFFSETS.items() if b == bits and o == zero and head.number("BSCALE", 1) == 1), None)
            if name:
                kind = np.dtype(xisf.SAMPLES[name])
                x = raw.astype(raw.dtype.newbyteorder("=")).view(kind) ^ kind.type(_OFFSETS[name][1])
            else:
                x = fits.decode_pixels(body, bits, head.number("BSCALE", 1), zero)
                x = x if x.dtype in (np.uint8, np.float32, np.float64) else x.astype(np.float64)
                name = {"uint8": "UInt8", "float32": "Float32", "float64": "Float64"}[x.dtype.name]
            axes = head.axes
            geometry = [axes[0], axes[1] if len(axes) > 1 else 1, int(np.prod(axes[2:])) if len(axes) > 2 else 1]
            keywords = [(c.key, c.raw, c.comment) for c in head.ordered() if not _is_structure(c.key)]
            images.append(xisf.Image(geometry, name, "RGB" if geometry[2] == 3 else "Gray", bounds=(0.0, 1.0) if name.startswith("Float") else None, data=x.astype(x.dtype.newbyteorder("<")).tobytes(), keywords=keywords))
        elif head.kind != "none":
            end = h.data_offset + h.data_length
            others.append({"index": h.index, "size": end + fits.padding(h.data_length) - h.header_offset})
            properties.append(xisf.Property(f"FITS:HDU{h.index}", "ByteArray", list(data[h.header_offset : end + fits.padding(h.data_length)])))
    properties.append(xisf.Property("FITS:PreservedHDULayout", "String", json.dumps(others)))
    meta = [xisf.Property("XISF:CreatorApplication", "String", "skylattice")]
    return xisf.write(xisf.Unit(metadata=meta, images=images, properties=properties), **options)


CONVERSIONS = {
    ("ser", "fits"): ser_to_fits, ("fits", "ser"): fits_to_ser, ("ser", "xisf"): ser_to_xisf, ("xisf", "ser"): xisf_to_ser, ("xisf", "fits"): xisf_to_fits,
    ("fits", "xisf"): fits_to_xisf,
}


def convert(data: bytes, way: Sequence[str]) -> bytes:
    """Convert through a sequence of formats: ("ser", "fits", "ser")."""
    for a, b in zip(way, way[1:], strict=False):
        if (a, b) not in CONVERSIONS:
            raise (XisfValidationError if "xisf" in (a, b) else FitsDataError)(f"{a} to {b}")
        data = CONVERSIONS[a, b](data)
    return data
