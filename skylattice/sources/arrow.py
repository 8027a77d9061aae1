"""Arrow kernels between files as binary rows (path, content) and tables of their parts.

A row of input holds one file, as ``spark.read.format("binaryFile")`` gives it; outputs hold at most
one frame, tile or table row each. Readers decode a batch of files at a time and yield as they go.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skylattice.formats import fits, ser, tiles
from skylattice.sources import columns

#: Rows of a decoded table in one Arrow batch.
ROWS = 16_384
#: Rows, and bytes, that kernels which hold Python values or whole files take at a time; and bytes of a batch that Spark sends them.
STEP_ROWS, STEP_BYTES, BATCH_BYTES = 256, 4 << 20, 16 << 20

HDUS = (
    "path string, hdu_index int, xtension string, extname string, data_type string, bitpix int, naxis array<long>, bzero double, bscale double, "
    "pcount long, gcount int, header_offset long, data_offset long, data_length long, has_data boolean"
)
CARDS = (
    "path string, hdu_index int, card_index int, key string, value_raw string, kind string, value_str string, value_num double, "
    "value_bool boolean, comment string"
)
FRAMES = "path string, hdu_index int, frame int, width int, height int, dtype string, pixels array<double>"


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T._parse_datatype_string(ddl)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over tasks by ``keys``: a table of few bytes lies in one or two partitions, however much work its rows are. For rows of keys and short values."""
    return rows.repartition(max(24, 3 * rows.sparkSession.sparkContext.defaultParallelism), *keys)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends Python batches of at most 16 MiB (of 64 by default)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded rows and bytes, so that what is made of a slice is bounded, too."""
    for batch in batches:
        size = max(1, min(STEP_ROWS, STEP_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _weight(row: dict) -> int:
    """Bytes that a row's arrays, texts and lists hold, about."""
    return sum(v.nbytes if isinstance(v, np.ndarray) else 8 * len(v) if isinstance(v, list) else len(v) for v in row.values() if isinstance(v, np.ndarray | bytes | str | list))


def _emit(files: DataFrame, schema: str | T.StructType, rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """Rows that ``rows(path, content)`` gives for each file; null contents give none."""
    kind = schema_of(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        weight = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                for row in rows(path.as_py(), content.as_py()):
                    held.append(row)
                    weight += _weight(row)
                    if len(held) >= STEP_ROWS or weight >= STEP_BYTES:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return bounded(files.select("path", "content")).mapInArrow(run, kind)


def hdu_row(path: str, h: fits.Hdu) -> dict:
    head = h.header
    return {
        "path": path, "hdu_index": h.index, "xtension": str(head.get("XTENSION", "")).strip() or None, "extname": head.get("EXTNAME"),
        "data_type": head.kind, "bitpix": int(head.number("BITPIX")), "naxis": head.axes, "bzero": float(head.number("BZERO", 0)),
        "bscale": float(head.number("BSCALE", 1)), "pcount": int(head.number("PCOUNT")), "gcount": int(head.number("GCOUNT", 1)),
        "header_offset": h.header_offset, "data_offset": h.data_offset, "data_length": h.data_length, "has_data": head.has_data,
    }


def card_rows(path: str, h: fits.Hdu) -> Iterator[dict]:
    for c in h.header.ordered():
        number = isinstance(c.value, int | float) and not isinstance(c.value, bool)
        yield {
            "path": path, "hdu_index": h.index, "card_index": c.index, "key": c.key, "value_raw": c.raw, "kind": c.kind,
            "value_str": c.value if isinstance(c.value, str) else None, "value_num": float(c.value) if number else None,
            "value_bool": c.value if isinstance(c.value, bool) else None, "comment": c.comment,
        }


def frame_rows(path: str, content: bytes, h: fits.Hdu, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    data = fits.data_of(content, h)
    if h.header.kind == "compressed_image":
        planes: Iterator[tuple[int, np.ndarray]] = iter([(0, tiles.decode_image(data, h.header))])
    else:
        count = fits.frame_count(h.header)
        planes = ((i, fits.frame(data, h.header, i)) for i in range(start, min(count, count if stop is None else stop)))
    for i, x in planes:
        yield {"path": path, "hdu_index": h.index, "frame": i, "width": x.shape[1], "height": x.shape[0], "dtype": str(x.dtype), "pixels": x.ravel().astype(np.float64)}


def read_hdus(files: DataFrame) -> DataFrame:
    return _emit(files, HDUS, lambda path, data: (hdu_row(path, h) for h in fits.hdus(data)))


def read_cards(files: DataFrame) -> DataFrame:
    return _emit(files, CARDS, lambda path, data: (r for h in fits.hdus(data) for r in card_rows(path, h)))


def read_issues(files: DataFrame) -> DataFrame:
    """What each header does against the standard."""
    return _emit(files, "path string, hdu_index int, level string, code string, key string", lambda path, data: (
        {"path": path, "hdu_index": h.index, "level": a, "code": b, "key": c} for h in fits.hdus(data) for a, b, c in fits.verify(h.header)))


def read_frames(files: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """One row per image plane, frames ``start`` to ``stop`` of each image."""
    return _emit(files, FRAMES, lambda path, data: (
        r for h in fits.hdus(data) if h.header.kind in ("image", "compressed_image") for r in frame_rows(path, data, h, start, stop)))


def read_table(files: DataFrame, schema: str | T.StructType, hdu: int = 1, start: int = 0, count: int | None = None, row: str | None = None) -> DataFrame:
    """Rows of the table in each file's unit ``hdu``; only the columns that ``schema`` names are decoded.

    Columns are decoded as NumPy arrays and go to Arrow without Python values where their type
    allows. ``row`` names a column for the row's number in its table.
    """
    kind = schema_of(schema)
    arrow = to_arrow_schema(kind)
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.is_valid:
                    continue
                data = content.as_py()
                unit = next((h for h in fits.scan(fits.reader_of(data), len(data)) if h.index == hdu), None)
                if unit is None:
                    continue
                body = fits.data_of(data, unit)
                if unit.header.kind == "table":
                    found = fits.decode_ascii(body, unit.header)
                else:
                    cells, heap = fits.split_table(body, unit.header)
                    cells = cells[start : None if count is None else start + count]
                    found = {c.name: columns.decode(cells, heap, c) for c in fits.columns(unit.header) if c.name in names}
                if row:
                    size = len(next(iter(found.values()), []))
                    found[row] = np.arange(start, start + size)
                yield from pa.table([as_array(found[f.name], f.type) for f in arrow], schema=arrow).to_batches(ROWS)

    return files.select("content").mapInArrow(run, kind)


def as_array(values: pa.Array | np.ndarray | list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind) if isinstance(values, list) else (values if isinstance(values, pa.Array) else pa.array(values, from_pandas=False)).cast(kind)


def _to_numpy(column: pa.Array) -> list | np.ndarray:
    kind = column.type
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) else column.to_pylist()


def write_tables(df: DataFrame, forms: Sequence[str], ascii_: bool = False, places: bool = True, extra: fits.Cards = ()) -> DataFrame:
    """(path, content): a file per batch of rows, an empty primary unit and a table with the columns of ``df``."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            if ascii_:
                unit = fits.ascii_hdu(names, forms, [_to_numpy(c) for c in batch.columns], places)
            else:
                unit = fits.table_hdu(names, forms, [columns.encode(c, f) for c, f in zip(batch.columns, forms, strict=True)], extra)
            yield pa.record_batch([[f"part-{part}-{i}.fits"], pa.array([fits.write([fits.empty_primary(), unit])], pa.binary())], ["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


def write_images(df: DataFrame, bitpix: int, bscale: float | None = None, bzero: float | None = None, codec: str | None = None, tile: tuple[int, int] | None = None) -> DataFrame:
    """(path, content): a file per row (path, width, height, depth, pixels); pixels are stored as given, or tile by tile with a codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for width, height, depth, pixels in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "depth")), batch.column("pixels"), strict=True):
                x = pixels.values.to_numpy(zero_copy_only=False).reshape((depth, height, width) if depth > 1 else (height, width))
                if codec:
                    data = fits.write([fits.empty_primary(), tiles.image_hdu(x.astype(np.int64), codec, bitpix, tile)])
                else:
                    data = fits.write([fits.image_hdu(x, bitpix, bscale=bscale, bzero=bzero)])
                out.append(data)
            yield pa.record_batch([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return bounded(df.select("path", "width", "height", "depth", "pixels")).mapInArrow(run, "path string, content binary")


SER_FILES = (
    "path string, file_id string, lu_id int, color_id int, byte_order string, width int, height int, pixel_depth int, frame_count int, "
    "observer string, instrument string, telescope string, start_ticks decimal(20,0), start_utc_ticks decimal(20,0), channel_count int, "
    "bytes_per_sample int, frame_bytes long, warnings array<struct<code:string,message:string>>"
)
SER_FRAMES = "path string, frame int, offset long, byte_length long, ts_ticks decimal(20,0), samples array<int>"


def read_ser_files(files: DataFrame, strict: bool = True, policy: str = "compat") -> DataFrame:
    from decimal import Decimal

    def rows(path: str, data: bytes) -> Iterator[dict]:
        f = ser.parse(fits.reader_of(data), len(data), strict, policy)
        h = f.header
        yield {
            "path": path, "file_id": h.file_id, "lu_id": h.lu_id, "color_id": h.color_id, "byte_order": h.byte_order, "width": h.width, "height": h.height,
            "pixel_depth": h.pixel_depth, "frame_count": f.frames, "observer": h.observer, "instrument": h.instrument, "telescope": h.telescope,
            "start_ticks": Decimal(h.start_ticks), "start_utc_ticks": Decimal(h.start_utc_ticks), "channel_count": h.channels,
            "bytes_per_sample": h.sample_bytes, "frame_bytes": h.frame_bytes, "warnings": [{"code": a, "message": b} for a, b in h.warnings],
        }

    return _emit(files, SER_FILES, rows)


def read_ser_frames(files: DataFrame, strict: bool = True, policy: str = "compat", rgb: bool = False) -> DataFrame:
    """One row per frame; ``rgb`` turns samples into interleaved RGB."""
    from decimal import Decimal

    def rows(path: str, data: bytes) -> Iterator[dict]:
        f = ser.parse(fits.reader_of(data), len(data), strict, policy)
        for i in range(f.frames):
            raw = data[f.offset(i) : f.offset(i) + f.header.frame_bytes]
            x = ser.samples(raw, f.header)
            x = ser.to_rgb(x, f.header).ravel() if rgb else x
            yield {"path": path, "frame": i, "offset": f.offset(i), "byte_length": len(raw), "ts_ticks": Decimal(f.timestamps[i]) if f.timestamps else None, "samples": x.astype(np.int32)}

    return _emit(files, SER_FRAMES, rows)


def write_ser(frames: DataFrame, key: str, width: int, height: int, pixel_depth: int, color_id: int = 0) -> DataFrame:
    """(path, content): a sequence per value of ``key`` from rows (key, frame, ts_ticks, samples), in the order of frame.

    A sequence is one file, so its frames meet in one task; sequences are spread over tasks.
    """

    def run(name, table):
        rows = sorted(table.select(["frame", "ts_ticks", "samples"]).to_pylist(), key=lambda r: r["frame"])
        kind = np.uint8 if pixel_depth <= 8 else "<u2"
        raw = [np.array(r["samples"]).astype(kind).tobytes() for r in rows]
        data = ser.write(raw, width, height, pixel_depth, color_id, [int(r["ts_ticks"]) for r in rows])
        return pa.table({"path": [str(name[0].as_py())], "content": pa.array([data], pa.binary())})

    return frames.groupBy(key).applyInArrow(run, "path string, content binary")


def write_xisf_images(df: DataFrame, sample_format: str, bounds: tuple[float, float] | None = None, distributed: bool = False, **options) -> DataFrame:
    """(path, content): a unit per row (path, width, height, pixels and, if there, keywords: array of name, value, comment; elements: map of map).

    A distributed unit is two files in the folder ``path``: unit.xish and blocks.xisb.
    """
    from skylattice.formats import xisf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            paths, out = [], []
            for r, pixels in zip(batch.drop_columns(["pixels"]).to_pylist(), batch.column("pixels"), strict=True):
                x = pixels.values.to_numpy(zero_copy_only=False).astype(xisf.SAMPLES[sample_format]).reshape(-1, r["height"], r["width"])
                keywords = [(k["name"], k["value"], k["comment"]) for k in r.get("keywords") or ()]
                elements = {k: {a: [float(n) for n in b.split(":")] if ":" in b else b for a, b in v} for k, v in r.get("elements") or ()}
                image = xisf.Image([r["width"], r["height"], len(x)], sample_format, bounds=bounds, data=x.tobytes(), keywords=keywords, elements=elements, id="main")
                unit = xisf.Unit(metadata=[xisf.Property("XISF:CreatorApplication", "String", "skylattice")], images=[image])
                if distributed:
                    out += xisf.write_distributed(unit, **options)
                    paths += [f"{r['path']}/unit.xish", f"{r['path']}/blocks.xisb"]
                else:
                    out.append(xisf.write(unit, **options))
                    paths.append(r["path"])
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return bounded(df).mapInArrow(run, "path string, content binary")


def write_zip(files: DataFrame, key: str) -> DataFrame:
    """(path, content): an archive per value of ``key`` of rows (key, path, content). An archive's files meet in one task."""
    from skylattice.formats import archive

    def run(name: tuple, table: pa.Table) -> pa.Table:
        some = dict(zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True))
        return pa.table({"path": [f"{name[0].as_py()}.zip"], "content": pa.array([archive.pack(some)], pa.binary())})

    return files.select(key, "path", "content").groupBy(key).applyInArrow(run, "path string, content binary")


def read_zip(files: DataFrame) -> DataFrame:
    """(path, content) of the files in archives; paths begin with the archive's."""
    from skylattice.formats import archive

    return _emit(files, "path string, content binary", lambda path, data: ({"path": f"{path}/{k}", "content": v} for k, v in archive.unpack(data).items()))


def convert(files: DataFrame, *way: str) -> DataFrame:
    """(path, content) of each file converted through formats, such as "ser", "fits", "xisf"."""
    from skylattice.formats.convert import convert as one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array([path]), pa.array([one(content, way)], pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


XISF_IMAGES = (
    "path string, image int, id string, geometry array<long>, channel_count int, sample_format string, pixel_storage string, color_space string, "
    "bounds array<double>, byte_order string, data binary"
)
_VALUES = "value_str string, value_num double, value_exact decimal(20,0), vec array<double>, rows int, cols int"
XISF_PROPERTIES = f"path string, scope string, image int, id string, type string, format string, comment string, {_VALUES}"
XISF_CELLS = f"path string, table_id string, row int, pos int, field_id string, type string, {_VALUES}"
XISF_KEYWORDS = "path string, image int, name string, value string, comment string"
XISF_ELEMENTS = "path string, image int, element string, values map<string,string>, data binary"
_XISF_VIEWS = {"images": XISF_IMAGES, "properties": XISF_PROPERTIES, "cells": XISF_CELLS, "keywords": XISF_KEYWORDS, "elements": XISF_ELEMENTS, "described": XISF_ELEMENTS}


def read_xisf(files: DataFrame, view: str = "images", strict: bool = True, verify: bool = True, decode_images: bool = True, blocks: DataFrame | None = None, signature_policy: str = "require") -> DataFrame:
    """images, properties, cells, keywords, elements (an image's descriptive ones) or described (those and the keywords, as elements) of XISF units.

    ``blocks`` are the files (path, content) in which distributed units keep their data: a header
    file of folder f finds ``path(@header_dir/name)`` as f/name, and other targets by their whole
    text. Headers and blocks meet by folder, so a folder's files are in one task.
    """
    rows = _xisf_rows(view, strict, verify, decode_images, signature_policy)
    if blocks is None:
        return _emit(files, _XISF_VIEWS[view], rows)
    kind = schema_of(_XISF_VIEWS[view])
    arrow = to_arrow_schema(kind)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)

    def run(key: tuple, headers: pa.Table, parts: pa.Table) -> pa.Table:
        held = dict(zip(parts.column("block_path").to_pylist(), parts.column("block").to_pylist(), strict=True))

        def resolve(_: str, target: str) -> bytes:
            if target not in held:
                from skylattice.errors import XisfResourceError

                raise XisfResourceError(f"no file {target!r}")
            return held[target]

        out = [r for path, data in zip(headers.column("path").to_pylist(), headers.column("content").to_pylist(), strict=True) if data is not None for r in rows(path, data, resolve, key[0].as_py())]
        return pa.Table.from_pylist(out, arrow)

    named = files.select(folder.alias("folder"), "path", "content").groupBy("folder")
    parts = blocks.select(folder.alias("folder"), F.col("path").alias("block_path"), F.col("content").alias("block")).groupBy("folder")
    return named.cogroup(parts).applyInArrow(run, kind)


def _xisf_rows(view: str, strict: bool, verify: bool, decode_images: bool, signature_policy: str) -> Callable[..., Iterator[dict]]:
    from skylattice.formats import xisf

    def rows(path: str, data: bytes, resolve: xisf.Resolver | None = None, directory: str = "") -> Iterator[dict]:
        unit = xisf.read(data, resolve, directory, strict=strict, verify=verify, decode_images=decode_images and view == "images", signature_policy=signature_policy)
        if view == "images":
            for i, x in enumerate(unit.images):
                yield {
                    "path": path, "image": i, "id": x.id, "geometry": x.geometry, "channel_count": x.channels, "sample_format": x.sample_format,
                    "pixel_storage": x.pixel_storage, "color_space": x.color_space, "bounds": list(x.bounds) if x.bounds else None, "byte_order": x.byte_order, "data": x.data,
                }
        elif view == "properties":
            scopes = [("metadata", None, unit.metadata), ("unit", None, unit.properties), *(("image", i, x.properties) for i, x in enumerate(unit.images))]
            for scope, i, some in scopes:
                for p in some:
                    yield {"path": path, "scope": scope, "image": i, "id": p.id, "type": p.type, "format": p.format, "comment": p.comment, **xisf.value_columns(p)}
        elif view == "cells":
            for t in unit.tables:
                for r, cells in enumerate(t.rows):
                    for pos, p in enumerate(cells):
                        yield {"path": path, "table_id": t.id, "row": r, "pos": pos, "field_id": p.id, "type": p.type, **xisf.value_columns(p)}
        elif view == "keywords":
            for i, x in enumerate(unit.images):
                for name, value, comment in x.keywords:
                    yield {"path": path, "image": i, "name": name, "value": value, "comment": comment}
        else:
            for i, x in enumerate(unit.images):
                for name, values in x.elements.items():
                    some = {k: ":".join(f"{n:g}" for n in v) if isinstance(v, list) else f"{v:g}" if isinstance(v, float) else str(v) for k, v in values.items() if k != "data" and v is not None}
                    yield {"path": path, "image": i, "element": name, "values": some, "data": values.get("data")}
                for name, value, comment in x.keywords if view == "described" else ():
                    yield {"path": path, "image": i, "element": "FITSKeyword", "values": {"name": name, "value": value, "comment": comment}, "data": None}

    return rows


def write_xisf_tables(df: DataFrame, table_id: str, kinds: Sequence[str]) -> DataFrame:
    """(path, content): a unit per batch of rows, with the columns of ``df`` as the fields of one table."""
    from skylattice.formats import xisf

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            rows = [[xisf.Property(n, k, v) for n, k, v in zip(names, kinds, r, strict=True)] for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            unit = xisf.Unit(tables=[xisf.Table(table_id, list(zip(names, kinds, strict=True)), rows)])
            yield pa.record_batch([[f"part-{part}-{i}.xisf"], pa.array([xisf.write(unit)], pa.binary())], ["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


def write_xisf_references(refs: DataFrame, elements: DataFrame, key: str, per_unit: int = 4096) -> DataFrame:
    """(path, content): units with the elements (uid, value) that references (key, uid) name, and a table per reference.

    A table is called by its reference's key and holds the element's row and the unit's structure
    through Reference elements. Elements and references meet by uid; a unit holds at most
    ``per_unit`` references and the elements that they name. References to no element are left out.
    """
    import xml.etree.ElementTree as ET

    from skylattice.formats import xisf

    spark = refs.sparkSession
    parts = max(1, refs.count() // (4 * per_unit), int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part")

    def run(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        values = dict(zip(right.column("uid").to_pylist(), right.column("value").to_pylist(), strict=True))
        named = sorted((u, k) for k, u in zip(left.column(key).to_pylist(), left.column("uid").to_pylist(), strict=True) if u in values)
        files = []
        for i in range(0, len(named), per_unit):
            some = named[i : i + per_unit]
            root = ET.Element("xisf", {"version": "1.0", "xmlns": xisf.NAMESPACE})
            home = ET.SubElement(root, "Elements")
            fields = ET.SubElement(home, "Structure", {"uid": "structure"})
            ET.SubElement(fields, "Field", {"id": "value", "type": "String"})
            for u in dict.fromkeys(u for u, _ in some):
                row = ET.SubElement(home, "Row", {"uid": f"row{u}"})
                cell = ET.SubElement(row, "Cell", {} if values[u] is not None else {"type": "Boolean", "value": "false"})
                cell.text = values[u]
            for u, k in some:
                t = ET.SubElement(root, "Table", {"id": str(k), "rows": "1", "columns": "1"})
                ET.SubElement(t, "Reference", {"ref": "structure"})
                ET.SubElement(t, "Reference", {"ref": f"row{u}"})
            files.append((f"part-{group[0].as_py()}-{i}.xisf", b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root)))
        return pa.table({"path": pa.array([p for p, _ in files], pa.string()), "content": pa.array([c for _, c in files], pa.binary())})

    known = elements.where("uid IS NOT NULL").select(part, "uid", "value").groupBy("part")
    wanted = refs.where("uid IS NOT NULL").select(part, key, "uid").groupBy("part")
    return wanted.cogroup(known).applyInArrow(run, "path string, content binary")
