"""Sky pyramids as DataFrames: building tiles from an image, mosaics, maps and cutouts from tiles, and linting trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.errors import HipsError
from skylattice.formats import convert, fits, hips, tiles as compressed, xisf
from skylattice.functions import sky, text
from skylattice.operators.images import finite_mean

TILES = "order int, ipix long, width int, depth int, data array<float>"
#: Samples of a source image that are broadcast to the tasks, at most; larger images are cut into row blocks first.
SOURCE_SAMPLES = 64_000_000
MAX_TILES = 200_000


def build_tiles(spark: SparkSession, planes: np.ndarray, wcs: hips.Wcs, order: int = 0, min_order: int = 0, tile_width: int = 512, interpolation: str = "bilinear", blank: float = float("nan"), max_tiles: int = MAX_TILES) -> DataFrame:
    """Tiles of all orders that an image touches, every order resampled from the image itself; order 0 means the image's own.

    The image is broadcast, its size checked; tiles are dealt to tasks by number, so the work is
    spread evenly and nothing but tile numbers is shuffled.
    """
    if planes.size > SOURCE_SAMPLES:
        raise HipsError(f"an image of {planes.size} samples must be cut into blocks of {SOURCE_SAMPLES}")
    height, width = planes.shape[1:]
    top = order or hips.estimate_order(max(width, height), tile_width)
    lon, lat, radius = hips.footprint(wcs, width, height)
    todo = None
    for k in range(min_order, top + 1):
        some = sky.disc_tiles(spark, k, lon, lat, radius).select(F.lit(k).alias("order"), "ipix")
        todo = some if todo is None else todo.union(some)
    per_order = todo.groupBy("order").count().where(F.col("count") > max_tiles).head()
    if per_order:
        raise HipsError(f"over {max_tiles} tiles at order {per_order['order']}")
    shared = spark.sparkContext.broadcast(planes.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tile = hips.reproject(shared.value, wcs, k, i, tile_width, interpolation, blank)
                yield pa.record_batch(
                    [pa.array([k], pa.int32()), pa.array([i]), pa.array([tile_width], pa.int32()), pa.array([len(tile)], pa.int32()), pa.array([tile.ravel()], pa.list_(pa.float32()))],
                    ["order", "ipix", "width", "depth", "data"],
                )

    return todo.repartition(spark.sparkContext.defaultParallelism, "order", "ipix").mapInArrow(run, TILES)


def encode_tiles(tiles: DataFrame, kind: str = "fits", frame: str = "equatorial") -> DataFrame:
    """(path, content) of tile files; cubes are written as FITS only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = [], []
            for r in batch.to_pylist():
                x = np.array(r["data"], np.float32).reshape(r["depth"], r["width"], r["width"])
                if kind != "fits" and r["depth"] > 1:
                    continue
                paths.append(hips.tile_path(r["order"], r["ipix"], hips.EXTENSION[kind]))
                data.append(hips.encode_tile(x, r["order"], r["ipix"], kind, frame))
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(data, pa.binary())], ["path", "content"])

    return tiles.select("order", "ipix", "width", "depth", "data").mapInArrow(run, "path string, content binary")


def decode_tiles(files: DataFrame) -> DataFrame:
    """Tiles of (path, content) rows, one row per tile: of several formats the first of fits, png counts."""
    p = text.parse_tile_path("path")
    rank = F.when(p["format"] == "fits", 0).otherwise(1)
    first = F.row_number().over(Window.partitionBy(p["order"], p["ipix"]).orderBy(rank))
    rows = files.where(p.isNotNull()).select(p["order"].alias("order"), p["ipix"].alias("ipix"), p["format"].alias("format"), "content", first.alias("_n")).where("_n = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hips.decode_tile(c, f) for c, f in zip(batch.column("content").to_pylist(), batch.column("format").to_pylist(), strict=True)]
            yield pa.record_batch(
                [batch.column("order"), batch.column("ipix"), pa.array([x.shape[2] for x in found], pa.int32()), pa.array([x.shape[0] for x in found], pa.int32()), pa.array([x.ravel() for x in found], pa.list_(pa.float32()))],
                ["order", "ipix", "width", "depth", "data"],
            )

    return rows.select("order", "ipix", "format", "content").mapInArrow(run, TILES)


def map_values(tiles: DataFrame, order: int, ordering: str = "NESTED") -> DataFrame:
    """(ipix, value): the mean of each tile's finite pixels."""
    ipix = F.col("ipix") if ordering == "NESTED" else sky.nest_to_ring(order, F.col("ipix"))
    return tiles.where(F.col("order") == order).select(ipix.alias("ipix"), finite_mean(F.transform("data", lambda x: x.cast("double"))).cast("float").alias("value"))


def cutout(tiles: DataFrame, wcs: hips.Wcs, width: int, height: int, order: int, interpolation: str = "bilinear") -> DataFrame:
    """(y, x, value) of an output image: each pixel finds its tile, and tiles sample their own pixels.

    The join is on the tile number, a row per output pixel on one side and per tile on the other.
    A tile that is missing leaves its pixels null.
    """
    spark = tiles.sparkSession
    w = sky.wcs(*map(float, wcs))
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    world = sky.pixel_to_world(w, F.col("x").cast("double"), F.col("y").cast("double"))
    grid = grid.withColumn("p", sky.let(lambda s: sky.lonlat_to_nest(order, s["w"]["lon"], s["w"]["lat"]), w=world))
    grid = grid.select("y", "x", F.col("p.ipix").alias("ipix"), F.col("p.x").alias("fx"), F.col("p.y").alias("fy"))
    points = grid.groupBy("ipix").agg(F.collect_list(F.struct("y", "x", "fx", "fy")).alias("points"))
    joined = points.join(tiles.where(F.col("order") == order).select("ipix", F.col("width").alias("w"), "data"), "ipix", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = r["points"]
                if r["data"] is None:
                    values: list = [None] * len(p)
                else:
                    n = r["w"]
                    plane = np.array(r["data"][: n * n], np.float64).reshape(n, n)
                    fx, fy = np.array([a["fx"] for a in p]) * n, np.array([a["fy"] for a in p]) * n
                    values = hips.sample(plane, fx, fy, interpolation).tolist()
                yield pa.record_batch([pa.array([a["y"] for a in p], pa.int32()), pa.array([a["x"] for a in p], pa.int32()), pa.array(values, pa.float64())], ["y", "x", "value"])

    return joined.select("ipix", "points", "w", "data").mapInArrow(run, "y int, x int, value double")


def lint(files: DataFrame, properties: str | None) -> DataFrame:
    """(level, code, subject) for a tree of (path) rows. Tiles are judged one by one; only counts meet in one row."""
    spark = files.sparkSession
    values = hips.parse_properties(properties or "")
    if properties is None:
        return spark.createDataFrame(hips.lint([], None), "level string, code string, subject string")
    # Rules of one path need that path alone; the rest needs whether there is any Allsky, MOC or tile.
    per_path = F.col("path")
    p = text.parse_tile_path("path")
    most = values.get("hips_order", "")
    formats = [hips.EXTENSION[f] for f in ("jpeg" if x == "jpg" else x for x in hips.formats_of(values.get("hips_tile_format", ""))) if f in hips.EXTENSION]
    cube = values.get("dataproduct_type") in ("cube", "spectral-cube")
    named = F.regexp_extract(per_path, r"([^/]*)$", 1).startswith("Npix")
    allsky = per_path.rlike(r"(^|/)Norder\d+/Allsky\.")
    rule = lambda cond, level, code: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), per_path.alias("subject")))
    rules = [
        rule(allsky & ~per_path.rlike(r"Norder3/Allsky\."), "warning", "ALLSKY_ORDER_UNEXPECTED"),
        rule(allsky & ~F.regexp_extract(per_path, r"\.(\w+)$", 1).isin(formats or [""]), "warning", "ALLSKY_FORMAT_UNDECLARED"),
        rule(named & p.isNull(), "warning", "UNRECOGNIZED_TILE_NAME"),
        rule(p["order"] > F.lit(int(most) if most.isdigit() else 99), "error", "TILE_ORDER_EXCEEDS_MAX"),
        rule(p.isNotNull() & ~p["format"].isin(formats or [""]), "error", "TILE_FORMAT_UNDECLARED"),
        rule(p.isNotNull() & p["spectral_order"].isNull() & F.lit(cube), "error", "CUBE_TILE_PATTERN_EXPECTED"),
        rule(p["spectral_order"].isNotNull() & F.lit(not cube), "error", "UNEXPECTED_CUBE_TILE_PATTERN"),
    ]
    each = files.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select("i.*")
    found = files.agg(F.count_if(allsky).alias("a"), F.count_if(per_path.rlike(r"(^|/)Moc\.fits$")).alias("m"), F.count_if(p.isNotNull()).alias("t"))
    missing = [("a", "warning", "ALLSKY_MISSING", "Allsky"), ("m", "warning", "MOC_MISSING", "Moc.fits"), ("t", "error", "NO_TILES_FOUND", "")]
    whole = found.select(F.explode(F.filter(F.array(*(F.when(F.col(c) == 0, F.struct(F.lit(x).alias("level"), F.lit(y).alias("code"), F.lit(z).alias("subject"))) for c, x, y, z in missing)), lambda x: x.isNotNull())).alias("i")).select("i.*")
    own = spark.createDataFrame(hips.check_properties(values), "level string, code string, subject string")
    return own.union(each).union(whole)


def _halved(tiles: DataFrame, most: int) -> DataFrame:
    """(ipix, depth, data as bytes) of tiles that are halved, where they are, until they are ``most`` pixels wide or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                planes = list(np.array(r["data"], np.float32).reshape(r["depth"], r["width"], r["width"]))
                while planes[0].shape[0] > most:
                    planes = [hips.downsample(x).astype(np.float32) for x in planes]
                out.append(np.stack(planes).tobytes())
            yield pa.record_batch([batch.column("ipix"), batch.column("depth"), pa.array(out, pa.binary())], ["ipix", "depth", "data"])

    return tiles.select("ipix", "depth", "width", "data").mapInArrow(run, "ipix long, depth int, data binary")


def write_tree(tiles: DataFrame, root: str, title: str, order: int, tile_width: int, formats: tuple[str, ...] = ("fits",), frame: str = "equatorial", properties: dict[str, str] | None = None) -> dict[str, str]:
    """Write tile files, properties, Allsky, MOC and an index page under a local or mounted folder; returns the properties.

    Tiles are written by the tasks that made them. The MOC needs the top order's tile numbers and
    the Allsky the order-3 (or top) tiles, at most 768 of them. ``properties`` add to the usual ones.
    """
    import os

    values = hips.default_properties(
        creator_did=f"ivo://local/{title.replace(' ', '-')}", obs_title=title, hips_frame=frame, hips_order=str(order), hips_tile_width=str(tile_width), hips_tile_format=" ".join(formats))
    values |= properties or {}
    for kind in formats:

        def save(rows, root=root):
            for r in rows:
                path = os.path.join(root, r["path"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + ".part", "wb") as f:
                    f.write(r["content"])
                os.replace(path + ".part", path)  # a task that runs again writes the same file

        encode_tiles(tiles, kind, frame).foreachPartition(save)
    low = min(order, 3)
    planes: list[list[tuple[int, np.ndarray]]] = [[]]
    width = tile_width
    while width > 64:
        width //= 2
    for r in _halved(tiles.where(F.col("order") == low), 64).toLocalIterator():
        for z, x in enumerate(np.frombuffer(r["data"], np.float32).reshape(r["depth"], width, width)):
            if z == len(planes):
                planes.append([])
            planes[z].append((r["ipix"], x))
    mosaic = np.stack([hips.allsky(p, low, width) for p in planes])
    os.makedirs(os.path.join(root, f"Norder{low}"), exist_ok=True)
    files = {
        f"Norder{low}/Allsky.fits": fits.write([fits.image_hdu(mosaic[0] if len(mosaic) == 1 else mosaic, -32)]),
        "Moc.fits": hips.moc(order, [r["ipix"] for r in tiles.where(F.col("order") == order).select("ipix").toLocalIterator()]),
        "properties": hips.format_properties(hips.compatible_properties(values)).encode(),
        "index.html": hips.index_page(title).encode(),
    }
    for name, data in files.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    return values


# -- conversions from and to trees


def _image_of(data: bytes) -> tuple[np.ndarray, hips.Wcs]:
    """All planes and the world coordinates of a file's first image unit, plain or tile-compressed."""
    for h in fits.hdus(data):
        if h.header.kind == "compressed_image":
            return compressed.decode_image(fits.data_of(data, h), h.header)[None], hips.wcs_of(h.header)
        if h.header.kind == "image" and fits.frame_count(h.header):
            body = fits.data_of(data, h)
            return np.stack([fits.frame(body, h.header, i) for i in range(fits.frame_count(h.header))]), hips.wcs_of(h.header)
    raise HipsError("no image")


def fits_to_hips(spark: SparkSession, data: bytes, root: str, title: str, order: int = 0, min_order: int = 0, tile_width: int = 512, interpolation: str = "bilinear", blank: float = float("nan"), formats: tuple[str, ...] = ("fits",), frame: str = "equatorial", max_tiles: int = MAX_TILES, properties: dict[str, str] | None = None) -> dict[str, str]:
    """Write the tree of a file's first image, with all its planes; returns the properties. Order 0 means the image's own."""
    planes, wcs = _image_of(data)
    top = order or hips.estimate_order(max(planes.shape[1:]), tile_width)
    low = max(0, min(min_order, top))
    tiles = build_tiles(spark, planes, wcs, top, low, tile_width, interpolation, blank, max_tiles)  # order 0 is its own estimate
    more = {"hips_order_min": str(low)}
    if len(planes) > 1:
        more |= {"dataproduct_type": "cube", "hips_cube_depth": str(len(planes)), "hips_cube_firstframe": "0"}
    tiles = tiles.persist()
    try:
        return write_tree(tiles, root, title, top, tile_width, formats, frame, more | (properties or {}))
    finally:
        tiles.unpersist()


def xisf_to_hips(spark: SparkSession, data: bytes, root: str, title: str, image_index: int = 0, **options) -> dict[str, str]:
    """Write the tree of one image of a unit; complex images are refused."""
    unit = xisf.read(data)
    if not 0 <= image_index < len(unit.images):
        raise HipsError(f"no image {image_index}")
    image = unit.images[image_index]
    if image.sample_format.startswith("Complex"):
        raise HipsError("complex images have no tiles")
    return fits_to_hips(spark, convert.xisf_to_fits(xisf.write(xisf.Unit(images=[image])), meta_extension=False), root, title, **options)


def read_tree(spark: SparkSession, root: str, order: int | None = None) -> tuple[dict[str, str], DataFrame]:
    """A tree's properties and its tiles of one order, by default the highest."""
    text_of = spark.read.format("binaryFile").load(f"{root}/properties").first()
    values = hips.parse_properties(bytes(text_of["content"]).decode())
    at = int(values.get("hips_order", 0)) if order is None else order
    files = spark.read.format("binaryFile").load(f"{root}/Norder{at}/Dir*/Npix*.*").select("path", "content")
    return values, decode_tiles(files)


def cutout_fits(spark: SparkSession, root: str, width: int = 512, height: int = 512, wcs: hips.Wcs | None = None, projection: str = "TAN", lon: float = 0.0, lat: float = 0.0, fov: float = 1.0, rotation: float = 0.0, order: int | None = None, interpolation: str = "bilinear") -> bytes:
    """A FITS image cut out of a tree's first plane; places without a tile are NaN. ``wcs`` counts before the centre, field and rotation."""
    if width * height > SOURCE_SAMPLES:
        raise HipsError(f"a cutout of {width * height} samples; at most {SOURCE_SAMPLES}")
    values, tiles = read_tree(spark, root, order)
    order = int(values.get("hips_order", 0)) if order is None else order
    w = wcs or hips.cutout_wcs(width, height, lon, lat, fov, rotation)
    image = np.full((height, width), np.nan, np.float32)
    for r in cutout(tiles, w, width, height, order, interpolation).where("value IS NOT NULL").toLocalIterator():
        image[r["y"], r["x"]] = r["value"]
    a, b, _ = hips.FRAMES[values.get("hips_frame", "equatorial")]
    keys = ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")
    extra = [("CTYPE1", (a + projection.upper())[:8]), ("CTYPE2", (b + projection.upper())[:8]), *zip(keys, map(float, w), strict=True), ("HIPSORD", order), ("HIPSFWID", int(values.get("hips_tile_width", 512)))]
    return fits.write([fits.image_hdu(image, -32, extra=extra)])


def map_fits(spark: SparkSession, root: str, order: int | None = None, ordering: str = "NESTED", column: str = "SIGNAL") -> bytes:
    """A FITS table of a whole order's values, one row per pixel in ``ordering``; pixels without a tile are NaN."""
    values, tiles = read_tree(spark, root, order)
    order = int(values.get("hips_order", 0)) if order is None else order
    if (count := 12 << 2 * order) > SOURCE_SAMPLES:
        raise HipsError(f"a map of {count} pixels; at most {SOURCE_SAMPLES}")
    out = np.full(count, np.nan, np.float32)
    for r in map_values(tiles, order, ordering).where("value IS NOT NULL").toLocalIterator():
        out[r["ipix"]] = r["value"]
    extra = [("PIXTYPE", "HEALPIX"), ("ORDERING", ordering), ("INDXSCHM", "IMPLICIT"), ("NSIDE", 1 << order), ("FIRSTPIX", 0), ("LASTPIX", count - 1), ("COORDSYS", hips.FRAMES[values.get("hips_frame", "equatorial")][2])]
    return fits.write([fits.empty_primary(), fits.table_hdu([column], ["1E"], [out], extra)])


def tile_fits(spark: SparkSession, root: str, order: int, ipix: int) -> bytes:
    """One tile with all its planes as a FITS image."""
    values, tiles = read_tree(spark, root, order)
    r = tiles.where(F.col("ipix") == ipix).first()
    if r is None:
        raise HipsError(f"no tile {ipix} of order {order}")
    x = np.array(r["data"], np.float32).reshape(r["depth"], r["width"], r["width"])
    return hips.encode_tile(x, order, ipix, "fits", values.get("hips_frame", "equatorial"))


_EXPORTS = {"cutout": cutout_fits, "map": map_fits, "tile": tile_fits}


def hips_to_fits(spark: SparkSession, root: str, kind: str = "cutout", **options) -> bytes:
    """A tree as one FITS file: a cutout, a map of an order, or a tile."""
    if kind not in _EXPORTS:
        raise HipsError(f"no export {kind!r}")
    return _EXPORTS[kind](spark, root, **options)


def hips_to_xisf(spark: SparkSession, root: str, kind: str = "cutout", **options) -> bytes:
    """The FITS file of ``hips_to_fits`` as an XISF unit."""
    return convert.fits_to_xisf(hips_to_fits(spark, root, kind, **options))
