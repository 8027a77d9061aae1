"""Image operators over frames (path, hdu_index, frame, width, height, pixels) and their exploded pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.text import col


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def pixels(frames: DataFrame) -> DataFrame:
    """One row per pixel: (..., y, x, value)."""
    keys = [c for c in frames.columns if c != "pixels"]
    out = frames.select(*keys, F.posexplode("pixels").alias("_i", "value"))
    return out.withColumns({"y": F.floor(F.col("_i") / F.col("width")).cast("int"), "x": F.pmod("_i", F.col("width")).cast("int")}).drop("_i")


def extent(values: Column | str) -> Column:
    """(min, max) of an array without NaN; both NaN if nothing is left."""
    v = F.filter(col(values), lambda x: x.isNotNull() & ~F.isnan(x))
    nan = F.lit(float("nan"))
    return F.struct(F.coalesce(F.array_min(v), nan).alias("min"), F.coalesce(F.array_max(v), nan).alias("max"))


def finite_extent(values: Column | str) -> Column:
    """(min, max) of the finite values: (0, 1) if there are none, (min, min + 1) if all are equal."""
    v = F.filter(col(values), lambda x: x.isNotNull() & is_finite(x))
    lo, hi = F.array_min(v), F.array_max(v)
    return F.struct(F.coalesce(lo, F.lit(0.0)).alias("min"), F.when(lo == hi, lo + 1).otherwise(F.coalesce(hi, F.lit(1.0))).alias("max"))


def finite_mean(values: Column | str) -> Column:
    v = F.filter(col(values), lambda x: x.isNotNull() & is_finite(x))
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(F.lit(float("nan")))


def to_bytes(values: Column | str) -> Column:
    """Values stretched over 0 to 255 between the finite extremes, rounded half up; others are 0."""
    e = finite_extent(values)
    scaled = lambda x: F.floor((x - e["min"]) * 255 / (e["max"] - e["min"]) + 0.5)
    return F.transform(col(values), lambda x: F.when(is_finite(x), F.greatest(F.lit(0), F.least(F.lit(255), scaled(x)))).otherwise(0).cast("int"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def pixel_at(values: Column | str, x: Column, y: Column, width: Column | int) -> Column:
    """The value at flat place y * width + x; NaN outside the array."""
    at = (y * width + x + 1).cast("int")
    return F.coalesce(F.when(at > 0, F.try_element_at(col(values), at)), F.lit(float("nan")))


def downsample(px: DataFrame, keys: list[str], nearest: bool = False) -> DataFrame:
    """Blocks of two by two pixels as one: the mean of the finite ones (NaN if none), or the upper left one."""
    grouped = px.withColumns({"_x": F.floor(F.col("x") / 2).cast("int"), "_y": F.floor(F.col("y") / 2).cast("int")}).groupBy(*keys, "_x", "_y")
    value = F.min_by("value", F.struct("y", "x")) if nearest else F.coalesce(F.avg(F.when(is_finite(F.col("value")), F.col("value"))), F.lit(float("nan")))
    return grouped.agg(value.alias("value")).withColumnsRenamed({"_x": "x", "_y": "y"})


def _at(values: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    return F.when(inside, F.try_element_at(values, (y * width + x + 1).cast("int")))


def sample_nearest(values: Column, x: Column, y: Column, width: Column, height: Column, blank: float = float("nan")) -> Column:
    return F.coalesce(_at(values, F.floor(x + 0.5), F.floor(y + 0.5), width, height), F.lit(blank))


def sample_bilinear(values: Column, x: Column, y: Column, width: Column, height: Column, blank: float = float("nan")) -> Column:
    """The weighted mean of the finite ones among four neighbours; ``blank`` if there are none."""
    x0, y0 = F.floor(x), F.floor(y)
    total, weight = F.lit(0.0), F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            w = (1 - F.abs(x - x0 - dx)) * (1 - F.abs(y - y0 - dy))
            v = _at(values, x0 + dx, y0 + dy, width, height)
            ok = v.isNotNull() & is_finite(v)
            total, weight = total + F.when(ok, w * v).otherwise(0.0), weight + F.when(ok, w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(F.lit(blank))


def _catmull_rom(t: Column) -> list[Column]:
    return [
        ((-0.5 * t + 1.0) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1.0, ((-1.5 * t + 2.0) * t + 0.5) * t, (0.5 * t - 0.5) * t * t,
    ]


def sample_bicubic(values: Column, x: Column, y: Column, width: Column, height: Column, blank: float = float("nan")) -> Column:
    """Catmull-Rom over sixteen neighbours; bilinear where one of them is missing."""
    x0, y0 = F.floor(x), F.floor(y)
    wx, wy = _catmull_rom(x - x0), _catmull_rom(y - y0)
    total, ok = F.lit(0.0), F.lit(True)
    for j in range(4):
        for i in range(4):
            v = _at(values, x0 + (i - 1), y0 + (j - 1), width, height)
            ok = ok & F.coalesce(is_finite(v), F.lit(False))
            total = total + wx[i] * wy[j] * F.coalesce(v, F.lit(0.0))
    return F.when(ok, total).otherwise(sample_bilinear(values, x, y, width, height, blank))


def tile_layout(tile: Column, width: Column, height: Column, tile_width: Column, tile_height: Column) -> Column:
    """(x, y, w, h) of a numbered tile; tiles at the edges are cut."""
    across = F.ceil(width / tile_width)
    x, y = F.pmod(tile, across) * tile_width, F.floor(tile / across) * tile_height
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.least(tile_width, width - x).cast("int").alias("w"), F.least(tile_height, height - y).cast("int").alias("h"))


def dequantize(value: Column, scale: Column, zero: Column) -> Column:
    """Stored integers without dithering: the null number is NaN, the zero number 0."""
    return F.when(value == -2147483647, F.lit(float("nan"))).when(value == -2147483646, F.lit(0.0)).otherwise(value * scale + zero)


def first_with_data(hdus: DataFrame) -> DataFrame:
    """Of each file the first unit that has data."""
    return hdus.where("has_data").groupBy("path").agg(F.min("hdu_index").alias("hdu_index"))


def is_cube(naxis: Column) -> Column:
    """Whether an image has more than one plane: some axis beyond the second is longer than 1."""
    return F.exists(F.slice(naxis, 3, 999), lambda n: n > 1)


def same_shape(hdus: DataFrame) -> DataFrame:
    """Image units of each file that have the shape and type of its first one."""
    images = hdus.where("data_type = 'image'")
    shape = F.struct("naxis", "bitpix")
    first = images.groupBy("path").agg(F.min_by(shape, "hdu_index").alias("_first"))
    return images.join(first, "path").where(shape == F.col("_first")).drop("_first")


def allsky_place(ipix: Column, order: int, tile_width: int) -> Column:
    """(row, column, y, x) of a tile in the mosaic of all tiles: floor(sqrt(count)) tiles in a row."""
    across = int((12 << 2 * order) ** 0.5)
    row, column = F.floor(ipix / across).cast("int"), F.pmod(ipix, F.lit(across)).cast("int")
    return F.struct(row.alias("row"), column.alias("column"), (row * tile_width).alias("y"), (column * tile_width).alias("x"))
