"""Column expressions of sky geometry: linear world coordinates, HEALPix (Gorski et al. 2005), distances. No Python at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.functions.text import col

_PI = math.pi


def wcs(crpix1, crpix2, crval1, crval2, cd11=None, cd12=None, cd21=None, cd22=None, cdelt1=None, cdelt2=None, crota2=None) -> Column:
    """A linear transform as a struct: the CD matrix if all its parts are there, else CDELT turned by CROTA2; null if singular."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("double")
    c = [lit(x) for x in (cd11, cd12, cd21, cd22)]
    rotation = F.radians(F.coalesce(lit(crota2), F.lit(0.0)))
    d1, d2 = F.coalesce(lit(cdelt1), F.lit(1.0)), F.coalesce(lit(cdelt2), F.lit(1.0))
    full = c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull() & c[3].isNotNull()
    turned = (d1 * F.cos(rotation), -d2 * F.sin(rotation), d1 * F.sin(rotation), d2 * F.cos(rotation))
    m = [F.when(full, a).otherwise(b) for a, b in zip(c, turned, strict=True)]
    names = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")
    s = F.struct(*(v.alias(n) for v, n in zip([lit(crpix1), lit(crpix2), lit(crval1), lit(crval2), *m], names, strict=True)))
    return F.when(F.abs(m[0] * m[3] - m[1] * m[2]) >= 1e-16, s)


def pixel_to_world(w: Column, x: Column, y: Column) -> Column:
    """(lon, lat) of pixels counted from 0: longitude in [0, 360), latitude clamped to +-90."""
    dx, dy = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
    lon = w["crval1"] + w["cd11"] * dx + w["cd12"] * dy
    lat = w["crval2"] + w["cd21"] * dx + w["cd22"] * dy
    return F.struct(F.pmod(lon, F.lit(360.0)).alias("lon"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)).alias("lat"))


def world_to_pixel(w: Column, lon: Column, lat: Column) -> Column:
    """(x, y) counted from 0; the longitude difference goes the short way round."""
    dlon = (lon - w["crval1"] + 540.0) % 360.0 - 180.0
    dlat = lat - w["crval2"]
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    x = (w["cd22"] * dlon - w["cd12"] * dlat) / det
    y = (w["cd11"] * dlat - w["cd21"] * dlon) / det
    return F.struct((x + w["crpix1"] - 1).alias("x"), (y + w["crpix2"] - 1).alias("y"))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees between two directions."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def _spread_bits(v: Column, order: int) -> Column:
    """The lowest ``order`` bits of v, moved to the even places. One term per bit, so the expression stays small."""
    out = F.lit(0).cast("long")
    for i in range(order):
        out = out + F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 2 * i)
    return out


def _even_bits(v: Column, order: int) -> Column:
    """The lowest ``order`` bits at the even places of v, side by side."""
    out = F.lit(0).cast("long")
    for i in range(order):
        out = out + F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(F.lit(1).cast("long")), i)
    return out


def let(then, **values: Column) -> Column:
    """``then`` of a struct of named values, each computed once and not wherever it is used: expressions stay small."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), then)[0]


def npix(order: int) -> int:
    return 12 << 2 * order


def nest_parts(order: int, ipix: Column) -> tuple[Column, Column, Column]:
    """(face, x, y) of a nested pixel: its place in its base pixel."""
    i = ipix.cast("long")
    return F.shiftright(i, 2 * order), _even_bits(i, order), _even_bits(F.shiftright(i, 1), order)


def nest_to_lonlat(order: int, ipix: Column, dx: Column | float = 0.5, dy: Column | float = 0.5) -> Column:
    """(lon, lat) in degrees of a point of a nested pixel: (dx, dy) of its width from its southern corner."""
    face, ix, iy = nest_parts(order, ipix)
    n = float(1 << order)

    def plane(s: Column) -> Column:
        # base pixels stand on a grid of half steps: column 2 (face mod 4), one more in the polar rows
        column = 2 * s["face"].bitwiseAND(F.lit(3).cast("long")) + F.when(s["row"] == 1, 0).otherwise(1)
        return let(sphere, t=(column.cast("double") + s["p"] - s["q"]) * (_PI / 4), u=(s["p"] + s["q"] - s["row"].cast("double")) * (_PI / 4))

    def sphere(s: Column) -> Column:
        t, u = s["t"], s["u"]
        middle, sigma = F.abs(u) <= _PI / 4, 2.0 - 4.0 * F.abs(u) / _PI
        z = F.when(middle, 8.0 * u / (3.0 * _PI)).otherwise(F.signum(u) * (1.0 - sigma * sigma / 3.0))
        pole = F.abs(F.abs(u) - _PI / 2) < 1e-15
        turn = F.when(pole, F.lit(0.0)).otherwise((F.abs(u) - _PI / 4) / (F.abs(u) - _PI / 2) * (F.pmod(t, F.lit(_PI / 2)) - _PI / 4))
        phi = F.when(middle, t).otherwise(t - turn)
        return F.struct(F.pmod(F.degrees(phi), F.lit(360.0)).alias("lon"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).alias("lat"))

    return let(plane, face=face, row=F.floor(face / 4).cast("long"), p=(ix.cast("double") + dx) / n, q=(iy.cast("double") + dy) / n)


def lonlat_to_nest(order: int, lon: Column, lat: Column) -> Column:
    """(ipix, x, y): the nested pixel of a direction, and the place inside it, 0 to 1 along both edges."""
    n = 1 << order

    def plane(s: Column) -> Column:
        z, phi = s["z"], s["phi"]
        sigma = F.signum(z) * (2.0 - F.sqrt(3.0 * (1.0 - F.abs(z))))
        middle = F.abs(z) <= 2.0 / 3.0
        t = F.when(middle, phi).otherwise(phi - (F.abs(sigma) - 1.0) * (F.pmod(phi, F.lit(_PI / 2)) - _PI / 4))
        return let(edges, t=t / (_PI / 2), u=F.when(middle, 0.75 * z).otherwise(sigma / 2.0))

    def edges(s: Column) -> Column:
        # steps along both edges of base pixels; the equatorial faces lie where both are in the same step
        return let(steps, a=s["t"] + s["u"] + 0.5, b=s["t"] - s["u"] + 0.5)

    def steps(s: Column) -> Column:
        fa, fb = F.floor(s["a"]), F.floor(s["b"])
        face = F.when(fa == fb, F.pmod(fa, F.lit(4)) + 4).when(fa > fb, F.pmod(fb, F.lit(4))).otherwise(F.pmod(fa, F.lit(4)) + 8)
        return let(cells, face=face.cast("long"), x=(s["a"] - fa) * n, y=(1.0 - s["b"] + fb) * n)

    def cells(s: Column) -> Column:
        inside = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v))).cast("long")
        return let(pixel, face=s["face"], x=s["x"], y=s["y"], ix=inside(s["x"]), iy=inside(s["y"]))

    def pixel(s: Column) -> Column:
        ipix = F.shiftleft(s["face"], 2 * order) + _spread_bits(s["ix"], order) + F.shiftleft(_spread_bits(s["iy"], order), 1)
        return F.struct(ipix.alias("ipix"), (s["x"] - s["ix"]).alias("x"), (s["y"] - s["iy"]).alias("y"))

    return let(plane, z=F.sin(F.radians(lat)), phi=F.pmod(F.radians(lon), F.lit(2 * _PI)))


def nest_to_ring(order: int, ipix: Column) -> Column:
    """The ring-order number of a nested pixel."""
    n = 1 << order
    total = npix(order)
    face, ix, iy = nest_parts(order, ipix)

    def ring(s: Column) -> Column:
        base = 2 * s["face"].bitwiseAND(F.lit(3).cast("long")) + F.when(s["row"] == 1, 0).otherwise(1)
        return let(place, base=base, ring=(s["row"] + 2) * n - s["ix"] - s["iy"] - 1, step=s["ix"] - s["iy"])

    def place(s: Column) -> Column:
        r = s["ring"]
        north, south = r < n, r > 3 * n
        size = F.when(north, r).when(south, 4 * n - r).otherwise(F.lit(n))
        before = F.when(north, 2 * r * (r - 1)).when(south, total - 2 * (4 * n - r + 1) * (4 * n - r)).otherwise(2 * n * (n - 1) + 4 * n * (r - n))
        odd = F.when(north | south, F.lit(0)).otherwise((r - n).bitwiseAND(F.lit(1).cast("long")))
        return let(number, before=before, size=size, at=F.floor((s["base"] * size + s["step"] + 1 + odd) / 2))

    def number(s: Column) -> Column:
        at = F.when(s["at"] > 4 * s["size"], s["at"] - 4 * s["size"]).when(s["at"] < 1, s["at"] + 4 * s["size"]).otherwise(s["at"])
        return (s["before"] + at - 1).cast("long")

    return let(ring, face=face, row=F.floor(face / 4).cast("long"), ix=ix, iy=iy)


def max_pixel_radius(order: int) -> float:
    """Degrees from a pixel's centre to its corner, at most over the sphere (the standard library's definition)."""
    n = 1 << order
    t1 = 1 - 1 / n
    z1, p1 = 2 / 3, _PI / (4 * n)
    z2 = 1 - t1 * t1 / 3
    s1, s2 = math.sqrt(1 - z1 * z1), math.sqrt(1 - z2 * z2)
    return math.degrees(math.acos(max(-1.0, min(1.0, s1 * math.cos(p1) * s2 + z1 * z2))))


def disc_tiles(spark, order: int, lon: float, lat: float, radius: float):
    """Tiles of an order that a disc may touch: centres within the radius and a pixel's own.

    Beyond order 4 the candidates are children of the touched tiles two orders above, so the work
    follows the disc and not the sphere.
    """
    tiles = spark.range(npix(order)).withColumnRenamed("id", "ipix") if order <= 4 else None
    if tiles is None:
        parents = disc_tiles(spark, order - 2, lon, lat, radius)
        tiles = parents.select(F.explode(F.sequence(F.col("ipix") * 16, F.col("ipix") * 16 + 15)).alias("ipix"))
    c = nest_to_lonlat(order, F.col("ipix"))
    near = great_circle(c["lon"], c["lat"], F.lit(lon), F.lit(lat)) <= radius + max_pixel_radius(order)
    return tiles.where(near)
