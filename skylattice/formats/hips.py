"""HiPS files: properties, tile paths and bytes, Allsky mosaics, MOC, HEALPix in NumPy, resampling and lint rules."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Sequence

import numpy as np

from skylattice.codecs import png
from skylattice.errors import HipsError
from skylattice.formats import fits
from skylattice.functions.text import TILE_PATTERN

EXTENSION = {"fits": "fits", "png": "png", "jpeg": "jpg"}

# Keys that the standard wants, those of cubes, and the frames' names.
REQUIRED = ("creator_did", "obs_title", "dataproduct_type", "hips_version", "hips_frame", "hips_order", "hips_tile_width", "hips_tile_format")
SPECTRAL_REQUIRED = ("hips_order_freq", "hips_order_min", "em_min", "em_max")
PLANE_KEYS = ("hips_cube_depth", "hips_cube_firstframe")
PRODUCTS = ("image", "cube", "spectral-cube")
FRAMES = {"equatorial": ("RA---", "DEC--", "C"), "galactic": ("GLON-", "GLAT-", "G"), "ecliptic": ("ELON-", "ELAT-", "E")}


def tile_path(order: int, ipix: int, extension: str = "fits", spectral_order: int | None = None, spectral_index: int = 0) -> str:
    """A tile's path; cube tiles carry their spectral order and index too."""
    if spectral_order is None:
        return f"Norder{order}/Dir{ipix // 10000 * 10000}/Npix{ipix}.{extension}"
    return f"Norder{order}_{spectral_order}/Dir{ipix // 10000 * 10000}_{spectral_index // 10 * 10}/Npix{ipix}_{spectral_index}.{extension}"


def parse_properties(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def format_properties(values: dict[str, str]) -> str:
    return "".join(f"{k:<20} = {values[k]}\n" for k in sorted(values))


def default_properties(**values: str) -> dict[str, str]:
    return {"hips_version": "1.4", "dataproduct_type": "image", "hips_frame": "equatorial"} | values


def compatible_properties(values: dict[str, str]) -> dict[str, str]:
    """Properties with the older names of three keys added."""
    frame = FRAMES.get(values.get("hips_frame", ""), ("", "", ""))[2]
    extra = {"coordsys": frame, "maxOrder": values.get("hips_order", ""), "format": values.get("hips_tile_format", "")}
    return values | {k: v for k, v in extra.items() if v}


def _whole(text: str, least: int = 0) -> bool:
    return re.fullmatch(r"\d+", text) is not None and int(text) >= least


def formats_of(text: str) -> list[str]:
    """Formats of a list with commas or blanks, in lower case."""
    return [x for x in re.split(r"[,\s]+", text.lower()) if x]


def check_properties(values: dict[str, str]) -> list[tuple[str, str, str]]:
    """(level, code, key) of what is missing, invalid or odd. ``jpg`` is an odd name of jpeg; cubes need their depth and first frame."""
    product = values.get("dataproduct_type", "")
    cube = product == "cube"
    wanted = REQUIRED + (PLANE_KEYS if cube else ()) + (SPECTRAL_REQUIRED if "hips_order_freq" in values else ())
    out = [("error", "MISSING_PROPERTY", k) for k in wanted if not values.get(k)]
    given = {k: v for k, v in values.items() if v}
    formats = formats_of(given.get("hips_tile_format", ""))
    rules = {
        "hips_order": lambda v: _whole(v) and int(v) <= 29,
        "hips_tile_width": lambda v: _whole(v, 1) and int(v).bit_count() == 1,
        "hips_frame": lambda v: v in FRAMES,
        "hips_version": lambda v: re.fullmatch(r"\d+(\.\d+){0,2}", v) is not None,
        "hips_tile_format": lambda v: bool(formats) and {"jpeg" if f == "jpg" else f for f in formats} <= set(EXTENSION),
        "dataproduct_type": lambda v: v in PRODUCTS,
        "hips_order_min": lambda v: _whole(v) and (not _whole(given.get("hips_order", "")) or int(v) <= int(given["hips_order"])),
        "hips_cube_depth": lambda v: not cube or _whole(v, 1),
        "hips_cube_firstframe": lambda v: not cube or _whole(v),
    }
    out += [("error", "INVALID_PROPERTY", k) for k, ok in rules.items() if k in given and not ok(given[k])]
    odd = [k for k in ("hips_release_date", "hips_status") if k not in values]
    odd += ["hips_tile_format"] * ("jpg" in formats) + [k for k in PLANE_KEYS if k in given and not cube]
    return out + [("warning", "PROPERTY_WARNING", k) for k in odd]


def lint(paths: Sequence[str], properties: str | None) -> list[tuple[str, str, str]]:
    """(level, code, subject) of a tree given by its files' paths and its properties text."""
    if properties is None:
        return [("error", "PROPERTIES_READ_FAILED", "properties")]
    values = parse_properties(properties)
    out = check_properties(values)
    most = int(values["hips_order"]) if re.fullmatch(r"\d+", values.get("hips_order", "")) else None
    formats = {EXTENSION[f] for f in ("jpeg" if x == "jpg" else x for x in formats_of(values.get("hips_tile_format", ""))) if f in EXTENSION}
    cube = values.get("dataproduct_type") in ("cube", "spectral-cube")
    tiles = 0
    for path in paths:
        name = path.rpartition("/")[2]
        allsky = re.search(r"Norder(\d+)/Allsky\.(\w+)$", path)
        if allsky:
            if allsky[1] != "3":
                out.append(("warning", "ALLSKY_ORDER_UNEXPECTED", path))
            if allsky[2] not in formats:
                out.append(("warning", "ALLSKY_FORMAT_UNDECLARED", path))
            continue
        if not name.startswith("Npix"):
            continue
        m = re.search(TILE_PATTERN, path)
        if not m:
            out.append(("warning", "UNRECOGNIZED_TILE_NAME", path))
            continue
        tiles += 1
        if most is not None and int(m[1]) > most:
            out.append(("error", "TILE_ORDER_EXCEEDS_MAX", path))
        if m[7] not in formats:
            out.append(("error", "TILE_FORMAT_UNDECLARED", path))
        if cube and not m[2]:
            out.append(("error", "CUBE_TILE_PATTERN_EXPECTED", path))
        if not cube and m[2]:
            out.append(("error", "UNEXPECTED_CUBE_TILE_PATTERN", path))
    if not any("/Allsky." in f"/{p}" for p in paths):
        out.append(("warning", "ALLSKY_MISSING", "Allsky"))
    if not any(p.rpartition("/")[2] == "Moc.fits" for p in paths):
        out.append(("warning", "MOC_MISSING", "Moc.fits"))
    if not tiles:
        out.append(("error", "NO_TILES_FOUND", ""))
    return out


def index_page(title: str) -> str:
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1></body></html>\n"


# -- HEALPix, nested


def _compact(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for i in range(30):
        out |= (v >> 2 * i & 1) << i
    return out


def _spread(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for i in range(30):
        out |= (v >> i & 1) << 2 * i
    return out


def tile_grid(order: int, ipix: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) in degrees of the centres of a tile's pixels, [y, x]."""
    n = 1 << order
    face, inside = ipix >> 2 * order, np.array(ipix & (n * n - 1))
    ix, iy = int(_compact(inside)), int(_compact(inside >> 1))
    step = (np.arange(width) + 0.5) / width
    p, q = ((ix + step) / n)[None, :], ((iy + step) / n)[:, None]
    row = face >> 2
    column = 2 * (face & 3) + (row != 1)
    t, u = (column + p - q) * math.pi / 4, (p + q - row) * math.pi / 4
    au = np.abs(u)
    sigma = 2 - 4 * au / math.pi
    z = np.where(au <= math.pi / 4, 8 * u / (3 * math.pi), np.sign(u) * (1 - sigma * sigma / 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = (au - math.pi / 4) / (au - math.pi / 2) * (t % (math.pi / 2) - math.pi / 4)
    phi = np.where(au <= math.pi / 4, t, t - np.where(np.isfinite(turn), turn, 0))
    return np.degrees(phi) % 360, np.degrees(np.arcsin(np.clip(z, -1, 1)))


def lonlat_to_pixel(order: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ipix, x, y): nested pixels and the places inside them, 0 to 1."""
    n = 1 << order
    z, phi = np.sin(np.radians(lat)), np.radians(lon) % (2 * math.pi)
    sigma = np.sign(z) * (2 - np.sqrt(np.maximum(3 * (1 - np.abs(z)), 0)))
    middle = np.abs(z) <= 2 / 3
    t = np.where(middle, phi, phi - (np.abs(sigma) - 1) * (phi % (math.pi / 2) - math.pi / 4)) / (math.pi / 2)
    u = np.where(middle, 0.75 * z, sigma / 2)
    a, b = t + u + 0.5, t - u + 0.5
    fa, fb = np.floor(a), np.floor(b)
    face = np.where(fa == fb, fa % 4 + 4, np.where(fa > fb, fb % 4, fa % 4 + 8)).astype(np.int64)
    x, y = (a - fa) * n, (1 - b + fb) * n
    ix, iy = (np.clip(np.floor(v), 0, n - 1).astype(np.int64) for v in (x, y))
    return (face << 2 * order) + _spread(ix) + 2 * _spread(iy), x - ix, y - iy


# -- world coordinates and sampling

Wcs = tuple[float, float, float, float, float, float, float, float]  # crpix1 crpix2 crval1 crval2 cd11 cd12 cd21 cd22


def wcs_of(header: fits.Header) -> Wcs:
    """The linear transform of a header: the CD matrix if it is whole, else CDELT turned by CROTA2."""
    cd = [header.get(k) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]
    if not all(isinstance(v, int | float) and math.isfinite(v) for v in cd):
        a, d1, d2 = math.radians(header.number("CROTA2", 0)), header.number("CDELT1", 1), header.number("CDELT2", 1)
        cd = [d1 * math.cos(a), -d2 * math.sin(a), d1 * math.sin(a), d2 * math.cos(a)]
    if abs(cd[0] * cd[3] - cd[1] * cd[2]) < 1e-16:
        raise HipsError("the world coordinates are singular")
    return (*(float(header.number(k)) for k in ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2")), *map(float, cd))


def cutout_wcs(width: int, height: int, lon: float = 0.0, lat: float = 0.0, fov: float = 1.0, rotation: float = 0.0) -> Wcs:
    """The transform of an image around a centre: ``fov`` degrees along the longer side, turned by ``rotation``."""
    if fov <= 0 or min(width, height) < 1:
        raise HipsError("a cutout needs a field and a size")
    step, a = fov / max(width, height), math.radians(rotation)
    return (width / 2 + 0.5, height / 2 + 0.5, lon, lat, -step * math.cos(a), -step * math.sin(a), -step * math.sin(a), step * math.cos(a))


def world_to_pixel(w: Wcs, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dlon, dlat = np.fmod(lon - w[2] + 540, 360) - 180, lat - w[3]
    det = w[4] * w[7] - w[5] * w[6]
    return (w[7] * dlon - w[5] * dlat) / det + w[0] - 1, (w[4] * dlat - w[6] * dlon) / det + w[1] - 1


def pixel_to_world(w: Wcs, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = x + 1 - w[0], y + 1 - w[1]
    return (w[2] + w[4] * dx + w[5] * dy) % 360, np.clip(w[3] + w[6] * dx + w[7] * dy, -90, 90)


def sample(plane: np.ndarray, x: np.ndarray, y: np.ndarray, method: str = "bilinear", blank: float = np.nan) -> np.ndarray:
    """Values at fractional places: nearest, bilinear over the finite neighbours, or bicubic where all sixteen are finite."""
    h, w = plane.shape

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (i >= 0) & (j >= 0) & (i < w) & (j < h)
        return np.where(ok, plane[np.where(ok, j, 0).astype(np.int64), np.where(ok, i, 0).astype(np.int64)], np.nan)

    if method == "nearest":
        out = at(np.floor(x + 0.5), np.floor(y + 0.5))
        inside = (np.floor(x + 0.5) >= 0) & (np.floor(y + 0.5) >= 0) & (np.floor(x + 0.5) < w) & (np.floor(y + 0.5) < h)
        return np.where(inside, out, blank)
    x0, y0 = np.floor(x), np.floor(y)
    total, weight = np.zeros(x.shape), np.zeros(x.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            v = at(x0 + dx, y0 + dy)
            k = np.where(np.isfinite(v), (1 - np.abs(x - x0 - dx)) * (1 - np.abs(y - y0 - dy)), 0)
            total += np.where(k > 0, k * np.where(np.isfinite(v), v, 0), 0)
            weight += k
    linear = np.where(weight > 0, total / np.where(weight > 0, weight, 1), blank)
    if method == "bilinear":
        return linear
    if method != "bicubic":
        raise HipsError(f"interpolation {method!r}")
    kernel = lambda t: (((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t)
    wx, wy = kernel(x - x0), kernel(y - y0)
    cubic = sum(wx[i] * wy[j] * at(x0 + i - 1, y0 + j - 1) for j in range(4) for i in range(4))
    return np.where(np.isfinite(cubic), cubic, linear)


def reproject(planes: np.ndarray, w: Wcs, order: int, ipix: int, width: int, method: str = "bilinear", blank: float = np.nan) -> np.ndarray:
    """A tile of all planes as float32, (depth, width, width)."""
    x, y = world_to_pixel(w, *tile_grid(order, ipix, width))
    return np.stack([sample(p, x, y, method, blank) for p in planes]).astype(np.float32)


def estimate_order(max_dim: int, tile_width: int = 512) -> int:
    return min(13, max(0, math.ceil(math.log2(max(1, max_dim / tile_width)))))


def footprint(w: Wcs, width: int, height: int) -> tuple[float, float, float]:
    """(lon, lat, radius) of a disc around an image: its centre and the farthest corner."""
    lon, lat = pixel_to_world(w, np.array([(width - 1) / 2]), np.array([(height - 1) / 2]))
    x, y = np.array([-0.5, width - 0.5, -0.5, width - 0.5]), np.array([-0.5, -0.5, height - 0.5, height - 0.5])
    clon, clat = pixel_to_world(w, x, y)
    a, b = np.radians(lat[0]), np.radians(clat)
    c = np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(clon - lon[0]))
    return float(lon[0]), float(lat[0]), float(np.degrees(np.arccos(np.clip(c, -1, 1))).max())


# -- tiles


def encode_tile(tile: np.ndarray, order: int, ipix: int, kind: str = "fits", frame: str = "equatorial") -> bytes:
    """FITS float32 of all planes with the tile's cards, or PNG bytes of the first plane stretched over its finite values."""
    if kind == "fits":
        lon, lat = tile_grid(order, ipix, 1)
        n, width = 1 << order, tile.shape[-1]
        a, b, _ = FRAMES[frame]
        cd = 45 / width / n
        extra = [
            ("CTYPE1", f"{a}HPX"), ("CTYPE2", f"{b}HPX"), ("CRPIX1", width / 2 + 0.5), ("CRPIX2", width / 2 + 0.5), ("CRVAL1", float(lon[0, 0])),
            ("CRVAL2", float(lat[0, 0])), ("CD1_1", -cd), ("CD1_2", 0.0), ("CD2_1", 0.0), ("CD2_2", cd), ("ORDER", order), ("NPIX", ipix), ("NSIDE", n), ("ORDERING", "NESTED"),
        ]
        return fits.write([fits.image_hdu(tile[0] if len(tile) == 1 else tile, -32, extra=extra)])
    if kind == "png":
        return png.encode(to_bytes(tile[0]))
    raise HipsError(f"tiles of {kind!r} are not written")


def to_bytes(plane: np.ndarray) -> np.ndarray:
    finite = plane[np.isfinite(plane)].astype(np.float64)
    lo, hi = (finite.min(), finite.max()) if len(finite) else (0.0, 1.0)
    hi = lo + 1 if hi == lo else hi
    out = np.floor((np.where(np.isfinite(plane), plane, lo).astype(np.float64) - lo) * 255 / (hi - lo) + 0.5)
    return np.where(np.isfinite(plane), np.clip(out, 0, 255), 0).astype(np.uint8)


def decode_tile(data: bytes, kind: str) -> np.ndarray:
    """(depth, height, width) as float32; colours become gray."""
    if kind == "fits":
        h = next(x for x in fits.hdus(data) if x.header.has_data)
        body = fits.data_of(data, h)
        return np.stack([fits.frame(body, h.header, i) for i in range(fits.frame_count(h.header))]).astype(np.float32)
    if kind == "png":
        x = png.decode(data).astype(np.float64)
        plane = x[..., 0] if x.shape[2] < 3 else 0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2]
        return plane[None].astype(np.float32)
    raise HipsError(f"tiles of {kind!r} are not read here")


def downsample(plane: np.ndarray, mean: bool = True) -> np.ndarray:
    """Blocks of two by two pixels as one: the mean of the finite ones, or the upper left one."""
    if not mean:
        return plane[::2, ::2]
    h, w = plane.shape[0] // 2 * 2, plane.shape[1] // 2 * 2
    x = plane[:h, :w].reshape(h // 2, 2, w // 2, 2).transpose(0, 2, 1, 3).reshape(h // 2, w // 2, 4).astype(np.float64)
    ok = np.isfinite(x)
    n = ok.sum(axis=2)
    return np.where(n > 0, np.where(ok, x, 0).sum(axis=2) / np.maximum(n, 1), np.nan)


def allsky(tiles: Iterable[tuple[int, np.ndarray]], order: int, width: int) -> np.ndarray:
    """The mosaic of an order's tiles; places without a tile, or with a short one, are NaN."""
    count = 12 << 2 * order
    across = int(count**0.5)
    out = np.full((-(-count // across) * width, across * width), np.nan, np.float32)
    for ipix, tile in tiles:
        if tile.size == width * width:
            r, c = divmod(ipix, across)
            out[r * width : (r + 1) * width, c * width : (c + 1) * width] = tile.reshape(width, width)
    return out


def split_allsky(mosaic: np.ndarray, order: int, width: int) -> dict[int, np.ndarray]:
    count = 12 << 2 * order
    across = int(count**0.5)
    return {i: mosaic[i // across * width : (i // across + 1) * width, i % across * width : (i % across + 1) * width] for i in range(count)}


def moc(order: int, pixels: Sequence[int]) -> bytes:
    """A coverage map: pixels in the NUNIQ order of a one-column table; four sisters become their parent."""
    found: dict[int, set[int]] = {order: set(pixels)}
    for k in range(order, 0, -1):
        here = found[k]
        parents = {p >> 2 for p in here if p % 4 == 0 and {p, p + 1, p + 2, p + 3} <= here}
        found[k] = {p for p in here if p >> 2 not in parents}
        found[k - 1] = found.get(k - 1, set()) | parents
    numbers = sorted((4 << 2 * k) + p for k, some in found.items() for p in some)
    extra = [("PIXTYPE", "HEALPIX"), ("ORDERING", "NUNIQ"), ("COORDSYS", "C"), ("MOCORDER", order)]
    return fits.write([fits.empty_primary(), fits.table_hdu(["UNIQ"], ["1K"], [numbers], extra, name="MOC")])


def convert_tile(data: bytes, source: str, target: str, order: int, ipix: int) -> bytes:
    return encode_tile(decode_tile(data, source), order, ipix, target)
