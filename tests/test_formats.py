"""Byte-level formats and codecs, against literal values and round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.codecs import blocks, hcompress, plio, png, rice
from skylattice.errors import DecompressionError, FitsHeaderError, SerValidationError, XisfChecksumError, XisfParseError
from skylattice.formats import convert, fits, hips, ser, tiles, xisf

PIXELS = np.array([-30, -10, 0, 10, 20, 40, 80, 120, 160, 200, 240, 280, 320, 360, 400, 440]).reshape(4, 4)
MASK = np.array([0, 0, 1, 1, 5, 5, 5, 10, 10, 20, 20, 30, 30, 30, 40, 40])


@pytest.mark.parametrize("codec", ["RICE_1", "GZIP_1", "HCOMPRESS_1"])
def test_tiles_of_signed_pixels(codec):
    data = fits.write([fits.empty_primary(), tiles.image_hdu(PIXELS, codec, 16 if codec == "GZIP_1" else 32, (3, 2))])
    h = fits.hdus(data)[1]
    assert h.header.kind == "compressed_image"
    assert (tiles.decode_image(fits.data_of(data, h), h.header) == PIXELS).all()


def test_plio_words():
    assert (plio.decode(plio.encode(MASK), 16) == MASK).all()
    assert plio.decode(np.array([0, 7, -100, 10, 0, 0, 0, 0x4003, 0x2004, 0x5002], np.int16), 6).tolist() == [1, 1, 1, 0, 5, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=90), st.sampled_from([1, 2, 4]), st.booleans())
def test_rice(values, size, small):
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[size]
    x = (np.array(values) % (50 if small else 2**32)).astype(kind)
    assert (rice.decode(rice.encode(x, 32, size), len(x), 32, size) == x).all()


def test_rice_ends_early():
    with pytest.raises(DecompressionError):
        rice.decode(rice.encode(np.arange(200) * 37, 32, 4)[:40], 200, 32, 4)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 18), st.integers(1, 18), st.integers(0, 1 << 30))
def test_hcompress(nx, ny, seed):
    x = np.random.default_rng(seed).integers(-3000, 3000, (nx, ny))
    assert (hcompress.decode(hcompress.encode(x)) == x).all()


def test_hcompress_rejects_other_bytes():
    with pytest.raises(DecompressionError):
        hcompress.decode(b"no stream")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 9))
def test_block_codecs(data, item):
    data = data * 3
    assert blocks.unshuffle(blocks.shuffle(data, item), item) == data
    for codec in ("zlib", "lz4"):
        stored, spec = blocks.encode_block(data, codec, item)
        assert blocks.decode_block(stored, spec) == data


def test_subblocks_have_their_own_sizes():
    parts = [b"a" * 300, b"b" * 77]
    stored = [blocks.lz4_compress(x) for x in parts]
    spec = ":".join(f"{len(s)},{len(p)}" for s, p in zip(stored, parts, strict=True))
    assert blocks.decode_block(b"".join(stored), "lz4:377", spec) == b"".join(parts)
    with pytest.raises(XisfParseError):
        blocks.decode_block(stored[0], "lz4:299")


def test_base64_in_any_dress():
    assert blocks.from_base64(" -_8 =\n") == b"\xfb\xff"
    with pytest.raises(XisfParseError):
        blocks.from_base64("a")


def test_png():
    for shape in ((5, 7), (4, 3, 3), (2, 2, 4)):
        x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(x)) == (x if x.ndim == 3 else x[..., None])).all()


# -- FITS


def test_cards():
    h = fits.parse_header("".join(fits.format_card(*c) for c in [("SIMPLE", True), ("NAME", "it's", "whose"), ("N", -3), ("X", 1.5), ("N", 4), ("COMMENT", "hello")]) + "D       = 1.5D3" + " " * 65 + "END")
    assert (h.get("SIMPLE"), h.get("NAME"), h.get("N"), h.get("X"), h.get("D")) == (True, "it's", 4, 1.5, 1500.0)
    assert h.cards["NAME"].comment == "whose" and h.cards["N"].index == 4 and h.comments == ["hello"]
    assert h.number("MISSING", 7) == 7
    with pytest.raises(FitsHeaderError):
        h.number("NAME")
    assert fits.split_index("NAXIS12") == ("NAXIS", 12)


def test_header_without_end_stops_the_walk():
    whole = fits.write([fits.empty_primary()])
    assert len(fits.hdus(whole + b"X" * 2880)) == 1


@pytest.mark.parametrize(("bitpix", "values"), [(8, [0, 255]), (16, [1000, -500, 32767, -32768, 0, 12345]), (32, [-(2**31), 5]), (64, [2**62, -1]), (-32, [1.5, -2.25]), (-64, [1e300, -0.5])])
def test_images(bitpix, values):
    data = fits.write([fits.image_hdu(np.array([values]), bitpix)])
    h = fits.hdus(data)[0]
    assert len(data) % 2880 == 0 and fits.frame(fits.data_of(data, h), h.header, 0).tolist() == [values]


def test_scaling_types():
    raw = np.array([1, 2], ">i2").tobytes()
    assert fits.decode_pixels(raw, 16, 1, 32768).dtype == np.int32
    assert fits.decode_pixels(raw, 16, 0.5, 0).dtype == np.float32
    assert fits.decode_pixels(np.array([-1], ">i8").tobytes(), 64, 1, 2.0**63).tolist() == [2**63 - 1]
    assert np.isnan(fits.decode_pixels(raw, 16, 1, 0, blank=2)[1])


def test_heap_columns_of_every_kind():
    forms = {"1PE": [[1.5], [], [2.5, -1.0]], "1PD": [[1e300], [], [0.5]], "1PK": [[2**60], [], [-1]], "1PI": [[1, 2], [], [3]], "1QJ": [[7], [8, 9], []]}
    data = fits.write([fits.empty_primary(), fits.table_hdu(list(forms), list(forms), list(forms.values()))])
    h = fits.hdus(data)[1]
    assert fits.decode_table(fits.data_of(data, h), h.header) == forms


def test_ascii_numbers_that_cannot_be_read():
    cards, data = fits.ascii_hdu(["a", "n", "x"], ["A4", "I5", "F8.2"], [["ab", "c"], [1, 22], [1.5, -2.25]])
    whole = fits.write([fits.empty_primary(), (cards, data.replace(b"22", b"??"))])
    h = fits.hdus(whole)[1]
    assert fits.decode_ascii(fits.data_of(whole, h), h.header) == {"a": ["ab", "c"], "n": [1, None], "x": [1.5, -2.25]}


def test_dither_undoes_itself():
    r = tiles.dither_values(3, 5, 20)
    stored = np.round(np.linspace(0, 9, 20) / 0.5 + r - 0.5)
    assert np.abs(tiles.dequantize(stored, 0.5, 0.0, "SUBTRACTIVE_DITHER_1", 3, 5) - np.linspace(0, 9, 20)).max() <= 0.26
    out = tiles.dequantize(np.array([tiles.NULL_VALUE, tiles.ZERO_VALUE, 4]), 2.0, 1.0)
    assert np.isnan(out[0]) and out[1:].tolist() == [0.0, 9.0]
    assert tiles.layout(5, 4, 3, 2) == [(0, 0, 3, 2), (3, 0, 2, 2), (0, 2, 3, 2), (3, 2, 2, 2)]


# -- SER


def video(frames=3, depth=8, color=0, width=4, height=3):
    size = width * height * (3 if color >= 100 else 1)
    raw = [((13 + 17 * k + 7 * np.arange(size)) % 256).astype(np.uint8 if depth == 8 else "<u2").tobytes() for k in range(frames)]
    return ser.write(raw, width, height, depth, color, [638000000000000000 + 100000 * i for i in range(frames)], "me", "it", "that", 5, 6, 42), raw


def test_ser():
    data, raw = video()
    f = ser.parse(fits.reader_of(data), len(data))
    assert (f.frames, f.header.observer, f.header.lu_id, f.timestamps[-1] - f.timestamps[0]) == (3, "me", 42, 200000)
    with pytest.raises(SerValidationError):
        ser.parse(fits.reader_of(data), len(data) - 40)
    cut = ser.parse(fits.reader_of(data[:-50]), len(data) - 50, strict=False)
    assert cut.frames < 3 and cut.header.warnings
    assert ser.byte_order(0, "compat") == "little" and ser.byte_order(0, "spec") == "big"
    smooth = np.arange(1000, 1400).astype(">u2").tobytes()
    assert ser.byte_order(0, "auto", smooth) == "big"


def test_filter_array():
    h = ser.SerHeader("x", 0, 8, 0, 2, 2, 8, 1)
    assert ser.to_rgb(np.array([10, 20, 30, 40], np.uint8), h).tolist()[0][0] == [10, 20, 40]
    h.color_id = 101
    assert ser.to_rgb(np.array([1, 2, 3] * 4, np.uint8), h).tolist()[0][0] == [3, 2, 1]


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("color", [0, 100])
@pytest.mark.parametrize("way", [("ser", "fits", "ser"), ("ser", "xisf", "ser"), ("ser", "xisf", "fits")])
def test_conversions_of_videos(depth, color, way):
    data, raw = video(depth=depth, color=color)
    out = convert.convert(data, way)
    if way[-1] == "ser":
        assert out == data
    else:
        assert len([h for h in fits.hdus(out) if h.header.kind == "image"]) == 3


# -- XISF


def unit():
    image = xisf.Image([2, 2, 1], "UInt16", data=np.array([0, 1, 65535, 42], "<u2").tobytes(), keywords=[("OBJECT", "'M31'", "which")])
    image.properties = [xisf.Property("exact", "UInt64", 2**64 - 1), xisf.Property("v", "F64Vector", [1.5, 2.5]), xisf.Property("m", "I32Matrix", [[1, 2], [3, 4]])]
    cell = [xisf.Property("A", "UInt32", 42)]
    return xisf.Unit(images=[image], tables=[xisf.Table("T1", [("A", "UInt32")], [cell])], properties=[xisf.Property("big", "ByteArray", [7] * 9000)])


@pytest.mark.parametrize("codec", [None, "zlib", "lz4"])
def test_xisf(codec):
    data = xisf.write(unit(), codec)
    back = xisf.read(data)
    assert back.images[0].samples().ravel().tolist() == [0, 1, 65535, 42] and back.images[0].keywords == [("OBJECT", "'M31'", "which")]
    assert [p.value for p in back.images[0].properties] == [2**64 - 1, [1.5, 2.5], [[1, 2], [3, 4]]]
    assert back.tables[0].rows[0][0].value == 42 and back.properties[0].value == [7] * 9000
    bad = bytearray(data)
    bad[4096] ^= 255
    with pytest.raises((XisfChecksumError, XisfParseError)):
        xisf.read(bytes(bad))


def test_distributed_units_and_indexes():
    head, body = xisf.write_distributed(unit(), "zlib")
    assert xisf.read(head, resolve=lambda kind, target: body, directory="/d").images[0].samples()[0, 1, 0] == 65535
    loop = bytearray(xisf.build_index([(b"x", 1)]))
    loop[24:32] = (16).to_bytes(8, "little")
    with pytest.raises(XisfParseError):
        xisf.parse_index(bytes(loop))


def test_complex_images_become_tables():
    image = xisf.Image([2, 1, 1], "Complex32", data=np.array([1.5 - 2.5j, 3.25 + 4.75j], "<c8").tobytes())
    out = convert.xisf_to_fits(xisf.write(xisf.Unit(images=[image])))
    found = fits.hdus(out)
    assert [h.header.kind for h in found][:2] == ["none", "binary_table"]
    assert fits.decode_table(fits.data_of(out, found[1]), found[1].header)["COMPLEX"] == [{"re": 1.5, "im": -2.5}, {"re": 3.25, "im": 4.75}]


def test_fits_keeps_types_through_xisf():
    x = np.array([[0, 1], [65535, 42]], np.uint16)
    stored, bits, zero = convert._stored(x)
    data = fits.write([fits.image_hdu(stored, bits, bscale=1, bzero=zero, extra=[("OBJECT", "M31"), ("EXPTIME", 2.5)])])
    back = convert.convert(data, ("fits", "xisf", "fits"))
    h = fits.hdus(back)[0]
    assert fits.frame(fits.data_of(back, h), h.header, 0).tolist() == x.tolist()
    assert (h.header.get("OBJECT"), h.header.get("EXPTIME"), h.header.get("BITPIX")) == ("M31", 2.5, 16)


# -- HiPS


def test_sky_grid_is_inverse():
    for order, ipix in ((0, 4), (3, 700), (5, 12000)):
        lon, lat = hips.tile_grid(order, ipix, 4)
        found, x, y = hips.lonlat_to_pixel(order, lon, lat)
        assert (found == ipix).all() and np.allclose(x[0], [0.125, 0.375, 0.625, 0.875]) and np.allclose(y[:, 0], [0.125, 0.375, 0.625, 0.875])


def test_sampling_and_mosaics():
    plane = np.array([[1.0, 2.0], [3.0, 4.0]])
    at = lambda x, y, m: float(hips.sample(plane, np.array(x), np.array(y), m))
    assert at(0.5, 0.5, "bilinear") == 2.5 and at(0.49, 1.49, "nearest") == 3 and np.isnan(at(5.0, 5.0, "nearest"))
    assert hips.downsample(np.array([[1, np.nan], [3, 5.0]])).tolist() == [[3.0]]
    sky = hips.allsky([(0, np.array([1, 2, 3])), (5, np.array([5, 6, 7, 8]))], 0, 2)
    assert sky.shape == (8, 6) and np.isnan(sky[0, 0]) and hips.split_allsky(sky, 0, 2)[5].tolist() == [[5, 6], [7, 8]]
    assert [hips.estimate_order(n) for n in (512, 4096, 10**9)] == [0, 3, 13]


def test_tiles_and_trees():
    tile = np.arange(16, dtype=np.float32).reshape(1, 4, 4)
    assert (hips.decode_tile(hips.encode_tile(tile, 2, 9), "fits") == tile).all()
    assert hips.decode_tile(hips.convert_tile(hips.encode_tile(tile, 2, 9), "fits", "png", 2, 9), "png")[0, 3, 3] == 255
    assert hips.tile_path(3, 12345) == "Norder3/Dir10000/Npix12345.fits"
    codes = {c for _, c, _ in hips.lint(["Norder9/Dir0/Npix1.png", "Norder1/Dir0/Npixel.fits"], "hips_order = 3\nhips_tile_format = fits\nhips_tile_width = 100\n")}
    assert {"MISSING_PROPERTY", "INVALID_PROPERTY", "TILE_ORDER_EXCEEDS_MAX", "TILE_FORMAT_UNDECLARED", "UNRECOGNIZED_TILE_NAME", "ALLSKY_MISSING", "MOC_MISSING"} <= codes
    table = hips.moc(1, range(4))
    h = fits.hdus(table)[1]
    assert fits.decode_table(fits.data_of(table, h), h.header)["UNIQ"].tolist() == [4]


def test_world_coordinates():
    w = (10.0, 20.0, 120.0, -10.0, -0.5, 0.1, 0.05, 0.5)
    assert [float(v) for v in hips.pixel_to_world(w, np.array(9.0), np.array(19.0))] == [120.0, -10.0]
    x, y = hips.world_to_pixel(w, *hips.pixel_to_world(w, np.array(3.0), np.array(4.0)))
    assert np.allclose([x, y], [3, 4])
