"""The engine on Spark: queries against their SQL, data sources, pyramids and streaming."""

import collections
import os

import numpy as np
import pytest

from skylattice.formats import fits, hips, ser
from skylattice.plans import catalogue, pyramids

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    clean = lambda x: None if x is None or x != x else round(x, 6) + 0.0 if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    frame = frame[sorted(frame.columns)]
    return collections.Counter(tuple(map(str, map(clean, r))) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["bintable_all_types", "header_cards", "image_scaled_bzero", "rice_roundtrip", "sample_bicubic", "healpix_ang2pix", "ser_timing", "xisf_table_cells", "convert_ser_fits_ser", "hips_lint"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    assert rows_of(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows_of(con.execute(catalogue.SQL[name]).df())


def test_data_sources(spark, tmp_path):
    from skylattice.sources.datasource import register

    register(spark)
    cube = np.arange(24, dtype=np.int16).reshape(4, 2, 3)
    table = fits.table_hdu(["id", "name", "v"], ["1K", "4A", "1PE"], [[1, 2, 3], ["a", "bb", "c"], [[1.0], [], [2.0, 3.0]]])
    (tmp_path / "a.fits").write_bytes(fits.write([fits.image_hdu(cube, 16), table]))
    read = lambda view, **o: spark.read.format("skyfits").options(path=str(tmp_path / "a.fits"), view=view, **o).load()
    assert [r["data_type"] for r in read("hdus").orderBy("hdu_index").collect()] == ["image", "binary_table"]
    assert read("cards").where("key = 'NAXIS3'").first()["value_num"] == 4
    assert read("frames").where("frame = 2").select("pixels").collect()[0][0] == cube[2].ravel().tolist()
    rows = read("rows").where("_row >= 1").orderBy("_row").collect()
    assert [(r["id"], r["name"], r["v"]) for r in rows] == [(2, "bb", []), (3, "c", [2.0, 3.0])]
    assert read("rows", columns="name").columns == ["path", "_row", "name"]
    (tmp_path / "b.ser").write_bytes(ser.write([bytes([i] * 4) for i in range(5)], 2, 2, 8, 0, list(range(5))))
    frames = spark.read.format("skyser").option("path", str(tmp_path / "b.ser")).load()
    assert [r["samples"] for r in frames.where("frame BETWEEN 3 AND 4").orderBy("frame").collect()] == [[3] * 4, [4] * 4]


def test_sources_split_tables_and_read_only_their_part(spark, tmp_path, monkeypatch):
    """ASCII and variable-length tables in many partitions; nothing is opened to plan them, and a task reads its rows and their heap alone."""
    from skylattice.sources import datasource

    datasource.register(spark)
    n = 300
    ascii_ = fits.ascii_hdu(["id", "name"], ["I8", "A6"], [list(range(n)), [f"n{i}" for i in range(n)]])
    wide = fits.table_hdu(["id", "v", "s", "x", "c"], ["1K", "1PD", "1PA", "5X", "2C"], [list(range(n)), [[float(i)] * (i % 5) for i in range(n)], ["t" * (i % 3) for i in range(n)], [[i >> k & 1 for k in range(5)] for i in range(n)], [[complex(i, 1), complex(0, i)] for i in range(n)]])
    (tmp_path / "t.fits").write_bytes(fits.write([fits.empty_primary(), ascii_, wide]))
    read = lambda **o: spark.read.format("skyfits").options(path=str(tmp_path / "t.fits"), view="rows", partitionBytes="4096", **o).load()
    assert read(hdu="1").rdd.getNumPartitions() >= 3
    assert sorted(tuple(r) for r in read(hdu="1").select("_row", "id", "name").collect()) == [(i, i, f"n{i}") for i in range(n)]
    rows = read(hdu="2").where("_row >= 10 AND _row < 290").orderBy("_row").collect()
    assert [(r["id"], r["v"], r["s"], r["x"]) for r in rows] == [(i, [float(i)] * (i % 5), "t" * (i % 3), [i >> k & 1 for k in range(5)]) for i in range(10, 290)]
    assert [(r["c"][0]["re"], r["c"][1]["im"]) for r in rows] == [(i, i) for i in range(10, 290)]

    opened = []
    monkeypatch.setattr(datasource, "reader_of", lambda path: opened.append(path))
    source = datasource.FitsSource({"path": str(tmp_path / "t.fits"), "view": "rows", "partitionBytes": "4096"})
    reader = source.reader(None)
    assert len(reader.partitions()) >= 3 and not opened
    monkeypatch.undo()

    sizes = []
    plain = datasource.reader_of

    def counting(path):
        one = plain(path)
        return lambda at, length: sizes.append(length) or one(at, length)

    monkeypatch.setattr(datasource, "reader_of", counting)
    schema = datasource.FitsSource({"path": str(tmp_path / "t.fits"), "view": "rows", "hdu": "2"}).schema()
    part = datasource._FitsReader({"path": "", "view": "rows", "hdu": "2"}, schema)
    sizes.clear()
    got = sum(b.num_rows for b in part.read(datasource.Part((str(tmp_path / "t.fits"),), 1, 30)))
    assert got == 10 and max(sizes) <= 2880 and sum(sizes) < 12_000


def test_xisf_source_finds_blocks_in_the_unit_s_folder_only(spark, tmp_path):
    from skylattice.formats import xisf
    from skylattice.sources.datasource import register

    register(spark)
    unit = xisf.Unit(images=[xisf.Image([2, 2, 1], "UInt8", data=b"abcd", id="m", keywords=[("A", "1", "")])], properties=[xisf.Property("P:v", "F64Vector", [1.0, 2.0])])
    (tmp_path / "one").mkdir()
    header, blocks = xisf.write_distributed(unit, max_inline=0)
    (tmp_path / "one" / "unit.xish").write_bytes(header)
    (tmp_path / "one" / "blocks.xisb").write_bytes(blocks)
    (tmp_path / "one" / "whole.xisf").write_bytes(xisf.write(unit))
    read = lambda path="one", **o: spark.read.format("skyxisf").options(path=str(tmp_path / path), **o).load()
    assert [bytes(r["data"]) for r in read().collect()] == [b"abcd", b"abcd"]
    assert [r["vec"] for r in read(view="properties").where("scope = 'unit'").collect()] == [[1.0, 2.0]] * 2
    assert read(view="keywords").count() == 2 and read(decodeImages="false").first()["data"] is None
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "unit.xish").write_bytes(header.replace(b"@header_dir/blocks", b"@header_dir/../one/blocks"))
    with pytest.raises(Exception, match="outside the unit"):
        read("two").collect()
    assert bytes(read("two", anywhere="true").first()["data"]) == b"abcd"


def test_pyramid_tree(spark, tmp_path):
    y, x = np.mgrid[0:16, 0:32]
    wcs = (16.5, 8.5, 0.1, 0.1, -0.5, 0.0, 0.0, 0.5)
    tiles = pyramids.build_tiles(spark, (x + 0.1 * y)[None], wcs, order=1, tile_width=8).cache()
    pyramids.write_tree(tiles, str(tmp_path), "a test", 1, 8, ("fits", "png"))
    assert hips.parse_properties((tmp_path / "properties").read_text())["coordsys"] == "C"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Npix*").load(str(tmp_path))
    back = {(r["order"], r["ipix"]): r["data"] for r in pyramids.decode_tiles(files).collect()}
    want = {(r["order"], r["ipix"]): r["data"] for r in tiles.collect()}
    assert back.keys() == want.keys() and all(np.array_equal(back[k], want[k], equal_nan=True) for k in want)
    out = pyramids.cutout(tiles, (4.5, 4.5, 0.1, 0.1, -0.5, 0.0, 0.0, 0.5), 8, 8, 1).collect()
    assert len(out) == 64 and any(r["value"] is not None and np.isfinite(r["value"]) for r in out)
    values = {r["ipix"]: r["value"] for r in pyramids.map_values(tiles, 0).collect()}
    for ipix, v in values.items():
        d = np.array(want[0, ipix], np.float64)
        assert np.isnan(v) if not np.isfinite(d).any() else abs(v - d[np.isfinite(d)].mean()) < 1e-4


def test_conversions_with_trees(spark, tmp_path):
    from skylattice.formats import convert, xisf

    y, x = np.mgrid[0:16, 0:32]
    wcs = (16.5, 8.5, 0.1, 0.1, -0.5, 0.0, 0.0, 0.5)
    cards = list(zip(("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2"), wcs, strict=True))
    cube = np.stack([x + 0.1 * y, 100.0 - x]).astype(np.float32)
    data = fits.write([fits.image_hdu(cube, -32, extra=cards)])
    root = str(tmp_path / "cube")
    values = pyramids.fits_to_hips(spark, data, root, "a cube", order=3, tile_width=8)
    assert (values["dataproduct_type"], values["hips_cube_depth"], values["hips_order"], values["hips_order_min"]) == ("cube", "2", "3", "0")
    mosaic = fits.hdus((tmp_path / "cube/Norder3/Allsky.fits").read_bytes())[0].header
    assert mosaic.axes[2] == 2
    want = {r["ipix"]: np.array(r["data"], np.float32) for r in pyramids.build_tiles(spark, cube, wcs, 3, 3, 8).collect()}

    def image(raw):
        h = fits.hdus(raw)[0]
        return h.header, np.stack([fits.frame(fits.data_of(raw, h), h.header, i) for i in range(fits.frame_count(h.header))])

    for ipix in sorted(want)[:3]:
        _, tile = image(pyramids.hips_to_fits(spark, root, "tile", order=3, ipix=ipix))
        assert np.array_equal(tile.ravel(), want[ipix], equal_nan=True)
    for ordering in ("NESTED", "RING"):
        raw = pyramids.hips_to_fits(spark, root, "map", ordering=ordering)
        h = fits.hdus(raw)[1]
        got = np.array(fits.decode_table(fits.data_of(raw, h), h.header)["SIGNAL"])
        assert (h.header.get("NSIDE"), h.header.get("ORDERING"), len(got)) == (8, ordering, 768)
        means = [np.nanmean(v.astype(np.float64)) for v in want.values() if np.isfinite(v).any()]
        assert np.allclose(np.sort(got[np.isfinite(got)]), np.sort(means), rtol=1e-5)
        if ordering == "NESTED":
            assert np.array_equal(np.flatnonzero(np.isfinite(got)), sorted(i for i, v in want.items() if np.isfinite(v).any()))
    header, cut = image(pyramids.hips_to_fits(spark, root, width=12, height=8, lon=0.1, lat=0.1, fov=4.0, rotation=30.0, interpolation="nearest"))
    w = hips.wcs_of(header)
    assert np.allclose(w, hips.cutout_wcs(12, 8, 0.1, 0.1, 4.0, 30.0)) and header.get("HIPSORD") == 3
    py, px = np.mgrid[0:8, 0:12].astype(float)
    ipix, fx, fy = hips.lonlat_to_pixel(3, *hips.pixel_to_world(w, px, py))
    for j in range(8):
        for i in range(12):
            plane = want[ipix[j, i]][:64].reshape(8, 8)
            v = hips.sample(plane, np.array([fx[j, i] * 8]), np.array([fy[j, i] * 8]), "nearest")[0]
            assert np.array_equal(cut[0, j, i], v, equal_nan=True)
    assert np.isfinite(cut).sum() > 60
    # through XISF, both ways, the tiles and the cutout are those of FITS
    again = str(tmp_path / "again")
    flat = fits.write([fits.image_hdu(cube[0], -32, extra=cards)])
    pyramids.xisf_to_hips(spark, convert.fits_to_xisf(flat), again, "an image", order=3, tile_width=8)
    _, tiles = pyramids.read_tree(spark, again)
    assert {r["ipix"]: r["data"] for r in tiles.collect()}.keys() == want.keys()
    assert all(np.array_equal(r["data"], want[r["ipix"]][:64], equal_nan=True) for r in tiles.collect())
    unit = xisf.read(pyramids.hips_to_xisf(spark, again, width=12, height=8, lon=0.1, lat=0.1, fov=4.0, rotation=30.0, interpolation="nearest"))
    assert np.array_equal(unit.images[0].samples()[0], cut[0], equal_nan=True)
    complex_unit = xisf.write(xisf.Unit(images=[xisf.Image([2, 2, 1], "Complex32", data=bytes(32))]))
    with pytest.raises(pyramids.HipsError):
        pyramids.xisf_to_hips(spark, complex_unit, str(tmp_path / "none"), "none")


def test_cutout_reaches_every_tile(spark, tmp_path):
    g = np.random.default_rng(2)
    vectors = g.standard_normal((150, 64)).round(3)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["y"], r["x"]): r["value"] for r in catalogue.QUERIES["hips_cutout_nearest"](spark, str(tmp_path)).collect()}
    py, px = np.mgrid[0:32, 0:64]
    assert len(got) == py.size
    ipix, fx, fy = hips.lonlat_to_pixel(2, *hips.pixel_to_world((32.5, 16.5, 180.0, 0.0, -5.625, 0.0, 0.0, 5.625), px.astype(float), py.astype(float)))
    assert set(ipix.ravel().tolist()) == set(range(192))
    for y, x, i, a, b in zip(py.ravel().tolist(), px.ravel().tolist(), ipix.ravel().tolist(), fx.ravel(), fy.ravel(), strict=True):
        if i >= len(vectors):
            assert got[y, x] is None
            continue
        c, r = int(np.floor(a * 8 + 0.5)), int(np.floor(b * 8 + 0.5))
        if c < 8 and r < 8:
            assert got[y, x] == vectors[i].reshape(8, 8)[r, c]
        else:
            assert np.isnan(got[y, x])


def test_uid_join_reads_references(spark, tmp_path, monkeypatch):
    from skylattice.sources import arrow

    orders = [(k, k % 7 or None) for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    customers = {1: "A & <b>", 2: "", 3: None, 4: "d", 6: "é"}
    spark.createDataFrame(list(customers.items()), "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    seen, real = [], arrow.read_xisf
    monkeypatch.setattr(arrow, "read_xisf", lambda files, *a: seen.append([bytes(r["content"]) for r in files.collect()]) or real(files, *a))
    got = sorted((r["o_orderkey"], r["value"]) for r in catalogue.QUERIES["xisf_uid_join"](spark, str(tmp_path)).collect())
    assert got == [(k, customers[c]) for k, c in orders if c in customers]
    assert seen and all(b"<Reference ref=" in x and b"uid=" in x for x in seen[0])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_uid_join_equals_sql(spark):
    test_query_equals_sql(spark, "xisf_uid_join")


def test_stream_of_videos(spark, tmp_path):
    from skylattice.streaming.ingest import frames, rates

    start = 621_355_968_000_000_000 + 1_700_000_000 * 10_000_000
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.ser").write_bytes(ser.write([bytes([9] * 4)] * 6, 2, 2, 8, 0, [start + i * 200_000_000 for i in range(6)]))
    q = rates(frames(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(frames), max(mean) FROM rates").first()[:] == (6, 9.0)
    finally:
        q.stop()
