"""Queries over inputs that grow: counts beyond a sample's width, rows spread over tasks, batches of bounded size."""

import collections
import os

import numpy as np
import pyarrow as pa
import pytest

from skylattice.plans import catalogue

DATA = "/root/testdata/sf0.001"

NARROW = ["image_scaled_bzero", "gzip_tile", "image_decode_8", "image_decode_16", "image_scaled_real", "convert_fits_xisf_fits"]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Line items of which three cells of the raster hold 70,000 (beyond 16 bits), 40,000 (beyond 15) and 256."""
    d = str(tmp_path_factory.mktemp("crowded"))
    cells = [(7.0, 0.03, 70_000), (50.0, 0.1, 40_000), (1.0, 0.0, 256)]
    rows = " UNION ALL ".join(f"SELECT {q}D AS l_quantity, {c}D AS l_discount FROM range({n})" for q, c, n in cells)
    spark.sql(rows).write.parquet(f"{d}/lineitem.parquet")
    return d


def rows_of(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", NARROW)
def test_counts_beyond_the_width_of_a_sample(spark, crowded, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{crowded}/lineitem.parquet/*.parquet')")
    assert rows_of(catalogue.QUERIES[name](spark, crowded).select("x", "y", "value").collect()) == rows_of(con.execute(f"SELECT x, y, value FROM ({catalogue.SQL[name]})").fetchall())


def test_cards_of_all_texts(spark):
    """Lines are those of a cut by characters, wherever END stands and whatever else the text holds."""
    from pyspark.sql import functions as F

    from skylattice.functions import text

    end, line = "END".ljust(80), "COMMENT a line".ljust(80)
    some = [
        "", end, line, line * 3 + end + line, line[:-3] + end + line * 2, line[:-3] + end + "   " + line + end, "é".ljust(80) + line + end, "\U0001d54f".ljust(80) + end, line + "END", line + "END  ",
        line * 599 + end, line * 600 + end, line * 700 + end, line * 700, "\n" * 80 + end, "é" * 40 + end + " " * 40 + end, line + end[:-1] + "x" + line + end, None,
    ]

    def want(x):
        lines = [x[i : i + 80] for i in range(0, len(x), 80)][:600]
        return lines[: next((i for i, v in enumerate(lines) if v.rstrip(" ") == "END"), None)]

    rows = spark.createDataFrame(list(enumerate(some)), "i int, x string").select("i", text.cards(F.col("x")).alias("lines")).collect()
    assert {r["i"]: r["lines"] for r in rows} == {i: None if x is None else want(x) for i, x in enumerate(some)}


def tasks_of(frame):
    """How many of a frame's partitions have rows."""
    return frame.rdd.mapPartitions(lambda rows: [1] if next(iter(rows), None) is not None else []).count()


@pytest.fixture(scope="module")
def one_task(spark, tmp_path_factory):
    """Tables of one partition each, as small files are."""
    d = str(tmp_path_factory.mktemp("one_task"))
    columns = {
        "orders": ["id AS o_orderkey"], "customer": ["id AS c_custkey", "'name ' || id AS c_name", "'BUILDING' AS c_mktsegment"],
        "part": ["id AS p_partkey", "'part <' || id || '> & \"é\"' AS p_name", "CAST(id % 50 + 1 AS INT) AS p_size", "id + 0.5D AS p_retailprice"],
    }
    for name, some in columns.items():
        spark.range(3000).selectExpr(*some).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    assert tasks_of(catalogue.table(spark, d, "orders")) == 1
    return d


SPREAD = ["header_line_cap", "ser_header_fields", "xisf_properties_view", "xisf_image_elements"]


@pytest.mark.parametrize("name", SPREAD)
def test_rows_of_a_small_table_are_spread_over_tasks(spark, one_task, name):
    from skylattice.plans import formats, trees  # noqa: F401

    assert tasks_of(catalogue.QUERIES[name](spark, one_task)) >= 8


class Kernels:
    """Stands for a DataFrame and keeps the functions that would run on its batches."""

    def __init__(self, spark):
        self.sparkSession, self.runs = spark, []

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.runs.append(run)
        return self


def sizes_of(run, batch):
    """(most rows, most bytes) of what a kernel yields for one batch; the rows of it all."""
    out = list(run(iter([batch])))
    return max(b.num_rows for b in out), max(b.nbytes for b in out), pa.Table.from_batches(out)


TEXTS = ["xisb_roundtrip", "zlib_roundtrip", "lz4_roundtrip"]


@pytest.mark.parametrize("name", TEXTS)
def test_texts_are_held_a_few_at_a_time(spark, monkeypatch, name):
    """3,000 texts of 20 KB in one batch: a kernel makes copies of some megabytes at a time, not of all."""
    kernels = Kernels(spark)
    monkeypatch.setattr(catalogue, "table", lambda *_: kernels)
    catalogue.QUERIES[name](spark, "")
    texts = [bytes([65 + i % 26]) * 20_000 + b"%d" % i for i in range(3000)]
    rows, size, found = sizes_of(kernels.runs[0], pa.record_batch([pa.array(range(3000)), pa.array(texts)], ["doc_id", "raw"]))
    assert rows <= 256 and size <= 8 << 20
    assert found.column("doc_id").to_pylist() == list(range(3000)) and found.column("raw").to_pylist() == texts


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", TEXTS)
def test_texts_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    assert rows_of(catalogue.QUERIES[name](spark, DATA).collect()) == rows_of(con.execute(catalogue.SQL[name]).fetchall())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20


def test_images_are_held_a_few_at_a_time(spark):
    """Writers and readers of files yield bounded batches, whatever they get in one; small files share a batch."""
    from skylattice.sources import arrow

    n, side = 600, 64
    kernels = Kernels(spark)
    arrow.write_images(kernels, -64)
    arrow.read_frames(kernels)
    pixels = np.arange(n * side * side, dtype=np.float64).reshape(n, -1)
    whole = [np.full(n, k, np.int32) for k in (side, side, 1)]
    images = pa.record_batch([pa.array(map(str, range(n))), *map(pa.array, whole), pa.array(list(pixels))], ["path", "width", "height", "depth", "pixels"])
    rows, size, files = sizes_of(kernels.runs[0], images)
    assert rows <= 256 and size <= 10 << 20
    rows, size, frames = sizes_of(kernels.runs[1], files.combine_chunks().to_batches()[0])
    assert 16 <= rows <= 256 and size <= 10 << 20
    assert frames.column("path").to_pylist() == [str(i) for i in range(n)]
    assert np.array_equal(np.concatenate([c.values.to_numpy() for c in frames.column("pixels").combine_chunks()]), pixels.ravel())


def test_byte_orders_are_found_once_for_a_batch_s_flags(spark, monkeypatch):
    from skylattice.formats import ser
    from skylattice.plans import formats

    kernels, calls, real = Kernels(spark), [], ser.byte_order
    monkeypatch.setattr(formats, "table", lambda *_: kernels)
    monkeypatch.setattr(ser, "byte_order", lambda flag, policy, sample=b"": calls.append(policy) or real(flag, policy, sample))
    catalogue.QUERIES["ser_byte_order_policies"](spark, "")
    lines = [1, 2, 3, 4, 7] * 1000
    out = pa.Table.from_batches(list(kernels.runs[0](iter([pa.record_batch([pa.array(range(5000)), pa.array(lines, pa.int32())], ["l_orderkey", "l_linenumber"])]))))
    want = [(i, n, n % 2 == 0, "little" if n % 2 == 0 else "big", "big" if n % 2 == 0 else "little", "big") for i, n in enumerate(lines)]
    assert list(zip(*(c.to_pylist() for c in out.columns), strict=True)) == want
    assert len(calls) <= 6


def test_a_unit_s_header_is_written_once(monkeypatch):
    """Positions of attachments are put into the written header; it is the one that the library's writer gives."""
    import xml.etree.ElementTree as ET

    from skylattice.formats import xisf

    odd = "a & <b> \"c\" 'd' é \U0001d54f\r\n\t"
    properties = [xisf.Property("P:s", "String", odd, odd), xisf.Property("P:e", "String", ""), *(xisf.Property(f"P:{i}", "F64Vector", [float(i)] * (40 * i + 1)) for i in range(40))]
    unit = xisf.Unit(properties=properties, images=[xisf.Image([3, 2, 1], "UInt8", data=b"abcdef", id=odd, keywords=[("A", odd, odd)])])
    calls, real = [], xisf._xml
    monkeypatch.setattr(xisf, "_xml", lambda e: calls.append(ET.tostring(e)) or real(e))
    for align in (1, 4096):
        calls.clear()
        back = xisf.read(xisf.write(unit, max_inline=16, alignment=align))
        assert len(calls) == 1
        assert [(p.id, p.value) for p in back.properties[2:]] == [(p.id, p.value) for p in properties[2:]] and back.images[0].data == b"abcdef"
        assert back.images[0].keywords == [("A", odd, odd)]
    root = ET.fromstring(calls[0])
    root.tag, e = "xisf", ET.SubElement(root, "New", {"k": odd})
    e.text = odd
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2]
    assert real(root) == ET.tostring(root)


def test_folders_of_many_units_are_listed_by_tasks(tmp_path, monkeypatch):
    """The driver sees the folders' names alone; every unit is read once, those beside the folders, too."""
    from pyspark.sql import types as T

    from skylattice.formats import xisf
    from skylattice.sources import datasource

    monkeypatch.setattr(datasource, "FOLDERS", 70)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("id", T.StringType())])
    unit = xisf.write_distributed(xisf.Unit(properties=[xisf.Property("P:v", "F64Vector", [1.0, 2.0])]), max_inline=0)
    for i in range(150):
        (tmp_path / f"[{i}]" / "deep").mkdir(parents=True)
        (tmp_path / f"[{i}]/deep/unit.xish").write_bytes(unit[0])
        (tmp_path / f"[{i}]/deep/blocks.xisb").write_bytes(unit[1])
    (tmp_path / "top.xisf").write_bytes(xisf.write(xisf.Unit(properties=[xisf.Property("P:a", "Int32", 1)])))
    (tmp_path / "_left.xisf").write_bytes(b"")
    reader = datasource._XisfReader({"path": str(tmp_path), "view": "properties"}, schema)
    with monkeypatch.context() as m:
        m.setattr(os, "walk", lambda *_: pytest.fail("the driver walks the folders"))
        parts = reader.partitions()
    assert max(len(p.names) for p in parts if isinstance(p, datasource.Folders)) <= 70 and len(parts) > 64
    found = [x["path"] for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(found) == sorted([str(tmp_path / f"[{i}]/deep/unit.xish") for i in range(150)] + [str(tmp_path / "top.xisf")])
