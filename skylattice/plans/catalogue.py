"""Queries that run the engine's operators on the star-schema tables, each with the SQL that says what must come out.

Rows are written as files of a format and read back, rasterised into images, or used as sky
positions and times; a query's columns and values are those of its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import sky, text
from skylattice.operators import images, video
from skylattice.sources import arrow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- binary and ASCII tables


def _lineitem_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int"), "l_quantity", "l_returnflag", "l_extendedprice")
    return arrow.write_tables(rows, ["1K", "1J", "1D", "1A", "1D"])


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def bintable_scan_filter_agg(spark, d):
    rows = arrow.read_table(_lineitem_files(spark, d), "l_quantity double, l_returnflag string, l_extendedprice double")
    return rows.where("l_quantity > 25").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT l_quantity > 25 AS big, CAST(l_linenumber & 1 AS INTEGER) AS low_bit, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(sum(l_discount), 4) AS discount, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1, 2""")
def bintable_all_types(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        (q > 25).alias("l"), F.array(*(n.bitwiseAND(F.lit(8 >> i)).cast("boolean").cast("int") for i in range(4))).alias("x"), n.cast("short").alias("b"),
        n.cast("short").alias("i"), q.cast("int").alias("j"), F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("a"), q.cast("float").alias("e"),
        F.col("l_discount").alias("d"), F.struct(q.cast("float").alias("re"), n.cast("float").alias("im")).alias("c"),
        F.struct(F.col("l_discount").alias("re"), F.col("l_tax").alias("im")).alias("m"),
    )
    files = arrow.write_tables(rows, ["1L", "4X", "1B", "1I", "1J", "1K", "1A", "1E", "1D", "1C", "1M"])
    back = arrow.read_table(files, "l boolean, x array<short>, b short, i short, j int, k bigint, a string, e float, d double, c struct<re:float,im:float>, m struct<re:double,im:double>")
    return back.groupBy(F.col("l").alias("big"), F.element_at("x", 4).cast("int").alias("low_bit")).agg(
        F.count("*").alias("n"), F.sum(F.col("c.im").cast("long")).alias("lines"), F.sum(F.col("e").cast("long")).alias("quantity"),
        F.round(F.sum("d"), 4).alias("discount"), F.round(F.sum("m.im"), 4).alias("tax"),
    )


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def bintable_vla(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    back = arrow.read_table(arrow.write_tables(rows, ["1K", "1PE"]), "vec_id bigint, embedding array<float>")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT o_totalprice FROM orders")
def bintable_get_column(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return arrow.read_table(arrow.write_tables(rows, ["1K", "1D", "1A"]), "o_totalprice double")


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r BETWEEN 2 AND 5")
def bintable_row_range(spark, d):
    """Rows 2 to 5 of a file per nation; no others are decoded."""
    import numpy as np
    import pyarrow as pa

    from skylattice.formats import fits

    def run(key, rows):
        order = np.argsort(rows.column("c_custkey").to_numpy())
        unit = fits.table_hdu(["c_custkey", "c_acctbal"], ["1K", "1D"], [rows.column(c).to_numpy()[order] for c in ("c_custkey", "c_acctbal")])
        return pa.table({"path": [f"{key[0].as_py()}.fits"], "content": pa.array([fits.write([fits.empty_primary(), unit])], pa.binary())})

    files = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").applyInArrow(run, "path string, content binary")
    return arrow.read_table(files, "c_custkey bigint, c_acctbal double", start=2, count=4)


@query("SELECT p_partkey, p_name, p_size, round(p_retailprice, 2) AS p_retailprice FROM part")
def ascii_table_scan(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("int"), "p_retailprice")
    back = arrow.read_table(arrow.write_tables(rows, ["I12", "A60", "I6", "F14.4"], ascii_=True), "p_partkey bigint, p_name string, p_size int, p_retailprice double")
    return back.withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("SELECT n_nationkey, replace(n_name, ' ', '_') AS n_name FROM nation")
def ascii_table_whitespace(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), F.translate("n_name", " ", "_").alias("n_name"))
    return arrow.read_table(arrow.write_tables(rows, ["I6", "A25"], ascii_=True, places=False), "n_nationkey int, n_name string")


# -- headers


def _part_headers(spark: SparkSession, d: str) -> DataFrame:
    """A header of four cards per part, as text."""
    value = lambda k, v, c=None: text.format_card(F.lit(k), v, c)
    return table(spark, d, "part").select(
        "p_partkey",
        F.concat(
            value("PARTNAME", text.format_string(F.col("p_name")), F.lit("name of the part")), value("PSIZE", text.format_integer(F.col("p_size")), F.lit("size")),
            value("BIG", text.format_bool(F.col("p_size") > 25)), F.rpad(F.lit("COMMENT made of a part"), 80, " "), F.rpad(F.lit("END"), 80, " "),
        ).alias("header"),
    )


@query("""SELECT p_partkey, i AS card_index, k AS key, v AS value_raw, c AS comment FROM part, LATERAL (VALUES
  (0, 'PARTNAME', '''' || replace(p_name, '''', '''''') || repeat(' ', greatest(0, 8 - length(p_name))) || '''', 'name of the part'),
  (1, 'PSIZE', CAST(p_size AS VARCHAR), 'size'), (2, 'BIG', CASE WHEN p_size > 25 THEN 'T' ELSE 'F' END, '')) t(i, k, v, c)""")
def header_cards(spark, d):
    lines = _part_headers(spark, d).select("p_partkey", F.posexplode(text.cards("header")).alias("card_index", "line"))
    return lines.select("p_partkey", "card_index", text.card_key("line").alias("key"), text.card_value("line").alias("value_raw"), text.card_comment("line").alias("comment")).where("value_raw IS NOT NULL")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS psize, trim(p_name) AS partname, p_size > 25 AS big, -1.0::DOUBLE AS missing FROM part")
def header_typed_lookup(spark, d):
    lines = text.cards("header")
    of = lambda key, f: F.coalesce(*(f(x) for x in [F.filter(lines, lambda line: text.card_key(line) == key)[0]]))
    return _part_headers(spark, d).select(
        "p_partkey", of("PSIZE", text.card_number).alias("psize"), of("PARTNAME", text.card_string).alias("partname"), of("BIG", text.card_bool).alias("big"),
        F.coalesce(text.card_number(F.try_element_at(F.filter(lines, lambda line: text.card_key(line) == "NONE"), F.lit(1))), F.lit(-1.0)).alias("missing"),
    )


@query("""SELECT p_partkey, 'error' AS level, 'RANGE' AS code, 'BITPIX' AS key FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'error', 'RANGE', 'GCOUNT' FROM part WHERE p_partkey % 5 = 0""")
def header_verify_issues(spark, d):
    from collections.abc import Iterator

    import pyarrow as pa

    from skylattice.formats import fits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                cards = [("SIMPLE", True), ("BITPIX", 9 if k % 3 == 0 else 8), ("NAXIS", 0), ("GCOUNT", 2 if k % 5 == 0 else 1)]
                out += [(k, *x) for x in fits.verify(fits.parse_header(fits.format_header(cards)))]
            names = ["p_partkey", "level", "code", "key"]
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64() if i == 0 else pa.string()) for i in range(4)], names)

    return arrow.spread(table(spark, d, "part").select("p_partkey"), "p_partkey").mapInArrow(run, "p_partkey long, level string, code string, key string")


@query("SELECT n, (2880 - n % 2880) % 2880 AS pad FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem)")
def block_padding(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("n")).distinct().select("n", text.block_padding("n").alias("pad"))


def _region_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per region: an empty primary unit, a table of its nations, an image of four pixels."""
    import numpy as np
    import pyarrow as pa

    from skylattice.formats import fits

    def run(key, rows):
        names = rows.column("n_nationkey").to_pylist()
        units = [
            fits.empty_primary(), fits.table_hdu(["n_nationkey"], ["1J"], [sorted(names)], name="NATIONS"),
            fits.image_hdu(np.arange(4, dtype=np.int16).reshape(2, 2), 16, extension=True),
        ]
        return pa.table({"path": [str(key[0].as_py())], "content": pa.array([fits.write(units)], pa.binary())})

    return table(spark, d, "nation").select("n_regionkey", "n_nationkey").groupBy("n_regionkey").applyInArrow(run, "path string, content binary")


@query("""WITH n AS (SELECT n_regionkey AS r, count(*) AS c FROM nation GROUP BY 1)
  SELECT CAST(r AS VARCHAR) AS path, i AS hdu_index, t AS data_type, l AS data_length, o AS data_offset FROM n, LATERAL (VALUES
  (0, 'none', 0::BIGINT, 2880::BIGINT), (1, 'binary_table', 4 * c, 5760::BIGINT), (2, 'image', 8::BIGINT, 5760 + 4 * c + (2880 - (4 * c) % 2880) % 2880 + 2880)) v(i, t, l, o)""")
def hdu_catalog(spark, d):
    return arrow.read_hdus(_region_files(spark, d)).select("path", "hdu_index", "data_type", "data_length", "data_offset")


@query("SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS path, 1 AS hdu_index FROM nation")
def hdu_first_with_data(spark, d):
    return images.first_with_data(arrow.read_hdus(_region_files(spark, d)))


# -- images

_RASTER_SQL = """SELECT CAST(l_quantity AS INTEGER) - 1 AS x, CAST(round(l_discount * 100) AS INTEGER) AS y, CAST({value} AS DOUBLE) AS value
  FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2"""


def _raster(spark: SparkSession, d: str, value=None) -> DataFrame:
    """An image of 50 by 11 pixels: line items by quantity and discount, as one row (path, width, height, depth, pixels)."""
    px = (
        table(spark, d, "lineitem").where("l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1")
        .groupBy((F.col("l_quantity").cast("int") - 1).alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"))
        .agg((F.count("*") if value is None else value).cast("double").alias("value"))
    )
    cells = px.agg(F.map_from_entries(F.collect_list(F.struct(F.col("y") * 50 + F.col("x"), "value"))).alias("m"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(549)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.select(F.lit("raster").alias("path"), F.lit(50).alias("width"), F.lit(11).alias("height"), F.lit(1).alias("depth"), pixels.alias("pixels"))


def _digit_images(image: DataFrame, base: int) -> DataFrame:
    """An image per digit of the pixels (whole numbers from 0 on) to the base, so that counts of any size fit into narrow samples; paths end in the digit's place."""
    most, places = F.array_max("pixels"), range(-(-53 // (base.bit_length() - 1)))
    place = F.explode(F.filter(F.array(*map(F.lit, places)), lambda k: (k == 0) | (F.pow(F.lit(float(base)), k) <= F.col("_most")))).alias("_place")
    digit = lambda v: F.floor(v / F.pow(F.lit(float(base)), F.col("_place"))) % base
    rows = image.withColumn("_most", most).select("*", place)
    return rows.withColumns({"path": F.concat_ws("-", "path", "_place"), "pixels": F.transform("pixels", lambda v: digit(v).cast("double"))}).drop("_most", "_place")


def _from_digits(px: DataFrame, base: int, bscale: float = 1.0, bzero: float = 0.0) -> DataFrame:
    """(x, y, value) of what ``_digit_images`` made, scaled as its images were; pixels of which no digit counts are left out."""
    place = F.regexp_extract("path", r"-(\d+)$", 1).cast("int")
    count = F.sum((F.col("value") - bzero) / bscale * F.pow(F.lit(float(base)), place))
    return px.groupBy("x", "y").agg(count.alias("_n")).where("_n != 0").select("x", "y", (F.col("_n") * bscale + bzero).alias("value"))


def _decoded(spark: SparkSession, d: str, bitpix: int, raw=None, base: int | None = None, shown=(1.0, 0.0), **options) -> DataFrame:
    base = base or (1 << 15 if bitpix == 16 else 1 << 24)  # what samples of 16 bits, reals of 32 bits and PLIO hold exactly
    image = _raster(spark, d)
    if bitpix == 8:
        base, image = 1 << 8, image.withColumn("pixels", F.transform("pixels", lambda v: v % 256))
    image = _digit_images(image, base)
    if raw is not None:
        image = image.withColumn("pixels", F.transform("pixels", raw))
    return _from_digits(images.pixels(arrow.read_frames(arrow.write_images(image, bitpix, **options))), base, *shown)


def _image_query(bitpix: int, sql_value: str, raw, name: str, **options) -> None:
    query(_RASTER_SQL.format(value=sql_value) + f" HAVING {sql_value} <> 0", name)(lambda spark, d: _decoded(spark, d, bitpix, raw, **options))


_image_query(8, "count(*) % 256", None, "image_decode_8")
for _bits in (16, 32, 64, -32, -64):
    _image_query(_bits, "count(*)", None, f"image_decode_{str(_bits).replace('-', 'm')}")
_image_query(16, "count(*)", lambda v: v - 32768, "image_scaled_bzero", base=1 << 16, bscale=1.0, bzero=32768.0)


@query("SELECT x, y, value * 0.5 + 10 AS value FROM (" + _RASTER_SQL.format(value="count(*)") + ")")
def image_scaled_real(spark, d):
    return _decoded(spark, d, 16, shown=(0.5, 10.0), bscale=0.5, bzero=10.0)


for _codec, _bits in (("RICE_1", 32), ("GZIP_1", 16), ("PLIO_1", 32), ("HCOMPRESS_1", 32)):
    _image_query(_bits, "count(*)", None, {"RICE_1": "rice_roundtrip", "GZIP_1": "gzip_tile", "PLIO_1": "plio_roundtrip", "HCOMPRESS_1": "hcompress_roundtrip"}[_codec], codec=_codec, tile=(16, 4))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as frames of 8 by 8 pixels."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))


_PIXELS = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"SELECT vec_id, list_min({_PIXELS}) AS lo, list_max({_PIXELS}) AS hi FROM embeddings")
def image_extent(spark, d):
    e = images.extent("pixels")
    files = arrow.write_images(_frames(spark, d).withColumns({"path": F.col("vec_id").cast("string"), "depth": F.lit(1)}), -64)
    return arrow.read_frames(files).select(F.col("path").cast("long").alias("vec_id"), e["min"].alias("lo"), e["max"].alias("hi"))


@query(f"SELECT vec_id, list_min(list_filter({_PIXELS}, lambda x: x >= 0)) AS lo, list_max(list_filter({_PIXELS}, lambda x: x >= 0)) AS hi FROM embeddings WHERE len(list_filter(embedding, lambda x: x >= 0)) > 0")
def image_extent_nan(spark, d):
    holes = _frames(spark, d).withColumn("pixels", F.transform("pixels", lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(x)))
    e = images.extent("pixels")
    return holes.select("vec_id", e["min"].alias("lo"), e["max"].alias("hi")).where(~F.isnan("lo"))


@query("SELECT vec_id, CAST(embedding[44] AS DOUBLE) AS value, CAST(embedding[49] AS DOUBLE) AS wrapped FROM embeddings")
def image_get_pixel(spark, d):
    at = lambda x, y: images.pixel_at("pixels", F.lit(x), F.lit(y), F.col("width"))
    return _frames(spark, d).select("vec_id", at(3, 5).alias("value"), at(8, 5).alias("wrapped"))


@query(f"SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, round(list_sum({_PIXELS}), 4) AS total FROM embeddings WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) BETWEEN 2 AND 4")
def cube_frames(spark, d):
    frames = _frames(spark, d).where("label IS NOT NULL")
    cubes = frames.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "pixels"))).alias("f"))
    cubes = cubes.select(F.col("label").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.size("f").alias("depth"), F.flatten("f.pixels").alias("pixels"))
    back = arrow.read_frames(arrow.write_images(cubes, -64), 1, 4)
    return back.select(F.col("path").cast("int").alias("label"), "frame", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_PX = f"SELECT vec_id, i % 8 AS x, i // 8 AS y, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest({_PIXELS}) AS v FROM embeddings)"


@query(f"SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, round(avg(v), 5) + 0.0 AS value FROM ({_PX}) GROUP BY 1, 2, 3")
def image_downsample_mean(spark, d):
    return images.downsample(images.pixels(_frames(spark, d)), ["vec_id"]).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(f"SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, v AS value FROM ({_PX}) WHERE x % 2 = 0 AND y % 2 = 0")
def image_downsample_nearest(spark, d):
    return images.downsample(images.pixels(_frames(spark, d)), ["vec_id"], nearest=True)


def _sampled(spark, d, f):
    return _frames(spark, d).select("vec_id", F.round(f(F.col("pixels"), F.lit(2.3), F.lit(4.6), F.col("width"), F.col("height")), 5).alias("value"))


@query("SELECT vec_id, round(CAST(embedding[5 * 8 + 2 + 1] AS DOUBLE), 5) AS value FROM embeddings")
def sample_nearest(spark, d):
    return _sampled(spark, d, images.sample_nearest)


@query("""SELECT vec_id, round(0.7 * 0.4 * CAST(embedding[35] AS DOUBLE) + 0.3 * 0.4 * CAST(embedding[36] AS DOUBLE) + 0.7 * 0.6 * CAST(embedding[43] AS DOUBLE)
  + 0.3 * 0.6 * CAST(embedding[44] AS DOUBLE), 5) AS value FROM embeddings""")
def sample_bilinear(spark, d):
    return _sampled(spark, d, images.sample_bilinear)


@query(f"""WITH w AS (SELECT unnest([-1, 0, 1, 2]) AS k, unnest([-0.5*t*t*t + t*t - 0.5*t, 1.5*t*t*t - 2.5*t*t + 1, -1.5*t*t*t + 2*t*t + 0.5*t, 0.5*t*t*t - 0.5*t*t]) AS wx,
  unnest([-0.5*u*u*u + u*u - 0.5*u, 1.5*u*u*u - 2.5*u*u + 1, -1.5*u*u*u + 2*u*u + 0.5*u, 0.5*u*u*u - 0.5*u*u]) AS wy
  FROM (SELECT CAST(0.3 AS DOUBLE) AS t, CAST(0.6 AS DOUBLE) AS u))
  SELECT vec_id, round(sum(v * a.wx * b.wy), 5) AS value FROM ({_PX}) p JOIN w a ON p.x = 2 + a.k JOIN w b ON p.y = 4 + b.k GROUP BY vec_id""")
def sample_bicubic(spark, d):
    return _sampled(spark, d, images.sample_bicubic)


@query(f"""SELECT vec_id, CAST(list_sum(b) AS BIGINT) AS total, b[1] AS first FROM (SELECT vec_id, list_transform(v, lambda x:
  CAST(floor((x - list_min(v)) * 255 / (list_max(v) - list_min(v)) + 0.5) AS INTEGER)) AS b FROM (SELECT vec_id, {_PIXELS} AS v FROM embeddings))""")
def float_to_byte(spark, d):
    rows = _frames(spark, d).select("vec_id", images.to_bytes("pixels").alias("b"))
    return rows.select("vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("b")[0].alias("first"))


@query("SELECT DISTINCT r, g, b, round(0.299 * r + 0.587 * g + 0.114 * b, 4) AS gray FROM (SELECT l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)")
def rgba_to_gray(spark, d):
    rows = table(spark, d, "lineitem").select(*((F.col(c) % 256).alias(n) for c, n in (("l_orderkey", "r"), ("l_partkey", "g"), ("l_suppkey", "b")))).distinct()
    return rows.select("r", "g", "b", F.round(images.gray(F.col("r"), F.col("g"), F.col("b")), 4).alias("gray"))


@query("""SELECT c_custkey AS tile, CAST((c_custkey % 7) * 16 AS INTEGER) AS x, CAST((c_custkey // 7) * 8 AS INTEGER) AS y, CAST(least(16, 100 - (c_custkey % 7) * 16) AS INTEGER) AS w,
  CAST(least(8, m + 5 - (c_custkey // 7) * 8) AS INTEGER) AS h FROM customer, (SELECT (max(c_custkey) // 7) * 8 AS m FROM customer)""")
def tile_placement(spark, d):
    """Customers as tiles of an image that is as high as their largest key needs, its last row of tiles cut."""
    rows = table(spark, d, "customer")
    height = F.lit((rows.agg(F.max("c_custkey")).first()[0] or 0) // 7 * 8 + 5)
    t = images.tile_layout(F.col("c_custkey"), F.lit(100), height, F.lit(16), F.lit(8))
    return rows.select(F.col("c_custkey").alias("tile"), t["x"].alias("x"), t["y"].alias("y"), t["w"].alias("w"), t["h"].alias("h"))


@query("""SELECT l_orderkey AS k, count(*) AS n, round(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey * 0.25 + 100 END), 3) AS total FROM lineitem GROUP BY 1""")
def dequantize(spark, d):
    stored = F.when(F.col("l_linenumber") == 1, F.lit(-2147483646)).otherwise(F.col("l_partkey"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), images.dequantize(stored, F.lit(0.25), F.lit(100.0)).alias("v"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query("""WITH RECURSIVE r(i, s) AS (SELECT 1, 16807::BIGINT UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM r WHERE i < 10000)
  SELECT i, round(CAST(CAST(s / 2147483647.0 AS FLOAT) AS DOUBLE), 6) AS value FROM r""")
def dither_sequence(spark, d):
    from skylattice.formats.tiles import dither_sequence as randoms

    return spark.createDataFrame([(i + 1, round(float(x), 6)) for i, x in enumerate(randoms())], "i int, value double")


# -- sky


_WCS_SQL = "SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey // 100 AS DOUBLE) AS y FROM customer"


def _wcs():
    return sky.wcs(10.0, 20.0, 120.0, -10.0, cd11=-0.5, cd12=0.1, cd21=0.05, cd22=0.5)


@query(f"""SELECT c_custkey, round(((120 - 0.5 * (x - 9) + 0.1 * (y - 19)) % 360 + 360) % 360, 6) AS lon,
  round(greatest(-90, least(90, -10 + 0.05 * (x - 9) + 0.5 * (y - 19))), 6) AS lat FROM ({_WCS_SQL})""")
def wcs_pixel_to_world(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100).cast("double").alias("x"), F.floor(F.col("c_custkey") / 100).cast("double").alias("y"))
    p = sky.pixel_to_world(_wcs(), F.col("x"), F.col("y"))
    return rows.select("c_custkey", F.round(p["lon"], 6).alias("lon"), F.round(p["lat"], 6).alias("lat"))


@query("""SELECT c_custkey, round((0.5 * dlon - 0.1 * dlat) / det + 9, 5) AS x, round((-0.5 * dlat - 0.05 * dlon) / det + 19, 5) AS y FROM (
  SELECT c_custkey, (c_custkey % 360 + 0.25 - 120 + 540) % 360 - 180 AS dlon, c_acctbal / 200.0 + 10 AS dlat, -0.5 * 0.5 - 0.1 * 0.05 AS det FROM customer)""")
def wcs_world_to_pixel(spark, d):
    p = sky.world_to_pixel(_wcs(), F.col("c_custkey") % 360 + 0.25, F.col("c_acctbal") / 200.0)
    return table(spark, d, "customer").select("c_custkey", F.round(p["x"], 5).alias("x"), F.round(p["y"], 5).alias("y"))


_LONLAT = "SELECT c_custkey, (c_custkey * 37 % 360) + 0.37 AS lon, degrees(asin(greatest(-0.999, least(0.999, c_acctbal / 10500.0)))) AS lat FROM customer"


def _positions(spark, d):
    lat = F.degrees(F.asin(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("c_acctbal") / 10500.0))))
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") * 37 % 360 + 0.37).alias("lon"), lat.alias("lat"))


@query(f"""SELECT c_custkey, round(degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(-20)) + cos(radians(lat)) * cos(radians(-20)) * cos(radians(lon - 80)))))), 6) AS dist
  FROM ({_LONLAT})""")
def great_circle_distance(spark, d):
    return _positions(spark, d).select("c_custkey", F.round(sky.great_circle(F.col("lon"), F.col("lat"), F.lit(80.0), F.lit(-20.0)), 6).alias("dist"))


_NEST = f"""
  SELECT c_custkey, bal, CASE WHEN fa = fb THEN fa % 4 + 4 WHEN fa > fb THEN fb % 4 ELSE fa % 4 + 8 END * 64
    + (ix & 1) + ((ix & 2) << 1) + ((ix & 4) << 2) + ((iy & 1) << 1) + ((iy & 2) << 2) + ((iy & 4) << 3) AS ipix
  FROM (SELECT *, CAST(floor((a - floor(a)) * 8) AS BIGINT) AS ix, CAST(floor((1 - (b - floor(b))) * 8) AS BIGINT) AS iy,
    CAST(floor(a) + 4 AS BIGINT) AS fa, CAST(floor(b) + 4 AS BIGINT) AS fb FROM (
    SELECT *, t + u + 0.5 AS a, t - u + 0.5 AS b FROM (
      SELECT c_custkey, bal, CASE WHEN abs(z) <= 2.0/3 THEN phi ELSE phi - (abs(s) - 1) * (phi % (pi()/2) - pi()/4) END / (pi()/2) AS t,
        CASE WHEN abs(z) <= 2.0/3 THEN 0.75 * z ELSE s / 2 END AS u
      FROM (SELECT c_custkey, bal, z, phi, sign(z) * (2 - sqrt(3 * (1 - abs(z)))) AS s FROM (
        SELECT l.c_custkey, c_acctbal AS bal, sin(radians(lat)) AS z, radians(lon) AS phi FROM ({_LONLAT}) l JOIN customer c ON l.c_custkey = c.c_custkey)))))"""


@query(f"SELECT c_custkey, CAST(ipix AS BIGINT) AS ipix FROM ({_NEST})")
def healpix_ang2pix(spark, d):
    return _positions(spark, d).select("c_custkey", sky.lonlat_to_nest(3, F.col("lon"), F.col("lat"))["ipix"].alias("ipix"))


@query("""SELECT i AS ipix, round(degrees(asin(z)), 6) AS lat FROM (SELECT i, CASE WHEN abs(u) <= 1 THEN 2 * u / 3 ELSE sign(u) * (1 - (2 - abs(u)) * (2 - abs(u)) / 3) END AS z FROM (
  SELECT i, (ix + 0.5) / 8 + (iy + 0.5) / 8 - i // 256 AS u FROM (
    SELECT i, (i & 1) + ((i & 4) >> 1) + ((i & 16) >> 2) AS ix, ((i & 2) >> 1) + ((i & 8) >> 2) + ((i & 32) >> 3) AS iy FROM (SELECT unnest(range(768)) AS i))))""")
def healpix_pix2ang(spark, d):
    return spark.range(768).select(F.col("id").alias("ipix"), F.round(sky.nest_to_lonlat(3, F.col("id"))["lat"], 6).alias("lat"))


@query("""WITH p AS (SELECT i, f, ix, iy, CASE f // 4 WHEN 0 THEN 2 * (f % 4) + 1 WHEN 1 THEN 2 * (f % 4) ELSE 2 * (f % 4) + 1 END AS jp, (f // 4 + 2) * 8 - ix - iy - 1 AS jr FROM (
    SELECT i, i // 64 AS f, (i & 1) + ((i & 4) >> 1) + ((i & 16) >> 2) AS ix, ((i & 2) >> 1) + ((i & 8) >> 2) + ((i & 32) >> 3) AS iy FROM (SELECT unnest(range(768)) AS i))),
  q AS (SELECT *, CASE WHEN jr < 8 THEN jr WHEN jr > 24 THEN 32 - jr ELSE 8 END AS nr,
    CASE WHEN jr < 8 THEN 2 * jr * (jr - 1) WHEN jr > 24 THEN 768 - 2 * (33 - jr) * (32 - jr) ELSE 112 + 32 * (jr - 8) END AS before, CASE WHEN jr BETWEEN 8 AND 24 THEN (jr - 8) & 1 ELSE 0 END AS k FROM p)
  SELECT i AS ipix, CAST(before + (CASE WHEN p > 4 * nr THEN p - 4 * nr WHEN p < 1 THEN p + 4 * nr ELSE p END) - 1 AS BIGINT) AS ring FROM (
    SELECT *, CAST(floor((jp * nr + ix - iy + 1 + k) / 2.0) AS BIGINT) AS p FROM q)""")
def healpix_nest2ring(spark, d):
    return spark.range(768).select(F.col("id").alias("ipix"), sky.nest_to_ring(3, F.col("id")).alias("ring"))


@query(f"SELECT CAST(ipix AS BIGINT) AS ipix, count(*) AS n, round(avg(bal), 4) AS value FROM ({_NEST}) GROUP BY 1")
def healpix_map_mean(spark, d):
    px = _positions(spark, d).withColumn("ipix", sky.lonlat_to_nest(3, F.col("lon"), F.col("lat"))["ipix"])
    return px.groupBy("ipix").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("value"))


@query(f"""SELECT ipix FROM (SELECT i AS ipix, z, phi FROM (SELECT i, CASE WHEN abs(u) <= 1 THEN 2 * u / 3 ELSE sign(u) * (1 - (2 - abs(u)) * (2 - abs(u)) / 3) END AS z,
   CASE WHEN abs(u) <= 1 THEN t * pi()/4 ELSE t * pi()/4 - (abs(u) - 1) / (abs(u) - 2) * ((t * pi()/4) % (pi()/2) - pi()/4) END AS phi FROM (
   SELECT i, (ix + 0.5) / 8 + (iy + 0.5) / 8 - i // 256 AS u, 2 * (i // 64 % 4) + CASE i // 256 WHEN 1 THEN 0 ELSE 1 END + (ix - iy) / 8.0 + 8 AS t FROM (
   SELECT i, (i & 1) + ((i & 4) >> 1) + ((i & 16) >> 2) AS ix, ((i & 2) >> 1) + ((i & 8) >> 2) + ((i & 32) >> 3) AS iy FROM (SELECT unnest(range(768)) AS i)))))
  WHERE degrees(acos(greatest(-1, least(1, z * sin(radians(15)) + sqrt(1 - z * z) * cos(radians(15)) * cos(phi - radians(40)))))) <= 12 + {sky.max_pixel_radius(3)!r}""")
def tile_disc_prune(spark, d):
    return sky.disc_tiles(spark, 3, 40.0, 15.0, 12.0)


# -- paths and properties


@query("SELECT DISTINCT l_partkey AS ipix, 'Norder5/Dir' || (l_partkey // 10000) * 10000 || '/Npix' || l_partkey || '.fits' AS path FROM lineitem")
def hips_path(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("ipix")).distinct().select("ipix", text.tile_path(F.lit(5), "ipix").alias("path"))


@query("SELECT DISTINCT l_partkey AS ipix, 5 AS ord, (l_partkey // 10000) * 10000 AS dir, 'png' AS format FROM lineitem")
def hips_path_parse(spark, d):
    paths = table(spark, d, "lineitem").select("l_partkey").distinct().select(text.tile_path(F.lit(5), "l_partkey", "png").alias("path"))
    p = text.parse_tile_path("path")
    return paths.select(p["ipix"].alias("ipix"), p["order"].alias("ord"), p["dir"].alias("dir"), p["format"].alias("format"))


@query("SELECT p_partkey, CAST(least(13, greatest(0, ceil(log2(greatest(1.0, p_size * 100 / 512.0))))) AS INTEGER) AS ord FROM part")
def hips_order_estimate(spark, d):
    return table(spark, d, "part").select("p_partkey", text.order_estimate(F.col("p_size") * 100).alias("ord"))


@query("""SELECT t AS ipix, CAST(t // 27 AS INTEGER) AS tile_row, CAST(t % 27 AS INTEGER) AS tile_col, CAST((t // 27) * 64 AS INTEGER) AS y, CAST((t % 27) * 64 AS INTEGER) AS x
  FROM (SELECT DISTINCT l_partkey % 768 AS t FROM lineitem)""")
def hips_allsky_layout(spark, d):
    p = images.allsky_place(F.col("ipix"), 3, 64)
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 768).alias("ipix")).distinct()
    return rows.select("ipix", p["row"].alias("tile_row"), p["column"].alias("tile_col"), p["y"].alias("y"), p["x"].alias("x"))


@query("SELECT p_partkey, p_name AS title, CAST(p_size AS VARCHAR) AS width FROM part")
def hips_properties_parse(spark, d):
    lines = F.concat(F.lit("# a comment\nobs_title = "), F.col("p_name"), F.lit("\nhips_tile_width   = "), F.col("p_size").cast("string"), F.lit("\n\nbad line\n"))
    m = text.properties(lines)
    return table(spark, d, "part").select("p_partkey", F.element_at(m, "obs_title").alias("title"), F.element_at(m, "hips_tile_width").alias("width"))


# -- video


_TICKS = "SELECT *, epoch_us(ts) * 10 + 621355968000000000 AS ticks, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events"


def _events(spark, d):
    rows = table(spark, d, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.withColumns({"ticks": video.ticks_of(F.col("ts")), "frame": frame})


@query(f"SELECT CAST(user_id AS VARCHAR) AS path, CAST(frame AS INTEGER) AS frame, CAST(ticks AS BIGINT) AS ts_ticks, CAST(event_id % 256 AS INTEGER) AS s0, CAST(user_id % 256 AS INTEGER) AS s1 FROM ({_TICKS})")
def ser_roundtrip(spark, d):
    rows = _events(spark, d).select("user_id", "frame", F.col("ticks").alias("ts_ticks"), F.array((F.col("event_id") % 256).cast("int"), (F.col("user_id") % 256).cast("int")).alias("samples"))
    back = arrow.read_ser_frames(arrow.write_ser(rows, "user_id", 2, 1, 8))
    return back.select("path", "frame", F.col("ts_ticks").cast("long").alias("ts_ticks"), F.col("samples")[0].alias("s0"), F.col("samples")[1].alias("s1"))


@query(f"""SELECT user_id, count(*) AS frames, CAST(max(ticks) - min(ticks) AS BIGINT) AS duration_ticks, round((max(ticks) - min(ticks)) / 1e7, 4) AS seconds,
  round(CASE WHEN max(ticks) > min(ticks) THEN (count(*) - 1) / ((max(ticks) - min(ticks)) / 1e7) END, 8) AS fps FROM ({_TICKS}) GROUP BY user_id""")
def ser_timing(spark, d):
    t = video.timing(_events(spark, d), "user_id")
    return t.withColumns({"seconds": F.round("seconds", 4), "fps": F.round("fps", 8)})


@query("""SELECT user_id, count(*) FILTER (back) AS breaks, count(*) FILTER (back) = 0 AS ordered FROM (
  SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events) GROUP BY user_id""")
def ser_order_check(spark, d):
    return video.order_breaks(_events(spark, d), "user_id", "event_id")


@query("""SELECT l_suppkey, count(DISTINCT v & 255) AS low_bytes, round(avg(CASE WHEN v % 256 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS share, CAST(coalesce(sum(abs(v - p)), 0) AS BIGINT) AS step
  FROM (SELECT l_suppkey, v, lag(v) OVER (PARTITION BY l_suppkey ORDER BY o) AS p FROM (
    SELECT l_suppkey, l_partkey % 65536 AS v, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS o FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem))) GROUP BY 1""")
def ser_endianness(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").distinct()
    rows = rows.select("l_suppkey", (F.col("l_partkey") % 65536).alias("v"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("o"))
    return video.endianness_score(rows, "l_suppkey", "o", "v").withColumn("share", F.round("share", 6))


@query("SELECT DISTINCT n, p, greatest(0, least(n, greatest(p // 108, 1), p // 100)) AS frames FROM (SELECT l_partkey AS n, l_orderkey * 10 AS p FROM lineitem)")
def ser_relaxed_frames(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("n"), (F.col("l_orderkey") * 10).alias("p")).distinct()
    return rows.select("n", "p", video.relaxed_frames(F.col("n"), F.col("p"), F.lit(100)).alias("frames"))


# -- blocks


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, base64(encode(text)) AS b64 FROM documents")
def checksums_base64(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("b64"))


def _codec_query(codec: str, item: int) -> None:
    def run(spark, d):
        from collections.abc import Iterator

        import pyarrow as pa

        from skylattice.codecs import blocks

        def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrow.steps(batches):
                out = []
                for raw in batch.column(1).to_pylist():
                    if codec == "zstd":
                        import zstandard

                        out.append(blocks.decode_block(zstandard.compress(raw), f"zstd:{len(raw)}"))
                    elif codec == "none":
                        out.append(blocks.unshuffle(blocks.shuffle(raw, item), item))
                    else:
                        out.append(blocks.decode_block(*blocks.encode_block(raw, codec, item)))
                yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "raw"])

        rows = arrow.bounded(table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))).mapInArrow(trip, "doc_id long, raw binary")
        return rows.select("doc_id", F.length("raw").cast("long").alias("n"), F.sha2("raw", 256).alias("digest"))

    name = {"zlib": "zlib_roundtrip", "lz4": "lz4_roundtrip", "zstd": "zstd_decode", "none": "shuffle_roundtrip"}[codec]
    query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, sha256(coalesce(text, '')) AS digest FROM documents", name)(run)


for _codec, _item in (("zlib", 4), ("lz4", 2), ("zstd", 1), ("none", 8)):
    _codec_query(_codec, _item)


@query("SELECT p_partkey, 'attachment' AS type, CAST(p_partkey * 4096 AS BIGINT) AS position, CAST(p_size AS BIGINT) AS size FROM part")
def xisf_location_parse(spark, d):
    where = text.location(F.concat_ws(":", F.lit("attachment"), (F.col("p_partkey") * 4096).cast("string"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", where["type"].alias("type"), where["position"].alias("position"), where["size"].alias("size"))


@query("SELECT p_partkey, 'zlib' AS codec, p_size % 2 = 0 AS shuffled, CAST(p_partkey * 2 AS BIGINT) AS size, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS item FROM part")
def xisf_compression_parse(spark, d):
    even = F.col("p_size") % 2 == 0
    c = text.compression(F.concat(F.lit("zlib"), F.when(even, "+sh").otherwise(""), F.lit(":"), (F.col("p_partkey") * 2).cast("string"), F.when(even, ":2").otherwise("")))
    return table(spark, d, "part").select("p_partkey", c["codec"].alias("codec"), c["shuffled"].alias("shuffled"), c["size"].alias("size"), c["item"].alias("item"))


@query("SELECT p_partkey, p_name, p_size, round(p_retailprice, 2) AS price FROM part")
def xisf_table_cells(spark, d):
    rows = arrow.spread(table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("int"), "p_retailprice"), "p_partkey")
    cells = arrow.read_xisf(arrow.write_xisf_tables(rows, "PARTS", ["UInt64", "String", "Int32", "Float64"]), "cells")
    of = lambda name, c: F.max(F.when(F.col("field_id") == name, F.col(c)))
    wide = cells.groupBy("path", "row").agg(
        of("p_partkey", "value_exact").cast("long").alias("p_partkey"), of("p_name", "value_str").alias("p_name"), of("p_size", "value_exact").cast("int").alias("p_size"),
        F.round(of("p_retailprice", "value_num"), 2).alias("price"),
    )
    return wide.drop("path", "row")


@query("SELECT o_orderkey, c_mktsegment AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def xisf_uid_join(spark, d):
    refs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"))
    elements = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("value"))
    cells = arrow.read_xisf(arrow.write_xisf_references(refs, elements, "o_orderkey"), "cells")
    # a row without a value is no String
    return cells.select(F.col("table_id").cast("long").alias("o_orderkey"), F.when(F.col("type") == "String", F.col("value_str")).alias("value"))


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, sha256(coalesce(text, '')) AS digest FROM documents")
def xisb_roundtrip(spark, d):
    from collections.abc import Iterator

    import pyarrow as pa

    from skylattice.formats import xisf

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.steps(batches):
            data = batch.column(1).to_pylist()
            file = xisf.build_index([(x, len(x)) for x in data])
            index = xisf.parse_index(file)
            out = [file[index[i + 1][0] : index[i + 1][0] + index[i + 1][1]] for i in range(len(data))]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "raw"])

    rows = arrow.bounded(table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))).mapInArrow(trip, "doc_id long, raw binary")
    return rows.select("doc_id", F.length("raw").cast("long").alias("n"), F.sha2("raw", 256).alias("digest"))


def _event_sequences(spark, d) -> DataFrame:
    rows = _events(spark, d).select("user_id", "frame", F.col("ticks").alias("ts_ticks"), F.array((F.col("event_id") % 65536).cast("int"), (F.col("user_id") % 256).cast("int")).alias("samples"))
    return arrow.write_ser(rows, "user_id", 2, 1, 16)


_SEQUENCE_SQL = f"SELECT CAST(user_id AS VARCHAR) AS path, CAST(frame AS INTEGER) AS frame, {{ticks}} AS ts_ticks, CAST(event_id % 65536 AS INTEGER) AS s0, CAST(user_id % 256 AS INTEGER) AS s1 FROM ({_TICKS})"


def _conversion_query(name: str, *way: str) -> None:
    def run(spark, d):
        back = arrow.read_ser_frames(arrow.convert(_event_sequences(spark, d), *way))
        return back.select("path", "frame", F.col("ts_ticks").cast("long").alias("ts_ticks"), F.col("samples")[0].alias("s0"), F.col("samples")[1].alias("s1"))

    exact = "CAST(ticks AS BIGINT)"
    query(_SEQUENCE_SQL.format(ticks=exact), name)(run)


_conversion_query("convert_ser_fits_ser", "ser", "fits", "ser")
_conversion_query("convert_ser_xisf_ser", "ser", "xisf", "ser")


@query(_RASTER_SQL.format(value="count(*)"))
def convert_fits_xisf_fits(spark, d):
    base = 1 << 16
    image = arrow.write_images(_digit_images(_raster(spark, d), base).withColumn("pixels", F.transform("pixels", lambda v: v - 32768)), 16, bscale=1.0, bzero=32768.0)
    return _from_digits(images.pixels(arrow.read_frames(arrow.convert(image, "fits", "xisf", "fits"))), base)


@query("""WITH g AS (SELECT x, y, CAST(100 + x + 10 * y AS DOUBLE) AS v FROM (SELECT unnest(range(32)) AS x) a CROSS JOIN (SELECT unnest(range(16)) AS y) b),
  t AS (SELECT i // 64 AS ipix, i % 8 AS px, i // 8 % 8 AS py FROM (SELECT unnest(range(768)) AS i)),
  u AS (SELECT ipix, px, py, 2 * (ipix % 4) + CASE ipix // 4 WHEN 1 THEN 0 ELSE 1 END + (px - py) / 8.0 AS t, (px + 0.5) / 8 + (py + 0.5) / 8 - ipix // 4 AS u FROM t),
  s AS (SELECT ipix, px, py, CASE WHEN abs(u) <= 1 THEN 2 * u / 3 ELSE sign(u) * (1 - (2 - abs(u)) * (2 - abs(u)) / 3) END AS z,
    CASE WHEN abs(u) <= 1 THEN t * 45 ELSE t * 45 - (abs(u) - 1) / (abs(u) - 2) * ((t * 45) % 90 - 45) END AS lon FROM u),
  p AS (SELECT ipix, px, py, (((lon + 360) % 360 - 0.13 + 540) % 360 - 180) / -0.5 + 15.5 AS x, (degrees(asin(z)) - 0.17) / 0.5 + 7.5 AS y FROM s)
  SELECT ipix, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, v AS value FROM p JOIN g ON g.x = floor(p.x + 0.5) AND g.y = floor(p.y + 0.5)""")
def hips_reproject_nearest(spark, d):
    import numpy as np

    from skylattice.plans import pyramids

    y, x = np.mgrid[0:16, 0:32]
    wcs = (16.5, 8.5, 0.13, 0.17, -0.5, 0.0, 0.0, 0.5)
    tiles = pyramids.build_tiles(spark, (100.0 + x + 10 * y)[None], wcs, order=1, min_order=0, tile_width=8, interpolation="nearest").where("order = 0")
    px = tiles.select("ipix", F.posexplode("data").alias("i", "v")).where(~F.isnan("v"))
    return px.select("ipix", (F.col("i") % 8).cast("int").alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), F.col("v").cast("double").alias("value"))


@query()
def hips_cutout_nearest(spark, d):
    from skylattice.plans import pyramids

    vectors = table(spark, d, "embeddings")
    order = 0  # the lowest that holds all ids
    while 12 << 2 * order <= (vectors.agg(F.max("vec_id")).first()[0] or 0):
        order += 1
    tiles = vectors.select(F.lit(order).alias("order"), F.col("vec_id").alias("ipix"), F.lit(8).alias("width"), F.lit(1).alias("depth"), F.col("embedding").alias("data"))
    # the whole sky, in pixels of a quarter of a tile's width, so that no tile is missed
    width, height, step = 16 << order, 8 << order, 22.5 / (1 << order)
    return pyramids.cutout(tiles, (width / 2 + 0.5, height / 2 + 0.5, 180.0, 0.0, -step, 0.0, 0.0, step), width, height, order, "nearest")


@query("""SELECT 'error' AS level, 'TILE_FORMAT_UNDECLARED' AS code, 'Norder5/Dir' || (i // 10000) * 10000 || '/Npix' || i || '.png' AS subject FROM (SELECT DISTINCT l_partkey AS i FROM lineitem) WHERE i % 10 = 0
  UNION ALL VALUES ('warning', 'ALLSKY_MISSING', 'Allsky'), ('warning', 'MOC_MISSING', 'Moc.fits'), ('warning', 'PROPERTY_WARNING', 'hips_status'), ('warning', 'PROPERTY_WARNING', 'hips_release_date')""")
def hips_lint(spark, d):
    from skylattice.formats import hips
    from skylattice.plans import pyramids

    i = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i")).distinct()
    files = i.select(F.when(F.col("i") % 10 == 0, text.tile_path(F.lit(5), "i", "png")).otherwise(text.tile_path(F.lit(5), "i")).alias("path"))
    values = hips.default_properties(creator_did="ivo://x/y", obs_title="t", hips_order="6", hips_tile_width="64", hips_tile_format="fits")
    return pyramids.lint(files, hips.format_properties(values))


@query("SELECT p_partkey, p_size & (p_size - 1) <> 0 AS bad_width, p_size % 2 = 0 AS missing_title FROM part")
def hips_properties_validate(spark, d):
    from collections.abc import Iterator

    import pyarrow as pa

    from skylattice.formats import hips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for size in batch.column(1).to_pylist():
                values = hips.default_properties(creator_did="a", obs_title="" if size % 2 == 0 else "t", hips_order="3", hips_tile_width=str(size), hips_tile_format="fits")
                found.append({(c, k) for _, c, k in hips.check_properties(values)})
            bad, missing = ([x in f for f in found] for x in (("INVALID_PROPERTY", "hips_tile_width"), ("MISSING_PROPERTY", "obs_title")))
            yield pa.record_batch([batch.column(0), pa.array(bad), pa.array(missing)], ["p_partkey", "bad_width", "missing_title"])

    return arrow.spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").mapInArrow(run, "p_partkey long, bad_width boolean, missing_title boolean")
