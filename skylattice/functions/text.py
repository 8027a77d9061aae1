"""Column expressions over header text, paths and specifications. All are built-in functions, inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def block_padding(n: Column | str) -> Column:
    """Bytes that fill n up to whole blocks of 2880."""
    return F.pmod(-col(n), F.lit(2880))


_END = "END".ljust(80)


def cards(header: Column | str, max_lines: int = 600) -> Column:
    """Header text as an array of 80-character lines, up to END.

    One search finds the END card. If its place counted in characters is its place counted in bytes, all
    before it is ASCII, and lines are cut out of the bytes; other text is cut by characters.
    """

    def cut(x: Column) -> Column:
        raw, at = x["raw"], x["at"]
        plain = (at % 80 == 1) & (F.substring(raw, at, F.lit(80)) == F.lit(_END.encode()))
        stop = F.least(at - 1, F.lit(80 * max_lines))
        lines = F.transform(F.sequence(F.lit(1), stop, F.lit(80)), lambda i: F.substring(raw, i, F.lit(80))).cast("array<string>")
        return F.when(plain, F.when(stop > 0, lines).otherwise(F.array().cast("array<string>"))).otherwise(_character_cards(raw.cast("string"), max_lines))

    return _bound(F.struct(col(header).cast("binary").alias("raw"), F.regexp_instr(col(header), F.lit(_END)).alias("at")), cut)


def _character_cards(header: Column, max_lines: int) -> Column:
    # found in one pass: a substring by its place would count characters from the start each time
    lines = F.slice(F.regexp_extract_all(header, F.lit("(?s).{1,80}"), F.lit(0)), 1, max_lines)

    def up_to_end(lines: Column) -> Column:
        return _bound(F.array_position(F.transform(lines, lambda x: F.rtrim(x)), "END"), lambda end: F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines))

    return _bound(lines, up_to_end)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def card_key(line: Column | str) -> Column:
    return F.trim(F.substring(col(line), 1, 8))


def card_value(line: Column | str) -> Column:
    """Raw value text of a card: a quoted string with its quotes, or what stands before the comment."""
    rest = F.substring(col(line), 11, 70)
    quoted = F.regexp_extract(rest, r"^\s*('(?:[^']|'')*')", 1)
    return F.when(F.substring(col(line), 9, 2) != "= ", F.lit(None)).when(quoted != "", quoted).otherwise(F.trim(F.regexp_extract(rest, r"^(.*?)(?: /.*)?$", 1)))


def card_string(line: Column | str) -> Column:
    raw = card_value(line)
    return F.when(raw.startswith("'"), F.trim(F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))))


def card_number(line: Column | str) -> Column:
    """A card's number, with D exponents; null for strings and logicals."""
    raw = card_value(line)
    return F.translate(F.nullif(F.regexp_extract(raw, r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][-+]?\d+)?)", 1), F.lit("")), "Dd", "EE").cast("double")


def card_bool(line: Column | str) -> Column:
    raw = card_value(line)
    return F.when(raw == "T", True).when(raw == "F", False)


def card_comment(line: Column | str) -> Column:
    rest = F.substring(col(line), 11, 70)
    after = F.regexp_replace(rest, r"^\s*'(?:[^']|'')*'", "")
    return F.trim(F.regexp_extract(after, r"(?:^| )/ ?(.*)$", 1))


def format_card(key: Column | str, value: Column, comment: Column | None = None) -> Column:
    """A card of 80 characters; ``value`` is formatted text, as from ``format_string`` or ``format_integer``."""
    text = F.concat(F.rpad(F.substring(F.upper(col(key)), 1, 8), 8, " "), F.lit("= "), value)
    if comment is not None:
        text = F.concat(text, F.lit(" / "), comment)
    return F.rpad(text, 80, " ")


def format_string(value: Column | str) -> Column:
    text = F.replace(col(value), F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), F.when(F.length(text) < 8, F.rpad(text, 8, " ")).otherwise(text), F.lit("'"))


def format_integer(value: Column | str) -> Column:
    return F.lpad(col(value).cast("string"), 20, " ")


def format_bool(value: Column | str) -> Column:
    return F.lpad(F.when(col(value), "T").otherwise("F"), 20, " ")


def keyword_base(key: Column | str) -> Column:
    """The base of an indexed keyword: NAXIS of NAXIS2."""
    found = F.regexp_extract(col(key), r"(\D+)(\d+)", 1)
    return F.when(found != "", found).otherwise(col(key))


def keyword_index(key: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(key), r"(\D+)(\d+)", 2), F.lit("")).cast("int")


def data_length(bitpix: Column, naxis: Column, pcount: Column) -> Column:
    """Bytes of a data unit, from BITPIX, an array of axes and PCOUNT."""
    size = F.aggregate(naxis, F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))
    return F.when(has_data(naxis), F.floor(size * F.abs(bitpix) / 8) + pcount).otherwise(F.lit(0)).cast("long")


def has_data(naxis: Column) -> Column:
    return F.exists(naxis, lambda x: x != 0)


def tile_path(order: Column | str, ipix: Column | str, extension: str = "fits") -> Column:
    """Norder{o}/Dir{d}/Npix{i}.{ext}"""
    i = col(ipix).cast("long")
    return F.concat(F.lit("Norder"), col(order).cast("string"), F.lit("/Dir"), (F.floor(i / 10000) * 10000).cast("string"), F.lit("/Npix"), i.cast("string"), F.lit(f".{extension}"))


TILE_PATTERN = r"Norder(\d+)(?:_(\d+))?/Dir(\d+)(?:_(\d+))?/Npix(\d+)(?:_(\d+))?\.(fits|png|jpg|jpeg)$"


def parse_tile_path(path: Column | str) -> Column:
    """(order, spectral_order, dir, ipix, spectral_index, format) of a tile's path; null for other paths."""
    part = lambda i: F.nullif(F.regexp_extract(col(path), TILE_PATTERN, i), F.lit(""))
    return F.when(
        part(1).isNotNull(),
        F.struct(
            part(1).cast("int").alias("order"), part(2).cast("int").alias("spectral_order"), part(3).cast("long").alias("dir"),
            part(5).cast("long").alias("ipix"), part(6).cast("int").alias("spectral_index"), part(7).alias("format"),
        ),
    )


def order_estimate(max_dim: Column | str, tile_width: int = 512) -> Column:
    """The order at which tiles of that width resolve an image: at most 13."""
    ratio = F.greatest(F.lit(1.0), col(max_dim).cast("double") / tile_width)
    return F.least(F.lit(13), F.greatest(F.lit(0), F.ceil(F.log2(ratio)).cast("int")))


def location(text: Column | str) -> Column:
    """(type, encoding, position, size, target, index_id) of a data block's location."""
    t = col(text)
    kind = (
        F.when(t.startswith("inline"), "inline").when(t == "embedded", "embedded").when(t.rlike(r"^(attachment|attached):"), "attachment")
        .when(t.startswith("url("), "url").when(t.startswith("path("), "path")
    )
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("long")
    target = F.nullif(F.regexp_extract(t, r"^(?:url|path)\((.*)\)", 1), F.lit(""))
    return F.struct(
        kind.alias("type"),
        F.when(kind == "inline", F.nullif(F.regexp_extract(t, r"^inline:(\w+)$", 1), F.lit(""))).alias("encoding"),
        number(r"^(?:attachment|attached):(\d+):\d+$").alias("position"),
        number(r"^(?:attachment|attached):\d+:(\d+)$").alias("size"),
        target.alias("target"),
        F.nullif(F.regexp_extract(t, r"\):(\w+)$", 1), F.lit("")).alias("index_id"),
    )


def compression(text: Column | str) -> Column:
    """(codec, shuffled, size, item) of a compression attribute."""
    p = r"^([a-z0-9-]+?)(\+sh)?:(\d+)(?::(\d+))?$"
    part = lambda i: F.regexp_extract(F.lower(F.trim(col(text))), p, i)
    return F.struct(
        F.nullif(part(1), F.lit("")).alias("codec"), (part(2) != "").alias("shuffled"), F.nullif(part(3), F.lit("")).cast("long").alias("size"),
        F.when(part(1) != "", F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(1))).alias("item"),
    )


def subblocks(text: Column | str) -> Column:
    """array<(stored, full)> of ``c,u:c,u``."""
    return F.transform(F.filter(F.split(col(text), ":"), lambda x: x != ""), lambda x: F.struct(F.split(x, ",")[0].cast("long").alias("stored"), F.split(x, ",")[1].cast("long").alias("full")))


def properties(text: Column | str) -> Column:
    """map<string,string> of ``key = value`` lines; blank lines and comments are skipped, later keys win."""
    lines = F.filter(F.transform(F.split(col(text), "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("k"), F.trim(F.split(x, "=", 2)[1]).alias("v")))
    unique = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return unique


def format_properties(values: Column) -> Column:
    """Lines of a property map, sorted by key, keys padded to 20."""
    keys = F.array_sort(F.map_keys(values))
    return F.concat_ws("\n", F.transform(keys, lambda k: F.concat(F.when(F.length(k) < 20, F.rpad(k, 20, " ")).otherwise(k), F.lit(" = "), F.element_at(values, k))))


def fixed_text(raw: Column | str) -> Column:
    """A fixed field of bytes as text: up to the first NUL, trimmed."""
    return F.trim(F.split_part(F.decode(col(raw), "ISO-8859-1"), F.lit("\0"), F.lit(1)))


def content_range(header: Column | str) -> Column:
    """(start, end, total) of a Content-Range header such as ``bytes 0-99/2880``; null unless all three are there and fit."""
    pattern = r"(?i)^\s*bytes\s+(\d+)-(\d+)/(\d+)\s*$"
    start, end, total = (F.try_to_number(F.nullif(F.regexp_extract(col(header), pattern, i), F.lit("")), F.lit("9" * 18)).cast("long") for i in (1, 2, 3))
    return F.when((start <= end) & (end < total), F.struct(start.alias("start"), end.alias("end"), total.alias("total")))


def range_problem(status: Column, encoding: Column, header: Column, start: Column, end: Column, total: Column) -> Column:
    """Why an answer to a range request can't be used (STATUS, ENCODING, RANGE_INVALID or RANGE_MISMATCH); null if it can."""
    found = content_range(header)
    plain = F.lower(F.trim(F.coalesce(encoding, F.lit(""))))
    return (
        F.when(~status.eqNullSafe(F.lit(206)), "STATUS").when(~plain.isin("", "identity"), "ENCODING").when(found.isNull(), "RANGE_INVALID")
        .when((found["start"] != start) | (found["end"] != end) | (found["total"] != total), "RANGE_MISMATCH")
    )


def cutout_query(hips_id: Column | str, width: Column, height: Column, format: str = "fits", projection: str = "TAN", **values: Column) -> Column:
    """The query string that asks a remote service for a cutout. ``values``: fov, ra, dec, coordsys, rotation_angle, or wcs, which counts before them; null ones are left out."""
    pairs = [("hips", col(hips_id)), ("width", width), ("height", height), ("format", F.lit(format))]
    if "wcs" in values:
        pairs.append(("wcs", values["wcs"]))
    else:
        pairs += [("projection", F.lit(projection)), *((k, values[k]) for k in ("fov", "ra", "dec", "coordsys", "rotation_angle") if k in values)]
    text = lambda v: F.url_encode(v.cast("string"))
    return F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), text(v))) for k, v in pairs))
