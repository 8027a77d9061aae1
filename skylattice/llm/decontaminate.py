"""Benchmark decontamination: winnowed fingerprints of documents are joined with those of test items, and hits are extended.

Both sides keep the least 5-gram hash of every window, so a shared run of 10 words shares a
fingerprint. A fingerprint carries the hashes of the words around it, as many as decide which runs
of a whole window it lies in; so a joined pair is extended by itself, without the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.shared import discard, small_batches, stored
from skylattice.llm.textkernel import Block, blocks, byte_class, grams

#: Consecutive words that make a hit.
WINDOW = 10
#: Words in a fingerprinted gram; with windows of WINDOW - GRAM + 1 grams every shared WINDOW words share a fingerprint.
GRAM = 5
#: Bits, as a power of two, of the filter of items' fingerprints that is broadcast: 16 MB, whatever the items' number.
FILTER_BITS = 27
#: Bytes of what hit documents share with items that are broadcast back to the documents, at most; beyond, a join does it.
HIT_BYTES = 64 << 20

WORD = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    count = len(x) - width + 1
    out = x[:count].copy()
    for i in range(1, width):
        pick(out, x[i : i + count], out=out)
    return out


def winnow(words: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the grams that are the least of some ``window`` consecutive grams.

    Which grams of a run of words are kept depends on the run alone, ties are all kept, so two
    texts that share ``gram + window - 1`` consecutive words keep the same grams of them.
    """
    hashes = grams(words, gram)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = row[: len(hashes)] == row[gram - 1 :]
    hashes = np.where(valid, hashes, _NONE)
    if window > 1:
        edge = np.full(window - 1, _NONE)
        least = _sliding(np.concatenate([edge, hashes, edge]), window, np.minimum)  # of the windows that end at each gram and after
        # a window over a row's border is none; its least may keep a gram too many, never one too few
        valid &= _sliding(least, window, np.maximum)[: len(hashes)] == hashes
    at = np.flatnonzero(valid)
    return at, hashes[at]


def _lengths(window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int]]:
    """Each length of shared run that counts, and the length of its grams: items of fewer words than a window count whole."""
    return [(n, gram if n == window else n) for n in range(1, window + 1)]


def _prints(block: Block, n: int, gram: int, out_of_row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a block's texts for runs of n words: row, word position, hash, words around (one row of hashes each); and the rows' numbers of words.

    Of the words around, those beyond the text's ends are ``out_of_row``, which differs between the sides.
    """
    starts, ends, first = block.spans(WORD)
    words = block.hashes(starts, ends)
    at, hashes = winnow(words, first, gram, n - gram + 1)
    row = np.searchsorted(first, at, "right") - 1
    return row, at - first[row], hashes, _around(words, first, row, at, n, gram, out_of_row), np.diff(first)


def _around(words: np.ndarray, first: np.ndarray, row: np.ndarray, at: np.ndarray, n: int, gram: int, out_of_row: int) -> np.ndarray:
    index = at[:, None] + np.arange(gram - n, n)[None, :]
    inside = (index >= first[row][:, None]) & (index < first[row + 1][:, None])
    return np.where(inside, words[np.clip(index, 0, max(len(words) - 1, 0))], np.uint64(out_of_row)) if len(at) else np.zeros(index.shape, np.uint64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of numbers as one binary value."""
    width = rows.shape[1] * 8
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def item_prints(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(n, h, words, item): the items' fingerprints, each once. Null ids and texts have none."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                for n, gram in _lengths():
                    row, _, h, words, sizes = _prints(block, n, gram, 2)
                    mine = sizes[row] >= n if n == WINDOW else sizes[row] == n
                    if mine.any():
                        row, h, words = row[mine], h[mine], words[mine]
                        _, once = np.unique(np.column_stack([row.astype(np.uint64), words]), axis=0, return_index=True)
                        yield pa.record_batch(
                            [pa.array(np.full(len(once), n, np.int32)), pa.array(h[once].view(np.int64)), _binary(words[once]), pa.array(ids[block.first + row[once]].astype(np.int64))],
                            ["n", "h", "words", "item"],
                        )

    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(run, "n int, h long, words binary, item long").distinct()


def _filter_of(prints: DataFrame) -> np.ndarray:
    """A bit for every value of the first FILTER_BITS bits of a fingerprint that occurs, packed; each 32,768 bits are gathered by a task."""
    low = 64 - FILTER_BITS

    def run(key, table):
        cell = table.column("cell").to_numpy()
        bits = np.zeros(1 << 15, bool)
        bits[cell & 0x7FFF] = True
        return pa.table({"part": pa.array([int(cell[0] >> 15)], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    cells = prints.select(F.shiftrightunsigned("h", low).alias("cell")).distinct().withColumn("part", F.shiftright("cell", 15))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in cells.groupBy("part").applyInArrow(run, "part long, bits binary").toLocalIterator():
        out[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _digest(text: bytes) -> tuple[int, int]:
    raw = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def text_prints(docs: DataFrame, lengths: list[int], bits: np.ndarray, text: str = "text") -> DataFrame:
    """(d1, d2, n, h, words, at): fingerprints of texts that pass the filter, by the text's digest; ``at`` packs all positions where these words stand."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    low = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for block in blocks(batch.column(0)):
                starts, ends, first = block.spans(WORD)
                hashed = block.hashes(starts, ends)
                for n, gram in _lengths():
                    if n not in lengths:
                        continue
                    at, h = winnow(hashed, first, gram, n - gram + 1)
                    cell = (h >> low).astype(np.int64)
                    some = np.flatnonzero(table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
                    if not len(some):
                        continue
                    at, h = at[some], h[some]
                    row = np.searchsorted(first, at, "right") - 1
                    words = _around(hashed, first, row, at, n, gram, 1)
                    _, once, which = np.unique(np.column_stack([row.astype(np.uint64), words]), axis=0, return_index=True, return_inverse=True)
                    which = which.ravel()
                    order = np.argsort(which, kind="stable")
                    places = np.split((at - first[row])[order].astype("<u4"), np.cumsum(np.bincount(which))[:-1])
                    names = {int(i): _digest(block.text(int(i))) for i in np.unique(row)}
                    keys = np.array([names[i] for i in row[once].tolist()], np.int64)
                    yield pa.record_batch(
                        [
                            pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.full(len(once), n, np.int32)), pa.array(h[once].view(np.int64)),
                            _binary(words[once]), pa.array([x.tobytes() for x in places], pa.binary()),
                        ],
                        ["d1", "d2", "n", "h", "words", "at"],
                    )

    return docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "d1 long, d2 long, n int, h long, words binary, at binary")


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined pairs whose words around are alike for a whole run: how far it reaches left and right of the gram's first word."""
    gram_of = dict(_lengths())
    for batch in batches:
        sizes = batch.column("n").to_numpy()
        for n in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == n)
            part = batch.take(pa.array(some))
            sides = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<u8").reshape(len(some), -1) for c in ("words", "theirs")]
            same = sides[0] == sides[1]
            centre = n - gram_of[n]
            right = np.cumprod(same[:, centre:], axis=1).sum(axis=1)
            left = np.cumprod(same[:, :centre][:, ::-1], axis=1).sum(axis=1)
            ok = (left + right >= n) & (right >= gram_of[n])
            kept = part.filter(pa.array(ok))
            columns = [kept.column(c) for c in ("d1", "d2", "n", "h", "words", "at", "item")]
            yield pa.record_batch([*columns, pa.array(-left[ok].astype(np.int32)), pa.array(right[ok].astype(np.int32))], ["d1", "d2", "n", "h", "words", "at", "item", "l", "r"])


def _hits(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame:
    """(d1, d2, spans, items): for each text with hits, by its digest, where they stand and the items that occur."""
    theirs = stored(item_prints(items, item_id, item_text), "item-prints")
    lengths = [r["n"] for r in theirs.select("n").distinct().collect()]  # WINDOW values at most
    # copies of a text count once
    ours = stored(text_prints(docs, lengths, _filter_of(theirs), text).dropDuplicates(["d1", "d2", "n", "h", "words"]), "text-prints")
    joined = ours.join(theirs.withColumnRenamed("words", "theirs"), ["n", "h"])
    runs = joined.mapInArrow(_extended, "d1 long, d2 long, n int, h long, words binary, at binary, item long, l int, r int")
    # a gram's runs all hold the gram, so together they are one span
    spans = runs.groupBy("d1", "d2", "n", "h", "words").agg(
        F.first("at").alias("at"), F.min("l").alias("l"), F.max("r").alias("r"), F.collect_set("item").alias("items")
    )
    out = stored(
        spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("at", "l", "r")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")),
        "text-hits",
    )
    discard(theirs, ours)
    return out


def _covered(spans: list) -> list[tuple[int, int]]:
    """The union of all spans around all their positions, as separate runs (left, right) in order."""
    edges = np.concatenate([np.frombuffer(at, "<u4").astype(np.int64)[:, None] + np.array([[l, r]]) for at, l, r in spans])
    edges = edges[np.lexsort([edges[:, 1], edges[:, 0]])]
    reach = np.maximum.accumulate(edges[:, 1])
    cut = np.flatnonzero(np.concatenate([[True], edges[1:, 0] > reach[:-1]]))
    return list(zip(edges[cut, 0].tolist(), reach[np.append(cut[1:] - 1, len(reach) - 1)].tolist(), strict=True))


_RUN = T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType())])
HITS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("items", T.ArrayType(T.LongType()))]
)


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", hit_bytes: int = HIT_BYTES) -> DataFrame:
    """Every document with what it shares with test items; adds n_words, runs and items.

    A window is WINDOW consecutive words of an item, or all words of a shorter one; words are
    lower-cased A-Z runs of letters, digits and what is beyond ASCII. ``runs`` are the separate
    (left, right) word spans, in order, in which every word lies in an occurrence of some window.
    ``items`` are the ids of items with occurring windows, sorted. Null or empty texts and items
    have no words. An item id that is repeated stands for all its texts; repeated documents each
    have the same result. Columns of the added names are replaced; all others stay.

    Words are compared by 64-bit hashes, runs of at least a whole window at a time. Only
    fingerprints that pass a broadcast filter of bounded size are shuffled. Texts are found again
    by their 128-bit digest: hits of up to ``hit_bytes`` are broadcast to one narrow pass over the
    documents; beyond, the documents are joined with them.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*HITS.names)
    hits = _hits(docs, items, text, item_id, item_text)
    at = docs.columns.index(text)
    width = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *HITS.fields])
    weight = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + F.length(x["at"]) + 100) + 8 * F.size("items") + 200
    if hits.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"] <= hit_bytes:
        known = {(r["d1"], r["d2"]): ([tuple(x) for x in r["spans"]], r["items"]) for r in hits.toLocalIterator()}
        return docs.mapInArrow(_told(docs.sparkSession.sparkContext.broadcast(known), at, width), schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_digest(x.encode()) if x is not None else (None, None) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], names)

    # columns go by place here, so that no name of docs can clash
    names = [f"c{i}" for i in range(width)] + ["d1", "d2"]
    placed = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + [T.StructField(k, T.LongType()) for k in ("d1", "d2")])
    joined = docs.toDF(*names[:width]).mapInArrow(named, placed).join(hits, ["d1", "d2"], "left").select(*names[:width], "spans", "items")
    return joined.mapInArrow(_told(None, at, width), schema)


def _told(shared, at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words: list[int] = []
            texts = batch.column(at)
            for block in blocks(texts):
                n_words.extend(np.diff(block.spans(WORD)[2]).tolist())
            if shared:
                found = [shared.value.get(_digest(x.encode())) if x is not None else None for x in texts.to_pylist()]
            else:
                found = [
                    ([(x["at"], x["l"], x["r"]) for x in spans], items) if spans is not None else None
                    for spans, items in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)
                ]
            runs = [[{"l": a, "r": b} for a, b in _covered(x[0])] if x else [] for x in found]
            spans = pa.array(runs, pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())])))
            items = pa.array([x[1] if x else [] for x in found], pa.list_(pa.int64()))
            yield pa.record_batch([*batch.columns[:width], pa.array(n_words, pa.int64()), spans, items], [*(f"c{i}" for i in range(width)), *HITS.names])

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) from ``find``'s columns."""
    covered = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["r"] - x["l"])
    return found.select(
        id_col,
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM items
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, i, g.n FROM grams g JOIN items b ON g.n = b.n AND g.win = b.win
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hits) h, LATERAL (SELECT unnest(range(h.i, h.i + h.n)) AS p) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""
