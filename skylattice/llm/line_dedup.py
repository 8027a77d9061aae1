"""Line dedup: sharded cuckoo filters in front of exact reference counts, open to additions and removals of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.cuckoo import CuckooFilter, build
from skylattice.llm.shared import shared_dir, small_batches
from skylattice.llm.textkernel import Block, blocks, byte_class

#: Code points of a key that counts.
MIN_POINTS = 20
#: Documents that hold a key whose lines go.
MIN_DOCS = 3
#: Keys in a shard's filter when the shards are laid out.
SHARD_KEYS = 50_000
#: Generations of postings beyond which they are written anew as one, without what was removed.
MOST_GENERATIONS = 8
#: Bytes of filters, and rows of repeated keys, that are broadcast at most; beyond them, joins do the work.
FILTER_BYTES = 64 << 20
EXACT_ROWS = 1_000_000

_SPACE = byte_class(b" \t\n\v\f\r")


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each row; of the lines that count: number, row, both halves of the key's digest)."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    # a row's last line ends where the row does, all others at a line end
    first = np.arange(len(block) + 1) + np.searchsorted(breaks, block.offsets)
    ends = np.empty(len(starts), np.int64)
    last = np.zeros(len(starts), bool)
    last[first[1:] - 1] = True
    ends[last], ends[~last] = block.offsets[1:], breaks
    # where an empty row begins just after a line end, equal starts are in the order of rows
    solid = np.flatnonzero(_SPACE[block.data])
    left, right = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = np.flatnonzero(left <= right)
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    a, z = solid[left[some]], solid[right[some]] + 1
    long = points[z] - points[a] >= MIN_POINTS
    number, a, z = some[long], a[long], z[long]
    row = np.searchsorted(first, number, "right") - 1
    return starts, ends, first, number, row, *block.digests(a, z)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id): the keys of each document's lines that count, as 128-bit BLAKE2b digests; once a row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                *_, row, k1, k2 = _lines(block)
                once = np.unique(np.stack([row.astype(np.uint64), k1, k2], 1), axis=0)
                yield pa.record_batch(
                    [
                        pa.array(once[:, 1].view(np.int64)), pa.array(once[:, 2].view(np.int64)),
                        pa.array(ids[block.first + once[:, 0].astype(np.int64)].astype(np.int64)),
                    ],
                    ["k1", "k2", "doc_id"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long")


class LineStore:
    """Which lines occur in how many documents, as tables in shared storage.

    ``postings`` (gen, k1, k2, doc_id) grow with each ``add``; ``removed`` (gen, doc_id) with each
    ``remove``, so a removal rewrites no posting and can be undone by adding the document again.
    From them come a snapshot per generation: ``refs`` (shard, k1, k2, refs, holder), exact
    counts of documents and the largest document id of each key, and ``filters`` (shard, blob),
    a cuckoo filter per shard with the keys that ``min_docs`` documents or more hold. Keys that
    cross that count are inserted into, or deleted from, their shard's filter; a filter without
    room is built anew at twice its size. Once shards hold twice the keys that they are meant for,
    they are laid out anew, and all filters built. After MOST_GENERATIONS, postings are written
    anew without removed documents. A generation counts once it is complete, so a step
    that fails or repeats leaves the last one whole.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, exact_rows: int = EXACT_ROWS) -> None:
        self.spark, self.path, self.min_docs = spark, path or shared_dir(spark, "lines"), min_docs
        self.filter_bytes, self.exact_rows = filter_bytes, exact_rows
        self.gen = 0
        self.shards = 0
        self._postings: list[str] = []
        self._removed: list[str] = []
        self._refs = "refs"  # the name of this generation's table

    def _at(self, table: str, gen: int | None = None) -> str:
        return f"{self.path}/gen-{self.gen if gen is None else gen:05d}/{table}"

    def refs(self) -> DataFrame:
        """Exact counts at this generation: (shard, k1, k2, refs, holder)."""
        return self.spark.read.parquet(self._at(self._refs))

    def filters(self) -> DataFrame:
        return self.spark.read.parquet(self._at("filters"))

    def live(self) -> DataFrame:
        """(k1, k2, doc_id) of all documents that are in."""
        rows = self.spark.read.parquet(*self._postings)
        if self._removed:
            gone = self.spark.read.parquet(*self._removed).groupBy("doc_id").agg(F.max("gen").alias("gone"))
            rows = rows.join(gone, "doc_id", "left").where("gone IS NULL OR gone < gen")
        return rows.select("k1", "k2", "doc_id")

    def _counted(self, rows: DataFrame) -> DataFrame:
        # first by key and document, then by key: both partial in each task, so no key's rows meet in one
        return rows.distinct().groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("holder"))

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(max(self.shards, 1))).cast("int").alias("shard")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> LineStore:
        """Take documents in. A document id that is in already adds the lines that it didn't have."""
        new = f"{self.path}/gen-{self.gen + 1:05d}/postings"
        line_keys(docs, id_col, text).withColumn("gen", F.lit(self.gen + 1)).write.mode("overwrite").parquet(new)
        fresh = self.spark.read.parquet(new).select("k1", "k2", "doc_id")
        if self.gen:
            known = self.live()
            fresh = fresh.join(known, ["k1", "k2", "doc_id"], "left_anti")
            counts = self._counted(fresh).unionByName(self.refs().select("k1", "k2", "refs", "holder"))
            counts = counts.groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.max("holder").alias("holder"))
        else:
            counts = self._counted(fresh)
        self._postings.append(new)
        return self._commit(counts)

    def remove(self, docs: DataFrame, id_col: str = "doc_id") -> LineStore:
        """Take documents out by id; ids that aren't in change nothing. Lines they shared count less, and may stay again."""
        if not self.gen:
            return self
        gone = f"{self.path}/gen-{self.gen + 1:05d}/removed"
        before = self.live()
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(self.gen + 1).alias("gen")).distinct().write.mode("overwrite").parquet(gone)
        ids = self.spark.read.parquet(gone)
        touched = before.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct()
        self._removed.append(gone)
        again = self._counted(self.live().join(touched, ["k1", "k2"], "left_semi"))
        kept = self.refs().join(touched, ["k1", "k2"], "left_anti").select("k1", "k2", "refs", "holder")
        return self._commit(kept.unionByName(again))

    def _commit(self, counts: DataFrame) -> LineStore:
        gen = self.gen + 1
        if not self.shards:
            counts.write.mode("overwrite").parquet(self._at("counts", gen))
            counts = self.spark.read.parquet(self._at("counts", gen))
            self.shards = max(1, -(-counts.where(F.col("refs") >= self.min_docs).count() // SHARD_KEYS))
        write = lambda rows, name: rows.select(self._shard(), "k1", "k2", "refs", "holder").write.mode("overwrite").parquet(self._at(name, gen))
        name, many = "refs", F.col("refs") >= self.min_docs
        write(counts, name)
        refs = self.spark.read.parquet(self._at(name, gen))
        keys = refs.where(many).count()
        fresh = not self.gen
        if keys > 2 * SHARD_KEYS * self.shards:
            self.shards, fresh, name = -(-keys // SHARD_KEYS), True, "refs-laid-out"
            write(refs.drop("shard"), name)
            refs = self.spark.read.parquet(self._at(name, gen))
        now = refs.where(many).select("shard", "k1", "k2")
        if not fresh:
            old = self.refs().where(many).select("shard", "k1", "k2")
            change = now.join(old, ["shard", "k1", "k2"], "left_anti").withColumn("step", F.lit(1))
            change = change.unionByName(old.join(now, ["shard", "k1", "k2"], "left_anti").withColumn("step", F.lit(-1)))
            filters = (
                self.filters().select("shard", "blob").groupBy("shard")
                .cogroup(change.groupBy("shard")).applyInPandas(_updated, "shard int, blob binary")
            )
            filters.write.mode("overwrite").parquet(self._at("changed", gen))
            filters = self.spark.read.parquet(self._at("changed", gen))
            full = filters.where("blob IS NULL").select("shard")
            rebuilt = now.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_built, "shard int, blob binary")
            filters = filters.where("blob IS NOT NULL").unionByName(rebuilt)
        else:
            filters = now.groupBy("shard").applyInPandas(_built, "shard int, blob binary")
        filters.write.mode("overwrite").parquet(self._at("filters", gen))
        self.gen, self._refs = gen, name
        if len(self._postings) > MOST_GENERATIONS:
            one = self._at("live")
            self.live().withColumn("gen", F.lit(gen)).write.mode("overwrite").parquet(one)
            self._postings, self._removed = [one], []
        return self

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` with the lines dropped that ``min_docs`` documents of the store hold, but for their holder's.

        A text is cut at line ends; a line's key is the line without white space at both ends,
        A-Z in lower case; keys of under 20 code points never go. All lines of a key stay in the
        document of the largest id that holds it. Kept lines are joined by line ends again. Adds
        n_lines and n_dropped, replacing columns of these names; other columns stay. A null text
        stays null and counts as one empty line; rows without an id lose no line.

        The filters are probed first, and what they pass is looked up in the exact table: in a
        broadcast copy while that is within ``exact_rows``, beyond it by a join on the key,
        whose result goes back to the documents by id.
        """
        small_batches(self.spark)
        docs = docs.drop("n_lines", "n_dropped")
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        at = docs.columns.index(id_col), docs.columns.index(text)
        size = self.filters().agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("n")).first()["n"]
        blobs = {r["shard"]: bytes(r["blob"]) for r in self.filters().collect()} if size <= self.filter_bytes else None
        repeated = self.refs().where(F.col("refs") >= self.min_docs)
        if blobs is not None and repeated.count() <= self.exact_rows:
            table = repeated.select("k1", "k2", "holder").toPandas()
            exact = _Exact(table["k1"].to_numpy(np.int64), table["k2"].to_numpy(np.int64), table["holder"].to_numpy(np.int64))
            shared = self.spark.sparkContext.broadcast((_Filters(blobs, self.shards), exact))
            return docs.mapInArrow(_dropper(shared, at, None), schema)
        rows = line_keys(docs, id_col, text).distinct()
        if blobs is not None:
            shared = self.spark.sparkContext.broadcast((_Filters(blobs, self.shards), None))
            rows = rows.mapInArrow(_sifter(shared), "k1 long, k2 long, doc_id long")
        lost = rows.join(repeated.select("k1", "k2", "holder"), ["k1", "k2"]).where("doc_id != holder")
        # columns go by place here, so that no name of docs can clash
        names = [f"c{i}" for i in range(len(docs.columns))]
        lost = lost.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("k1", "k2")).alias("lost"))
        joined = docs.toDF(*names).join(lost, F.col(names[at[0]]).cast("long") == F.col("id"), "left").select(*names, "lost")
        return joined.mapInArrow(_dropper(None, at, len(names)), schema)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "blob": [build(rows["k1"].to_numpy(np.int64).view(np.uint64)).to_bytes()]})


def _updated(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes; null if they don't fit and it must be built anew."""
    shard = int((old if len(old) else change)["shard"].iloc[0])
    if not len(old):
        return pd.DataFrame({"shard": [shard], "blob": [None]})
    some = CuckooFilter.from_bytes(bytes(old["blob"].iloc[0]))
    ok = True
    for step, key in sorted(zip(change["step"], change["k1"].to_numpy(np.int64).view(np.uint64).tolist(), strict=True)):
        ok = ok and (some.remove(key) if step < 0 else some.add(key))
    return pd.DataFrame({"shard": [shard], "blob": [some.to_bytes() if ok else None]})


class _Filters:
    """All shards' filters, probed by key; a key's shard is its first half modulo their number."""

    def __init__(self, blobs: dict[int, bytes], shards: int) -> None:
        self.blobs, self.shards = blobs, shards
        self._open: dict[int, CuckooFilter] = {}

    def maybe(self, k1: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k1), bool)
        shard = k1.view(np.int64) % self.shards
        order = np.argsort(shard, kind="stable")
        if not len(k1):
            return out
        numbers, starts = np.unique(shard[order], return_index=True)
        for n, places in zip(numbers.tolist(), np.split(order, starts[1:]), strict=True):
            if n in self.blobs:
                if n not in self._open:
                    self._open[n] = CuckooFilter.from_bytes(self.blobs[n])
                out[places] = self._open[n].contains(k1[places])
        return out


class _Exact:
    def __init__(self, k1: np.ndarray, k2: np.ndarray, holder: np.ndarray) -> None:
        order = np.lexsort([k2, k1])
        self.k1, self.k2, self.holder = k1[order], k2[order], holder[order]

    def holders(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known keys, their holders)."""
        if not len(self.k1):
            return np.zeros(0, np.int64), self.holder
        at = np.searchsorted(self.k1, k1)
        found = np.full(len(k1), -1)
        for step in range(64):  # keys with the same first half, if ever, lie side by side
            near = np.minimum(at + step, len(self.k1) - 1)
            same = (self.k1[near] == k1) & (at + step < len(self.k1))
            if not same.any():
                break
            hit = same & (self.k2[near] == k2)
            found[hit] = near[hit]
        known = np.flatnonzero(found >= 0)
        return known, self.holder[found[known]]


def _sifter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, _ = shared.value
        for batch in batches:
            yield batch.filter(pa.array(filters.maybe(batch.column(0).to_numpy().view(np.uint64))))

    return run


def _dropper(shared, at: tuple[int, int], lost_at: int | None):
    """Rows with their lines dropped: those the broadcast tables name, or those in the column at ``lost_at``."""
    id_at, text_at = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, exact = shared.value if shared else (None, None)
        for batch in batches:
            ids = batch.column(id_at).to_pylist()
            texts = batch.column(text_at)
            lost = batch.column(lost_at).to_pylist() if lost_at is not None else None
            totals: list[int] = []
            dropped: list[int] = []
            changed: dict[int, str] = {}
            for block in blocks(texts):
                starts, ends, first, number, row, k1, k2 = _lines(block)
                if lost is None:
                    some = np.flatnonzero(filters.maybe(k1))
                    known, holder = exact.holders(k1[some].view(np.int64), k2[some].view(np.int64))
                    mine = np.array([-1 if x is None else x for x in ids[block.first : block.first + len(block)]], np.int64)
                    none = np.array([x is None for x in ids[block.first : block.first + len(block)]], bool)
                    at_row = row[some[known]]
                    bad = number[some[known]][(mine[at_row] != holder) & ~none[at_row]]
                else:
                    sets = [{(x["k1"], x["k2"]) for x in lost[block.first + i] or ()} for i in range(len(block))]
                    pairs = zip(k1.view(np.int64).tolist(), k2.view(np.int64).tolist(), row.tolist(), strict=True)
                    bad = number[np.array([(a, b) in sets[i] for a, b, i in pairs], bool)]
                keep = np.ones(len(starts), bool)
                keep[bad] = False
                totals.extend(np.diff(first).tolist())
                per_row = np.bincount(np.searchsorted(first, bad, "right") - 1, minlength=len(block))
                dropped.extend(per_row.tolist())
                for i in np.flatnonzero(per_row).tolist():
                    lines = [block.data[starts[k] : ends[k]].tobytes() for k in range(first[i], first[i + 1]) if keep[k]]
                    changed[block.first + i] = b"\n".join(lines).decode()
            columns = list(batch.columns[: lost_at if lost_at is not None else len(batch.columns)])
            if changed:
                columns[text_at] = pa.array([changed.get(i, x) for i, x in enumerate(texts.to_pylist())], pa.string())
            names = batch.schema.names[: len(columns)] + ["n_lines", "n_dropped"]
            yield pa.record_batch([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = LineStore(spark).add(docs).dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, pos, line, r.key IS NOT NULL AND k.doc_id <> holder AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
