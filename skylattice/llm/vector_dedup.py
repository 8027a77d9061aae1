"""Embedding near-dup: a forest of random-projection trees with spill, exact cosines within leaves, union of links."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.shared import components, discard, small_batches, stored

COSINE = 0.98
TREES = 6
#: Vectors in a leaf of a small label, about.
LEAF = 256
#: Width of the band around a split that goes to both sides, in standard deviations of the projected difference of
#: two vectors at the least cosine: so the band is as narrow as the links are short, whatever the depth.
SPREAD = 1.0
#: Distinct vectors of a label that one task takes whole, with all trees; larger labels are dealt to tasks leaf by leaf.
SUBTREE = 8_192
#: Vectors on each side of a task, about: a leaf of a large label, or two blocks of a larger leaf.
BLOCK = 2_048
#: Vectors that the splits of large labels are fitted on, in all labels together: END_SAMPLE for each leaf, within these.
END_SAMPLE = 32
SAMPLE = 20_000
MOST_SAMPLE = 100_000

_SPLIT = 1e-9  # cosines this close to the threshold are recomputed with exact sums


@dataclass
class _Node:
    direction: np.ndarray
    low: float
    high: float
    left: _Node | int
    right: _Node | int


def _margin(cosine: float, width: int, spread: float) -> float:
    return 0.5 * spread * sqrt(max(0.0, 2 * (1 - cosine)) / width)


def _split(x: np.ndarray, random: np.random.Generator, margin: float) -> tuple[np.ndarray, float, float, np.ndarray, np.ndarray] | None:
    """A random direction, two borders (up to ``high`` goes left, from ``low`` on goes right) and both sides; None where no split helps.

    The split lies in the widest gap of the projections between their 0.3 and 0.7 quantiles, so
    that it parts few near neighbours.
    """
    for _ in range(8):
        direction = random.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        projected = x @ direction
        a = np.sort(projected)
        n, near = len(a), max(1, len(a) // 50)
        lo, hi = int(0.3 * n), max(int(0.7 * n), int(0.3 * n) + 1)
        wide = a[np.minimum(np.arange(lo, hi) + near, n - 1)] - a[np.maximum(np.arange(lo, hi) - near, 0)]
        middle = float(a[lo + int(np.argmax(wide))])
        left, right = np.flatnonzero(projected <= middle + margin), np.flatnonzero(projected >= middle - margin)
        if max(len(left), len(right)) <= 0.85 * n:
            return direction, middle - margin, middle + margin, left, right
    return None


def _dense(x: np.ndarray, random: np.random.Generator, least: float) -> bool:
    """Whether about half of the pairs, or more, are links: judged by the pairs of 64 random vectors."""
    some = x[random.choice(len(x), min(64, len(x)), replace=False)]
    return bool(np.mean(some @ some.T >= least) > 0.4)


def _grow(x: np.ndarray, weight: float, block: int, random: np.random.Generator, margin: float, least: float, sizes: list[float]) -> _Node | int:
    """A tree over a sample, each vector of which stands for ``weight``. ``sizes`` gets the estimated size of each leaf.

    A node is a leaf if it is small, or if no split helps: its pairs are mostly links, or the sample has no more to say.
    """
    parted = None
    if len(x) * weight > block and len(x) >= 16 and not _dense(x, random, least):
        parted = _split(x, random, margin)
    if parted is None:
        sizes.append(len(x) * weight)
        return len(sizes) - 1
    direction, low, high, left, right = parted
    below = [_grow(x[side], weight, block, random, margin, least, sizes) for side in (left, right)]
    return _Node(direction, low, high, *below)


def _drop(node: _Node | int, x: np.ndarray, rows: np.ndarray, out: list[tuple[int, np.ndarray]]) -> None:
    if not len(rows):
        return
    if isinstance(node, int):
        out.append((node, rows))
        return
    a = x[rows] @ node.direction
    _drop(node.left, x, rows[a <= node.high], out)
    _drop(node.right, x, rows[a >= node.low], out)


def _leaves(x: np.ndarray, random: np.random.Generator, margin: float, leaf: int, least: float) -> Iterator[np.ndarray]:
    """Row numbers of the leaves of a tree over ``x``. Where most pairs are links anyway, a node is a leaf whatever its size."""
    stack = [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf or _dense(x[rows], random, least):
            yield np.sort(rows)
        elif parted := _split(x[rows], random, margin):
            stack += [rows[parted[3]], rows[parted[4]]]
        else:  # all are close to the split: halve by rank, a tenth of each side goes to both
            a = x[rows] @ random.standard_normal(x.shape[1])
            order, cut, more = rows[np.argsort(a, kind="stable")], len(rows) // 2, max(1, len(rows) // 10)
            stack += [order[: cut + more], order[cut - more :]]


class _Tally:
    """Links among a task's vectors: how many rows each vector is linked to, and a forest that connects what links connect."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, least: float) -> None:
        self.raw, self.x, self.copies, self.least = raw, _unit(raw), copies.astype(np.float64), least
        self.linked = np.zeros(len(raw))
        self.root = np.arange(len(raw))
        self.edges: list[tuple[int, int]] = []

    def leaf(self, left: np.ndarray, right: np.ndarray | None, before: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Compare the rows ``left`` with each other, or with the rows ``right``; ``before`` tells pairs that an earlier leaf has had."""
        for i in range(0, len(left), 1024):
            part = left[i : i + 1024]
            rest = left[i:] if right is None else right
            product = self.x[part] @ self.x[rest].T
            ok = product >= self.least
            a, b = np.nonzero(np.abs(product - self.least) < _SPLIT)
            for k, m in zip(a.tolist(), b.tolist(), strict=True):
                ok[k, m] = _cosine(self.raw[part[k]], self.raw[rest[m]]) >= self.least
            if right is None:
                ok = np.triu(ok, 1)
            a, b = np.nonzero(ok)
            had = before(part[a], rest[b])
            ok[a[had], b[had]] = False
            if ok.any():
                counts = ok.astype(np.float64)
                self.linked[part] += counts @ self.copies[rest]
                self.linked[rest] += self.copies[part] @ counts
                self._connect(part, rest, ok)

    def _connect(self, part: np.ndarray, rest: np.ndarray, ok: np.ndarray) -> None:
        for k in np.flatnonzero(ok.any(axis=1)).tolist():
            i, near = int(part[k]), rest[ok[k]]
            roots = self.root[near]
            apart = roots != self.root[i]
            if apart.any():
                others, at = np.unique(roots[apart], return_index=True)
                self.edges += [(i, j) for j in near[apart][at].tolist()]
                self.root[np.isin(self.root, others)] = self.root[i]


def _cosine(p: np.ndarray, q: np.ndarray) -> float:
    return fsum(p * q) / (sqrt(fsum(p * p)) * sqrt(fsum(q * q)))


def _shares(codes: np.ndarray, here: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of rows have a leaf in common that comes before leaf ``here``; each row's leaves are padded with -1."""

    def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(codes.shape[1]):
            mine = codes[a, k]
            early = (mine >= 0) & (mine < here)
            for m in range(codes.shape[1]):
                out |= early & (mine == codes[b, m])
        return out

    return before


def _padded(lists: list[list[int] | np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max((len(x) for x in lists), default=0)), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class VectorLinks:
    """Links of near-equal vectors within labels.

    Equal vectors of a label are one point, named by a digest, so groups of exact copies cost
    nothing. Every tree sees every point; a point lies in several leaves where it is near a split.
    Two points that share a leaf of some tree are compared in double precision, and count in the
    first leaf that they share; pairs of at least the least cosine are links. A leaf gives each point's
    number of links and the edges that connect its points, never all links, so results are linear
    in the points however dense a group is.

    A label of up to ``subtree`` points is a task with all its trees. Larger labels' trees are
    fitted on a bounded sample, whose leaves hold ``block`` points, about; larger leaves (groups
    whose pairs are mostly links, or more than the sample can part) are compared by all pairs of
    blocks of that size. So no task holds more than its bound.

    Vectors that are null, zero, or hold null or non-finite components, and those without a label
    or id, link with nothing. Vectors of different lengths never link. Repeated ids are allowed:
    each row counts by its own vector, and a component is named by its smallest id. Other columns
    are ignored, whatever their names.
    """

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spread: float = SPREAD, subtree: int = SUBTREE, block: int = BLOCK, sample: int = SAMPLE, seed: int = 5) -> None:
        self.spark = rows.sparkSession
        small_batches(self.spark)
        self.cosine, self.trees, self.leaf, self.spread, self.subtree, self.block, self.sample, self.seed = cosine, trees, leaf, spread, subtree, block, sample, seed
        plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
        known = stored(plain.mapInArrow(_digested, "id long, label string, k long, k2 long, v binary"), "vectors")
        self.rows = known.select("id", "k", "k2")
        self.points = stored(
            known.where("label IS NOT NULL").groupBy("k", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")),
            "points",
        )

    def _forest(self) -> dict[str, list[tuple[_Node | int, list[int]]]]:
        """For each label of more than ``subtree`` points its trees, and each leaf's number of blocks.

        There are fewer such labels than points / subtree, and ``MOST_SAMPLE`` vectors at most are
        brought here. A label that is one dense leaf has one tree, since all would be the same.
        """
        big = {r["label"]: r["n"] for r in self.points.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > self.subtree).collect()}
        if not big:
            return {}
        total = sum(big.values())
        size = max(self.sample, min(MOST_SAMPLE, END_SAMPLE * -(-total // self.block)))
        names = F.broadcast(self.spark.createDataFrame([(x,) for x in big], "label string"))
        share = int(min(1.0, size / total) * (1 << 20)) + 1
        picked = self.points.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share).join(names, "label").select("label", "v").orderBy("label", "v").toPandas()
        out = {}
        for name, n in sorted(big.items()):
            mine = picked["v"][picked["label"] == name].tolist()
            x = _unit(np.frombuffer(b"".join(mine), np.float64).reshape(len(mine), -1)) if mine else np.zeros((0, 1))
            trees = []
            for tree in range(self.trees):
                random = np.random.default_rng([self.seed, tree, zlib.crc32(name.encode())])
                sizes: list[float] = []
                top = _grow(x, n / max(len(x), 1), self.block, random, _margin(self.cosine, x.shape[1], self.spread), self.cosine, sizes)
                trees.append((top, [max(1, int(np.ceil(s / self.block / 1.5))) for s in sizes]))
                if isinstance(top, int):
                    trees[-1] = (top, [max(1, -(-n // self.block))])
                    trees = trees[-1:]
                    break
            out[name] = trees
        return out

    def found(self) -> DataFrame:
        """(a, b, n): a point's number of linked rows, from each task that has some (b null), and the edges that connect points (n null)."""
        forest = self.spark.sparkContext.broadcast(self._forest())

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = np.array(batch.column("label").to_pylist(), object)
                vectors = batch.column("v")
                # blocks of large leaves are dealt by name
                mixed = batch.column("k").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                small = np.flatnonzero(~np.isin(labels, list(forest.value)))
                yield from dealt(batch, [(i, -1, 0, 0, 0, b"") for i in small.tolist()])
                for name in sorted(set(labels.tolist()) & set(forest.value)):
                    mine = np.flatnonzero(labels == name)
                    x = _unit(np.frombuffer(b"".join(vectors.take(pa.array(mine)).to_pylist()), np.float64).reshape(len(mine), -1))
                    codes: list[list[int]] = [[] for _ in range(len(mine))]
                    places: list[tuple[int, int, int, int, int, bytes]] = []
                    for tree, (top, counts) in enumerate(forest.value[name]):
                        ends: list[tuple[int, np.ndarray]] = []
                        _drop(top, x, np.arange(len(mine)), ends)
                        for end, rows in ends:
                            for r in rows.tolist():
                                codes[r].append(tree << 24 | end)
                        before = [np.array(c, "<u4").tobytes() for c in codes]
                        for end, rows in ends:
                            count = counts[end]
                            for r in rows.tolist():
                                i = int(mine[r])
                                b = int(mixed[i]) % count
                                for other in range(count):
                                    places.append((i, tree, end, min(b, other) * count + max(b, other), int(b > other), before[r]))
                            # a batch's rows meet every block of a large leaf, so they leave in slices
                            if len(places) > 16_384:
                                yield from dealt(batch, places)
                                places = []
                    yield from dealt(batch, places)

        def dealt(batch: pa.RecordBatch, places: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(places), 16_384):
                i, *rest = zip(*places[at : at + 16_384], strict=True)
                part = batch.select(["k", "copies", "label", "v"]).take(pa.array(i, pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.record_batch([*part.columns, *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], ["k", "copies", "label", "v", "tree", "end", "pair", "side", "before"])

        seed, spread, leaf, least, trees = self.seed, self.spread, self.leaf, self.cosine, self.trees

        def compare(key, table):
            k = table.column("k").to_numpy()
            order = np.argsort(k)
            raw = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(k), -1)[order]
            k = k[order]
            tally = _Tally(raw, table.column("copies").to_numpy()[order], least)
            if key[1].as_py() < 0:  # a whole label
                random = np.random.default_rng([seed, 77, zlib.crc32(key[0].as_py().encode())])
                codes: list[list[int]] = [[] for _ in range(len(k))]
                for tree in range(trees):
                    leaves = list(_leaves(tally.x, random, _margin(least, raw.shape[1], spread), leaf, least))
                    for number, rows in enumerate(leaves):
                        for r in rows.tolist():
                            codes[r].append(tree << 24 | number)
                    padded = _padded(codes)
                    for number, rows in enumerate(leaves):
                        tally.leaf(rows, None, _shares(padded, tree << 24 | number))
                    if len(leaves) == 1:
                        break  # one leaf holds all pairs
            else:
                lists = [np.frombuffer(x, "<u4") for x in table.column("before").to_pylist()]
                before = _shares(_padded([lists[i] for i in order.tolist()]), key[1].as_py() << 24 | key[2].as_py())
                side = table.column("side").to_numpy()[order]
                if side.any():
                    tally.leaf(np.flatnonzero(side == 0), np.flatnonzero(side == 1), before)
                else:
                    tally.leaf(np.arange(len(k)), None, before)
            some = np.flatnonzero(tally.linked)
            a = [*k[some].tolist(), *(int(k[i]) for i, _ in tally.edges)]
            b = [None] * len(some) + [int(k[j]) for _, j in tally.edges]
            n = [*tally.linked[some].astype(np.int64).tolist(), *[None] * len(tally.edges)]
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

        schema = "k long, copies long, label string, v binary, tree int, end long, pair long, side int, before binary"
        return self.points.mapInArrow(deal, schema).groupBy("label", "tree", "end", "pair").applyInArrow(compare, "a long, b long, n long")

    def result(self) -> DataFrame:
        """(vec_id, n_links, component_id, kept) for every row; a null id has null component_id and kept."""
        found = stored(self.found(), "vector-links")
        more = found.where("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("more"))
        of = components(found.where("b IS NOT NULL")).withColumnRenamed("id", "k")
        known = self.points.select("k", "k2", "id", "copies").join(more, "k", "left").join(of, "k", "left").withColumn("component", F.coalesce("component", "k"))
        least = known.groupBy("component").agg(F.min("id").alias("c"))
        names = stored(known.join(least, "component").select("k", "k2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), "c"), "vector-names")
        discard(found)
        component = F.coalesce("c", F.col("id"))
        return self.rows.join(names, ["k", "k2"], "left").select(
            F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept")
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, k, k2, v): of vectors that can link the label with the length, both halves of a digest of label and vector, and its bytes; else nulls."""
    for batch in batches:
        ids, labels, column = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        out: list[tuple[str | None, int | None, int | None, bytes | None]] = [(None, None, None, None)] * len(batch)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        usable = np.asarray(ids.is_valid()) & np.array([x is not None for x in labels], bool) & (sizes > 0)
        for width in np.unique(sizes[usable]).tolist():
            rows = np.flatnonzero(usable & (sizes == width))
            x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width) + 0.0  # of -0.0 and 0.0 the same
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            for i, v in zip(rows[good].tolist(), x[good], strict=True):
                name, raw = f"{labels[i]}/{width}", v.tobytes()
                digest = hashlib.blake2b(raw, digest_size=16, key=hashlib.blake2b(name.encode(), digest_size=16).digest()).digest()
                out[i] = name, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), raw
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "label", "k", "k2", "v"])


def _unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VectorLinks(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).result()


OP6_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), c(id, reach) AS (
  SELECT vec_id, vec_id FROM g UNION SELECT c.id, p.b FROM c JOIN p ON c.reach = p.a
), m AS (SELECT id, min(reach) AS component_id FROM c GROUP BY id
), n AS (SELECT a AS id, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(m.component_id, e.vec_id) AS component_id,
  coalesce(m.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""
