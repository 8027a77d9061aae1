"""N-gram Jaccard join: documents whose sets of word shingles are similar, joined in prefix trees.

A document's set is its distinct 5-word shingles as 63-bit hashes. One global order holds for all
sets: shingles that very many documents hold come last, others by hash. (Any order gives the same
links, so the frequent ones may be found approximately.) A trie of the sets in that order is dealt
to tasks, so that each task holds the paths which can meet:

1. Sets. Documents with equal sets form a class, named by a digest of the set; all later steps see
   a class once.
2. Near copies first. Sets that agree in two least hashes (BANDS chances) meet in blocks of bounded
   size. Each block is a trie that is traversed for every set with partial overlaps shared along
   paths and subtrees pruned by the lengths that remain; a subtree whose sets are all connected to
   the set already is skipped. This connects most of what belongs together.
3. What is left. Similar sets share a shingle among the first n - ceil(0.75 n) + 1 of each in the
   global order. These prefixes go to shards by shingle, with the component of step 2. A shingle
   whose sets all lie in one component has nothing left to give. Of the others, two sets of
   different components are a candidate if their sizes and the shingle's places in both leave
   enough overlap possible; no pair within a component is ever written.
   Pairs are written at once only for shingles of up to CROWD sets, so a row makes CROWD / 2 at most.
4. The sets of more crowded shingles, and of frequent ones, are bundled by the shingles' smallest
   set, so that all shingles of a passage meet in a task, which sifts its pairs before it writes
   them. Sets of shingles of over CROWD_ROWS sets are bundled likewise, and cut into parts of that
   size, dealt by component; parts of one component never meet each other. Where two parts meet,
   their sets are compared at once in a trie, and only links that connect something are written.
5. Candidates that share too few prefix shingles, or whose counts of shingles by hash cell rule
   the similarity out, are dropped; the rest is grouped around common neighbours, a bounded number
   of pairs a group. Each group's sets form a trie, which is traversed from its root towards the
   candidates with the same bounds and gives exact overlaps.
6. Components of all links.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.jaccard_trie import Trie, all_links
from skylattice.llm.shared import components, discard, small_batches, stored
from skylattice.llm.textkernel import Block, blocks, byte_class, grams, mix

WORDS = 5
PERCENT = 75
#: A shingle is frequent if one in FREQUENT_SHARE documents holds it, and at least FREQUENT_DOCS.
FREQUENT_DOCS = 4
FREQUENT_SHARE = 16_000
#: Sets that share a shingle of their prefixes, beyond which it counts as crowded: pairs would be many times the sets.
CROWD = 8
#: Sets in a block of near copies.
BLOCK_SETS = 256
#: Sets of crowded shingles in a part, about; two parts meet in a task.
CROWD_ROWS = 1024
#: Shingles of a part's sets, about.
PART_TOKENS = 1_000_000
#: Rows of crowded shingles in a bundle, about.
BUNDLE_ROWS = 20_000
#: Prefix shingles in a shard, about.
SHARD_TOKENS = 1_000_000
#: Candidate pairs in a group, about.
GROUP_PAIRS = 1024
#: Set ids that are broadcast to fetch sets, at most; beyond them the sets are fetched by joins.
FETCH_ROWS = 1_000_000
#: Pairs of hash functions whose least values bring near copies together.
BANDS = 4
#: Hash cells of the counts that rule out candidates.
CELLS = 64

_WORD = byte_class(b" \t\n\v\f\r")
_LATE = np.uint64(1 << 63)
_SEEDS = [np.uint64(0x9E37 * (i + 1)) for i in range(2 * BANDS)]


class _Last:
    """The frequent shingles; ``mark`` sets the highest bit of those in an array, which puts them last in the order."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(values >> np.uint64(47)).astype(np.int64)] = True

    def mark(self, x: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[(x >> np.uint64(47)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
            late = maybe[self.values[at] == x[maybe]]
            x = x.copy()
            x[late] |= _LATE
        return x


def _sets(block: Block, words: int, last: _Last | None = None) -> list[np.ndarray]:
    """Each row's distinct shingles in order; a row of fewer words has all of them as one, a row of none nothing."""
    starts, ends, first = block.spans(_WORD)
    hashes = block.hashes(starts, ends)
    full = grams(hashes, words) >> np.uint64(1)
    if last is not None:
        full = last.mark(full)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= words:
            x = np.sort(full[a : z - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif z > a:
            x = grams(hashes[a:z], z - a, seed=z - a) >> np.uint64(1)
            out.append(last.mark(x) if last is not None else x)
        else:
            out.append(hashes[:0])
    return out


def _sid(x: np.ndarray) -> int:
    """The name of a set, whether or not its frequent shingles are marked."""
    if len(x) and x[-1] >= _LATE:
        x = np.sort(x & ~_LATE)
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _bands(sets: list[np.ndarray]) -> list[list[int] | None]:
    """For each set BANDS numbers, each from its least values by two hash functions; None for empty sets."""
    some = [i for i, x in enumerate(sets) if len(x)]
    out: list[list[int] | None] = [None] * len(sets)
    if some:
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        least = [np.minimum.reduceat(mix(flat ^ seed), starts) for seed in _SEEDS]
        bands = np.stack([mix(least[2 * k] ^ mix(least[2 * k + 1])) for k in range(BANDS)], 1).view(np.int64).tolist()
        for i, x in zip(some, bands, strict=True):
            out[i] = x
    return out


def _cells(x: np.ndarray) -> bytes:
    return np.minimum(np.bincount((x >> np.uint64(57)).astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes()


class JaccardJoin:
    """The join's state for one table of documents: ``classes``, ``links`` and ``components``.

    Rows whose text is null or has no words have an empty set and link with nothing. Rows without
    an id, too, link with nothing. Repeated ids are allowed: each row counts by its own text. Equal
    similarity needs no tie rule, as a component's name is its smallest id. All other columns of
    ``docs`` are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD, fetch_rows: int = FETCH_ROWS, frequent_docs: int = FREQUENT_DOCS, crowd_rows: int = CROWD_ROWS) -> None:
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.words, self.percent, self.crowd, self.fetch_rows, self.frequent_docs, self.crowd_rows = words, percent, crowd, fetch_rows, frequent_docs, crowd_rows
        small_batches(self.spark)
        scanned = stored(self._scanned(), "jaccard-rows")
        self.rows = scanned.where("t IS NULL").select("doc_id", "sid", "n", "cells", "bands")
        total = self.rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        self.n_docs, self.n_tokens = total["docs"], total["tokens"]
        least = max(frequent_docs, self.n_docs // FREQUENT_SHARE)
        often = scanned.where("t IS NOT NULL").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("t")
        self.last = self.spark.sparkContext.broadcast(_Last(np.sort(often.toPandas()["t"].to_numpy(np.int64).view(np.uint64))))
        self.classes = stored(
            self.rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid")
            .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("bands").alias("bands")),
            "jaccard-classes",
        )

    def _scanned(self) -> DataFrame:
        """One row for each document, and rows (t, c) of shingles that are frequent within blocks of a task's rows.

        A shingle that one in FREQUENT_SHARE of all documents holds is so in some block. All tasks
        together can name FREQUENT_SHARE times a set's mean size of these at most.
        """
        words, share = self.words, FREQUENT_SHARE
        names = ["doc_id", "sid", "n", "cells", "bands", "t", "c"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(2, len(held) // share)
            null = [pa.nulls(int(some.sum()), k) for k in kinds[:5]]
            return pa.record_batch([*null, pa.array(values[some].view(np.int64)), pa.array(counts[some])], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            size = 0
            for batch in batches:
                for block in blocks(batch.column(1)):
                    sets = _sets(block, words)
                    rows = [[_sid(x) for x in sets], [len(x) for x in sets], [_cells(x) for x in sets], _bands(sets)]
                    null = [pa.nulls(len(sets), pa.int64())] * 2
                    yield pa.record_batch([batch.column(0).slice(block.first, len(block)), *map(pa.array, rows, kinds[1:5]), *null], names)
                    held += sets
                    size += sum(rows[1])
                    if size >= 2_000_000:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

        return self.docs.mapInArrow(run, "doc_id long, sid long, n long, cells binary, bands array<long>, t long, c long")

    # -- sets

    def _blocks_of_sets(self, wanted: DataFrame) -> DataFrame:
        """(block, sid, set) for (block, sid, rep) rows: texts are read again, and only sets that some block wants are kept.

        Up to ``fetch_rows`` wanted rows are broadcast, so that each set goes straight to its
        blocks; beyond, all sets are shuffled once to meet them. Texts never are.
        """
        words, last = self.words, self.last

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reps, cuts, sids, places = shared.value if shared else (None, None, None, None)
            for batch in batches:
                ids = batch.column(0)
                keep = np.asarray(ids.is_valid())
                mine = ids.fill_null(-1).to_numpy(zero_copy_only=False)
                at = mine
                if shared:
                    at = np.minimum(np.searchsorted(reps, mine), max(len(reps) - 1, 0))
                    keep = keep & (reps[at] == mine) if len(reps) else np.zeros(len(mine), bool)
                batch, at, mine = batch.filter(pa.array(keep)), at[keep], mine[keep]
                for block in blocks(batch.column(1)):
                    names, owners, where, data = [], [], [], []
                    for i, x in enumerate(_sets(block, words, last.value), block.first):
                        name, raw = _sid(x), x.tobytes()
                        rows = range(cuts[at[i]], cuts[at[i] + 1]) if shared else [None]
                        for k in rows:
                            if k is None or sids[k] == name:
                                names.append(name)
                                owners.append(int(mine[i]))
                                where.append(0 if k is None else int(places[k]))
                                data.append(raw)
                    yield pa.record_batch(
                        [pa.array(where, pa.int64()), pa.array(owners, pa.int64()), pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["block", "rep", "sid", "set"]
                    )

        schema = "block long, rep long, sid long, set binary"
        if wanted.count() <= self.fetch_rows:
            rows = wanted.select("rep", "sid", "block").toPandas().sort_values(["rep", "sid", "block"])
            reps, start = np.unique(rows["rep"].to_numpy(np.int64), return_index=True)
            shared = self.spark.sparkContext.broadcast((reps, np.append(start, len(rows)), rows["sid"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)))
            return self.docs.mapInArrow(run, schema).drop("rep")
        shared = None
        return self.docs.mapInArrow(run, schema).drop("block").join(wanted, ["rep", "sid"]).select("block", "sid", "set")

    def _joined(self, sets: DataFrame, pairs: DataFrame | None) -> DataFrame:
        """(a, b): links of each block's sets; all that chains need, or the given (block, a, b) pairs that are similar."""
        percent = self.percent
        packed = sets.withColumn("other", F.lit(None).cast("long"))
        if pairs is not None:
            packed = packed.unionByName(pairs.select("block", F.col("a").alias("sid"), F.lit(None).cast("binary").alias("set"), F.col("b").alias("other")))
        full = pairs is None

        def run(key, table):
            own: dict[int, np.ndarray] = {}
            targets: dict[int, list[int]] = defaultdict(list)
            for sid, x, other in zip(*(table.column(c).to_pylist() for c in ("sid", "set", "other")), strict=True):
                if x is not None:
                    own[sid] = np.frombuffer(x, np.uint64)
                else:
                    targets[sid].append(other)
            names = sorted(own)
            sets = [own[x] for x in names]
            if full:
                out = all_links(sets, percent)
            else:
                at = {x: i for i, x in enumerate(names)}
                trie = Trie(sets)
                out = [(at[a], m) for a, some in sorted(targets.items()) for m in trie.links(at[a], percent, targets=[at[b] for b in sorted(set(some))])]
            return pa.table({"a": pa.array([names[i] for i, _ in out], pa.int64()), "b": pa.array([names[j] for _, j in out], pa.int64())})

        return packed.groupBy("block").applyInArrow(run, "a long, b long")

    # -- near copies first

    def _near_copies(self) -> DataFrame:
        """(a, b): links of sets that agree in a band, enough of them to connect what they connect.

        A band's sets are dealt to blocks of bounded size, each with two members in common with
        the other blocks of that band; bands with the same members count once.
        """
        band = self.classes.select("sid", "rep", F.posexplode("bands").alias("r", "m")).select("sid", "rep", F.xxhash64("r", "m").alias("band"))
        mark = F.xxhash64("sid")
        counts = band.groupBy("band").agg(
            F.count("*").alias("c"), F.min(F.struct("sid", "rep")).alias("lo"), F.max(F.struct("sid", "rep")).alias("hi"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y")
        ).where("c > 1")
        counts = counts.groupBy("c", "x", "y").agg(F.min("band").alias("band"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        parts = stored(counts.select("band", "lo", "hi", F.ceil(F.col("c") / BLOCK_SETS).cast("int").alias("parts")), "jaccard-bands")
        name = lambda part: F.xxhash64("band", part).alias("block")
        dealt = band.join(parts.select("band", "parts"), "band").select(name(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")), "sid", "rep")
        anchors = parts.select("band", F.explode(F.array("lo", "hi")).alias("e"), "parts").select("band", "e.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        wanted = stored(dealt.union(anchors.select(name(F.col("part")), "sid", "rep")).distinct(), "jaccard-blocks")
        out = stored(self._joined(self._blocks_of_sets(wanted), None), "jaccard-near")
        discard(parts, wanted)
        return out

    # -- candidates

    def _prefixes(self, labels: DataFrame) -> DataFrame:
        """(sid, n, label, prefix): the first shingles in order of each class, which any similar set shares one of."""
        words, percent, last = self.words, self.percent, self.last

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(1)):
                    sets = _sets(block, words, last.value)
                    some = [i for i, x in enumerate(sets) if len(x)]
                    sets = [sets[i] for i in some]
                    rows = [pa.array([_sid(x) for x in sets], pa.int64()), pa.array([x[: _prefix_size(len(x), percent)].tobytes() for x in sets], pa.binary())]
                    ids = batch.column(0).slice(block.first, len(block)).take(pa.array(some, pa.int64()))
                    yield pa.record_batch([ids, *rows], ["rep", "sid", "prefix"])

        known = self.classes.select("sid", "rep", "n").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        return self.docs.mapInArrow(run, "rep long, sid long, prefix binary").join(known, ["rep", "sid"]).select("sid", "n", "label", "prefix")

    def _mixed(self, prefixes: DataFrame) -> np.ndarray:
        """Sorted: the frequent shingles that sets of different components hold in their prefixes (at most all frequent ones)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, owner, _ = _flat(batch.column("prefix"))
                late = flat >= _LATE
                t, label = flat[late], batch.column("label").to_numpy()[owner[late]]
                order = np.argsort(t, kind="stable")
                t, label = t[order], label[order]
                starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
                if len(starts):
                    least, most = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
                    yield pa.record_batch([pa.array(t[starts].view(np.int64)), pa.array(least), pa.array(most)], ["t", "lo", "hi"])

        found = prefixes.select("label", "prefix").mapInArrow(run, "t long, lo long, hi long").groupBy("t").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi")
        return np.sort(found.select("t").toPandas()["t"].to_numpy(np.int64).view(np.uint64))

    def _frequent_rows(self, prefixes: DataFrame, mixed: np.ndarray) -> DataFrame:
        """(token, sid, n, pos, label) of the frequent shingles in prefixes that are not all of one component."""
        shared = self.spark.sparkContext.broadcast(mixed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = shared.value
            for batch in batches:
                flat, owner, place = _flat(batch.column("prefix"))
                late = np.flatnonzero(flat >= _LATE)
                if len(some) and len(late):
                    at = np.minimum(np.searchsorted(some, flat[late]), len(some) - 1)
                    late = late[some[at] == flat[late]]
                    mine = [batch.column(c).to_numpy()[owner[late]] for c in ("sid", "n", "label")]
                    sid, n, label = (pa.array(x) for x in mine)
                    yield pa.record_batch([pa.array(flat[late].view(np.int64)), sid, n, pa.array(place[late]), label], ["token", "sid", "n", "pos", "label"])

        return prefixes.mapInArrow(run, "token long, sid long, n long, pos long, label long")

    def _shards(self, prefixes: DataFrame) -> DataFrame:
        """Prefix shingles that aren't frequent, packed by shard: shingles, their places, and for each set how many, name, size, component.

        A component is written only where it differs from the set's name.
        """
        count = max(8, -(-self.n_tokens // (4 * SHARD_TOKENS)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                flat, sid, n, label, place = (np.concatenate(x) for x in zip(*held, strict=True))
                shard = ((flat >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
                order = np.lexsort([sid, shard])
                shard = shard[order]
                numbers, cuts = np.unique(shard, return_index=True)
                out = []
                for k, a, z in zip(numbers.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                    mine = order[a:z]
                    names, first, many = np.unique(sid[mine], return_index=True, return_counts=True)
                    lead = mine[first]
                    other = label[lead] != names
                    raw = (flat[mine], place[mine].astype("<u4"), many.astype("<u4"), names, n[lead].astype("<u4"), np.packbits(other), label[lead][other])
                    out.append((k, *(x.tobytes() for x in raw)))
                kinds = [pa.int32()] + [pa.binary()] * 7
                return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _PACKED)

            for batch in batches:
                flat, owner, place = _flat(batch.column("prefix"))
                some = np.flatnonzero(flat < _LATE)
                if len(some):
                    held.append((flat[some], *(batch.column(c).to_numpy()[owner[some]] for c in ("sid", "n", "label")), place[some]))
                    size += len(some)
                if size >= 500_000:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

        return prefixes.mapInArrow(run, "shard int, " + ", ".join(f"{c} binary" for c in _PACKED[1:])).repartition(count, "shard")

    def _candidates(self, shards: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) and how many prefix shingles they share here (n), with token null; and rows of crowded shingles.

        Such a row has a token, a set (a) of size n with the token at pos, its component (label) and
        the token's smallest set (b), or null for more than ``crowd_rows`` sets.
        """
        percent, crowd, most = self.percent, self.crowd, self.crowd_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[list[np.ndarray]]] = defaultdict(list)
            for batch in batches:
                for k, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    t, p, c, s, n, f, own = (np.frombuffer(x, kind) for x, kind in zip(raw, ("<u8", "<u4", "<u4", "<i8", "<u4", "u1", "<i8"), strict=True))
                    label = s.copy()
                    label[np.flatnonzero(np.unpackbits(f, count=len(s)))] = own
                    d = np.repeat(np.arange(len(s)), c)
                    parts[k].append([t, s[d], n[d].astype(np.int64), p.astype(np.int64), label[d]])
            for k in sorted(parts):
                rows = _grouped(*(np.concatenate(x) for x in zip(*parts.pop(k), strict=True)))
                yield from _crowded(*rows, crowd, most)
                for a, b, times in _pairs_of(*rows, percent, crowd):
                    null = pa.nulls(len(a), pa.int64())
                    yield pa.record_batch([null, pa.array(a), pa.array(b), pa.array(times), null, null], _ROW)

        return shards.mapInArrow(run, "token long, a long, b long, n long, pos long, label long")

    # -- crowded shingles

    def _bundled(self, rows: DataFrame) -> DataFrame:
        """(a, b, c): candidates of different components at shingles of up to ``crowd_rows`` sets, and how many of these they share.

        rows: token, sid, n, pos, label, first. Bundles are dealt by the shingles' smallest set.
        Shingles of one passage mostly have the same one, so a pair is written once for most of
        what it shares, and only if its counts by hash cell allow it.
        """
        percent = self.percent
        rows = stored(rows.join(self.classes.select("sid", "cells"), "sid"), "jaccard-crowd-rows")
        sizes = rows.groupBy("first").agg(F.ceil(F.count("*") / BUNDLE_ROWS).cast("int").alias("parts"))
        count = max(8, -(-rows.count() // BUNDLE_ROWS))
        dealt = rows.join(sizes, "first").withColumn("bundle", F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("token"), F.col("parts"))), F.lit(count)))

        def run(key, table):
            t, sid, n, pos, label = (table.column(c).to_numpy() for c in ("token", "sid", "n", "pos", "label"))
            names, at = np.unique(sid, return_index=True)
            cells = np.frombuffer(b"".join(table.column("cells").take(pa.array(at)).to_pylist()), "<u2").reshape(-1, CELLS)
            size = n[at]
            out = []
            for a, b, times in _pairs_of(*_grouped(t.view(np.uint64), sid, n, pos, label), percent, 1 << 30):
                i, j = np.searchsorted(names, a), np.searchsorted(names, b)
                ok = _cells_allow(cells[i], cells[j], size[i], size[j], percent)
                out.append(pa.table({"a": pa.array(a[ok]), "b": pa.array(b[ok]), "c": pa.array(times[ok])}))
            return pa.concat_tables(out) if out else pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())]).empty_table()

        columns = ["bundle", "token", "sid", "n", "pos", "label", "cells"]
        return dealt.select(columns).groupBy("bundle").applyInArrow(run, "a long, b long, c long")

    def _crowd_links(self, rows: DataFrame) -> DataFrame:
        """(a, b): links between components at shingles of more sets, enough of them to connect what they connect.

        rows: token, sid, label. Shingles with the same smallest set, as those of a passage mostly
        have, are one bundle, in which a set is one row. A bundle's sets are cut into parts: a
        component of many sets has parts of its own, the others are dealt by component. Parts of one
        component don't meet; all other pairs of parts meet in a block each. There the sets are
        compared at once, so candidates are never rows: a block writes a link only if it joins two
        components that nothing in the block has joined before, fewer links than it has sets.
        """
        firsts = rows.groupBy("token").agg(F.min("sid").alias("first"))
        rows = rows.join(firsts, "token").select("first", "sid", "label").distinct()
        rows = stored(rows.join(self.classes.select("sid", "rep", "n"), "sid"), "jaccard-crowd-sets")
        share = F.greatest(F.count("*") / self.crowd_rows, F.sum("n") / PART_TOKENS)
        groups = rows.groupBy("first", "label").agg(share.alias("share")).withColumn("own", F.col("share") > 0.25)
        pool = groups.where("NOT own").groupBy("first").agg(F.ceil(F.sum("share")).cast("int").alias("parts"))
        groups = groups.join(pool, "first", "left").withColumn("parts", F.when(F.col("own"), F.ceil("share").cast("int")).otherwise(F.col("parts")))
        groups = stored(groups.select("first", "label", "own", "parts", F.when(F.col("own"), F.col("label")).alias("head")), "jaccard-crowd")
        part = lambda x: F.pmod(F.xxhash64(x), F.col("parts")).cast("int")
        dealt = rows.join(groups, ["first", "label"]).withColumn("part", F.when(F.col("own"), part("sid")).otherwise(part("label")))
        dealt = dealt.select("first", "sid", "rep", "label", F.xxhash64("head", "part").alias("p"))
        ends = groups.select("first", "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct().withColumn("p", F.xxhash64("head", "part"))
        meet = ends.alias("x").join(ends.alias("y"), "first").where("x.p <= y.p AND (x.head IS NULL OR y.head IS NULL OR x.head != y.head)")
        meet = meet.select("first", F.xxhash64("first", "x.p", "y.p").alias("block"), F.col("x.p").alias("i"), F.col("y.p").alias("j"))
        # a part that meets itself is on both sides (0), others are on the left (1) or the right (2)
        sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("p"), F.lit(0).alias("side")))).otherwise(
            F.array(F.struct(F.col("i").alias("p"), F.lit(1).alias("side")), F.struct(F.col("j").alias("p"), F.lit(2).alias("side")))
        )
        meet = meet.select("first", "block", F.explode(sides).alias("e")).select("first", "block", "e.p", "e.side")
        wanted = stored(dealt.join(meet, ["first", "p"]).select("block", "sid", "rep", "label", "side"), "jaccard-crowd-blocks")
        percent = self.percent

        def run(key, table):
            own: dict[int, np.ndarray] = {}
            place: dict[int, tuple[int, int]] = {}
            for sid, x, label, side in zip(*(table.column(c).to_pylist() for c in ("sid", "set", "label", "side")), strict=True):
                if x is not None:
                    own[sid] = np.frombuffer(x, np.uint64)
                else:
                    place[sid] = (label, side)
            names = sorted(own)
            found = _apart([own[x] for x in names], *(np.array([place[x][k] for x in names], np.int64) for k in (0, 1)), percent)
            return pa.table({"a": pa.array([names[i] for i, _ in found], pa.int64()), "b": pa.array([names[j] for _, j in found], pa.int64())})

        sets = self._blocks_of_sets(wanted.select("block", "sid", "rep"))
        packed = sets.unionByName(wanted.select("block", "sid", "label", "side"), allowMissingColumns=True)
        out = stored(packed.groupBy("block").applyInArrow(run, "a long, b long"), "jaccard-crowd-links")
        discard(rows, groups, wanted)
        return out

    # -- all

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Labels (sid, label) of the components of near copies, and links (a, b) between sets of different labels that are left."""
        labels = components(self._near_copies()).select(F.col("id").alias("sid"), F.col("component").alias("label"))
        prefixes = stored(self._prefixes(labels), "jaccard-prefixes")
        found = stored(self._candidates(self._shards(prefixes)), "jaccard-candidates")
        crowded = found.where("token IS NOT NULL").select("token", F.col("a").alias("sid"), "n", "pos", "label", F.col("b").alias("first"))
        mixed = self._mixed(prefixes)
        if len(mixed):
            often = stored(self._frequent_rows(prefixes, mixed), "jaccard-frequent-rows")
            stats = often.groupBy("token").agg(F.count("*").alias("k"), F.min("sid").alias("m"))
            stats = stats.select("token", F.when(F.col("k") <= self.crowd_rows, F.col("m")).alias("first"))
            crowded = crowded.unionByName(often.join(stats, "token"))
        crowded = stored(crowded, "jaccard-crowded")
        pairs = found.where("token IS NULL").select("a", "b", F.col("n").alias("c"))
        pairs = pairs.unionByName(self._bundled(crowded.where("first IS NOT NULL")))
        hot = crowded.where("first IS NULL").select("token", "sid", "label")
        near = None if hot.isEmpty() else self._crowd_links(hot)
        pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"))
        pairs = stored(self._sifted(pairs, hot.groupBy("sid").agg(F.count("*").alias("k"))), "jaccard-pairs")
        discard(prefixes, found, crowded)
        rest = self._verified(pairs)
        return labels, rest if near is None else rest.unionByName(near)

    def _sifted(self, pairs: DataFrame, crowded: DataFrame) -> DataFrame:
        """Pairs (a, b) whose shared prefix shingles, and whose counts by hash cell, allow enough overlap.

        Up to where the first of both prefixes ends, the sets share the c shingles that were
        counted and at most as many crowded ones as either prefix has; what lies beyond in the
        set of that prefix is all that can be added.
        """
        percent = self.percent
        of = lambda side: (
            self.classes.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("cells").alias(f"v{side}"))
            .join(crowded.select(F.col("sid").alias(side), F.col("k").alias(f"k{side}")), side, "left")
        )
        beyond = lambda n: F.ceil(F.col(n) * percent / 100) - 1
        most = F.col("c") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) + F.greatest(beyond("na"), beyond("nb"))
        rich = pairs.join(of("a"), "a").join(of("b"), "b").where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                va, vb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, CELLS) for c in ("va", "vb"))
                keep = _cells_allow(va, vb, na, nb, percent)
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

        return rich.mapInArrow(run, "a long, b long")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs that are similar, by groups that share neighbours; a hub with more than GROUP_PAIRS pairs has several groups."""
        ends = pairs.select("a", "b").union(pairs.select("b", "a"))
        hub = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("hub"))
        of = lambda side: hub.select(F.col("a").alias(side), F.col("hub").alias(f"h{side}"))
        grouped = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("hub", F.least("ha", "hb"))
        sizes = grouped.groupBy("hub").agg(F.ceil(F.count("*") / GROUP_PAIRS).cast("int").alias("parts"))
        # a pair's group depends on both of its sets, so a set with very many candidates is in several groups
        grouped = grouped.join(sizes, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int")).alias("block"), "a", "b")
        grouped = stored(grouped, "jaccard-groups")
        reps = self.classes.select("sid", "rep")
        wanted = stored(grouped.select("block", F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid"), "jaccard-wanted")
        out = stored(self._joined(self._blocks_of_sets(wanted), grouped), "jaccard-links")
        discard(grouped, wanted)
        return out

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row; an id that is null has a null component."""
        labels, rest = self.links()
        of = lambda side: labels.select(F.col("sid").alias(side), F.col("label").alias(f"l{side}"))
        edges = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        merged = components(edges).withColumnRenamed("id", "label")
        group = self.classes.select("sid", "rep").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        group = group.join(merged, "label", "left").select("sid", "rep", F.coalesce("component", "label").alias("group"))
        least = group.groupBy("group").agg(F.min("rep").alias("component_id"))
        names = group.join(least, "group").select("sid", "component_id")
        rows = self.rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
        return rows.join(names, "sid", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
        )


def _flat(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of some packed prefixes, the row of each and its place there."""
    raw = prefix.to_pylist()
    lengths = np.array([len(x) // 8 for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint64)
    return flat, np.repeat(np.arange(len(raw)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _possible(na, nb, pa_, pb, percent: int) -> np.ndarray:
    """Whether sets of sizes na and nb that first meet at places pa and pb can be similar."""
    overlap = 1 + np.minimum(na - pa_ - 1, nb - pb - 1) + np.minimum(pa_, pb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * overlap >= percent * (na + nb))


def _cells_allow(va, vb, na, nb, percent: int) -> np.ndarray:
    """Whether the counts of two sets' shingles by hash cell leave enough overlap possible; counts stop at 65535."""
    bound = np.minimum(va, vb).sum(axis=1, dtype=np.int64)
    return ((100 + percent) * bound >= percent * (na + nb)) | (np.maximum(na, nb) > 65535)


def _apart(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect components of sets on the left (side 1) and on the right (2); those on side 0 are on both.

    A set is compared only with sets that are of other components by then. Sizes and counts by
    hash cell rule most of these out; a trie is traversed towards the others.
    """
    trie = Trie(sets)
    size = np.array([len(x) for x in sets], np.int64)
    cells = np.frombuffer(b"".join(_cells(x & ~_LATE) for x in sets), "<u2").reshape(-1, CELLS)
    component = label.copy()
    right = np.flatnonzero(side != 1)
    out = []
    for a in np.flatnonzero(side != 2).tolist():
        b = right[right > a] if side[a] == 0 else right
        b = b[component[b] != component[a]]
        b = b[100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])]
        b = b[_cells_allow(cells[a], cells[b], size[a], size[b], percent)]
        for m in trie.links(a, percent, targets=b.tolist()):
            if component[m] != component[a]:
                component[component == component[m]] = component[a]
                out.append((a, m))
    return out


_PACKED = ["shard", "t", "p", "c", "s", "n", "f", "l"]
_ROW = ["token", "a", "b", "n", "pos", "label"]


def _grouped(t, s, n, p, label) -> tuple[np.ndarray, ...]:
    """Rows of shingles in order, each once, without shingles whose sets are all of one component; then their groups' starts and sizes."""
    order = np.lexsort([s, t])
    t, s = t[order], s[order]
    once = np.ones(len(t), bool)
    once[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    order = order[once]
    t, s, n, p, label = t[once], s[once], n[order], p[order], label[order]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(t)))
    if len(t):
        mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        starts, sizes = starts[mixed], sizes[mixed]
    return t, s, n, p, label, starts, sizes


def _crowded(t, s, n, p, label, starts, sizes, crowd: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of shingles of more than ``crowd`` sets, with the smallest set of those of up to ``most``."""
    big = np.flatnonzero(sizes > crowd)
    if len(big):
        rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in big.tolist()])
        first = np.repeat(s[starts[big]], sizes[big])
        first = pa.array(first, pa.int64(), mask=np.repeat(sizes[big] > most, sizes[big]))
        yield pa.record_batch([pa.array(t[rows].view(np.int64)), pa.array(s[rows]), first, pa.array(n[rows]), pa.array(p[rows]), pa.array(label[rows])], _ROW)


def _pairs_of(t, s, n, p, label, starts, sizes, percent: int, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs across components at shingles of up to ``crowd`` sets, each once, and how many shingles they share."""
    names, local = np.unique(s, return_inverse=True)
    local = local.astype(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for size in np.unique(sizes[sizes <= crowd]).tolist():
        some = starts[sizes == size]
        left, right = np.triu_indices(size, 1)
        step = max(1, 1_000_000 // len(left))
        for i in range(0, len(some), step):
            a = (some[i : i + step, None] + left[None, :]).ravel()
            b = (some[i : i + step, None] + right[None, :]).ravel()
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            ok = _possible(n[a], n[b], p[a], p[b], percent)
            key = local[a[ok]] << np.uint64(32) | local[b[ok]]  # a's sid is the smaller: rows of a shingle are in their order
            found.append((key, np.ones(len(key), np.int64)))
            count += len(key)
            if count > 4_000_000:
                found = [_summed(found)]
                count = 0
    if found:
        key, times = _summed(found)
        for i in range(0, len(key), 100_000):
            part = key[i : i + 100_000]
            yield names[(part >> np.uint64(32)).astype(np.int64)], names[(part & np.uint64(0xFFFFFFFF)).astype(np.int64)], times[i : i + 100_000]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).components()
