"""Toxicity: sentence scores under a noisy-or, trained from document labels alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.shared import small_batches, stored
from skylattice.llm.textkernel import Block, blocks, byte_class, mix

#: Labelled documents that training reads, at most: those of the smallest hashes.
TRAIN_DOCS = 20_000
#: Features of the model, at most: those whose documents' labels differ most.
FEATURES = 8_192
#: Documents that must hold a feature before it can be one.
MIN_DOCS = 4

_WORD = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
_BREAK = ~byte_class(b".!?\n")
_PREFIXES = (4, 5, 6)


def _features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their first 4, 5 and 6 bytes, each one's sentence and row.

    Sentences are numbered through the block; they end at ``.``, ``!``, ``?``, line ends and row
    borders. The arrays are in the order of kinds, not of the text.
    """
    starts, ends, first = block.spans(_WORD)
    row = np.repeat(np.arange(len(block)), np.diff(first))
    breaks = np.cumsum(_BREAK[block.data])[starts] if len(starts) else np.zeros(0, np.int64)
    sentence = breaks + row
    hashes, where = [block.hashes(starts, ends)], [np.arange(len(starts))]
    for k in _PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        hashes.append(mix(block.hashes(starts[longer], starts[longer] + k) ^ np.uint64(k)))
        where.append(longer)
    at = np.concatenate(where)
    return np.concatenate(hashes), sentence[at], row[at]


@dataclass
class Model:
    """Sorted feature hashes, their weights, a bias for sentences with a feature, and the base rate of others."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self) -> None:
        self._seen = np.zeros(1 << 18, bool)
        self._seen[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes`` of known features, their numbers)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self._seen[(hashes >> np.uint64(46)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        known = self.hashes[number] == hashes[maybe]
        return maybe[known], number[known]

    def score(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row scores, sentence numbers with features, their rows, their scores)."""
        hashes, sentence, row = _features(block)
        at, number = self.find(hashes)
        clean = np.full(len(block), np.log1p(-self.leak))
        if not len(at):
            return -np.expm1(clean), at, at, np.zeros(0)
        # a feature counts once in a sentence
        pairs, places = np.unique(np.stack([sentence[at], number], 1), axis=0, return_index=True)
        sentences, start, which = np.unique(pairs[:, 0], return_index=True, return_inverse=True)
        logit = self.bias + np.bincount(which, self.weights[pairs[:, 1]])
        rows = row[at][places][start]
        np.subtract.at(clean, rows, np.logaddexp(0, logit))  # log(1 - sigmoid(x)) = -log(1 + exp(x))
        return -np.expm1(clean), sentences, rows, 1 / (1 + np.exp(-logit))


def _held_out_rest(doc_id: str = "doc_id", modulus: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)), F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS, features: int = FEATURES) -> Model:
    """Train on texts of ``docs`` whose ids have a label 0 or 1, for the whole document, in ``labels``.

    At most ``train_docs`` labels are used, those of the smallest hashes of id and label. As they
    are so few they are broadcast, and only their documents are kept, in shared storage.
    Features are the words and word beginnings whose documents' labels differ most by the
    z-score of their log odds; their number is bounded too. A document is toxic if any of its
    sentences is: P = 1 - (1 - leak) * prod(1 - sigmoid(bias + sum of the sentence's weights)),
    over sentences with a feature; weights maximise the penalised likelihood of the labels.
    Without labels of both kinds the model scores the leak throughout, about 0. Null ids, texts and
    labels are left out. A document or a label that is repeated counts each time. Features of equal
    z-score are taken by hash. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    chosen = chosen.withColumn("h", F.xxhash64("i", "y")).orderBy("h").limit(train_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("text")).where("text IS NOT NULL")
    return _fit(stored(texts.join(F.broadcast(chosen), "i").select("y", "text"), "toxicity-sample"), features)


def _fit(sample: DataFrame, features: int) -> Model:
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -3.0, 1e-3)
    if len(totals) < 2:
        return empty

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                hashes, _, row = _features(block)
                once = np.unique(np.stack([hashes, row.astype(np.uint64)], 1), axis=0)
                toxic = y[block.first + once[:, 1].astype(np.int64)]
                keys, which = np.unique(once[:, 0], return_inverse=True)
                sums = [np.bincount(which, toxic == k, len(keys)).astype(np.int64) for k in (1, 0)]
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(sums[0]), pa.array(sums[1])], ["f", "pos", "neg"])

    n1, n0 = totals[1], totals[0]
    ratio = F.log((F.col("pos") + 0.5) / (n1 + 1.0)) - F.log((F.col("neg") + 0.5) / (n0 + 1.0))
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    chosen = (
        sample.select("y", "text").mapInArrow(count, "f long, pos long, neg long")
        .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") + F.col("neg") >= MIN_DOCS)
        .withColumn("z", F.abs(ratio) / spread).where("z >= 3")
        .orderBy(F.desc("z"), "f").limit(features).select("f").collect()
    )
    if not chosen:
        return empty
    hashes = np.sort(np.array([r["f"] for r in chosen], np.int64).view(np.uint64))
    probe = Model(hashes, np.zeros(len(hashes)), 0.0, 1e-3)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                found, sentence, row = _features(block)
                at, number = probe.find(found)
                pairs, places = np.unique(np.stack([sentence[at], number], 1), axis=0, return_index=True)
                rows = row[at][places]
                order = np.argsort(rows, kind="stable")
                pairs, cut = pairs[order], np.searchsorted(rows[order], np.arange(len(block) + 1))
                out = [pairs[cut[i] : cut[i + 1]] for i in range(len(block))]
                yield pa.record_batch(
                    [
                        pa.array([y[block.first + i] for i in range(len(block))], pa.int32()),
                        pa.array([(x[:, 0] - x[0, 0] if len(x) else x[:, 0]).tolist() for x in out], pa.list_(pa.int32())),
                        pa.array([x[:, 1].tolist() for x in out], pa.list_(pa.int32())),
                    ],
                    ["y", "s", "f"],
                )

    found = sample.select("y", "text").mapInArrow(gather, "y int, s array<int>, f array<int>").toArrow()
    lists = lambda c: [x.values.to_numpy() for x in found.column(c)]
    return _train(hashes, found.column("y").to_numpy().astype(float), lists("s"), lists("f"))


def _train(hashes: np.ndarray, y: np.ndarray, s: list, f: list, steps: int = 300) -> Model:
    """Maximise the noisy-or likelihood by Adam on whole sums; the penalty keeps weights finite."""
    docs = np.repeat(np.arange(len(y)), [len(x) for x in s])
    key = docs.astype(np.int64) << 32 | np.concatenate([np.asarray(x, np.int64) for x in s])
    feature = np.concatenate([np.asarray(x, np.int64) for x in f])
    sentences, which = np.unique(key, return_inverse=True)
    owner = sentences >> 32
    w, b = np.zeros(len(hashes)), -3.0
    leak = 1e-3
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        logit = b + np.bincount(which, w[feature], len(sentences))
        clean = np.full(len(y), np.log1p(-leak))
        clean -= np.bincount(owner, np.logaddexp(0, logit), len(y))
        p = np.clip(-np.expm1(clean), 1e-9, 1)
        # d log P / d logit of a sentence: its sigmoid times (1 - P) / P for label 1, minus its sigmoid for label 0
        slope = np.where(y == 1, np.exp(clean) / p, -1.0)[owner] / (1 + np.exp(-logit))
        grad = np.append(np.bincount(feature, slope[which], len(w)) - 0.02 * w, slope.sum() - 0.5 * (b + 3))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return Model(hashes, w, float(b), leak)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted, sentences): every row's toxicity, 0 to 1, from its whole text.

    ``sentences`` lists the sentences that score 0.5 or more as (number within the text, score).
    Null and empty texts score the leak, about 0. Each row counts by itself, repeated rows too, and
    whole texts count, however long. Other columns are left out. The model is small and bounded
    (``FEATURES``).
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                scores, sentences, rows, values = m.score(block)
                spots: list[list[dict]] = [[] for _ in range(len(block))]
                breaks = np.cumsum(np.concatenate([[0], _BREAK[block.data]]))[block.offsets[:-1]]
                for number, i, x in zip(sentences.tolist(), rows.tolist(), values.tolist(), strict=True):
                    if x >= 0.5:
                        spots[i].append({"sentence": number - i - int(breaks[i]), "score": x})
                keys = batch.column(0).slice(block.first, len(block))
                yield pa.record_batch(
                    [keys, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spots, pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())])))],
                    ["doc_id", "score", "predicted", "sentences"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, score double, predicted int, sentences array<struct<sentence:int,score:double>>"
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_held_out_rest() > 0).select("doc_id", "toxic")
    model = fit(docs, labels)
    return score(docs, model).select(
        "doc_id", (_held_out_rest() == 0).alias("held_out"), "score", "predicted", "sentences"
    )
