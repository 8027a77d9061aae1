"""Language ID: hyperdimensional profiles of letter n-grams, compared with language prototypes by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.shared import small_batches

#: Dimensions of the hypervectors.
DIMENSIONS = 1024
#: Languages that a model can hold; more values of lang are refused, so that models stay small.
MAX_LANGUAGES = 4096
#: n-gram vectors that a worker keeps; at more, the table starts anew.
KEPT_GRAMS = 20_000

_SCALE = 1 << 20  # documents' unit vectors are summed as whole numbers, so that sums don't depend on their order


def _letters() -> np.ndarray:
    """For each code point: 32 if it isn't a letter, else its lower-case form (where that is one code point)."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: np.ndarray | None = None


def _gram_codes(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct letter trigrams of a text and how often each occurs; words are set off by single spaces. None without letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    points = _LETTERS[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = True
    points = points[keep].astype(np.uint64)
    if len(points) < 3:
        return None
    codes = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    return np.unique(codes[points[1:-1] != 32], return_counts=True)


class Space:
    """Random vectors of letters and the bound vectors of trigrams made of them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7) -> None:
        self.dimensions, self.seed = dimensions, seed
        self._letter: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self._table = np.zeros((1024, dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self._letter:
            if len(self._letter) > KEPT_GRAMS:
                self._letter.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dimensions)
            self._letter[point] = (2 * bits - 1).astype(np.float32)
        return self._letter[point]

    def gram(self, code: int) -> np.ndarray:
        """Bind three letters: their vectors, rotated by their places from the end, are multiplied."""
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def _rows(self, codes: list[int]) -> list[int]:
        new = [c for c in codes if c not in self._row]
        if len(self._row) + len(new) > KEPT_GRAMS:
            self._row.clear()
            new = codes
        for c in new:
            at = len(self._row)
            if at >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[at] = self.gram(c)
            self._row[c] = at
        return [self._row[c] for c in codes]

    def bundle(self, text: str) -> np.ndarray | None:
        """A text's unit vector: the sum of its trigrams' vectors, as often as they occur. None without letters."""
        if (found := _gram_codes(text)) is None:
            return None
        codes, counts = found
        total = np.zeros(self.dimensions, np.float64)
        for i in range(0, len(codes), 2048):
            rows = self._rows(codes[i : i + 2048].tolist())
            total += counts[i : i + 2048].astype(np.float32) @ self._table[rows]
        norm = np.linalg.norm(total)
        return total / norm if norm else total


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray  # unit rows
    dimensions: int = DIMENSIONS
    seed: int = 7
    _space: Space | None = field(default=None, repr=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose prototype has the largest cosine with the text's profile, and that cosine, at least 0."""
        if self._space is None:
            self._space = Space(self.dimensions, self.seed)
        vector = self._space.bundle(text) if text else None
        if vector is None or not self.languages:
            return "und", 0.0
        cosines = self.prototypes @ vector
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Sum the profiles of every document of each non-null language; a document's profile has length 1.

    Tasks return a vector per language, which are summed by dimension in a shuffle. Documents
    without letters add nothing, repeated rows count each time, whole texts count, however long.
    Without documents the model predicts ``und`` throughout.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, seed), {}
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (vector := space.bundle(x)) is not None:
                    if y not in sums:
                        if len(sums) >= MAX_LANGUAGES:
                            raise ValueError(f"over {MAX_LANGUAGES} languages")
                        sums[y] = np.zeros(dimensions, np.int64)
                    sums[y] += np.rint(vector * _SCALE).astype(np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "v"])

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = known.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("d", "x"))
    rows = (
        sums.groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
        .orderBy("lang").limit(MAX_LANGUAGES + 1).select("lang", F.col("v.x").alias("v")).collect()
    )
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    vectors = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Model([r["lang"] for r in rows], vectors / np.where(norms, norms, 1), dimensions, seed)


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", value: str = "score") -> DataFrame:
    """Every row with the language of its whole text and the cosine; columns of these names are replaced.

    ``und`` and 0 where the text is null or has no letter. Of equal cosines the first language by
    name wins. Each row counts by itself, repeated rows too. The model's size is bounded.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(label, value)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                [*batch.schema.names, label, value],
            )

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(value, T.DoubleType())]))


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~_held_out()))
    return predict(docs.select("doc_id", _held_out().alias("held_out"), "text"), model).drop("text")
