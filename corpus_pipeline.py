"""A corpus pipeline of ordered stages over ``documents``.

Every stage but the last returns the columns of its input, in order and with their values but for
what the stage itself changes, and works on all rows that the one before has kept. A stage needs
doc_id and text (language ID also lang, line dedup n_chars); all other columns pass through,
whatever their names. Rows without an id pass the stages that compare documents. Repeated rows are
documents of their own; of repeated ids, what a stage says of an id holds for all its rows. Empty
tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import decontaminate, jaccard_join, language, line_dedup, packing
from skylattice.llm.shared import discard, stored

NEEDED = ("doc_id", "text", "lang", "n_chars")
#: Ids that a stage broadcasts to drop their rows, at most; beyond them it joins.
BROADCAST_IDS = 1_000_000
#: A text of LETTERS letters or more is in no learned language if its cosine with every prototype is below so many
#: standard deviations of the cosine of two random profiles (one over the root of the dimensions). Shorter ones say
#: too little: two clean words can be that far from all prototypes.
CHANCE = 3.0
LETTERS = 100


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``stage`` on ``docs`` with all columns that no stage needs renamed, so that no name clashes; then undo that."""
    names = [c if c in NEEDED else f"other column {i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*(f"`{c}`" for c in names)).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without a letter, or no more like any learned language than chance, are rejected.

    The model learns from all documents that name a language. Where none does, there is nothing to
    compare with, and all documents with a letter stay.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = (F.col("score") >= CHANCE / model.dimensions**0.5) | (F.length(F.regexp_replace("text", r"\P{L}", "")) < LETTERS)
    return _apart(docs, lambda some: language.predict(some, model).where((F.col("lang_pred") != "und") & told))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more hold, but for each line's largest document id. Documents of which no line with a letter or digit is left go."""

    def stage(some: DataFrame) -> DataFrame:
        kept = line_dedup.LineStore(spark).add(some).dedup(some)
        cut = F.col("n_dropped") > 0
        kept = kept.where(~(cut & ~F.col("text").rlike(r"[\p{L}\p{N}]")) | F.col("text").isNull())
        return kept.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in some.columns else kept

    return _apart(docs, stage)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id."""
    found = jaccard_join.JaccardJoin(docs).components()
    gone = stored(found.where("component_id != doc_id").select("doc_id").distinct(), "near-duplicates")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, lambda some: decontaminate.find(some, items).where(F.size("runs") == 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 1024."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over the table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
            if i:
                discard(before)  # the stage after it is written
    return docs
