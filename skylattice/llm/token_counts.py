"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.shared import small_batches, stored
from skylattice.llm.tokens import Encoder, default_path


def encoded_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens) of each row's whole text; null or empty texts have 0."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            lengths = [len(x) // 4 for x in encoder.encode_all(batch.column(0).to_pylist())]
            yield pa.record_batch([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text)).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, over all documents.

    The aggregate is partial in each task, so the shuffle holds a row per task and length.
    An empty table gives no rows; repeated rows count as often as they occur.
    """
    return encoded_lengths(docs, text, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Add what a context limit of ``n_tokens`` means, for every length that occurs.

    docs_up_to, tokens_up_to: documents of at most that length and their tokens;
    docs_over, tokens_over: the suffix sums beyond it;
    truncated_tokens: what is left if every document is cut at that length;
    quantile: the share of documents of at most that length.

    Running sums are made in two steps, within ranges of lengths and over the ranges' totals, so
    that no task sorts the whole histogram. Both steps read the histogram from shared storage, so
    that texts are encoded once. Lengths that tie are one row; other columns are ignored.
    """
    h = stored(histogram.select("n_tokens", "n_docs"), "token-histogram").withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    # ranges of equal ratio: an eighth of an octave each, so few however long texts are
    h = h.withColumn("part", F.floor(F.log2(F.col("n_tokens") + 1) * 8).cast("int"))
    from pyspark.sql import Window

    totals = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(
        "part",
        zero(F.sum("d").over(before)).alias("d0"),
        zero(F.sum("t").over(before)).alias("t0"),
        F.sum("d").over(everything).alias("all_d"),
        F.sum("t").over(everything).alias("all_t"),
    )
    within = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.withColumns({"d1": F.sum("n_docs").over(within), "t1": F.sum("tokens").over(within)})
        .join(totals, "part")
        .withColumns({"docs_up_to": F.col("d0") + F.col("d1"), "tokens_up_to": F.col("t0") + F.col("t1")})
        .withColumns({"docs_over": F.col("all_d") - F.col("docs_up_to"), "tokens_over": F.col("all_t") - F.col("tokens_up_to")})
        .select(
            "n_tokens", "n_docs", "docs_up_to", "tokens_up_to", "docs_over", "tokens_over",
            (F.col("tokens_up_to") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
            (F.col("docs_up_to") / F.col("all_d")).alias("quantile"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row (tokens, cut): the tokens left, and documents cut, if every text is cut at ``limit``; from ``with_suffix_sums``."""
    n = F.col("n_tokens")
    return sums.agg(
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(n > limit, F.col("n_docs"))), F.lit(0)).alias("cut"),
    )


def quantile_length(sums: DataFrame, q: float) -> DataFrame:
    """One row (n_tokens): the smallest length that a share ``q`` of documents doesn't exceed; null for no documents."""
    return sums.where(F.col("quantile") >= F.lit(q)).agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
