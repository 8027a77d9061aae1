"""Structured Streaming over a folder of new video files: an extension of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.video import timestamp_of
from skylattice.sources.arrow import read_ser_frames


def frames(spark: SparkSession, folder: str, policy: str = "compat") -> DataFrame:
    """A stream of frames (path, frame, ts, samples, ...) of the files that arrive in a folder."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.ser").load(folder)
    )
    return read_ser_frames(files, strict=False, policy=policy).withColumn("ts", timestamp_of(F.col("ts_ticks").cast("long")))


def rates(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, end, frames, mean): frames and mean sample per window of time; frames later than ``late`` are left out."""
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", width))
    return windows.agg(F.count("*").alias("frames"), F.avg(mean).alias("mean")).select("window.start", "window.end", "frames", "mean")
