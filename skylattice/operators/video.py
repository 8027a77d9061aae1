"""Timing and layout of frame sequences, as aggregates and windows over frame rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.formats.ser import TICKS_AT_EPOCH


def ticks_of(ts: Column) -> Column:
    """100 ns steps since year 1 of a timestamp (session time zone UTC for those without zone)."""
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(TICKS_AT_EPOCH)


def timestamp_of(ticks: Column) -> Column:
    """The timestamp of ticks, cut to milliseconds."""
    return F.timestamp_millis(F.floor((ticks - F.lit(TICKS_AT_EPOCH)) / 10_000).cast("long"))


def timing(frames: DataFrame, key: str, frame: str = "frame", ticks: str = "ticks") -> DataFrame:
    """(key, frames, duration_ticks, seconds, fps): from the first frame's time to the last one's."""
    g = frames.groupBy(key).agg(
        F.count("*").alias("frames"), (F.max_by(ticks, frame) - F.min_by(ticks, frame)).cast("long").alias("duration_ticks")
    )
    seconds = F.col("duration_ticks") / F.lit(1e7)
    return g.withColumns({"seconds": seconds, "fps": F.when(F.col("duration_ticks") > 0, (F.col("frames") - 1) / seconds)})


def order_breaks(frames: DataFrame, key: str, frame: str = "frame", ticks: str = "ticks") -> DataFrame:
    """(key, breaks, ordered): how often a frame's time is before that of the one before."""
    before = F.lag(ticks).over(Window.partitionBy(key).orderBy(frame))
    g = frames.withColumn("_back", F.col(ticks) < before).groupBy(key)
    return g.agg(F.count_if(F.col("_back")).alias("breaks")).withColumn("ordered", F.col("breaks") == 0)


def relaxed_frames(declared: Column, payload: Column, frame_bytes: Column) -> Column:
    """Frames of a file that is shorter than its header says."""
    whole = F.floor(payload / frame_bytes)
    return F.greatest(F.lit(0), F.least(declared, F.greatest(F.floor(payload / (frame_bytes + 8)), F.lit(1)), whole)).cast("long")


def endianness_score(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, low_bytes, share, step) of 16-bit values: distinct low bytes, share not divisible by 256, sum of steps."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))
    return samples.withColumn("_step", step).groupBy(key).agg(
        F.countDistinct(F.col(value).bitwiseAND(F.lit(255))).alias("low_bytes"),
        F.avg(F.when(F.col(value) % 256 != 0, 1.0).otherwise(0.0)).alias("share"),
        F.coalesce(F.sum("_step"), F.lit(0)).cast("long").alias("step"),
    )


def byte_order(flag: Column, policy: str = "compat") -> Column:
    """little or big, by the header's flag: ``compat`` takes 0 as little, ``spec`` as big."""
    little = flag == 0 if policy == "compat" else flag != 0
    return F.when(little, "little").otherwise("big")
