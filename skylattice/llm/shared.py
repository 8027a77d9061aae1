"""Helpers that several corpus operators use: shared storage, batch size, connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, in an Arrow batch on its way to Python: texts can be long, so batches are small.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path in the storage that all executors share.

    The cluster names that storage in ``spark.checkpoint.dir``. Only a local session, as in tests,
    may leave it unset; a temporary folder of this machine is then used and set.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"skylattice-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared storage and read it again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches in this session, alike for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph with long vertex ids.

    Returns (id, component): for every vertex of an edge, the smallest vertex id it reaches.
    Alternates large-star and small-star steps (Kiveris et al., 2014), each a shuffle on the
    vertex with min as a partial aggregate, so that no vertex's neighbours meet in one task;
    each step's edges are a table in the shared storage. The number of rounds is logarithmic
    in the length of the longest path in practice; ``rounds`` only stops a run that cannot end.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "cc"
    )
    before = None
    for _ in range(rounds):
        last, now = now, stored(_small_star(_large_star(now)), "cc")
        discard(last)
        digest = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours get linked to the smallest of it and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours get linked to the smallest of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
