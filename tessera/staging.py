"""Cutting lineage through tables in the folder all executors share.

A staged table survives the loss of executors: nothing that was computed before it is computed again.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this process where the setting is absent (single-machine tests)."""
    global _own
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage.  ``options`` are the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; only for those whose every reader has been staged itself."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the executors delete shuffle files that no plan refers to any more, as those behind a staged table: Spark does so when
    the driver collects garbage, which on a large heap is rarely.  To be called where the plans' names have gone out of scope."""
    gc.collect()  # lets go of the Python side's references first
    spark._jvm.System.gc()


def folder_bytes(staged: DataFrame) -> int:
    """What a staged table takes up."""
    at = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    return int(at.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the number of hash buckets an operator cuts its work into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_bits(df: DataFrame, size: Column, bytes_each: int, most_coarse: int) -> tuple[int, int]:
    """Bits ``(coarse, fine)`` of the hash buckets for work on ``df``: no fewer buckets than shuffle partitions, and so many that each
    stands for at most ``bytes_each`` of the input, since a bucket is held by one task as a whole.

    A first exchange deals to ``2**coarse`` buckets, ``2**most_coarse`` at most, as every input split makes a block for each; a second
    one, where ``fine`` is not 0, cuts each of them into ``2**fine``.  The input's size is the optimizer's estimate; where it has
    none (tables that come from Python), ``size`` is summed.
    """
    total = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if total >= 1 << 60:
        total = int(df.agg(F.sum(size)).first()[0] or 0)
    bits = (max(parallelism(df.sparkSession), -(-total // bytes_each)) - 1).bit_length()
    coarse = min(bits, most_coarse)
    return coarse, min(bits - coarse, 15)
