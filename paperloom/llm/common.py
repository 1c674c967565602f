"""Shared plumbing: scratch tables in the cluster's shared folder, and prefix sums that no single task carries."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local temporary folder only where that is unset and Spark is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    _MADE.append(f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Delete the scratch tables of this process, but for those that ``keep`` reads, and return how many went.  Call it once
    results are written: DataFrames that the operators returned read these tables."""
    read = " ".join(keep.inputFiles()) if keep is not None else ""
    gone = [p for p in _MADE if p.rsplit("/", 1)[1] not in read]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(path)
    return len(gone)


def hash_sample(df: DataFrame, keys: list[str], n: int) -> list:
    """At most ``n`` rows of ``df`` (without repeated rows), the least by the hash of ``keys``.  A bound on the hash, set from the number of rows, is
    applied in the tasks first, so about ``n`` rows reach the driver whatever the size of the table."""
    total = df.count()
    h = F.xxhash64(*keys)
    if total > n:
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * min(1.0, (n + 5 * n**0.5) / total)))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *keys).limit(n).collect()


def fewer(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in at most ``per_core`` partitions per core, or a sixteenth of the shuffle partitions for each if that is more: for
    rows after a shuffle whose many small files would cost more than their contents."""
    spark = df.sparkSession
    return df.coalesce(per_core * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def settle(df: DataFrame, compression: str = "zstd", shuffled: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, lineage cut, columns still pruned.

    ``shuffled``: small rows that come out of a shuffle; see ``fewer``."""
    path = scratch_dir(df.sparkSession)
    df = fewer(df) if shuffled else df
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balanced_chunks(n: int) -> int:
    """Number of chunks for two-level work over ``n`` rows: about sqrt(n) chunks of about sqrt(n) rows."""
    return max(1, math.isqrt(max(n, 0)))


def running_totals(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` (one row per non-negative integer ``order``) with ``out``: the sum of ``value`` over all smaller orders.

    Two levels: sums per block of consecutive orders, a running sum over the blocks, and one inside each block,
    so the widest task sees about the square root of the rows."""
    top = df.agg(F.max(order)).head()[0] or 0
    width = balanced_chunks(int(top) + 1)
    d = df.withColumn("_rt_blk", F.floor(F.col(order) / F.lit(width)).cast("long"))
    sums = d.groupBy("_rt_blk").agg(F.sum(value).alias("_sum"))
    w = Window.orderBy("_rt_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_rt_blk", F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias("_rt_base"))
    inner = Window.partitionBy("_rt_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_rt_in", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    return d.join(sums, "_rt_blk").withColumn(out, F.col("_rt_base") + F.col("_rt_in")).drop("_rt_blk", "_rt_base", "_rt_in")


def grouped_offsets(df: DataFrame, key: list[str], order: list[str], value, out: str, chunks: int) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over earlier rows of the same ``key``, in a fixed order of rows.

    The order is (hash of ``order`` modulo ``chunks``, ``order``).  A hot key is spread over all chunks: each task
    sorts chunks of a key, and only the sums of chunks meet.  Rows that tie in ``order`` are placed arbitrarily."""
    d = df.withColumn("_c", F.pmod(F.xxhash64(*order), F.lit(chunks))).withColumn("_v", value)
    nul = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    sums = d.groupBy(*key, "_c").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_c").alias("_kc"), F.coalesce(F.sum("_s").over(w), F.lit(0)).cast("long").alias("_rt_base"))
    inner = Window.partitionBy(*key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_rt_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)).cast("long"))
    cond = F.col("_c") == F.col("_kc")
    for c in nul:
        cond = cond & c
    return d.join(sums, cond).withColumn(out, F.col("_rt_base") + F.col("_rt_in")).drop("_c", "_kc", "_v", "_rt_in", "_rt_base", *[f"_k{i}" for i in range(len(key))])
