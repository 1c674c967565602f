"""Sinks: chosen columns, appends, upserts of nested documents, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.status import build_status, upsert


def write_table(df: DataFrame, path: str, columns: Sequence[str], sep: str = ",", append: bool = False) -> bool:
    """Columns in the given order, missing ones left out; an empty table is not written."""
    have = [c for c in columns if c in df.columns]
    if not have or df.isEmpty():
        return False
    df.select(*have).write.mode("append" if append else "overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    return True


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert_status(spark: SparkSession, path: str, new: DataFrame, version: int) -> DataFrame:
    """Results (pmid, stage, gene_id, model, leaf) added to the table at ``path`` as one more version; returns the documents.

    Versions are folders that are never rewritten, so a reader never sees half an update and a rerun of a version replaces
    only itself."""
    new.select("pmid", "stage", "gene_id", "model", "leaf").write.mode("overwrite").parquet(f"{path}/version={version}")
    return build_status(latest_status(spark, path).select("pmid", "stage", "gene_id", "model", "leaf"))


def compact_status(spark: SparkSession, path: str, version: int) -> int:
    """The table at ``path`` as one version: the latest results are written as ``version``, above all there are, then older versions
    go; returns how many.  A reader in between sees results twice and takes the later ones."""
    old = [r[0] for r in spark.read.schema("version int").parquet(path).select("version").distinct().collect()]  # as many as there were updates
    if max(old, default=-1) >= version:
        raise ValueError("the version must be above all there are")
    latest_status(spark, path).select("pmid", "stage", "gene_id", "model", "leaf").write.mode("overwrite").parquet(f"{path}/version={version}")
    for v in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("pmid string, stage string, gene_id string, model string, leaf string, version int").parquet(path)
    return upsert(rows.limit(0), rows, ["pmid", "stage", "gene_id", "model"], "version")


def before_after(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copy on write: keys, before, after of rows that were or are there."""
    pack = lambda d, n: d.select(*keys, F.struct(*[c for c in d.columns if c not in keys]).alias(n))
    return pack(old, "before").join(pack(new, "after"), list(keys), "full")


def write_side_texts(df: DataFrame, path: str, text: str, partition: str) -> None:
    """One folder of text files for each value of ``partition``."""
    df.select(F.col(text).alias("value"), partition).write.mode("overwrite").partitionBy(partition).text(path)
