"""Incremental forms of the batch operators: a folder of results as a stream, upserted per micro-batch; rolling call counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources.sinks import upsert_status

RESULTS = "pmid string, stage string, gene_id string, model string, leaf string"
CALLS = "ts timestamp, provider string, step string, model string, elapsed double"


def upsert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 25) -> StreamingQuery:
    """Results arriving as JSON files, upserted into ``target``.  The batch number is the version, so a replayed batch replaces
    itself and nothing is applied twice."""
    rows = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files).json(source)
    return rows.writeStream.foreachBatch(lambda df, n: upsert_status(spark, target, df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def calls_by_window(calls: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls and seconds by step in windows of event time; calls later than ``late`` are left out."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", width), "step").agg(F.count("*").alias("calls"), F.sum("elapsed").alias("elapsed"))
    return w.select(F.col("window.start").alias("start"), "step", "calls", "elapsed")


def calls_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    calls = spark.readStream.schema(CALLS).json(source)
    return calls_by_window(calls).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
