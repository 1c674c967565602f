"""Registration of queries with their SQL counterparts, and the views of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-paper pairs: lineitem as pairs, orders as papers, the supplier's nation as database."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene_id"), F.col("l_orderkey").alias("pmid"), "l_suppkey", F.col("l_linenumber").alias("pos"), "l_quantity", "l_returnflag")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid"), (F.col("o_orderstatus") != "F").alias("paper_available"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("database"))
    d = l.join(o, "pmid").join(s, "l_suppkey")
    said = F.col("l_returnflag") != "N"
    return d.select("gene_id", "pmid", "database", "pos", "paper_available", said.alias("alias_in_text"), F.when(said, F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long")).alias("mentions"), F.when(F.col("pos") % 3 == 0, F.lit(0)).otherwise(F.col("pos")).cast("long").alias("suppl_mentions"))


PAIRS = """pairs AS (
  SELECT l_partkey AS gene_id, l_orderkey AS pmid, n_name AS database, l_linenumber AS pos, o_orderstatus <> 'F' AS paper_available,
         l_returnflag <> 'N' AS alias_in_text, CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS mentions,
         CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS suppl_mentions
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage results: events as results, the type as stage, the user as entity."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id"), (F.col("event_id") % 400).alias("pmid"), F.col("event_type").alias("stage"), F.col("user_id").alias("gene_id"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), (k % 4 != 0).alias("success"), k.alias("k"), "value")


RESULTS = """results AS (
  SELECT event_id, event_id % 400 AS pmid, event_type AS stage, user_id AS gene_id, 'm' || CAST(event_id % 3 AS VARCHAR) AS model,
         CAST(props->>'$.k' AS INTEGER) % 4 <> 0 AS success, CAST(props->>'$.k' AS INTEGER) AS k, value FROM events)"""
