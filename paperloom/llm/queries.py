"""The operators' queries, one per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, separator=0)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiindex import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_read(spark, sf_dir, "documents")).withColumn("finding_crc32", F.crc32(F.col("finding").cast("binary"))).drop("finding")


def op6_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddups import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.93)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_read(spark, sf_dir, "documents")).drop("spans")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, budget=4)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents"), block=64, ceiling=3.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_mix, op3_pack, op4_neighbours, op5_secrets, op6_embedding_dups, op7_licenses, op8_token_file, op9_token_counts, op10_simhash)}
#: The join over all pairs of a label and the closure of its links: fit for a small table only.
ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dups": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM ok UNION SELECT r.x, n.b FROM r JOIN n ON n.a = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x), k AS (SELECT a, count(*) AS k FROM n GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(c, vec_id) AS kept FROM v LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.a = vec_id""",
}
