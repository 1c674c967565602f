"""Remote sources behind a backend: retry with backoff, permanent and passing failures, resumable fetches."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotAvailable(Exception):
    """The item does not exist in the source; trying again is no use."""


class FetchFailed(Exception):
    """The item could not be fetched now."""


class Unauthorized(Exception):
    """No further request can succeed."""


@dataclass
class Response:
    code: int
    body: str = ""
    retry_after: float | None = None


Backend = Callable[[str], Response]


def fetch(key: str, backend: Backend, retries: int = 4, base: float = 1.5, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> object:
    """The JSON behind ``key``.

    Server errors and 429 are retried after base * 2**n seconds up to ``cap`` plus jitter, or after what the server asks
    for; an answer that is no JSON means the item does not exist."""
    for n in range(retries + 1):
        r = backend(key)
        if r.code == 401:
            raise Unauthorized(key)
        if r.code == 200:
            try:
                return json.loads(r.body)
            except ValueError:
                raise NotAvailable(key) from None
        if r.code in (400, 404, 422):
            raise NotAvailable(key)
        if n < retries:
            sleep(r.retry_after if r.retry_after is not None else min(cap, base * 2**n) + jitter())
    raise FetchFailed(key)


def fetch_all(keys: DataFrame, key: str, backend: Backend, retries: int = 4) -> DataFrame:
    """Each distinct key fetched once: key, body (JSON text or null), error ('' | not_available | transient: ...)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k in part[key]:
                try:
                    rows.append((k, json.dumps(fetch(k, backend, retries)), ""))
                except NotAvailable:
                    rows.append((k, None, "not_available"))
                except FetchFailed as e:
                    rows.append((k, None, f"transient: {e}"))
            yield pd.DataFrame(rows, columns=[key, "body", "error"])

    return keys.select(F.col(key).cast("string").alias(key)).distinct().mapInPandas(run, f"{key} string, body string, error string")


def fetch_tables(spark: SparkSession, keys: DataFrame, key: str, backend: Backend, folder: str) -> DataFrame:
    """The tab-separated table behind each key that ``folder`` does not list as processed, appended to what is there: key, line number,
    line (without the header), header.

    Every attempt is appended to the log (key, code, processed, detail).  Answers with rows or without, and keys that the source
    cannot process (422), count as processed; other failures are tried again by the next call."""
    log = "key string, code int, processed boolean, detail string, body string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k in part["key"]:
                try:
                    r = backend(k)
                except Exception as e:  # the backend is foreign code  # noqa: BLE001
                    r = Response(0, f"{type(e).__name__}: {e}")
                rows.append((k, r.code, r.code in (200, 422), "" if r.code == 200 else r.body[:200] or f"HTTP {r.code}", r.body if r.code == 200 else None))
            yield pd.DataFrame(rows, columns=["key", "code", "processed", "detail", "body"])

    def read() -> DataFrame | None:
        try:
            return spark.read.schema(log).parquet(f"{folder}/log")
        except AnalysisException:  # nothing was fetched yet
            return None

    todo, before = keys.select(F.col(key).cast("string").alias("key")).distinct(), read()
    if before is not None:
        todo = todo.join(before.filter("processed").select("key").distinct(), "key", "left_anti")
    todo.mapInPandas(run, log).write.mode("append").parquet(f"{folder}/log")
    good = read().filter("code = 200").groupBy("key").agg(F.max("body").alias("body"))
    lines = F.split(F.regexp_replace("body", r"^\s+|\s+$", ""), "\n")
    d = good.select(F.col("key").alias(key), F.get(lines, F.lit(0)).alias("header"), F.posexplode(F.slice(lines, 2, F.size(lines))).alias("pos", "line"))
    return d.select(key, "pos", "line", "header")


def fetch_aliases(genes: DataFrame, backend: Callable[[str, str], Response], paths: Mapping[str, str]) -> DataFrame:
    """Aliases of genes (gene_id, database): gene_id, database, aliases (sorted, distinct, without the gene itself).

    ``paths`` maps a database in lower case to what the backend is asked with.  An unknown database, an error or an answer of
    another form gives none.  The answer names the gene (attributes.name) and its aliases (tables.Alias[].alias)."""

    def one(gene: str, database: str | None) -> list[str]:
        path = paths.get((database or "").strip().lower())
        if not gene or path is None:
            return []
        try:
            r = backend(gene, path)
            body = json.loads(r.body) if r.code == 200 else {}
            names = [(body.get("attributes") or {}).get("name"), *(x.get("alias") for x in (body.get("tables") or {}).get("Alias") or [])]
            return sorted({n for n in names if n and n != gene})
        except Exception:  # foreign answers must not end the job  # noqa: BLE001
            return []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(aliases=[one(g, d) for g, d in zip(part["gene_id"], part["database"], strict=True)])

    return genes.select("gene_id", "database").distinct().mapInPandas(run, "gene_id string, database string, aliases array<string>")


def is_available(body: str = "body"):
    """Whether an item could be fetched; any failure counts as not."""
    return F.col(body).isNotNull()


def is_transient(error: str = "error"):
    return F.coalesce(F.col(error).startswith("transient"), F.lit(False))


def resolve_ids(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``pmcid`` of each row: the key itself if it is one already, else from the lookup (key, pmcid)."""
    from paperloom.functions.values import normal_pmcid

    own = normal_pmcid(F.col(key))
    return df.join(table.select(key, F.upper("pmcid").alias("_p")), key, "left").withColumn("pmcid", F.coalesce(own, "_p")).drop("_p")
