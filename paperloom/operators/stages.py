"""Model stages: a pluggable client, calls in parallel over partitions, parse and repair, gates between stages."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.cluster import shared_folder
from paperloom.functions.llmjson import close_json, find_json

#: Client: (system, prompt, model) -> (text, usage, seconds); an exception is a failed call.
Client = Callable[[str, str, str], tuple[str, Mapping[str, int], float]]
RESULT = "stage string, model string, success boolean, data string, raw string, usage string, seconds double, error string"


def stub(system: str, prompt: str, model: str) -> tuple[str, dict[str, int], float]:
    """A deterministic client for tests: an object that depends on the prompt alone."""
    h = hashlib.sha256(f"{system}\n{prompt}".encode()).hexdigest()
    return json.dumps({"digest": h[:16], "only_in_passing": h[0] in "01"}), {"input": len(prompt), "output": 32}, 0.0


@dataclass(frozen=True)
class Stage:
    """A prompt column, the model and how answers are retried."""

    name: str
    prompt: Column
    model: str = "stub"
    system: str = ""
    retries: int = 2
    keep: list[str] = field(default_factory=lambda: ["pmid", "gene_id"])


def parse_answer(text: str | None, formatter: Callable[[str], str] | None = None) -> str | None:
    """JSON of an answer: as it is, closed where it was cut off, or as a formatter call gives it.  Nothing comes from an empty answer."""
    if not (text or "").strip():
        return None
    return find_json(text) or close_json(text) or (find_json(formatter(text)) if formatter else None)


def run_stage(df: DataFrame, stage: Stage, client: Client = stub, formatter: Callable[[str], str] | None = None) -> DataFrame:
    """``stage.keep`` and the columns of ``RESULT`` for each row; rows of one paper share a partition, as their prompts share a prefix."""
    keep, name, system, model, retries = stage.keep, stage.name, stage.system, stage.model, stage.retries

    def one(prompt: str) -> tuple:
        text, usage, seconds, error = None, {}, 0.0, None
        for _ in range(retries + 1):
            try:
                text, usage, spent = client(system, prompt, model)
                seconds += spent
                data = parse_answer(text, formatter)
                if data is not None:
                    return name, model, True, data, text, json.dumps(dict(usage)), seconds, None
                error = "json parsing failed after retries"
            except Exception as e:  # the call is foreign code  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        return name, model, False, None, text, json.dumps(dict(usage)), seconds, error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        for p in parts:
            got = pd.DataFrame([one(x) for x in p["_prompt"]], columns=columns, index=p.index)
            yield pd.concat([p[keep], got], axis=1)

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep), RESULT])
    rows = df.select(*keep, stage.prompt.alias("_prompt"))
    return (rows.repartition(keep[0]) if keep else rows).mapInPandas(run, schema)


def run_distinct(df: DataFrame, text: str, out: str, call: Callable[[pd.Series], pd.Series], kind: str) -> DataFrame:
    """``out`` = call(text), computed once for each distinct text and joined back; null for null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{out: call(p[text])})

    once = df.select(text).filter(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, {out} {kind}")
    return df.join(once, text, "left")


class Batches(Protocol):
    """A batch service: requests go in together, answers are fetched once it has ended."""

    def submit(self, requests: list[dict]) -> str: ...

    def state(self, batch: str) -> str: ...

    def answers(self, batch: str) -> Iterator[tuple[str, str | None, str | None]]:
        """(custom_id, text, error) of each request."""


#: States in which a batch changes no more.
ENDED = ("ended", "canceled", "expired")


def run_batch(df: DataFrame, stage: Stage, service: Callable[[], Batches], client: Client = stub, formatter: Callable[[str], str] | None = None, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep, parts: int = 8) -> DataFrame:
    """``run_stage`` through a batch service, for pairs (pmid, gene_id): pmid, gene_id and the columns of ``RESULT``.

    Each of ``parts`` partitions submits one batch, asks for its state every ``wait`` seconds and reads its answers one by one; an
    answer's id is split at its first underscore.  Where the service cannot be had or refuses, the requests are called one
    after the other.  Repeated pairs are one request."""
    name, model, system = stage.name, stage.model, stage.system

    def result(pmid, gene, text, error) -> tuple:
        data = parse_answer(text, formatter)
        if data is not None:
            return pmid, gene, name, model, True, data, text, "{}", 0.0, None
        return pmid, gene, name, model, False, None, text, "{}", 0.0, error or "JSON parsing failed"

    def alone(pmid, gene, prompt) -> tuple:
        try:
            text, usage, spent = client(system, prompt, model)
        except Exception as e:  # the call is foreign code  # noqa: BLE001
            return pmid, gene, name, model, False, None, None, "{}", 0.0, f"{type(e).__name__}: {e}"
        return (*result(pmid, gene, text, None)[:7], json.dumps(dict(usage)), spent, None if parse_answer(text, formatter) else "JSON parsing failed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["pmid", "gene_id", *(c.split()[0] for c in RESULT.split(", "))]
        rows = [tuple(r) for part in batches for r in part.itertuples(index=False)]
        if not rows:
            return
        try:
            api = service()
            batch = api.submit([{"custom_id": f"{p}_{g}", "system": system, "model": model, "prompt": text} for p, g, text in rows])
        except Exception:  # no service: the plain way  # noqa: BLE001
            yield pd.DataFrame([alone(*r) for r in rows], columns=columns)
            return
        while api.state(batch) not in ENDED:
            sleep(wait)
        yield pd.DataFrame([result(*key.split("_", 1), text, error) for key, text, error in api.answers(batch)], columns=columns)

    rows = df.select(F.col("pmid").cast("string").alias("pmid"), F.col("gene_id").cast("string").alias("gene_id"), stage.prompt.alias("_prompt")).dropDuplicates(["pmid", "gene_id"])
    return rows.repartition(parts, "pmid").mapInPandas(run, f"pmid string, gene_id string, {RESULT}")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a table in ``folder``, by default a new one in the shared folder of checkpoints: what was paid for is not asked again
    when an executor is lost."""
    path = shared_folder(df.sparkSession, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def curate(pairs: DataFrame, papers: DataFrame, prompts: Mapping[str, Column], client: Client = stub, done: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Summary, then descriptions, then verification of pairs (pmid, gene_id) in papers (pmid, text), as results to upsert.

    A pair goes on while its stage succeeded and did not find the entity mentioned in passing only; pairs whose last stage
    is in ``done`` (pmid, gene_id) are left out.  Each stage's results are written (see ``written``) before the next one reads
    them, as a call must not be made twice."""
    from paperloom.operators.relational import pending

    rows = (pairs if done is None else pending(pairs, done, ["pmid", "gene_id"])).join(papers, "pmid")
    out = None
    for name, prompt in prompts.items():
        got = written(run_stage(rows, Stage(name, prompt), client), folder)
        out = got if out is None else out.unionByName(got)
        good = got.filter(F.col("success") & ~F.coalesce(F.get_json_object("data", "$.only_in_passing") == "true", F.lit(False)))
        rows = rows.join(good.select("pmid", "gene_id", F.col("data").alias(f"{name}_data")), ["pmid", "gene_id"])
    return out
