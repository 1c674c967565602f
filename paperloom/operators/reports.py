"""Report aggregates.  Null keys are left out, as counting tables do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.values import percent


def counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def top_counts(df: DataFrame, key: str, k: int, out: str = "n") -> DataFrame:
    """The k most frequent values, ties by value."""
    return counts(df, [key], out).orderBy(F.desc(out), key).limit(k)


def measures(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column], distinct: Mapping[str, str] | None = None) -> DataFrame:
    """One pass: rows per key that meet each condition, and distinct counts."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    cells = [F.count_if(c).alias(n) for n, c in conditions.items()] + [F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()]
    return df.groupBy(*keys).agg(*cells)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows by the given columns, 0 where nothing falls; nulls on either side are left out."""
    d = df.filter(F.col(row).isNotNull())
    return d.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def in_order(df: DataFrame, key: str, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """All labels in their order, 0 where the table lacks one; ``pos`` from 0."""
    frame = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"pos int, {key} string")
    return frame.join(df, key, "left").fillna(0, subset=list(numbers))


def row_percent(df: DataFrame, values: Sequence[str], digits: int = 1) -> DataFrame:
    total = sum((F.col(v) for v in values), F.lit(0))
    return df.withColumns({v: percent(F.col(v), total, digits) for v in values})


def call_rollup(calls: DataFrame) -> DataFrame:
    """Calls by provider, step and model: number, seconds, tokens, cost (columns elapsed, tokens, cost)."""
    return calls.groupBy("provider", "step", "model").agg(F.count("*").alias("calls"), F.sum("elapsed").alias("elapsed"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def density(df: DataFrame, group: str, member: str, threshold: int) -> DataFrame:
    """Members per group: groups, mean, and how many are at or above a threshold, and below."""
    n = df.groupBy(group).agg(F.countDistinct(member).alias("n"))
    return n.agg(F.count("*").alias("groups"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") >= threshold).alias("high"), F.count_if(F.col("n") < threshold).alias("low"))


def statistics(df: DataFrame, value: str) -> DataFrame:
    """n, total, mean, exact median, least and most of a whole column.  Rows are counted per distinct value first, so the one task of
    the median sees values, not rows."""
    v, n = F.col(value), F.col("_n")
    by = df.filter(v.isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    return by.agg(F.sum(n).alias("n"), F.sum(v * n).alias("total"), (F.sum(v * n).cast("double") / F.sum(n)).alias("mean"), F.percentile(v, 0.5, n).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))


def text_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small aggregate as aligned text; beyond ``most`` rows it says how many more there are."""
    got = df.limit(most + 1).collect()
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in got[:most]]]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    more = [f"({df.count() - most} more rows)"] if len(got) > most else []
    return "\n".join([title, *["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows], *more]) + "\n"
