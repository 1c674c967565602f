"""Ranks, budgets, first-k, pivots by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CUTS = 200  # ranges that a rank over all rows is dealt into


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank by descending value, ties share their mean rank, nulls share the last.

    Counts per distinct value are ranked, not rows, and joined back.  Without ``by`` the values are dealt into ranges between
    some quantiles: sums of ranges run over those few, and each range is ranked in itself, so no task sees all values."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = F.desc_nulls_last(value)
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        n = n.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2)
    else:
        cuts = n.agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 10 * CUTS)).head()[0] or []
        above = F.lit(0)
        if cuts:
            above = F.when(F.col(value).isNull(), CUTS).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c > F.col(value))))
        n = n.withColumn("_b", above)
        sums = n.groupBy("_b").agg(F.sum("_n").alias("_s"))  # at most CUTS + 1 rows
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
        inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        n = n.join(F.broadcast(sums), "_b").withColumn(out, F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_b", "_base")
    n = n.withColumnsRenamed({c: f"_k_{c}" for c in [*by, value]}).drop("_n")
    on = F.lit(True)
    for c in [*by, value]:
        on = on & df[c].eqNullSafe(n[f"_k_{c}"])
    return df.join(n, on).drop(*[f"_k_{c}" for c in [*by, value]])


def weighted_mean(columns: Sequence[tuple[str, float]]) -> Column:
    """Weighted mean over the columns that are not null; null if all are."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c, w in columns:
        top = top + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
        bottom = bottom + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, out: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: Column, budget: int, out: str = "used") -> DataFrame:
    """Rows of each key, in order, until their sizes first exceed the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(size).over(w).cast("long")).filter(F.col(out) <= budget)


def pivot_first(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: str, order: str) -> DataFrame:
    """One column per value: the first non-null entry in order; rows without any are dropped."""
    cells = [F.min_by(F.col(value), F.when((F.col(column) == v) & F.col(value).isNotNull(), F.col(order))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*cells).filter(F.coalesce(*values).isNotNull())


def by_position(df: DataFrame, keys: Sequence[str], value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Columns ``names`` from the first values of each key in order, by position."""
    ranked = first_k(df, keys, [order], len(names))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("rn") == i + 1, F.col(value))).alias(n) for i, n in enumerate(names)])


def sample_groups(df: DataFrame, group: str, at_least: int, seed: int) -> DataFrame:
    """Whole groups in a seeded order until they hold at least ``at_least`` rows.  Each has a row, so as many groups do."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_o", order).orderBy("_o").limit(at_least)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.withColumn("_b", before).filter(F.col("_b") < at_least).select(group), group, "left_semi")
