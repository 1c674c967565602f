"""Keyed operations: keep-first, lookups, resume plans, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import longest_fragment, term_pattern

Cols = Sequence[str]


def require_columns(df: DataFrame, names: Cols) -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def flag_filter(df: DataFrame, available: str = "paper_available", mentioned: str = "alias_in_text") -> DataFrame:
    """Rows whose flags are true, for those of the two columns that exist."""
    for c in (available, mentioned):
        if c in df.columns:
            df = df.filter(F.col(c))
    return df


def keep_first(df: DataFrame, keys: Cols, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: Cols, value: str, position: str, ties: Cols = ()) -> DataFrame:
    """The value at the largest position; with ``ties``, that of the first row in their order of those at one (numeric) position, null
    values and positions aside."""
    last = F.min_by(value, _place(value, -F.col(position), ties)) if ties else F.max_by(value, position)
    return df.groupBy(*keys).agg(last.alias(value))


def first_wins(df: DataFrame, keys: Cols, value: str, position: str, ties: Cols = ()) -> DataFrame:
    """The value at the smallest position; ``ties`` as in ``last_wins``."""
    return df.groupBy(*keys).agg(F.min_by(value, _place(value, F.col(position), ties) if ties else position).alias(value))


def _place(value: str, position: Column, ties: Cols) -> Column:
    return F.when(F.col(value).isNotNull() & position.isNotNull(), F.struct(position.alias("_p"), *ties))


def left_join_unique(left: DataFrame, right: DataFrame, keys: Cols, order: Sequence[str | Column]) -> DataFrame:
    """Left join to the first right row of each key, so rows never multiply."""
    return left.join(keep_first(right, keys, order), list(keys), "left")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Cols, how: str = "left") -> DataFrame:
    """Join in which null keys match each other; the right keys are dropped."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"_r_{k}"])
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def pending(requested: DataFrame, done: DataFrame, keys: Cols) -> DataFrame:
    """Requested rows whose key is not done."""
    return requested.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pending_groups(requested: DataFrame, done: DataFrame, keys: Cols, group: str) -> tuple[DataFrame, DataFrame]:
    """(requested rows of groups in which any requested key is not done, done rows that stay valid)."""
    flag = done.select(*keys).distinct().withColumn("_done", F.lit(True))
    redo = requested.join(flag, list(keys), "left").groupBy(group).agg(F.bool_or(F.col("_done").isNull()).alias("_redo")).filter("_redo").select(group)
    return requested.join(redo, group, "left_semi"), done.join(redo, group, "left_anti")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Primary rows, and fallback rows of keys that the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def two_tier_lookup(df: DataFrame, first: DataFrame, second: DataFrame, keys: Cols, value: str, position: str, default: str = "") -> DataFrame:
    """``value`` from the first table (its last entry wins), else the second (its first entry wins), else ``default``."""
    a = last_wins(first, keys, value, position).withColumnRenamed(value, "_a")
    b = first_wins(second, keys, value, position).withColumnRenamed(value, "_b")
    return df.join(a, list(keys), "left").join(b, list(keys), "left").withColumn(value, F.coalesce("_a", "_b", F.lit(default))).drop("_a", "_b")


def with_default(df: DataFrame, lookup: DataFrame, keys: Cols, value: str, default: str) -> DataFrame:
    return df.join(lookup, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_flag(df: DataFrame, keys_of: DataFrame, keys: Cols, name: str) -> DataFrame:
    """``df`` with a boolean: whether the key is in ``keys_of``."""
    return df.join(keys_of.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def eav_aliases(records: DataFrame, id_code: int = 1, alias_code: int = 4) -> DataFrame:
    """Aliases by name from entity-attribute-value rows (id, column, content): a self-join on id."""
    t = records.filter(F.col("column") == id_code).select("id", F.col("content").alias("name"))
    r = records.filter(F.col("column") == alias_code).select("id", F.col("content").alias("alias"))
    return t.join(r, "id").groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def alias_sets(rows: DataFrame, name: str = "gene_id", alias: str = "alias") -> DataFrame:
    """Sorted distinct aliases of each name without the name itself and blanks."""
    good = rows.filter((F.col(alias) != F.col(name)) & (F.trim(alias) != ""))
    return good.groupBy(name).agg(F.array_sort(F.collect_set(alias)).alias("aliases"))


def union_first(frames: Sequence[DataFrame], keys: Cols, order: Sequence[str | Column] = ()) -> DataFrame:
    """Union distinct by key in which earlier frames win."""
    tagged = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return keep_first(every, keys, ["_rank", *order]).drop("_rank")


def mention_join(terms: DataFrame, lines: DataFrame, key: str, term: str = "term", line: str = "line") -> DataFrame:
    """Mentions of terms in the lines of the same key, for pairs that mention at all: terms' columns, lines' columns, n.

    Patterns and lower-cased lines are made once on each side; equi-joined on the key, a substring test drops most pairs before
    the pattern is matched."""
    t = terms.filter(F.trim(term) != "").withColumns({"_part": longest_fragment(F.col(term)), "_pattern": term_pattern(F.col(term))})
    r = lines.withColumnRenamed(key, "_key").withColumn("_low", F.lower(line))
    pairs = t.join(r, (t[key] == r["_key"]) & F.contains("_low", F.col("_part")))
    return pairs.withColumn("n", F.regexp_count(line, F.col("_pattern")).cast("long")).filter("n > 0").drop("_key", "_low", "_part", "_pattern")


def prefix_match(left: DataFrame, right: DataFrame, text: str, key: str, long: int = 250, short: int = 150) -> DataFrame:
    """For each left row, the right key whose squeezed text agrees in the first ``long`` characters, else the least one that
    agrees in the first ``short``: left columns, matched_key, exact."""
    norm = lambda n: F.left(F.regexp_replace(F.lower(text), r"\s+", ""), F.lit(n))
    side = lambda n, out: right.select(norm(n).alias("_n"), key).groupBy("_n").agg(F.min(key).alias(out)).withColumnRenamed("_n", f"_n_{out}")
    l = left.withColumn("_l", norm(long)).withColumn("_s", norm(short))  # noqa: E741
    out = l.join(side(long, "_a"), F.col("_l") == F.col("_n__a"), "left").join(side(short, "_b"), F.col("_s") == F.col("_n__b"), "left")
    return out.withColumn("matched_key", F.coalesce("_a", "_b")).withColumn("exact", F.col("_a").isNotNull()).drop("_l", "_s", "_a", "_b", "_n__a", "_n__b")


def first_non_blank(df: DataFrame, keys: Cols, fields: Cols, order: str) -> DataFrame:
    """For each key and field the first non-blank value in ``order``, '' where all are blank."""
    pick = lambda c: F.coalesce(F.min_by(c, F.when(F.trim(c) != "", F.col(order))), F.lit(""))
    return df.groupBy(*keys).agg(*[pick(c).alias(c) for c in fields])
