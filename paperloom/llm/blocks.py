"""Self-joins inside keys, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .graph import connected_components

TOP = 10_000  # keys whose sizes are broadcast, at most


def _sized(rows: DataFrame, key: list[str], cap: int, weight: Column | None, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """``rows`` of keys within the bounds; those of larger keys with ``_m``, the number of chunks to deal them into (None if there
    are none); and how many larger keys there are.

    The sizes of the largest keys are broadcast, at most ``TOP`` of them, so their rows are dealt where they are read."""
    load = F.lit(0) if weight is None else F.ceil(F.sum(weight) / limit)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / cap), load).cast("long").alias("_m"))
    sizes = settle(sizes.filter("_m > 1 and _n > 1"), shuffled=True)
    n = sizes.count()
    if not n:
        return rows, None, 0
    top = (sizes if n <= TOP else settle(sizes.orderBy(F.desc("_n"), *key).limit(TOP))).select(*key, "_m")
    small, large = rows.join(F.broadcast(top.drop("_m")), key, "left_anti"), rows.join(F.broadcast(top), key)
    if n > TOP:
        rest = sizes.select(*key, "_m").join(F.broadcast(top.drop("_m")), key, "left_anti")
        large = large.unionByName(small.join(rest, key))
        small = small.join(rest, key, "left_anti")
    return small, large, n


def bounded_groups(rows: DataFrame, key: list[str], payload: list[str], spread: str, cap: int) -> DataFrame:
    """Groups in which any two rows of one ``key`` meet: ``key``, ``across``, ``members`` (array of payload, chunk).

    A key of at most ``cap`` rows is one group.  A larger one is dealt by the hash of ``spread`` into chunks of about
    ``cap`` rows; each chunk is a group, and so is each pair of chunks (``across``: only rows of different chunks need to
    be compared there).  No row is lost and no task holds a whole hot key; a key of n rows costs n / cap copies of each, which
    is what meeting every pair takes.  Keys with a single row are left out.  Rows must be settled: they are read more
    than once."""
    small, large, _ = _sized(rows, key, cap, None, 1)
    one = small.groupBy(*key).agg(F.collect_list(F.struct(*payload, F.lit(0).cast("long").alias("chunk"))).alias("members")).filter(F.size("members") > 1)
    every = one.withColumn("across", F.lit(False))
    if large is None:
        return every
    c = F.pmod(F.xxhash64(spread), F.col("_m")).cast("long")
    large = large.withColumn("chunk", c).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    large = large.select(*key, *payload, "chunk", F.least("chunk", "_j").alias("_low"), F.greatest("chunk", "_j").alias("_high"))
    pairs = large.groupBy(*key, "_low", "_high").agg(F.collect_list(F.struct(*payload, "chunk")).alias("members"))
    return every.unionByName(pairs.withColumn("across", F.col("_low") < F.col("_high")).drop("_low", "_high"))


def linked_groups(rows: DataFrame, key: list[str], payload: list[str], ident: str, cap: int, link: Callable, weight: Column | None = None, limit: int = 1) -> DataFrame:
    """Links (a, b) such that their components are those of all links inside keys, whatever a key's size.

    ``link`` maps batches of (members, across) to edges a, b of a spanning forest of each group's links; members carry the
    payload (``ident``, a long, among it), ``side`` and ``comp``.  Where ``across``, only members of different sides and comps matter.
    A key over ``cap`` rows (or over ``limit`` of the summed ``weight``) is dealt into chunks, twice and differently, and each chunk
    is linked in itself.  What the links join so far needs no comparison: only rows outside a key's largest component then meet all
    rows of the key.  In a dense group of copies these are few, so its cost stays near its size; a large key without
    such a component is still compared in full.  Rows must be settled: they are read more than once."""
    kind = "a long, b long"
    small, large, n = _sized(rows, key, cap, weight, limit)
    member = lambda side, comp: F.collect_list(F.struct(*payload, F.lit(side).alias("side"), comp.cast("long").alias("comp"))).alias("members")
    linked = lambda groups, across: groups.filter(F.size("members") > 1).select("members", F.lit(across).alias("across")).mapInArrow(link, kind)
    first = linked(small.groupBy(*key).agg(member(0, F.col(ident))), False)
    if large is None:
        return first
    twice = large.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_c", F.pmod(F.xxhash64(ident, "_s"), F.col("_m")))
    first = settle(first.unionByName(linked(twice.groupBy(*key, "_s", "_c").agg(member(0, F.col(ident))), False)), shuffled=True)
    comps = connected_components(first)
    known = settle(large.join(comps, F.col(ident) == F.col("node"), "left").withColumn("_comp", F.coalesce("component", F.col(ident))).drop("node", "component"))
    parts = known.groupBy(*key, "_comp").agg(F.count("*").alias("_n"))
    parts = parts.groupBy(*key).agg(F.max_by("_comp", F.struct("_n", "_comp")).alias("_most"), (F.sum("_n") - F.max("_n")).alias("_rest")).filter("_rest > 0")
    parts = parts.select(*key, "_most", F.ceil(F.greatest(F.col("_rest") / cap, F.lit(1.0))).cast("long").alias("_r"))
    open_ = known.join(F.broadcast(parts) if n <= TOP else parts, key)
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = open_.filter("_comp <> _most").withColumn("_i", F.pmod(F.xxhash64(ident, F.lit("left")), F.col("_r"))).withColumn("_j", span("_m")).withColumn("_side", F.lit(0))
    right = open_.withColumn("_j", F.pmod(F.xxhash64(ident, F.lit(0)), F.col("_m"))).withColumn("_i", span("_r")).withColumn("_side", F.lit(1))
    both = left.select(*key, *payload, "_comp", "_side", "_i", "_j").unionByName(right.select(*key, *payload, "_comp", "_side", "_i", "_j"))
    cross = both.groupBy(*key, "_i", "_j").agg(F.collect_list(F.struct(*payload, F.col("_side").alias("side"), F.col("_comp").alias("comp"))).alias("members"))
    return first.unionByName(linked(cross.filter(F.exists("members", lambda x: x["side"] == 0)), True))


def members(batch) -> Iterator[tuple[dict, bool]]:
    """Each group of a batch of (members, across, ...): its fields by name, as numpy arrays (binary ones as Arrow arrays)."""
    import pyarrow as pa

    lists = batch.column(0)
    rows, ends = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    fields = {}
    for i, f in enumerate(rows.type):
        c = rows.field(i)
        fields[f.name] = c if pa.types.is_binary(f.type) or pa.types.is_string(f.type) else c.to_numpy(zero_copy_only=False)
    for g, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        yield {n: c[s:e] for n, c in fields.items()}, batch.column(1)[g].as_py()
