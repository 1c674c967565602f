"""Mixing sources to target weights.

The words of each source, in a fixed order of its documents, form blocks of ``block`` words.  Output is a row of
slots, ``shard_slots`` to a shard.  Each shard draws how many of its slots each source fills: multinomial counts,
conditioned on the corpus totals, so that the sources end on their targets.  They come from splitting the range of
shards in halves and drawing the left half's counts (a multivariate hypergeometric draw, seeded by the range), which any
task can repeat for its shards alone.  The q-th slot of a source is pass q // n over its n blocks and, within the
pass, block perm(q % n), where perm is a keyed pseudorandom permutation; blocks join slots by that index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import balanced_chunks, fewer, grouped_offsets, settle

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], ceiling: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``ceiling`` times its size, the excess goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = {i for i, n in enumerate(sizes) if n > 0}, total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > ceiling * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = ceiling * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, or its inverse: a Feistel network over an even number of bits, walked until inside."""
    half = np.uint64(max(1, -(-int(n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)

    def mixed(v: np.ndarray, r: int) -> np.ndarray:
        z = (v + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (z >> np.uint64(32)) & mask

    x = x.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(3, -1, -1) if back else range(4):
            left, right = (right ^ mixed(left, r), left) if back else (right, left ^ mixed(right, r))
        x[todo] = (left << half) | right
        todo = x >= n
    return x.astype(np.int64)


def split_counts(totals: np.ndarray, shards: int, slots: int, first: int, last: int, seed: int):
    """Yields (shard, counts by source, slots by source in earlier shards) for shards first..last-1 of ``shards``."""

    def walk(lo, hi, counts, before):
        if hi <= first or lo >= last or lo >= hi:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi])
        want = min((mid - lo) * slots, int(counts.sum()))
        left, rest, room = np.zeros_like(counts), int(counts.sum()), want
        for i, c in enumerate(counts.tolist()):
            rest -= c
            left[i] = _hypergeometric(draw, c, rest, room)
            room -= int(left[i])
        yield from walk(lo, mid, left, before)
        yield from walk(mid, hi, counts - left, before + left)

    yield from walk(0, shards, totals.copy(), np.zeros_like(totals))


def _hypergeometric(draw, good: int, bad: int, take: int) -> int:
    if not good or not take:
        return 0
    if not bad:
        return take
    if good + bad < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, take))
    # Beyond the library's range: by inversion, from the ratios of neighbouring probabilities within nine standard deviations.
    n = good + bad
    mean = take * (good / n)
    reach = 9 * (mean * (bad / n) * max(0.0, (n - take) / (n - 1))) ** 0.5 + 50
    lo, hi = max(0, take - bad, int(mean - reach)), min(good, take, int(mean + reach))
    k = np.arange(lo, hi, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1)) + np.log((take - k) / (bad - take + k + 1)))])
    chance = np.cumsum(np.exp(log - log.max()))
    return lo + int(np.searchsorted(chance, draw.random() * chance[-1], side="right"))


def source_plan(sizes: DataFrame, block: int, ceiling: float, weights: dict | None) -> list[dict]:
    """One entry for each source, in order of code points with null last (the mix is defined by this list, so the driver has it)."""
    rows = [(r[0], int(r[1])) for r in sizes.groupBy("source").agg(F.sum("size")).collect()]
    rows.sort(key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    w = [1.0 + i % 3 if weights is None else float(weights.get(s, 0)) for i, (s, _) in enumerate(rows)]
    plan = []
    for i, ((s, n), t) in enumerate(zip(rows, targets([n for _, n in rows], w, ceiling), strict=True)):
        blocks, words = -(-n // block), int(t + 0.5)
        words = min(words, int(ceiling * n))
        passes, rest = divmod(words, n) if n else (0, 0)
        plan.append({"k": i, "source": s, "size": n, "target": t, "blocks": blocks, "words": words, "passes": passes, "rest": rest, "slots": passes * blocks + (_slots_for(rest, n, blocks, block, i, passes) if rest else 0)})
    return plan


def _slots_for(rest: int, n: int, blocks: int, block: int, key: int, turn: int) -> int:
    """How many slots of pass ``turn`` give ``rest`` words; the source's last block may be short."""
    count = -(-rest // block)
    short = n - (blocks - 1) * block
    if rest and _last_at(blocks, key, turn) < count and (count - 1) * block + short < rest:
        count += 1
    return min(count, blocks)


def _pass_key(source: int, turn: int) -> int:
    return source * 1_000_003 + turn


def _last_at(blocks: int, source: int, turn: int) -> int:
    """The position at which a pass visits the source's last block."""
    return int(permute(np.array([blocks - 1]), blocks, _pass_key(source, turn), back=True)[0])


def slots(spark: SparkSession, plan: list[dict], block: int, shard_slots: int, seed: int) -> DataFrame:
    """Every slot of the mix: shard, slot, k (source number), pass_no, block_no, words (how many of the block's, from its start)."""
    totals, blocks, size, words = (np.array([p[c] for p in plan], dtype=np.int64) for c in ("slots", "blocks", "size", "words"))
    shards = -(-int(totals.sum()) // shard_slots)
    names = ["shard", "slot", "k", "pass_no", "block_no", "words"]

    def fill(s: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words of slots ``q`` of source ``s``."""
        n = int(blocks[s])
        short = int(size[s]) - (n - 1) * block
        turn, at, index = q // n, q % n, np.empty(len(q), dtype=np.int64)
        for t in np.unique(turn).tolist():
            index[turn == t] = permute(at[turn == t], n, _pass_key(s, t))
        have = np.where(index == n - 1, short, block)
        if q[-1] == totals[s] - 1:  # a source's last slot is cut where its words are complete
            t, i = int(turn[-1]), int(at[-1])
            before = t * int(size[s]) + i * block - (block - short) * (_last_at(n, s, t) < i)
            have[-1] = min(int(have[-1]), int(words[s]) - before)
        return turn, index, have

    def run(batches):
        for b in batches:
            for first in b.column(0).to_pylist():
                for shard, counts, before in split_counts(totals, shards, shard_slots, first, first + 1, seed):
                    used = np.flatnonzero(counts)
                    parts = [fill(int(s), np.arange(before[s], before[s] + counts[s])) for s in used]
                    k = np.repeat(used, counts[used])
                    slot = np.random.default_rng([seed, 1, shard]).permutation(len(k))
                    cols = [np.full(len(k), shard), slot, k, *(np.concatenate(x) for x in zip(*parts, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)

    return spark.range(0, shards, 1, max(1, -(-shards // 16))).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _place(docs: DataFrame, block: int, ceiling: float, weights: dict | None) -> tuple[DataFrame, list[dict]]:
    """doc_id, source, size, tid (a hash of the text), k, source_size, target and first (words of the source before the row, in the
    mix's order)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = settle(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tid")))
    plan = source_plan(d, block, ceiling, weights)
    table = d.sparkSession.createDataFrame([(p["source"], p["k"], p["size"], p["target"]) for p in plan], "_s string, k long, source_size long, target double")
    d = d.join(F.broadcast(table) if len(plan) <= 10_000 else table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return settle(grouped_offsets(d, ["k"], ["doc_id", "size", "tid"], F.col("size"), "first", balanced_chunks(d.count())), shuffled=True), plan


def _spans(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` once for each block that a document has words in."""
    number = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))
    return placed.filter("size > 0").withColumn("block_no", F.explode(number))


def mix(docs: DataFrame, block: int = 64, shard_slots: int = 1 << 14, ceiling: float = 3.0, weights: dict | None = None, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Every row of ``docs`` (doc_id, text, source; other columns are ignored) is returned.  ``weights`` by source default to
    1, 2, 3, repeating, in order of code points with null last.  ``taken`` counts repeats: each source's sum is its target,
    rounded; a word is taken once per pass, so no document exceeds ``ceiling`` times its size.  Null text has no words,
    null source is a source of its own, null doc_ids and repeated rows are kept.  An empty table, or one without words,
    takes nothing.  Reruns agree."""
    placed, plan = _place(docs, block, ceiling, weights)
    times = slots(docs.sparkSession, plan, block, shard_slots, seed).groupBy("k", "block_no", "words").agg(F.count("*").alias("times"))
    lo = F.greatest(F.col("first"), F.col("block_no") * block)
    hi = F.least(F.col("first") + F.col("size"), F.col("block_no") * block + F.col("words"))
    hits = _spans(placed, block).join(times.hint("merge"), ["k", "block_no"])  # its size is not known before it runs
    sums = hits.groupBy("k", "first").agg(F.sum(F.greatest(hi - lo, F.lit(0)) * F.col("times")).alias("taken"))
    cols = ["doc_id", "source", "size", "source_size", "target"]
    some = placed.filter("size > 0").join(sums, ["k", "first"], "left").select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return fewer(some.unionByName(placed.filter("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))))


def mixed_documents(docs: DataFrame, block: int = 64, shard_slots: int = 1 << 14, ceiling: float = 3.0, weights: dict | None = None, seed: int = 7) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each pass that takes words of a document.

    All passes come from the slots: those of a pass that hold words of a document are gathered, and its words taken in
    order, joined by spaces; a pass that takes all of them keeps the text as it is.  A column n_chars becomes the length of the
    text.  Documents that the mix leaves out are absent; see ``mix``, also for nulls and odd rows.  Rows that agree in
    doc_id, source and text stand for each other."""
    placed, plan = _place(docs, block, ceiling, weights)
    lo = F.greatest(F.col("first"), F.col("block_no") * block)
    hi = F.least(F.col("first") + F.col("size"), F.col("block_no") * block + F.col("words"))
    hits = _spans(placed, block).join(slots(docs.sparkSession, plan, block, shard_slots, seed).hint("merge"), ["k", "block_no"]).filter(hi > lo)
    spans = hits.select("k", "first", "pass_no", F.struct((lo - F.col("first")).cast("int").alias("at"), (hi - lo).cast("int").alias("n")).alias("s"))
    spans = spans.groupBy("k", "first", "pass_no").agg(F.array_sort(F.collect_list("s")).alias("_spans"))
    turns = spans.groupBy("k", "first").agg(F.array_sort(F.collect_list(F.struct("pass_no", "_spans"))).alias("_turns"))  # as many as a source has passes
    key = ["_d", "_src", "_t"]
    names = {"doc_id": "_d", "source": "_src", "tid": "_t"}
    own = placed.filter("size > 0").withColumnsRenamed(names).select(*key, "size", "k", "first").join(turns, ["k", "first"], "left")
    own = settle(own.select(*key, F.col("size").alias("_size"), F.col("first").alias("_first"), F.coalesce("_turns", F.array().cast(turns.schema["_turns"].dataType)).alias("_turns")), shuffled=True)
    each = own.groupBy(*key).agg(F.count("*").alias("_n"), F.max("_size").alias("_size"), F.min_by("_turns", "_first").alias("_turns"), F.max(F.size("_turns")).alias("_any"))
    each = each.filter("_any > 0").drop("_any").withColumnsRenamed({c: f"{c}2" for c in key})
    same = lambda c: F.col(c).eqNullSafe(F.col(f"{c}2"))
    mine = docs.withColumn("_d", F.col("doc_id").cast("long")).withColumn("_src", F.col("source").cast("string")).withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    both = mine.join(each.hint("merge"), (F.col("_t") == F.col("_t2")) & same("_d") & same("_src"))
    one = both.filter("_n = 1").select(*docs.columns, "_size", "_turns")
    # Repeated rows: the i-th of them takes the i-th turns.
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("_first"))).select(*[F.col(c).alias(f"{c}2") for c in key], F.col("_rank").alias("_rank2"), "_turns")
    more = both.filter("_n > 1").select(*docs.columns, *key, "_size").withColumn("_rank", rank)
    more = more.join(ranked, (F.col("_rank") == F.col("_rank2")) & (F.col("_t") == F.col("_t2")) & same("_d") & same("_src")).select(*docs.columns, "_size", "_turns")
    out = one.unionByName(more).withColumn("_spans", F.explode(F.col("_turns._spans")))
    taken = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(words, s["at"] + 1, s["n"]))), " ")
    out = out.withColumn("text", F.when(taken == F.col("_size"), F.col("text").cast("string")).otherwise(part)).select(docs.columns)
    return fewer(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out, 4)
