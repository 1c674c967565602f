"""Approximate nearest neighbours with an inverted multi-index.

Each half of the vectors has its own codebook; the pair of codes is a vector's cell.  A query sorts the centroids of both
halves by distance and takes pairs off a heap in order of summed distance until the cells hold enough entries; these
are reranked by exact distance.  How much is enough is measured, not guessed: on the training sample, the share of
entries that must be visited to reach the wanted recall against brute force.  The sample is drawn from the indexed rows.

Codebooks are fitted on a bounded sample (``TRAIN`` vectors); every vector is indexed.  Of equal vectors the k + 1 with
the smallest ids are indexed, as no other can be among the k nearest of any query.  Cells are gathered to blocks of
bounded size, a cell beyond that is spread over several; a query goes to the blocks of its cells."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fewer, hash_sample, settle
from .vectors import element_type, takes_part

TRAIN = 1 << 14
PROBES = 256  # sampled queries that the visited share is measured with
QUERY_CHUNK = 1 << 16  # queries that meet one copy of the index


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's k-means; a centroid without vectors stays where it is."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest_centroid(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T), 0)


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance (a heap over pairs of the two sorted lists) until they hold ``enough`` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, ia, ib, wide = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist(), len(second)
    heap, got, out, row = [(x[0] + y[0], 0, 0)], 0, [], [-1] * len(x)
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = ia[i] * wide + ib[j]
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        row[i] = j
        if j + 1 < wide and (i == 0 or row[i - 1] > j):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and row[i + 1] == j - 1:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return out


def visited_share(x: np.ndarray, books: list[np.ndarray], k: int, recall: float) -> float:
    """The share of entries that queries from the sample must visit to find ``recall`` of their k nearest in it."""
    half = x.shape[1] // 2
    parts = [x[:, :half], x[:, half:]]
    wide = len(books[1])
    cell = nearest_centroid(parts[0], books[0]) * wide + nearest_centroid(parts[1], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * wide)
    reached = []
    for q in range(0, len(x), max(1, len(x) // PROBES)):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        top = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        total = (((books[0] - parts[0][q]) ** 2).sum(axis=1)[:, None] + ((books[1] - parts[1][q]) ** 2).sum(axis=1)[None]).ravel()
        order = np.argsort(total, kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(counts[order])
        reached += (before[cell[top]] / len(x)).tolist()
    return float(np.quantile(reached, recall)) if reached else 1.0


def nearest(rows: DataFrame, is_query: Column, k: int = 10, recall: float = 0.96) -> DataFrame:
    """The k nearest found for each row of ``rows`` (vec_id, embedding) that ``is_query`` selects, among all rows with another
    vec_id: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision), ties to the smaller vec_id.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without vec_id or whose
    dimension is not the table's most frequent one.  Repeated rows are one candidate; a repeated query is answered for
    each row.  An empty table gives an empty result.  Other columns are ignored."""
    spark, kind, schema = rows.sparkSession, element_type(rows, "embedding"), "query_id long, rank int, vec_id long, score double"
    code = "float" if kind == "<f4" else "double"
    base = rows.filter(takes_part("embedding") & F.col("vec_id").isNotNull()).withColumn("_q", F.coalesce(is_query, F.lit(False)))
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{code}>").alias("v"), "_q")
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, total = int(common[0]), int(common[1])
    base = base.filter(F.size("v") == dim)
    least = Window.partitionBy("v").orderBy("vec_id")
    unique = settle(base.select("vec_id", "v").distinct().withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k + 1).select("vec_id", "v"))
    x = np.array([r["v"] for r in hash_sample(unique, ["vec_id", "v"], TRAIN)], dtype=np.float64)
    half, size = dim // 2, max(2, min(256, int(total**0.5 / 4)))
    books = [centroids(x[:, :half], size), centroids(x[:, half:], size)]
    share = visited_share(x, books, k, recall)
    wide = len(books[1])

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(v.as_py() for v in column), dtype=kind).reshape(-1, dim).astype(np.float64)

    def assign(batches):
        for b in batches:
            v = [np.array(y.as_py(), dtype=kind).tobytes() for y in b.column(1)]
            y = np.frombuffer(b"".join(v), dtype=kind).reshape(-1, dim).astype(np.float64)
            cell = nearest_centroid(y[:, :half], books[0]) * wide + nearest_centroid(y[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), pa.array(cell, pa.int64())], names=["vec_id", "vec", "cell"])

    index = settle(unique.mapInArrow(assign, "vec_id long, vec binary, cell long"), shuffled=True)
    counts = np.zeros(len(books[0]) * wide, dtype=np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # at most one row per pair of centroids
        counts[cell] = n
    entries = int(counts.sum())
    enough, limit = int(np.ceil(share * entries)), max(1024, min(1 << 14, entries // 2048))
    first, spread, block, held = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64), 0, 0
    for c in np.flatnonzero(counts).tolist():
        if held and held + counts[c] > limit:
            block, held = block + 1, 0
        first[c], spread[c] = block, -(-int(counts[c]) // limit)
        held += int(counts[c])
        if spread[c] > 1:
            block, held = block + int(spread[c]), 0
    blocks = block + 1

    def route(batches):
        for b in batches:
            y = np.array(b.column(1).to_pylist(), dtype=np.float64)
            if not len(y):
                continue
            near = [squared(y[:, :half], books[0]), squared(y[:, half:], books[1])]
            for i in range(len(y)):
                cells = np.array(visit(near[0][i], near[1][i], counts, enough), dtype=np.int64)
                each = np.repeat(cells, spread[cells])
                to = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(spread[cells]) - spread[cells], spread[cells])
                vec = y[i].astype(kind).tobytes()
                goal = np.unique(to)
                cols = [pa.array(goal), pa.array([b.column(2)[i].as_py()] * len(goal), pa.int64()), pa.array([b.column(0)[i].as_py()] * len(goal), pa.int64()), pa.array([vec] * len(goal), pa.binary()), pa.array([each[to == g].tolist() for g in goal], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "qno", "query_id", "vec", "cells"])

    asked = settle(base.filter("_q").select("vec_id", "v").withColumn("qno", F.monotonically_increasing_id()))
    probes = settle(asked.select("vec_id", "v", "qno").repartition(max(1, min(4096, entries // 4096)), "qno").mapInArrow(route, "block long, qno long, query_id long, vec binary, cells array<long>"), shuffled=True)
    chunks = max(1, -(-probes.count() // (blocks * QUERY_CHUNK)))
    probes = probes.withColumn("chunk", F.pmod(F.xxhash64("qno"), F.lit(chunks)).cast("long"))

    def deal(batches):
        for b in batches:
            cell, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 0))
            to = first[cell] + ids % spread[cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to)], names=["vec_id", "vec", "cell", "block"])

    dealt = index.mapInArrow(deal, "vec_id long, vec binary, cell long, block long").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of a block for each query of a chunk."""
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            y, ids, cell = matrix(right.column("vec")), right.column("vec_id").to_numpy(), right.column("cell").to_numpy()
            sq = (y * y).sum(axis=1)
            for at in range(0, left.num_rows, 256):
                part = left.slice(at, 256)
                q = matrix(part.column("vec"))
                dist = (q * q).sum(axis=1)[:, None] + sq[None] - 2 * (q @ y.T)
                for i in range(part.num_rows):
                    mine = part.column("query_id")[i].as_py()
                    can = np.flatnonzero(np.isin(cell, np.array(part.column("cells")[i].as_py())) & (ids != mine))
                    if len(can) > k:  # products are inexact near zero: all within their error of the k-th are measured
                        d = dist[i, can]
                        scale = 1e-9 * max(1e-300, float(sq.max()) + float(q[i] @ q[i]))
                        can = can[d <= np.partition(d, k - 1)[k - 1] + scale]
                    exact = np.sqrt(((y[can] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[can], exact))[:k]
                    for o, v in zip(out, ([part.column("qno")[i].as_py()] * len(best), [mine] * len(best), ids[can][best].tolist(), exact[best].tolist()), strict=True):
                        o += v
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["qno", "query_id", "vec_id", "score"])

    found = probes.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(rank, "qno long, query_id long, vec_id long, score double")
    order = Window.partitionBy("qno").orderBy("score", "vec_id")
    return fewer(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
