"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors a and b have cosine >= c when their squared distance is at most 2 - 2c.  After a rotation the coordinates
are split into blocks; a near pair is within its block's share of that budget (in proportion to the block's width) in
at least one block.  Each block is range-joined: a vector enters every grid cell that its ball of half the block's radius
touches on the first axes of the block, so the two vectors of a near pair share the cell of their midpoint.  Cells join
inside tasks, in groups of bounded size; candidates from a block are verified on the original vectors in double
precision there and then.  A pair counts only in the first block that proposes it, in the least cell it shares.

The rotation follows the main axes of a bounded sample, dealt over the blocks; being orthogonal, it changes which cells
are full, never the result.  Equal vectors are one class with a weight."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bounded_groups
from .common import fewer, hash_sample, settle
from .graph import Forest, connected_components
from .vectors import element_type, takes_part

SAMPLE = 4096  # vectors that the rotation is fitted on


def rotation(sample: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the sample's main axes, dealt in turn over ``blocks`` blocks of columns."""
    base = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))[0]
    if len(sample) > width:
        base = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=True)[2].T
    return base[:, np.concatenate([np.arange(b, width, blocks) for b in range(blocks)])]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(classes: DataFrame, kind: str, turn: dict, least: float, blocks: int, axes: int) -> DataFrame:
    """Rows label, dim, block, cell, and low (the least cell of the vector's ball on each axis) for each cell it enters."""

    def run(batches):
        for b in batches:
            rows = {n: b.column(i) for i, n in enumerate(("cid", "label", "dim", "n", "vec"))}
            dims = rows["dim"].to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                take = pa.array(at)
                x = np.frombuffer(b"".join(v.as_py() for v in rows["vec"].take(take)), dtype=kind).reshape(-1, d).astype(np.float64)
                y = _unit(x) @ turn[d]
                edge, out = np.cumsum([0, *[len(range(k, d, blocks)) for k in range(blocks)]]), []
                for k in range(blocks):
                    wide = int(edge[k + 1] - edge[k])
                    if not wide:
                        continue
                    r = np.sqrt((2 - 2 * least) * wide / d) * (1 + 1e-9) + 1e-12
                    g = min(axes, wide)
                    p = y[:, edge[k] : edge[k] + g] / (2 * r) + 0.5  # cells are twice the radius wide, the middle one centred on 0
                    low, high = np.floor(p - 0.25 - 1e-9).astype(np.int64), np.floor(p + 0.25 + 1e-9).astype(np.int64)
                    low, high = np.pad(low, ((0, 0), (0, axes - g))), np.pad(high, ((0, 0), (0, axes - g)))
                    for corner in range(1 << axes):
                        up = np.array([corner >> a & 1 for a in range(axes)], dtype=bool)
                        m = np.flatnonzero((~up | (high > low)).all(axis=1))
                        cell = np.where(up, high, low)[m]
                        out.append((m, k, cell, low[m]))
                for m, k, cell, low in out:
                    pick = pa.array(at[m])
                    fixed = lambda z: pa.array(z.tolist(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows["label"].take(pick), rows["dim"].take(pick), pa.array(np.full(len(m), k), pa.int32()), fixed(cell), fixed(low), rows["cid"].take(pick), rows["n"].take(pick), rows["vec"].take(pick)], names=["label", "dim", "block", "cell", "low", "cid", "n", "vec"])

    schema = "label string, dim int, block int, cell array<long>, low array<long>, cid long, n long, vec binary"
    return classes.select("cid", "label", "dim", "n", "vec").mapInArrow(run, schema)


def _join_cells(groups: DataFrame, kind: str, turn: dict, least: float, blocks: int, tile: int = 1024) -> DataFrame:
    """From each group: (cid, links) partial sums of linked weights, and (a, b) edges of a spanning forest of its links."""

    def pairs(x, y, low, cell, k, d, across, chunk):
        """Verified pairs i < j of a group that this block and cell are the first to propose, tile by tile."""
        edge = np.cumsum([0, *[len(range(q, d, blocks)) for q in range(blocks)]])
        limit = [(2 - 2 * least) * (edge[q + 1] - edge[q]) / d * (1 + 1e-9) + 1e-12 for q in range(blocks)]
        z = y[:, edge[k] : edge[k + 1]]
        sq = (z * z).sum(axis=1)
        for i0 in range(0, len(z), tile):
            for j0 in range(i0, len(z), tile):
                dist = sq[i0 : i0 + tile, None] + sq[None, j0 : j0 + tile] - 2 * (z[i0 : i0 + tile] @ z[j0 : j0 + tile].T)
                i, j = np.nonzero(dist <= limit[k] + 1e-9)
                i, j = i + i0, j + j0
                keep = i < j
                if across:
                    keep &= chunk[i] != chunk[j]
                i, j = i[keep], j[keep]
                keep = (np.maximum(low[i], low[j]) == cell).all(axis=1)
                i, j = i[keep], j[keep]
                for q in range(k):
                    e = slice(edge[q], edge[q + 1])
                    keep = ((y[i, e] - y[j, e]) ** 2).sum(axis=1) > limit[q]
                    i, j = i[keep], j[keep]
                keep = np.einsum("ij,ij->i", x[i], x[j]) >= least
                yield i[keep], j[keep]

    def run(batches):
        for b in batches:
            for g in range(b.num_rows):
                row = {n: b.column(i)[g] for i, n in enumerate(("dim", "block", "cell", "across", "members"))}
                d, k, cell = row["dim"].as_py(), row["block"].as_py(), np.array(row["cell"].as_py())
                m = row["members"].values
                vec = np.frombuffer(b"".join(v.as_py() for v in m.field("vec")), dtype=kind).reshape(-1, d).astype(np.float64)
                cid, weight = (m.field(c).to_numpy(zero_copy_only=False) for c in ("cid", "n"))
                chunk = m.field("chunk").to_numpy(zero_copy_only=False)
                low = np.asarray(m.field("low").flatten()).reshape(len(cid), -1)
                x = _unit(vec)
                y, links, forest = x @ turn[d], np.zeros(len(cid), dtype=np.int64), Forest(len(cid))
                for i, j in pairs(x, y, low, cell, k, d, row["across"].as_py(), chunk):
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    forest.add(i, j)
                used = np.flatnonzero(links)
                e = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
                none = pa.nulls(len(used), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cid[used]), pa.array(links[used]), none, none], names=["cid", "links", "a", "b"])
                none = pa.nulls(len(e), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(cid[e[:, 0]]), pa.array(cid[e[:, 1]])], names=["cid", "links", "a", "b"])

    return groups.select("dim", "block", "cell", "across", "members").mapInArrow(run, "cid long, links long, a long, b long")


def near_duplicates(rows: DataFrame, least: float = 0.93, blocks: int = 4, axes: int = 2, cap: int = 1 << 12) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared where labels are equal and not null and dimensions agree.  Vectors that are null, zero, or hold a
    null or non-finite component link with nothing and are components of their own; so do rows without label or
    vec_id.  Equal vectors of a label link with each other; repeated rows count as further vectors.  ``least`` must be
    above 0.  An empty table gives an empty result.  Other columns are ignored."""
    kind = element_type(rows, "embedding")
    code = "float" if kind == "<f4" else "double"
    base = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{code}>").alias("embedding"))
    ok = takes_part("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    valid = base.filter(ok)
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))

    def pack(batches):
        for b in batches:
            v = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array([len(x) for x in v], pa.int32()), pa.array([np.array(x.as_py(), dtype=kind).tobytes() for x in v], pa.binary()), b.column(2), b.column(3)], names=["label", "embedding", "dim", "vec", "least", "n"])

    classes = settle(classes.mapInArrow(pack, f"label string, embedding array<{code}>, dim int, vec binary, least long, n long").withColumn("cid", F.monotonically_increasing_id()), shuffled=True)
    dims = [r[0] for r in classes.select("dim").distinct().collect()]  # as many as there are lengths of vectors
    turn = {}
    for d in dims:
        sample = hash_sample(classes.filter(F.col("dim") == d).select("vec"), ["vec"], SAMPLE)
        x = np.frombuffer(b"".join(bytes(r[0]) for r in sample), dtype=kind).reshape(-1, d).astype(np.float64)
        turn[d] = rotation(_unit(x), d, blocks)
    cells = settle(_cells(classes, kind, turn, least, blocks, axes))
    key = ["label", "dim", "block", "cell"]
    groups = bounded_groups(cells, key, ["cid", "n", "low", "vec"], "cid", cap)
    found = settle(_join_cells(groups, kind, turn, least, blocks), shuffled=True)
    links = found.filter("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("a is not null").select("a", "b"))
    named = classes.select("cid", "label", "embedding", "least", "n").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").join(links, "cid", "left")
    lookup = named.select("label", "embedding", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = valid.join(lookup, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = base.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fewer(out).unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
