"""Best-fit packing by linear grouping.

Documents become token ids, each closed by a separator id; only a document longer than a sequence is cut.  The plan
needs nothing but the number of pieces of each length, so the driver holds at most ``capacity`` counters at any scale:

1. lengths above a threshold are sorted and dealt into groups of equal cardinality, each rounded up to its longest;
2. a linear program over these few sizes (columns generated by a knapsack) finds how often to use which configuration: it
   covers all large pieces with the fewest sequences;
3. actual lengths take the places of rounded ones; where a configuration is meant to be full, the last place takes the longest
   piece that fits.  Sequences left with useless room are kept as long as that room is within what the best
   possible packing leaves anyway, the others are dissolved;
4. what is left, and all small pieces, go longest first to the fullest sequence with room (best fit).

Pieces then look up their place by (length, rank among pieces of that length)."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import balanced_chunks, fewer, grouped_offsets, settle

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text; other columns are ignored).

    Null text is empty and yields the separator alone; a null doc_id stays null; repeated rows are separate documents.
    A document over ``capacity`` ids is cut into pieces of ``capacity``, of which the first takes the remainder."""

    def cut(batches):
        enc = tokens.encoder(tokenizer)
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(array("I", [*enc.ids(text.as_py()), separator]), dtype=np.uint32)
                first = len(ids) % capacity or capacity
                ends = [min(first, len(ids)), *range(first + capacity, len(ids) + 1, capacity)]
                at = 0
                for k, e in enumerate(ends):
                    rows.append((d, k, at, e - at, tokens.crc_of(ids[at:e]), ids[at:e].tobytes() if keep_ids else None))
                    at = e
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)
    return out if keep_ids else out.drop("ids")


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and has the greatest worth (a knapsack by number of pieces and room used); of equal ones that
    with the fewest pieces and the least room used."""
    most = capacity // int(sizes.min())
    best = np.full((most + 1, capacity + 1), -np.inf)
    took = np.full((most + 1, capacity + 1), -1, dtype=np.int32)
    best[0, 0] = 0
    for j in range(1, most + 1):
        for i, (n, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
            v = best[j - 1, : capacity + 1 - n] + w
            more = v > best[j, n:]
            best[j, n:][more] = v[more]
            took[j, n:][more] = i
    j, used = np.unravel_index(int(best.argmax()), best.shape)
    value, pattern = float(best[j, used]), np.zeros(len(sizes), dtype=np.int64)
    while j:
        i = int(took[j, used])
        pattern[i] += 1
        j, used = j - 1, used - int(sizes[i])
    return value, pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns over ascending ``sizes`` and how often the linear program, which wants the fewest sequences, uses each to meet
    ``demand``; those of most pieces first."""
    basis = np.diag(capacity // sizes).astype(np.float64)
    inv = np.linalg.inv(basis)
    for n in range(rounds):
        x = inv @ demand
        value, pattern = _best_pattern(sizes, inv.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inv @ pattern
        ratio = np.full(len(sizes), np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        row = inv[out] / step[out]
        inv = np.linalg.inv(basis) if n % 50 == 49 else inv - np.outer(step, row)
        if n % 50 != 49:
            inv[out] = row
    x = np.linalg.inv(basis) @ demand
    used = [(basis[:, j].astype(np.int64), float(x[j])) for j in range(len(sizes)) if x[j] > 1e-9]
    return sorted(used, key=lambda u: -int(u[0].sum()))


def _longest(counts: np.ndarray, top: int, used: dict[int, int]) -> int:
    """The longest length up to ``top`` that is left besides ``used``; 0 if none is."""
    while top > 0:
        held = np.flatnonzero(counts[: top + 1])
        if not len(held):
            return 0
        top = int(held[-1])
        if counts[top] > used.get(top, 0):
            return top
        top -= 1
    return 0


def _plan(counts: np.ndarray, capacity: int, smallest: int, groups: int, useful: int, slack: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """Kinds of sequence as (how many, [(length, copies)]), for counts by length; and how many large pieces stand in
    configurations of two or more.  ``slack`` is the useless room that configurations may leave altogether."""
    left, kinds, together = counts.copy(), [], 0
    if left[capacity]:
        kinds.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    large = np.flatnonzero(left[smallest:]) + smallest
    if len(large):
        cum = np.cumsum(left[large])
        edges = np.unique(np.searchsorted(cum, np.linspace(0, cum[-1], groups + 1)[1:]))
        sizes = large[edges]
        demand = np.bincount(np.searchsorted(edges, np.arange(len(large))), weights=left[large], minlength=len(edges))
        filled = []
        for pattern, often in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(sizes))[::-1] for _ in range(int(pattern[g]))]
            full, times = capacity - int(pattern @ sizes) < useful, int(often + 0.5)
            while times > 0:
                room, used = capacity, {}
                for k, g in enumerate(slots):
                    last = full and k and k == len(slots) - 1
                    n = _longest(left, min(room, room if last else int(sizes[g])), used)
                    if n < smallest:
                        break
                    used[n] = used.get(n, 0) + 1
                    room -= n
                else:
                    whole = min(times, *(int(left[n]) // c for n, c in used.items()))
                    for n, c in used.items():
                        left[n] -= whole * c
                    filled.append((room if room < useful else 0, whole, list(used.items())))
                    times -= whole
                    continue
                break
        for waste, times, held in sorted(filled, key=lambda f: f[0]):
            keep = min(times, slack // waste) if waste else times
            slack -= keep * waste
            if keep:
                kinds.append((keep, held))
                together += keep * sum(c for _, c in held) * (sum(c for _, c in held) > 1)
            for n, c in held:
                left[n] += (times - keep) * c
    return _best_fit(left, kinds, capacity), together


def _best_fit(left: np.ndarray, kinds: list, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Add the lengths counted in ``left``, longest first, each to the fullest kind of sequence that has room."""
    room: list[list] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, dtype=bool)

    def put(times: int, held: list, free: int) -> None:
        if times:
            room[free].append((times, held))
            open_[free] = True

    for times, held in kinds:
        put(times, held, capacity - sum(n * c for n, c in held))
    for n in np.flatnonzero(left)[::-1].tolist():
        c = int(left[n])
        while c:
            at = int(open_[n:].argmax()) + n
            if not open_[at]:
                fit = capacity // n
                put(c // fit, [(n, fit)], capacity - n * fit)
                if c % fit:
                    put(1, [(n, c % fit)], capacity - n * (c % fit))
                break
            times, held = room[at].pop()
            open_[at] = bool(room[at])
            fit = at // n
            full = min(c // fit, times)
            put(full, [*held, (n, fit)], at - n * fit)
            c -= full * fit
            times -= full
            if times and c:  # fewer than fit are left
                put(1, [*held, (n, c)], at - n * c)
                times, c = times - 1, 0
            put(times, held, at)
    return [k for r in room for k in r]


def best_plan(hist: np.ndarray, capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """The plan of ``_plan`` with the fewest sequences, for counts by length.  Thresholds are a third and a quarter of the capacity, so
    that a sequence may hold several large pieces; each is tried with the room that the best packing leaves, and with none."""
    spare = int(-(hist @ np.arange(capacity + 1)) % capacity)
    tries = [(-(-capacity // 3), capacity // 8, spare), (-(-capacity // 4), capacity // 16, spare), (-(-capacity // 3), 3 * capacity // 16, 0), (-(-capacity // 4), capacity // 16, 0)]
    plans = [_plan(hist, capacity, max(1, smallest), 64, useful, slack) for smallest, useful, slack in tries]
    return min(plans, key=lambda p: sum(t for t, _ in p[0]))


def plan_places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places as rows (length, first rank, sequence of that rank, offset), sorted; rank r is in sequence + r - first rank.

    Tries a few thresholds between large and small and keeps the plan with the fewest sequences, the first of equal ones."""
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        hist[n] += c
    kinds = best_plan(hist, capacity)[0]
    rank, seq, rows = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for times, held in kinds:
        at = 0
        for n, copies in held:
            for _ in range(copies):
                rows.append((n, int(rank[n]), seq, at))
                rank[n] += times
                at += n
        seq += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece, and ids (unsigned 32-bit, little
    endian) with ``keep_ids``.  An empty table gives an empty result.  Null texts, null doc_ids and repeated rows: see
    ``cut_pieces``."""
    pieces = settle(cut_pieces(docs, tokenizer, capacity, separator, keep_ids))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # one row per length: at most capacity rows
    places = plan_places(counts, capacity)
    chunks = balanced_chunks(sum(counts.values()))
    ranked = grouped_offsets(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank", chunks)
    key = places[:, 0] * (1 << 44) + places[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches):
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, n * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(places[at, 2] + rank - places[at, 1]), pa.array(places[at, 3])], names=[*names, "sequence_id", "offset"])

    kinds = {"piece": "int", "ids": "binary"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*names, "sequence_id", "offset"])
    return fewer(ranked.mapInArrow(place, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from ``pack(..., keep_ids=True)``: sequence_id, n_ids, ids.  A sequence has at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("_p")).select("sequence_id", "n_ids", F.expr("aggregate(_p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
