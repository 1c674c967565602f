"""Token ids as canonical length-limited Huffman codes.

The file format is a folder of Parquet files.  A row is one independent block of consecutive ids:

    part, block       order of the block; parts follow each other by ascending doc_id
    first_id          ids of this part before the block
    doc_ids, lengths  the documents of the block, in order, and how many ids each has
    checkpoints       bit offset of every ``STRIDE``-th id
    payload           the codes, most significant bit first

and a folder beside it, ``codes``, holds one row: ``lengths``, the code length of each id (0: the id does not occur).
Codes are canonical: ordered by (length, id).  Decoding looks ``limit`` bits up in a table, in lockstep over all
checkpoints of a block."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import running_totals, scratch_dir, settle

STRIDE = 128
BLOCK_SCHEMA = "part int, block int, first_id long, doc_ids array<long>, lengths array<int>, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids that occur (package-merge); 0 for the others."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError("limit is too small for so many ids")
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, merged, leaf = [], weights, np.ones(len(weights), dtype=bool)
    for _ in range(limit):
        levels.append(leaf)
        even = len(merged) // 2 * 2
        packs = merged[0:even:2] + merged[1:even:2]
        every = np.concatenate([weights, packs])
        order = np.argsort(every, kind="stable")
        merged, leaf = every[order], order < len(weights)
    take, depth = 2 * len(used) - 2, np.zeros(len(used), dtype=np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes of ``ids`` as bytes, and the bit offset of each id."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    if not len(ids):
        return b"", at
    word, code = at >> 6, codes[ids].astype(np.uint64)
    shift = 64 - (at & 63) - n  # below 0 where a code runs on into the next word
    over = np.flatnonzero(shift < 0)
    here = code << np.maximum(shift, 0).astype(np.uint64)
    here[over] = code[over] >> (-shift[over]).astype(np.uint64)
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    out[:-1] = np.bitwise_or.reduceat(here, np.searchsorted(word, np.arange(int(word[-1]) + 1)))  # a code begins in every word
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], at


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next ``limit`` bits."""
    limit = int(lengths.max()) if len(lengths) and lengths.max() else 1
    codes = canonical_codes(lengths)
    symbol, width = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used].astype(np.uint64) << (limit - lengths[used]).astype(np.uint64))]
    reach = 1 << (limit - lengths[used].astype(np.int64))
    n = int(reach.sum())
    symbol[:n], width[:n] = np.repeat(used, reach), np.repeat(lengths[used], reach)
    return symbol, width, limit


def unpack_bits(payload: bytes, checkpoints: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``count`` ids of a block; all stretches between checkpoints advance together."""
    symbol, width, limit = table
    raw = np.frombuffer(payload + bytes(STRIDE * 4 + 8), dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pos, last = checkpoints.astype(np.int64), len(window) - 1
    out = np.empty((len(pos), min(STRIDE, count) if count else 0), dtype=np.uint32)
    for k in range(out.shape[1]):
        peek = (window[np.minimum(pos >> 3, last)] >> (32 - limit - (pos & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, k] = symbol[peek]
        pos += width[peek]
    return out.reshape(-1)[:count]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """doc_id, ids (unsigned 32- or 16-bit little endian, by vocabulary size) of every row of ``docs``; null text is empty."""

    def run(batches):
        enc = tokens.encoder(tokenizer)
        code = "H" if enc.size <= 1 << 16 else "I"
        tail = array(code, [] if end_id is None else [end_id]).tobytes()
        for b in batches:
            ids = [enc.packed(t.as_py(), code) + tail for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def count_ids(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs, over all rows; summed in tasks, then per id, so the driver gets one row per id used."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            x = b.column(0).cast(pa.binary())
            ends = np.frombuffer(x.buffers()[1], dtype="<i4", count=x.offset + len(x) + 1)[x.offset :]
            if ends[-1] > ends[0]:
                total += np.bincount(np.frombuffer(x.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for i, n in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, limit: int = 16, block_ids: int = 1 << 16, part_ids: int = 1 << 22) -> None:
    """Encode every row of ``docs`` (doc_id, text) and write blocks below ``path`` in ascending doc_id order.

    A null doc_id comes first; rows that share a doc_id stand beside each other, in the order of a hash of their ids, so that
    they may be spread over tasks.
    ``limit`` bounds the code length (at most 24); it is raised where the vocabulary has more than 2**limit ids."""
    spark = docs.sparkSession
    size = tokens.encoder(tokenizer).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    limit = max(limit, int(size - 1).bit_length())
    ids = settle(tokenize(docs, tokenizer, end_id))
    counts = count_ids(ids, size, kind)
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()), STRIDE)], "lengths binary, stride int").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches):
        from pyspark import TaskContext

        codes, part, block, before = canonical_codes(lengths), TaskContext.get().partitionId(), 0, 0
        held, names, n = [], [], 0

        def flush():
            nonlocal block, before, held, names, n
            every = np.concatenate(held)
            payload, at = pack_bits(every, lengths, codes)
            row = {"part": part, "block": block, "first_id": before, "doc_ids": names, "lengths": [len(x) for x in held], "checkpoints": at[::STRIDE].tolist(), "payload": payload}
            block, before, held, names, n = block + 1, before + n, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append(np.frombuffer(x.as_py(), dtype=kind))
                names.append(d)
                n += len(held[-1])
                if n >= block_ids:
                    yield flush()
        if held:
            yield flush()

    parts = max(1, -(-int(counts.sum()) // part_ids))
    order = F.asc_nulls_first("doc_id"), F.asc("h")
    ordered = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a token file: doc_id, start (ids before it), n_tokens, ids_crc32, and ids with ``with_ids``."""
    blob = spark.read.schema("lengths binary, stride int").parquet(f"{path}/codes").head()[0]
    lengths = np.frombuffer(bytes(blob), dtype=np.uint8)

    def run(batches):
        table = decode_table(lengths)
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            for k in range(b.num_rows):
                sizes = np.array(get("lengths")[k].as_py(), dtype=np.int64)
                ids = unpack_bits(get("payload")[k].as_py(), np.array(get("checkpoints")[k].as_py(), dtype=np.int64), int(sizes.sum()), table)
                end = np.cumsum(sizes)
                mine = [ids[e - n : e].astype("<u4") for e, n in zip(end, sizes, strict=True)]
                cols = [pa.array([get("part")[k].as_py()] * len(sizes), pa.int32()), pa.array(get("doc_ids")[k].as_py(), pa.int64()), pa.array(get("first_id")[k].as_py() + end - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([tokens.crc_of(x) for x in mine], pa.int64())]
                names = ["part", "doc_id", "_at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.tobytes() for x in mine], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    read = blocks.mapInArrow(run, "part int, doc_id long, _at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    sums = running_totals(blocks.select(F.col("part").cast("long").alias("part"), total.alias("_n")).groupBy("part").agg(F.sum("_n").alias("_n")), "part", "_n", "_base")
    out = read.join(sums.select(F.col("part").cast("int").alias("part"), "_base"), "part")
    return out.select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """``write_tokens`` into the shared folder, then ``read_tokens``.  An empty table gives an empty result."""
    path = scratch_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
