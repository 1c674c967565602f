"""Exact token counts of every prefix by dynamic programming.

The vocabulary has no piece with a space inside, so a text falls into chunks, each a run of spaces and the characters up
to the next space, that are encoded independently.  Inside a chunk, the encoding of a prefix ends in the one vocabulary
piece that is a suffix of the prefix and that merges with nothing at its left border; hence

    count(prefix) = count(prefix without that piece) + 1

and the table of (count, last piece) over prefixes, shared by all chunks that begin alike, answers every prefix.
A character that no piece holds counts as its UTF-8 bytes.  A chunk over ``SHARED`` characters keeps its table in arrays
of its own, as a shared one would hold each of its prefixes in full; the recurrence is the same.

Texts of a batch are split into words together, and each distinct word is looked up once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SHARED = 256
SLICE = 1 << 23  # characters of texts that are split into words at once
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class PrefixCounter:
    """Prefix tables of a sentencepiece BPE model with byte fallback.  Memory is bounded: full memos are emptied."""

    def __init__(self, path: str, memo: int = 300_000):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        pieces = {p.piece for p in model.pieces if p.type == 1}
        #: The table is exact for such models only; for any other, each prefix asked for is encoded.
        self.direct = SentencePieceProcessor(model_file=path)
        letters = {c for p in pieces for c in p}
        self.exact = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and letters <= pieces and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        spec.add_dummy_prefix = False
        self.bare = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.pieces, self.letters = pieces, letters
        self.endings: dict = {}  # pieces as a tree of characters from the last to the first; the piece itself at ""
        for p in pieces:
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.memo, self.pairs, self.table, self.chunks = memo, {}, {"": (0, "")}, {}

    def _border(self, left: str, right: str) -> bool:
        """Whether the pieces stand beside each other in the encoding of their union."""
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > self.memo:
                self.pairs.clear()
            ok = self.pairs[key] = (left + right) not in self.pieces and self.bare.encode(left + right, out_type=str) == [left, right]
        return ok

    def _step(self, prefix: str) -> tuple[int, str]:
        """(count, last piece) of a chunk's prefix whose shorter prefixes are in the table; no last piece after bytes."""
        table, pairs = self.table, self.pairs
        node, at = self.endings.get(prefix[-1]), len(prefix) - 1
        if node is None or prefix[-1] not in self.letters:
            return table[prefix[:-1]][0] + len(prefix[-1].encode()), ""
        while node is not None:
            piece = node.get("")
            if piece is not None:
                count, last = table[prefix[:at]]
                if not last:
                    return count + 1, piece
                ok = pairs.get((last, piece))
                if ok or ok is None and self._border(last, piece):
                    return count + 1, piece
            at -= 1
            if at < 0:
                break
            node = node.get(prefix[at])
        raise AssertionError("a single character is always a piece here")

    def _fill(self, chunk: str) -> int:
        """Extend the table to all prefixes of a chunk and return the count of the whole."""
        table = self.table
        if chunk in table:
            return table[chunk][0]
        if len(table) > 4 * self.memo:
            table.clear()
            table[""] = (0, "")
        known = len(chunk) - 1
        while chunk[:known] not in table:
            known -= 1
        for n in range(known + 1, len(chunk) + 1):
            table[chunk[:n]] = self._step(chunk[:n])
        return table[chunk][0]

    def _prefixes(self, chunk: str) -> list[int]:
        """Counts of the prefixes of a chunk, the empty one first."""
        if len(chunk) > SHARED:
            return self._long(chunk)
        self._fill(chunk)
        return [self.table[chunk[:n]][0] for n in range(len(chunk) + 1)]

    def _whole(self, chunk: str) -> int:
        """The count of a chunk."""
        n = self.chunks.get(chunk)
        if n is None:
            if len(self.chunks) > self.memo:
                self.chunks.clear()
            n = self._long(chunk)[-1] if len(chunk) > SHARED else self._fill(chunk)
            if len(chunk) <= SHARED:
                self.chunks[chunk] = n
        return n

    @staticmethod
    def _split(text: str) -> list[str]:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        return sum(map(self._whole, self._split(text))) if self.exact else len(self.direct.encode(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i: the count of ``text[:i]``; the last entry is the count of the text."""
        if not self.exact:
            return np.array([0, *(len(self.direct.encode(text[:i])) for i in range(1, len(text) + 1))], dtype=np.int64)
        out, at, base = np.zeros(len(text) + 2, dtype=np.int64), 1, 0
        for chunk in self._split(text):  # positions count the space that the encoding puts before the text
            counts = self._prefixes(chunk)
            out[at : at + len(chunk)] = base + np.array(counts[1:])
            at, base = at + len(chunk), base + counts[-1]
        out[1] = 0  # the space alone: no text, no tokens
        return out[1:]

    def _long(self, chunk: str) -> list[int]:
        """The same recurrence over positions of one chunk, with arrays in place of the shared table."""
        counts, lasts = [0], [""]
        for n in range(1, len(chunk) + 1):
            c = chunk[n - 1]
            step, node, k = (counts[-1] + len(c.encode()), ""), self.endings.get(c), n - 1
            while node is not None:
                piece = node.get("")
                if piece is not None and (not lasts[k] or self._border(lasts[k], piece)):
                    step = (counts[k] + 1, piece)
                    break
                k -= 1
                node = node.get(chunk[k]) if k >= 0 else None
            counts.append(step[0])
            lasts.append(step[1])
        return counts

    def fitting(self, text: str, budget: int) -> int:
        """The length of the longest prefix that has at most ``budget`` tokens."""
        if not self.exact:
            return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1]) if budget >= 0 else 0
        chunks = self._split(text)
        return self._fit(chunks, np.cumsum([self._whole(x) for x in chunks]), budget)

    def _fit(self, chunks: list[str], ends: np.ndarray, budget: int) -> int:
        """``fitting`` for a text's chunks and the counts at their ends.  A prefix that ends inside a chunk has a token more, at
        least, than the chunks before it, so only one chunk is looked into."""
        k = int(np.searchsorted(ends, budget - 1, side="right"))
        before, base = sum(map(len, chunks[:k])), int(ends[k - 1]) if k else 0
        if k < len(chunks):
            fit = np.flatnonzero(np.array(self._prefixes(chunks[k])) + base <= budget)
            before += int(fit[-1]) if len(fit) else 0
        return max(0, before - 1)

    def counts(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Count of each text, and the length of its longest prefix within ``limit``."""
        n, fit = [0] * len(texts), [len(t) for t in texts]
        plain = []
        for i, t in enumerate(texts):
            if not self.exact or "  " in t or SPACE in t or t[:1] == " " or t[-1:] == " ":
                n[i] = self.count(t)
                fit[i] = self.fitting(t, limit) if n[i] > limit else len(t)
            elif t:
                plain.append(i)
        for part in _slices(plain, texts):
            words = pc.split_pattern(pa.array([texts[i] for i in part], pa.large_string()), " ")
            ends = np.asarray(words.offsets)
            coded = words.flatten().dictionary_encode()
            each = np.array([self._whole(SPACE + w) for w in coded.dictionary.to_pylist()], dtype=np.int64)[np.asarray(coded.indices)]
            sums = np.concatenate([[0], np.cumsum(each)])
            for at, i in enumerate(part):
                lo, hi = int(ends[at]), int(ends[at + 1])
                n[i] = int(sums[hi] - sums[lo])
                if n[i] > limit:
                    k = int(np.searchsorted(sums[lo + 1 : hi + 1] - sums[lo], limit - 1, side="right"))
                    head = texts[i].split(" ", k + 1)[: k + 1]
                    fit[i] = self._fit([SPACE + w for w in head], sums[lo + 1 : lo + 2 + k] - sums[lo], limit)
        return n, fit


def _slices(which: list[int], texts: list[str]) -> Iterator[list[int]]:
    """``which`` in runs of about ``SLICE`` characters of text."""
    held, size = [], 0
    for i in which:
        held.append(i)
        size += len(texts[i])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    fit_chars is the number of characters in the longest prefix of at most ``limit`` tokens.  Null text is empty: no
    bytes, no tokens.  Null doc_ids and repeated rows are kept.  An empty table gives an empty result."""

    def run(batches):
        c = counter(model)
        for b in batches:
            n, fit = c.counts([x or "" for x in b.column(1).to_pylist()], limit)
            size = pc.fill_null(pc.binary_length(b.column(1)).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and counts, an array whose entry i (from 0) is the exact token count of the first i characters."""

    def run(batches):
        c = counter(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.prefix_counts(t or "").tolist() for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, counts array<long>")
