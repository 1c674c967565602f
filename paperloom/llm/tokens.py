"""Exact, fast encoders for the public tokenizer files, kept per Python worker.

``byte_ids`` and ``word_ids`` give the ids that the tokenizers library gives.  Byte-pair encoding by merge rank is
confluent: where every vocabulary entry encodes to itself, merging the adjacent pair whose union has the least rank
gives what the merge list gives.  So ordinary texts go through tiktoken with ranks read from the same file, and texts
that hold characters beyond Latin scripts or a special string go through the tokenizers library itself."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

#: Beyond these, Unicode versions of the libraries could differ, so the named library decides.
_UNUSUAL = re.compile("[^\x01-\x1b\x20-\x84\x86-\u024f\u2010-\u2027\u20ac]|<\\|")
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _word_pattern() -> re.Pattern:
    """'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+ for lower-cased texts without unusual characters: the classes are
    written out for the characters that such texts may hold, which the faster standard library matches."""
    import regex

    usual = "".join(c for c in map(chr, range(1, 0x2100)) if not _UNUSUAL.match(c))
    held = sorted(set(usual) | set(usual.lower()))
    of = lambda kind: "".join(re.escape(c) for c in held if regex.fullmatch(kind, c))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^{spaces}{letters}{numbers}]+")


class _Words(dict):
    """Ids of words as bytes, each encoded once; emptied when full."""

    def __init__(self, bpe, code: str, most: int = 400_000):
        super().__init__()
        self.bpe, self.code, self.most = bpe, code, most

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        got = self[word] = array(self.code, self.bpe.encode_ordinary(word + "\0")).tobytes()
        return got


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, others follow from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a tokenizers JSON file (byte-level BPE, with or without word ends)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        chars, ends = _byte_chars(), spec["model"].get("end_of_word_suffix") or ""
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                end = bool(ends) and token.endswith(ends) and token != ends
                ranks[bytes(chars[c] for c in (token[: -len(ends)] if end else token)) + b"\0" * end] = i
        self.size = 1 + max(*spec["model"]["vocab"].values(), *special)
        self.words = _word_pattern() if ends else None
        #: With word ends, NUL closes each word, as no ordinary text holds it.
        self.held: dict[str, _Words] = {}
        self.bpe = tiktoken.Encoding("paperloom", pat_str=r"[^\x00]*\x00" if ends else _BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The library's own encoder, loaded with the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> list[int]:
        """Null counts as empty."""
        if not text:
            return []
        if _UNUSUAL.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        if self.words is None:
            return self.bpe.encode_ordinary(text)
        return array("I", self.packed(text, "I")).tolist()

    def packed(self, text: str | None, code: str) -> bytes:
        """The same ids as an array of type ``code`` (H or I) in bytes."""
        if not text or self.words is None or _UNUSUAL.search(text):
            return array(code, self.ids(text)).tobytes()
        held = self.held.get(code)
        if held is None:
            held = self.held[code] = _Words(self.bpe, code)
        return b"".join(map(held.__getitem__, self.words.findall(text.lower())))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
