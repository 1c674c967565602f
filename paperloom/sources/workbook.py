"""Cells of the older binary workbook format, version 8 (.xls): the compound file around it, and the records that hold cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Numbers of the records that are read.
EOF, FORMULA, CONTINUE, BOUNDSHEET, MULRK, SST, LABELSST, NUMBER, LABEL, BOOLERR, STRING, RK, BOF = 0x0A, 0x06, 0x3C, 0x85, 0xBD, 0xFC, 0xFD, 0x203, 0x204, 0x205, 0x207, 0x27E, 0x809
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END = 0xFFFFFFFA  # sector numbers from here on end a chain


def stream(raw: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The named stream of a compound file."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    first_dir, cutoff, first_mini, extra = (struct.unpack_from("<I", raw, at)[0] for at in (48, 56, 60, 68))
    size = 1 << shift
    sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    tables = numbers(raw[76:512])
    for _ in range(len(raw) // size):  # the list of tables goes on in sectors of its own
        if extra >= END:
            break
        *more, extra = numbers(sector(extra))
        tables += more
    fat = [n for t in tables if t < END for n in numbers(sector(t))]

    def chain(start: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table)):
            if start >= len(table):
                return
            yield start
            start = table[start]

    whole = lambda start: b"".join(map(sector, chain(start, fat)))
    listing, found, root = whole(first_dir), None, None
    for at in range(0, len(listing) - 127, 128):
        n, kind = struct.unpack_from("<HB", listing, at + 64)
        start, length = struct.unpack_from("<II", listing, at + 116)
        name = listing[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            root = start
        elif kind == 2 and name in names and found is None:
            found = start, length
    if found is None:
        raise ValueError("no workbook")
    start, length = found
    if length >= cutoff or root is None:
        return whole(start)[:length]
    small, mini, wide = whole(root), numbers(whole(first_mini)), 1 << mini_shift
    return b"".join(small[i * wide : (i + 1) * wide] for i in chain(start, mini))[:length]


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Records from ``at`` on, each with its continuations, up to the end of the part."""
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        parts, at = [data[at + 4 : at + 4 + n]], at + 4 + n
        while at + 4 <= len(data) and struct.unpack_from("<H", data, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", data, at + 2)[0]
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, parts
        if kind == EOF:
            return


class _Reader:
    """Values of a record that goes on in continuations; characters begin anew there, with a byte that tells their width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
            if self.at >= len(self.parts[self.k]) and len(out) < n:
                self.k, self.at = self.k + 1, 0
        return out

    def chars(self, n: int, wide: bool) -> str:
        out = ""
        while len(out) < n:
            if self.at >= len(self.parts[self.k]):
                if self.k + 1 >= len(self.parts):
                    break
                self.k, self.at = self.k + 1, 1
                wide = bool(self.parts[self.k][0] & 1)
            width = 1 + wide
            got = self.parts[self.k][self.at : self.at + (n - len(out)) * width]
            self.at += len(got)
            out += got.decode("utf-16-le" if wide else "latin-1", "replace")
        return out

    def text(self, count: str = "<H") -> str:
        n = struct.unpack(count, self.take(struct.calcsize(count)))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.chars(n, bool(flags & 1))
        self.take(4 * runs + more)
        return out


def _rk(n: int) -> float:
    """A number in its short form: whole or the upper half of a double, maybe a hundredth."""
    value = float((n if n < 1 << 31 else n - (1 << 32)) >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & ~3) << 32))[0]
    return value / 100 if n & 1 else value


def _number(x: float) -> str:
    return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else str(x)


def sheets(raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cells as text) of each sheet; rows without a value are left out.  Dates are their numbers."""
    data = stream(raw)
    names, shared = [], []
    for kind, parts in _records(data):
        if kind == BOUNDSHEET and parts[0][5] == 0:
            names.append((struct.unpack_from("<I", parts[0])[0], _Reader([parts[0][6:]]).text("<B")))
        elif kind == SST:
            r = _Reader(parts)
            unique = struct.unpack("<II", r.take(8))[1]
            shared = [r.text() for _ in range(unique)]
    for at, name in names:
        cells: dict[int, dict[int, str]] = {}
        waiting = None
        for kind, parts in _records(data, at):
            p = parts[0]
            if kind == STRING and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _Reader(parts).text()
                continue
            if kind not in (LABELSST, NUMBER, RK, MULRK, LABEL, FORMULA, BOOLERR):
                continue
            row, col = struct.unpack_from("<HH", p)
            line, waiting = cells.setdefault(row, {}), None
            if kind == LABELSST:
                line[col] = shared[struct.unpack_from("<I", p, 6)[0]]
            elif kind == NUMBER:
                line[col] = _number(struct.unpack_from("<d", p, 6)[0])
            elif kind == RK:
                line[col] = _number(_rk(struct.unpack_from("<I", p, 6)[0]))
            elif kind == MULRK:
                line.update({col + i: _number(_rk(struct.unpack_from("<I", p, 6 + 6 * i)[0])) for i in range((len(p) - 6) // 6)})
            elif kind == LABEL:
                line[col] = _Reader([p[6:], *parts[1:]]).text()
            elif kind == BOOLERR:
                line[col] = "" if p[7] else str(bool(p[6]))
            elif p[12:14] != b"\xff\xff":
                line[col] = _number(struct.unpack_from("<d", p, 6)[0])
            elif p[6] == 0:
                waiting = row, col
            elif p[6] == 1:
                line[col] = str(bool(p[8]))
        yield name, [[line.get(c, "") for c in range(max(line) + 1)] for _, line in sorted(cells.items()) if any(line.values())]
