"""Chunks of texts as arrays: where they lie in the texts' bytes, their digests, and tables of what distinct chunks stand for.

Digests are 64 bits of a polynomial over the bytes, mixed with the length. Two of n distinct chunks share one with a probability of
about n * n / 2**65: one in a million for five million chunks in one table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 256  # bytes; longer chunks are digested one by one
_WINDOW = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _accumulated(factor: int) -> np.ndarray:
    steps = np.full(_WINDOW + LONG + 1, factor, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _accumulated(_BASE), _accumulated(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of each number made to depend on all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts side by side, and where each begins, with the end; null counts as empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    begin = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[begin[0] : begin[-1]]
    return raw, begin - begin[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in runs whose texts have about ``most`` bytes; a longer text is alone."""
    _, begin = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest of each span raw[start:end]; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    edges = np.searchsorted(starts, np.arange(0, len(raw) + _WINDOW + 1, _WINDOW))
    for w, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a == b:
            continue
        base = w * _WINDOW
        part = raw[base : base + _WINDOW + LONG]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=total[1:])
        s = starts[a:b] - base
        e = np.minimum(ends[a:b] - base, len(part))
        out[a:b] = mixed((total[e] - total[s]) * _DOWN[s] + sizes[a:b].astype(np.uint64))
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class IdTable:
    """Digest -> ids, in arrays. Beyond ``most`` entries, those that were never asked for again go: a bound on memory that costs time alone."""

    def __init__(self, most: int, kind: type = np.uint32):
        self.most, self.kind = most, kind
        self._empty(1 << 12)

    def _empty(self, slots: int) -> None:
        self.n = 0
        self.keys, self.flat = np.zeros(slots // 2, np.uint64), np.empty(slots, self.kind)
        self.start, self.size = np.zeros(slots // 2 + 1, np.int64), np.zeros(slots // 2, np.int32)
        self.again = np.zeros(slots // 2, bool)
        self._place(slots)

    def _place(self, slots: int) -> None:
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.slot = np.full(slots, -1, np.int32)
        self._insert(np.arange(self.n, dtype=np.int32))

    def _insert(self, rows: np.ndarray) -> None:
        mask = len(self.slot) - 1
        at = (self.keys[rows] >> self.shift).astype(np.int64)
        while len(rows):
            free = self.slot[at] < 0
            self.slot[at[free]] = rows[free]
            left = self.slot[at] != rows
            rows, at = rows[left], (at[left] + 1) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each digest, -1 if it is absent."""
        mask = len(self.slot) - 1
        at = (h >> self.shift).astype(np.int64)
        rows = self.slot[at]
        open_ = np.flatnonzero((rows >= 0) & (self.keys[rows] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            rows[open_] = r = self.slot[at[open_]]
            open_ = open_[(r >= 0) & (self.keys[r] != h[open_])]
        return rows

    def _grow(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if need > len(have):
            more = np.zeros(max(need, 2 * len(have)), have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)

    def add(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Entries of absent, distinct digests; their ids stand in ``flat``, one entry's after the other's."""
        n, used = self.n + len(h), int(self.start[self.n])
        for name, need in (("keys", n), ("size", n), ("again", n), ("start", n + 1), ("flat", used + len(flat))):
            self._grow(name, need)
        self.keys[self.n : n], self.size[self.n : n], self.again[self.n : n] = h, size, False
        self.start[self.n + 1 : n + 1] = used + np.cumsum(size)
        self.flat[used : used + len(flat)] = flat
        rows = np.arange(self.n, n, dtype=np.int32)
        self.n = n
        if 2 * n > len(self.slot):
            self._place(1 << (4 * n - 1).bit_length())
        else:
            self._insert(rows)

    def mark(self, rows: np.ndarray) -> None:
        self.again[rows] = True

    def make_room(self, more: int) -> bool:
        """Whether entries had to go for ``more`` new ones: rows found before are void then."""
        if not self.n or (self.n + more <= self.most and self.start[self.n] <= 8 * self.most):
            return False
        rows = np.flatnonzero(self.again[: self.n] & (self.size[: self.n] <= LONG))[: self.most // 2]
        h, flat, size = self.keys[rows], gathered(self.flat, self.start[rows], self.size[rows]), self.size[rows]
        self._empty(1 << 12)
        self.add(h, flat, size)
        return True

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows side by side, and how many each has."""
        size = self.size[rows].astype(np.int64)
        return gathered(self.flat, self.start[rows], size), size
