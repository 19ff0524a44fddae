"""Pre-token units of Arrow text columns, and caches of what tokenizers make of them.

A *unit* is a run of ASCII white space and the non-white bytes after it. Cutting a text there never changes what a
byte-level BPE with the usual public pre-token pattern returns, so tokens of a text are the tokens of its units.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from . import textkit as tk

LONG = 256
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def units_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (n + 1, the last one the end) of all units, and per text the index of its first unit (rows + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[raw]
    begin = np.zeros(n + 1, dtype=bool)
    begin[1:n] = space[1:] & ~space[:-1]
    begin[off] = True
    begin[n] = True
    start = np.flatnonzero(begin)
    return start, np.searchsorted(start, off)


class UnitCache:
    """Maps units to runs of ids. ``encode`` takes a list of unit byte strings and returns a list of id lists.

    Known units are kept in sorted arrays of hashes; when more than ``limit`` are known all are forgotten, which costs
    time only.
    """

    def __init__(self, encode, limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def lookup(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per unit its run in ``self.ids``: (from, length)."""
        if len(start) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = tk.span_hash(raw, start[:-1], start[1:])
        for i in np.flatnonzero(np.diff(start) >= LONG).tolist():
            # polynomials modulo 2**64 have known collisions from 1,024 bytes on
            h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : start[i + 1]].tobytes(), digest_size=8).digest(), "big")
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self.clear()
        pos = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = pos < len(self.keys)
        known[inside] = self.keys[pos[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            got = self.encode([data[a:b] for a, b in zip(start[at[new]].tolist(), start[at[new] + 1].tolist())])
            size = np.fromiter(map(len, got), np.int64, len(got))
            base = len(self.first) - 1
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
            flat = np.fromiter((i for g in got for i in g), np.int32, int(size.sum()))
            self.ids = np.concatenate([self.ids, flat])
            where = np.searchsorted(self.keys, uniq[new])
            self.keys = np.insert(self.keys, where, uniq[new])
            self.slot = np.insert(self.slot, where, base + np.arange(len(new)))
            pos = np.searchsorted(self.keys, uniq)
        slot = self.slot[pos]
        return self.first[slot][inverse], (self.first[slot + 1] - self.first[slot])[inverse]


def ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i] + size[i]] of all i, one after the other."""
    total = int(size.sum())
    if total == 0:
        return values[:0]
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return values[shift + np.arange(total)]


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    return col
