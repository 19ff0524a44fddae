"""Vectorised text primitives shared by the corpus operators.

Everything works on Arrow string columns as raw UTF-8 bytes, so no Python object is made per word. A *word* is a
maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text; words carry a 64-bit hash.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at a time; bounds the temporaries of a Python worker to a few times eight bytes each.
CHUNK_BYTES = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 100_000)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls have length 0."""
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    dt = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=dt)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into runs of about ``limit`` bytes of ``column``; a longer text stands alone."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of several texts in order. ``row``: index of the text; ``first``: per text, index of its first word."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def lowered(col: pa.Array) -> pa.Array:
    if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    return pc.utf8_lower(col)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for every span at once, by prefix sums of a polynomial modulo 2**64."""
    p, inv = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[end] - sums[start]) * inv[start])


def words_of(col: pa.Array, lower: bool = True) -> Words:
    raw, off = string_buffers(lowered(col) if lower else col)
    n = len(raw)
    # a text end is a boundary: look at "is word" with texts kept apart
    flag = np.zeros(n + 2, dtype=np.int8)
    flag[1:-1] = WORD[raw]
    edge = np.diff(flag)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    if len(inner):
        inner = inner[(flag[inner] == 1) & (flag[inner + 1] == 1)]  # words that run over a text's end are two
        if len(inner):
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(raw, start, end, row, first, span_hash(raw, start, end))


def shingle_hash(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs within a text, and the word index at which each starts."""
    h = words.hash
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = words.row[:m] == words.row[n - 1 :]
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= _P
        acc += h[j : j + m]
    at = np.flatnonzero(ok)
    return mix64(acc[at]), at


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] along axis 0, empty segments 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[first[1:]] - total[first[:-1]]
