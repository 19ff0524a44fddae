"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are split into pre-tokens by the public pattern. The first tier is a minimal perfect hash over the vocabulary
(hash and displace: keys go to buckets, and each bucket gets the first seed that sends its keys to free slots, so n
keys fill n slots); a pre-token that is itself a token is resolved by one probe, proven by its stored fingerprint. The
second tier encodes the others: their bytes form a doubly linked list, and a heap yields the pair with the lowest rank,
leftmost first, until no neighbours merge. Each distinct pre-token of a batch is looked up once, and results are
remembered for the life of the worker up to a limit, which saves time only.

Decoding concatenates the bytes of the tokens; it gives back every text exactly.

Defined cases: a null text gives null ids, an empty text no ids. Very long pre-tokens take n log n steps. Repeated rows
are encoded alike; empty tables give empty results; extra columns are ignored. Ids outside the vocabulary raise an
error when decoded.
"""

from __future__ import annotations

import os
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vocab
from . import textkit as tk
from . import units as U

VOCABULARY = "byte_bpe_50k.tiktoken"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; ``find`` gives slots, or -1 for keys that are not in it."""

    def __init__(self, keys: np.ndarray, per_bucket: int = 3):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // per_bucket)
        self.seed = np.zeros(self.buckets, np.uint64)
        self.key = np.zeros(n, np.uint64)
        self.at = np.zeros(n, np.int64)  # slot of each key, in the given order
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        seeds = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-np.diff(edge), kind="stable").tolist():
            mine = order[edge[b] : edge[b + 1]]
            if not len(mine):
                break
            low = np.uint64(0)
            while True:  # 256 seeds at a time
                slots = self._slot(keys[mine][None, :], (seeds + low)[:, None])
                ok = ~taken[slots].any(axis=1)
                if len(mine) > 1:
                    s = np.sort(slots, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(ok.argmax())
                    break
                low += np.uint64(256)
            self.seed[b] = seeds[k] + low
            taken[slots[k]] = True
            self.at[mine] = slots[k]
        self.key[self.at] = keys

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix64(keys ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (tk.mix64(keys + seed * tk._P) % np.uint64(self.size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, self.seed[self._bucket(keys)])
        return np.where(self.key[slot] == keys, slot, -1)


class Coder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        ranks = vocab.read_ranks(path)
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        words = list(ranks)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        keys = tk.span_hash(raw, ends - np.array([len(w) for w in words]), ends)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens share a hash")
        self.hash = PerfectHash(keys)
        self.id_at = np.zeros(len(words), np.int64)
        self.id_at[self.hash.at] = np.array([ranks[w] for w in words])
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(vocab.PATTERN)
        self.pairs: dict[int, int] = {}
        self.memo: dict[bytes, list[int]] = {}
        self.cache = U.UnitCache(self.encode_units)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token by a heap over linked bytes."""
        n = len(data)
        single, pairs, join = self.single, self.pairs, self.join
        if len(pairs) > 1_000_000:
            pairs.clear()
        ids = [single[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        x = ids[0]
        for i in range(1, n):
            y = ids[i]
            key = x << 20 | y
            r = pairs[key] if key in pairs else join(x, y)
            if r >= 0:
                heap.append((r << 40 | i - 1, x, y))
            x = y
        heapify(heap)
        while heap:
            key, a, b = heappop(heap)
            i = key & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged since
            r = key >> 40
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                y = ids[k]
                key = r << 20 | y
                q = pairs[key] if key in pairs else join(r, y)
                if q >= 0:
                    heappush(heap, (q << 40 | i, r, y))
            p = before[i]
            if p >= 0:
                x = ids[p]
                key = x << 20 | r
                q = pairs[key] if key in pairs else join(x, r)
                if q >= 0:
                    heappush(heap, (q << 40 | p, x, r))
        return [x for x in ids if x >= 0]

    def join(self, a: int, b: int) -> int:
        """Rank of the token that two tokens make, -1 if none; remembered."""
        r = self.pairs[a << 20 | b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        """Ids of byte strings that are cut before white space; all distinct pre-tokens go through both tiers once."""
        pieces: list[bytes] = []
        many = []
        for u in units:
            found = [x.encode() for x in self.pattern.findall(u.decode())]
            pieces += found
            many.append(len(found))
        kinds = list(dict.fromkeys(pieces))
        ends = np.cumsum([len(k) for k in kinds]) if kinds else np.zeros(0, np.int64)
        size = np.array([len(k) for k in kinds], np.int64)
        slot = self.hash.find(tk.span_hash(np.frombuffer(b"".join(kinds), np.uint8), ends - size, ends)) if kinds else ends
        whole = self.id_at[slot].tolist() if kinds else []
        ids, memo = {}, self.memo
        if len(memo) > 300_000:
            memo.clear()
        for k, s, w in zip(kinds, slot.tolist(), whole):
            if s >= 0 and self.token[w] == k:
                ids[k] = [w]
            else:
                have = memo.get(k)
                if have is None:
                    have = self.merge(k)
                    if len(k) < 64:
                        memo[k] = have
                ids[k] = have
        out, at = [], 0
        for n in many:
            out.append([i for p in pieces[at : at + n] for i in ids[p]])
            at += n
        return out

    def encode(self, col: pa.Array) -> pa.Array:
        """Ids of an Arrow string column, as lists of int32."""
        raw, off = tk.string_buffers(col)
        start, first = U.units_of(raw, off)
        begin, size = self.cache.lookup(raw, start)
        total = np.concatenate([[0], np.cumsum(size)])[first].astype(np.int32)
        values = pa.array(U.ragged(self.cache.ids, begin, size), pa.int32())
        null = pa.array(col.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(total), values, mask=null) if col.null_count else pa.ListArray.from_arrays(pa.array(total), values)

    def decode(self, col: pa.ListArray) -> pa.Array:
        """Texts of lists of ids."""
        sizes = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = col.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token)):
            raise ValueError("an id is not in the vocabulary")
        ids = ids.astype(np.int64)
        data = U.ragged(self.bytes, self.offset[ids], self.length[ids])
        total = np.concatenate([[0], np.cumsum(self.length[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.large_string()).cast(pa.string())
        import pyarrow.compute as pc

        return pc.if_else(col.is_valid(), out, pa.scalar(None, pa.string())) if col.null_count else out


@lru_cache(maxsize=4)
def coder(folder: str, name: str = VOCABULARY) -> Coder:
    return Coder(os.path.join(folder, name))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = vocab.DEFAULT_FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, restored): ids of whole texts; restored says that decoding gave the text back."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        col = U.text_column(part, text)
        c = coder(folder, name)
        ids = c.encode(col)
        import pyarrow.compute as pc

        return {"n_tokens": pc.cast(ids.value_lengths(), pa.int64()), "ids": ids, "restored": pc.equal(c.decode(ids), col)}

    return common.append(docs, text, make, [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("restored", T.BooleanType())], [doc_id])


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", folder: str = vocab.DEFAULT_FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the text of its column of ids as ``out``."""
    at = encoded.columns
    schema = T.StructType([*(encoded.schema[c] for c in at), T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, coder(folder, name).decode(col)], names=[*at, out])

    return encoded.mapInArrow(run, schema)
