"""Packing by first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt at random (a hash of the row, its number among equal ones, and a seed) to groups of about
``group_docs``; each group is packed by itself, so the work is even and no step sees the whole corpus. The size of a document is the number of its tokens in
the byte-level BPE vocabulary of ``folder`` (``pack_tokens``, the same tokens as those of ``bpe.encode``), or without a
folder its number of UTF-8 bytes, ``unit`` of them to a token, rounded up; documents over the capacity are first cut in full pieces and a rest, so whole
texts are packed. Inside a group pieces go by decreasing size (ties by id, then piece) into the first bin with room,
which a tournament tree (a complete binary tree that holds the largest free capacity below each node) finds in
logarithmic time.

The result has a row per bin. Starts and lengths are in tokens of the document's own numbering.

Defined cases: null and empty texts have no size and are in no bin. Rows with a null id are packed with a null in the
list. Repeated rows are packed each, and spread over the groups. Very long texts are counted whole and cut in pieces.
doc_id may have any orderable type. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vocab
from . import textkit as tk
from . import units as U

CAPACITY, UNIT, GROUP_DOCS, SEED = 2048, 4, 4000, 17

_caches: dict[str, U.UnitCache] = {}


def count_tokens(col: pa.Array, folder: str = vocab.DEFAULT_FOLDER) -> pa.Array:
    """Tokens of each text of an Arrow string column."""
    if folder not in _caches:
        _caches[folder] = U.UnitCache(vocab.byte_bpe(folder).encode)
    raw, off = tk.string_buffers(col)
    start, first = U.units_of(raw, off)
    _, size = _caches[folder].lookup(raw, start)
    return pa.array(tk.segment_sum(size, first).astype(np.int64))


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size by first fit in the given order; no size may exceed the capacity."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out.append(node - leaves)
        free[node] -= size
        node >>= 1
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
    return out


def pack_group(group: int, ids: np.ndarray, valid: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """Bins of one group; ``ids`` counts where ``valid``."""
    pieces = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = part * capacity
    length = np.minimum(sizes[doc] - start, capacity)
    rank = np.zeros(len(ids), np.int64)
    rank[valid] = np.unique(ids[valid], return_inverse=True)[1]
    order = np.lexsort((part, rank[doc], ~valid[doc], -length))
    doc, start, length = doc[order], start[order], length[order]
    bins = np.array(first_fit(length.tolist(), capacity), np.int64)
    by = np.argsort(bins, kind="stable")
    cut = np.flatnonzero(np.diff(bins[by])) + 1
    split = lambda x: np.split(x[by], cut) if len(by) else []
    names = [[ids[d] if valid[d] else None for d in ds] for ds in split(doc)]
    lengths = split(length)
    return pd.DataFrame({"group": group, "bin": np.arange(len(names), dtype=np.int32), "used": [int(x.sum()) for x in lengths], "doc_ids": names, "starts": [x.tolist() for x in split(start)], "lengths": [x.tolist() for x in lengths]})


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, unit: int = UNIT, group_docs: int = GROUP_DOCS, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """(group, bin, used, doc_ids, starts, lengths): a row per bin."""
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    kind = docs.schema[doc_id].dataType
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(i.alias("id"), t.alias("txt"), F.xxhash64(t).alias("h"))
    if folder is None:
        rows = rows.withColumn("size", F.ceil(F.octet_length("txt") / unit).cast("bigint"))
    else:
        rows = common.append(rows, "txt", lambda part: {"size": count_tokens(U.text_column(part, "txt"), folder)}, [("size", T.LongType())], ["id", "h"])
    # equal rows are numbered, or one row said very often would be one group
    alike = rows.where("size > 0").groupBy("id", "h", "size").agg(F.count(F.lit(1)).alias("n"))
    each = alike.select("id", "size", "h", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    dealt = each.select("id", "size", F.pmod(F.xxhash64(F.lit(seed), "id", "h", "k"), F.lit(groups)).alias("group"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        valid = pdf["id"].notna().to_numpy()
        ids = np.empty(len(pdf), object)
        ids[valid] = pdf["id"][valid].map(int).tolist() if whole else pdf["id"][valid].tolist()
        bins = pack_group(int(key[0]), ids, valid, pdf["size"].to_numpy(np.int64), capacity)
        if whole:
            bins["doc_ids"] = [[None if d is None else str(d) for d in ds] for ds in bins["doc_ids"]]
        return bins

    whole = isinstance(kind, T.IntegralType)
    # integers come with their nulls as floats, which 2**53 and more don't survive: they travel as text
    dealt = dealt.withColumn("id", F.col("id").cast("string")) if whole else dealt
    fields = [("group", T.LongType()), ("bin", T.IntegerType()), ("used", T.LongType()), ("doc_ids", T.ArrayType(T.StringType() if whole else kind)), ("starts", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType()))]
    out = dealt.groupBy("group").applyInPandas(run, T.StructType([T.StructField(*f) for f in fields]))
    return out.withColumn("doc_ids", F.col("doc_ids").cast(T.ArrayType(kind))) if whole else out


def pack_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = SEED, folder: str = vocab.DEFAULT_FOLDER) -> DataFrame:
    """``pack`` by the tokens of a vocabulary; starts and lengths are places in the ids of ``bpe.encode``."""
    return pack(docs, doc_id, text, capacity, group_docs=group_docs, seed=seed, folder=folder)
