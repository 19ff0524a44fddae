"""Quality classifier by importance resampling: the sample looks like the target text.

Two hashed n-gram models, one of target and one of raw text, count the tokens (split at white space) and pairs of
neighbouring tokens of whole documents in 2**16 buckets, over all documents. A document's log weight is the sum over
its n-grams of log p_target - log p_raw (add-one smoothing). The sample of k documents without replacement takes the k
largest values of log weight + Gumbel noise; the noise comes from a hash of the row and a seed. The k-th value is
found exactly by narrowing histograms.

Target texts are the documents that ``labels`` calls good; raw text is everything.

Defined cases: null and empty texts have log weight 0. Very long texts count with all their n-grams. Rows that tie at
the cut, as repeated rows may, all stay. doc_id may have any type.
Without target rows all weights are 0 and the sample is uniform. Null ids never join a label. Labels that repeat an id
count once. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkit as tk
from . import units as U

BITS, FRACTION, SEED, BINS, BROADCAST_IDS = 16, 0.85, 11, 4096, 1_000_000


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens and token pairs, and the text of each."""
    raw, off = tk.string_buffers(col)
    start, first = U.units_of(raw, off)
    if len(start) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = start[:-1].copy()
    while True:  # past the white space in front
        more = (begin < start[1:]) & U.SPACE[raw[np.minimum(begin, len(raw) - 1)]]
        if not more.any():
            break
        begin += more
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    some = begin < start[1:]
    h, row = tk.span_hash(raw, begin[some], start[1:][some]), row[some]
    pair = tk.mix64(h[:-1] * tk._P + h[1:])
    same = row[:-1] == row[1:]
    ids = np.concatenate([h, pair[same]]) >> np.uint64(64 - BITS)
    return ids.astype(np.int64), np.concatenate([row, row[:-1][same]])


def models(docs: DataFrame, doc_id: str, text: str, good: DataFrame) -> np.ndarray:
    """log p_target - log p_raw per bucket. ``good``: ids of target documents."""
    n = 1 << BITS
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("txt"))
    ids = good.select(F.col(good.columns[0]).alias("id"), F.lit(True).alias("good")).distinct()
    # a checked size, some 60 bytes an id: ids of more documents than BROADCAST_IDS are joined by a shuffle
    ids = F.broadcast(ids) if good.count() <= BROADCAST_IDS else ids
    marked = rows.join(ids, "id", "left").select("txt", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n), np.int64)
        for batch in batches:
            for part in tk.byte_slices(batch, "txt"):
                ids, row = grams(U.text_column(part, "txt"))
                flag = part.column(1).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, bool)
                total[0] += np.bincount(ids, minlength=n)
                total[1] += np.bincount(ids[flag], minlength=n)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["b", "raw", "target"])

    got = marked.mapInArrow(count, "b bigint, raw bigint, target bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    total = np.ones((2, n))
    at = got.column("b").to_numpy()
    total[0, at] += got.column("raw").to_numpy()
    total[1, at] += got.column("target").to_numpy()
    if total[1].sum() == n:
        return np.zeros(n)
    return np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column, exactly; -inf if there are fewer. NaN must not occur."""
    x = F.col(column)
    rows, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if k > (rows or 0):
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        bin_ = F.least(F.floor((x - low) / width), F.lit(BINS - 1))
        inside = df.where((x >= low) & (x <= high))
        seen = sorted(inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: -r.b)
        for r in seen:
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
    if low == high:
        return low
    values = sorted((r[0] for r in df.where((x >= low) & (x <= high)).select(x).collect()), reverse=True)
    return values[k - above - 1]


def resample(docs: DataFrame, good: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of the sampled documents; k is ``fraction`` of all rows, rounded."""
    ratio = models(docs, doc_id, text, good)

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, row = grams(U.text_column(part, text))
        return {"log_weight": pa.array(np.bincount(row, ratio[ids], part.num_rows))}

    h = common.fresh(docs, "h")
    noise = docs.withColumn(h, F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))).select(f"`{doc_id}`", f"`{text}`", h)
    weighed = common.append(noise, text, make, [("log_weight", T.DoubleType())], [doc_id, h])
    unit = (F.shiftrightunsigned(F.col(h), 11) + 0.5) / float(1 << 53)
    keyed = common.cut(weighed.select(F.col(f"`{doc_id}`"), "log_weight", (F.col("log_weight") - F.log(-F.log(unit))).alias("gumbel_key")))
    k = round(fraction * keyed.count())
    return keyed.where(F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k))
