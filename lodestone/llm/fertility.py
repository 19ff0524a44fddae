"""Quality rules by tokeniser fertility: how public vocabularies cope with a text.

Measured per document over its whole text, with a byte-level BPE and a piece vocabulary with byte fallback:
characters per token, characters per piece, share of byte-fallback pieces, and Shannon entropy of the tokens in bits.
A document is rejected when a measure leaves the band of its cell. A cell is a language (the script of the text where
the language is null or empty) and a power of two of the number of tokens, as all measures spread more in short texts.
The band is the median of the cell, over all documents, more or less robust standard deviations (a floor keeps cells
of equal texts open): ``tight`` of them on the side where junk lies (few characters a token or piece, low entropy, many
bytes), ``width`` on the other. ``tight`` was chosen on the labelled rows of even doc_id of sf0.1, as the least quarter
that costs at most 1 % of the clean documents more than ``width`` on both sides. Cells of fewer than ``min_cell`` documents take the band of their language, and those
of small languages the band over everything.

Quartiles are those of the measures rounded down to a grid of 1/1024, with linear interpolation. A value on the edge of
its band is in it.

Defined cases: null texts count as empty and are rejected (``empty``). Very long texts are measured whole. Repeated rows
are each measured and count each. An empty table gives an empty result. Extra columns are left alone, clashing names included. Rows whose doc_id
is null are measured like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vocab
from . import textkit as tk
from . import units as U

MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "token_entropy")
FLOORS = {"chars_per_token": 0.08, "chars_per_piece": 0.08, "byte_share": 0.02, "token_entropy": 0.15}
FIELDS = [("script", T.StringType()), ("n_tokens", T.LongType()), *((m, T.DoubleType()) for m in MEASURES)]
JUNK = {"chars_per_token": -1, "chars_per_piece": -1, "byte_share": 1, "token_entropy": -1}  # the side where it lies
WIDTH, TIGHT, MIN_CELL, BROADCAST_CELLS, GRID = 5.0, 2.75, 50, 100_000, 1024.0

_caches: dict[tuple, U.UnitCache] = {}
_SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "other", "none")


def scripts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text, the index in _SCRIPTS of the script that most of its letters have, judged by UTF-8 lead bytes."""
    table = np.full(256, 7, np.int8)
    table[65:91] = table[97:123] = 0
    table[0xC3:0xCA] = 0
    table[0xCD:0xD0] = 1
    table[0xD0:0xD4] = 2
    table[0xD6:0xDE] = 3
    table[0xE0] = 4
    table[0xE3:0xEE] = 5
    table[[0xCA, 0xCB, 0xCC, 0xD4, 0xD5, 0xDE, 0xDF, 0xE1, 0xE2, 0xEE, 0xEF, *range(0xF0, 0xF8)]] = 6
    kind = table[raw]
    count = np.stack([tk.segment_sum(kind == k, off) for k in range(7)], axis=1)
    return np.where(count.max(axis=1, initial=0) > 0, count.argmax(axis=1) if len(count) else 0, 7)


def _lookup(folder: str, which: str, raw: np.ndarray, start: np.ndarray):
    key = (folder, which)
    if key not in _caches:
        _caches[key] = U.UnitCache((vocab.byte_bpe if which == "b" else vocab.piece_bpe)(folder).encode)
    cache = _caches[key]
    begin, size = cache.lookup(raw, start)
    return cache, begin, size


def measure(col: pa.Array, folder: str = vocab.DEFAULT_FOLDER) -> dict[str, pa.Array]:
    """The measures of an Arrow string column."""
    raw, off = tk.string_buffers(col)
    start, first = U.units_of(raw, off)
    rows = len(off) - 1
    bpe, begin, size = _lookup(folder, "b", raw, start)
    n_tokens = tk.segment_sum(size, first).astype(np.int64)
    ids = U.ragged(bpe.ids, begin, size).astype(np.int64)
    row = np.repeat(np.arange(rows), n_tokens)
    pair, times = np.unique((row << 22) | ids, return_counts=True)
    some = np.maximum(n_tokens, 1)
    entropy = np.log2(some) - np.bincount(pair >> 22, times * np.log2(times), rows) / some
    pieces, begin, size = _lookup(folder, "p", raw, start)
    n_pieces = tk.segment_sum(size, first)
    is_byte = vocab.piece_bpe(folder).is_byte
    total = np.concatenate([[0], np.cumsum(is_byte[pieces.ids])])
    n_bytes = tk.segment_sum(total[begin + size] - total[begin], first)
    chars = tk.segment_sum((raw & 0xC0) != 0x80, off)
    some_pieces = np.maximum(n_pieces, 1)
    return {"script": pa.array(np.array(_SCRIPTS, dtype=object)[scripts(raw, off)], pa.string()), "n_tokens": pa.array(n_tokens), "chars_per_token": pa.array(chars / some), "chars_per_piece": pa.array(chars / some_pieces), "byte_share": pa.array(n_bytes / some_pieces), "token_entropy": pa.array(np.maximum(entropy, 0.0))}


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "", folder: str = vocab.DEFAULT_FOLDER) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns of FIELDS, their names behind ``prefix``."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {prefix + k: v for k, v in measure(U.text_column(part, text), folder).items()}

    return common.append(docs, text, make, [(prefix + n, t) for n, t in FIELDS], keep)


def judge(measured: DataFrame, language: str = "lang", prefix: str = "", width: float = WIDTH, tight: float = TIGHT, min_cell: int = MIN_CELL) -> DataFrame:
    """``measured`` with ``<prefix>reject``: null, or the measure that left its band, or ``empty``.

    The corpus statistics are three grouped aggregates over all documents; they have a row per language and size.
    """
    p = prefix
    c = lambda n: F.col(f"`{p}{n}`")
    lang = F.col(f"`{language}`").cast("string") if language in measured.columns else F.lit(None).cast("string")
    have = measured.withColumns({p + "key": F.when(F.trim(lang) != "", lang).otherwise(F.concat(F.lit("script:"), c("script"))), p + "bin": F.floor(F.log2(F.greatest(c("n_tokens"), F.lit(1)))).cast("int")})
    # histograms on a fixed grid: the same whatever the partitions, and bounded by the range of the measures
    told = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.floor(c(m) * GRID) / GRID).alias("v")) for m in MEASURES))).alias("x")
    hist = common.cut(have.filter(c("n_tokens") > 0).select(c("key").alias("key"), c("bin").alias("bin"), told).groupBy("key", "bin", "x.m", "x.v").agg(F.count(F.lit(1)).alias("n")))
    out = have
    for by, keys in (("0", []), ("1", ["key"]), ("2", ["key", "bin"])):
        quarters = hist.groupBy(*keys, "m", "v").agg(F.sum("n").alias("n")).groupBy(*keys, "m").agg(F.percentile("v", [0.25, 0.5, 0.75], F.col("n")).alias("q"), F.sum("n").alias("n"))
        wide = [F.max("n").alias(f"{p}n{by}"), *(F.max(F.when(F.col("m") == m, F.col("q"))).alias(f"{p}{m}{by}") for m in MEASURES)]
        # a row per language and size: once counted, they are sent to the texts while they are few
        stats = common.cut(quarters.groupBy(*(F.col(k).alias(f"{p}{k}_{by}") for k in keys)).agg(*wide))
        if keys:
            stats = F.broadcast(stats) if stats.count() <= BROADCAST_CELLS else stats
            on = [c(k) == F.col(f"`{p}{k}_{by}`") for k in keys]
            out = out.join(stats, on, "left").drop(*(f"{p}{k}_{by}" for k in keys))
        else:
            out = out.crossJoin(F.broadcast(stats))  # one row
    reject = F.when(c("n_tokens") == 0, F.lit("empty"))
    for m in MEASURES:
        q = F.when(c("n2") >= min_cell, c(m + "2")).when(c("n1") >= min_cell, c(m + "1")).otherwise(c(m + "0"))
        spread = F.greatest((q[2] - q[0]) / 1.349, F.lit(FLOORS[m]))
        off = (c(m) - q[1]) * JUNK[m]
        reject = reject.when((off > tight * spread) | (off < -width * spread), F.lit(m))
    drop = [p + x for x in ("key", "bin")] + [p + m + by for m in ("n", *MEASURES) for by in "012"]
    return out.withColumn(p + "reject", reject).drop(*drop)


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", folder: str = vocab.DEFAULT_FOLDER, **bands) -> DataFrame:
    """(doc_id, lang, measures, reject) of all documents."""
    keep = [doc_id] + [language] * (language in docs.columns)
    measured = common.cut(measures(docs.select(*dict.fromkeys([*keep, text])), text, keep, folder=folder))
    return judge(measured, language, **bands)


def accept(docs: DataFrame, text: str = "text", language: str = "lang", folder: str = vocab.DEFAULT_FOLDER, owner: str = "", **bands) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with just the columns of ``docs``; see ``common.drop_written`` for ``owner``."""
    p = common.fresh(docs, "fertility")
    while any(c.lower().startswith(p) for c in docs.columns):
        p = "_" + p
    rows = common.written(measures(docs, text, prefix=p + "_", folder=folder), owner)
    return judge(rows, language, p + "_", **bands).filter(F.col(f"`{p}_reject`").isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
