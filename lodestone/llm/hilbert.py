"""Sharding along a Hilbert curve, for files that can be pruned by several metadata dimensions.

Dimensions are quantised to ``BITS`` bits by rank: a value's cell is the number of rows with smaller values, scaled to
2**BITS; nulls come first, and equal values share a cell, so hot values take wide ranges. The cells become an index on
the Hilbert curve (Skilling's transform, tabled for all cells). Rows are sorted by index, then id, and cut in runs of
about ``rows_per_run`` units of weight where the index changes; an index with more than that is split evenly by id. A
row weighs one, and one more for each ``unit`` of its ``weight`` column (characters), as long texts lie side by side on
the curve. Each run is contiguous in the result and meant to be a file; ``manifest`` has the least and largest value of
each dimension in every run, which is what a reader prunes by.

The counts have a row per distinct value of a dimension and are sorted and summed by ranges; the driver sees the at
most 2**BITS first values of cells, and the cut table has a row per index (at most 2**(BITS * dims)), so nothing but the
one sort moves documents. Its number of partitions follows the number of runs.

Defined cases: nulls in any dimension, id or text are kept; a null or negative weight is 0. Ties in all dimensions share
an index and go by id. Repeated rows share index and run. doc_id may have any type; what isn't an integer is split by
its hash. Empty and very long texts are rows like others. Empty tables give empty results. All columns of the table are
kept; the new ones get underscores in front where a name is taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

BITS, ROWS_PER_RUN, UNIT, RUNS_PER_TASK = 4, 2000, 4096, 8
DIMENSIONS = ("n_chars", "lang", "source")


def cell(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """The cell of ``column`` as an expression: how many of the (at most 2**bits) first values of cells it reaches."""
    count = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # ranges of values, numbered in order; the rows before a value are those of the ranges before and of its own so far
    ranged = common.cut(count.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("range", F.spark_partition_id()))
    total, before = 0, []
    for r in sorted(ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        before.append((r.range, total))
        total += r.n
    if not total:
        return F.lit(0)
    ahead = F.create_map(*(F.lit(x) for pair in before for x in pair))[F.col("range")]
    own = F.sum("n").over(Window.partitionBy("range").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    cells = ranged.select("value", F.floor((ahead + F.coalesce(own, F.lit(0))) * (1 << bits) / total).cast("int").alias("cell"))
    first = cells.where("value is not null").groupBy("cell").agg(F.min("value").alias("value")).orderBy("cell").collect()
    out: Column = F.lit(0)
    for r in first:
        out = F.when(F.col(f"`{column}`") >= F.lit(r.value), r.cell).otherwise(out)
    return out


def curve(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of ``cells`` (points, dimensions), by Skilling's transform."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    h = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            h = h * 2 + (((c ^ t) >> b) & 1)
    return h


def index(cells: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of int columns in [0, 2**bits), looked up in a constant table of all cells."""
    n = len(cells)
    if n * bits > 16:
        raise ValueError("the table of all cells has 2**(bits * dimensions) entries; 2**16 is the most")
    grid = np.arange(1 << (n * bits))
    table = curve(np.stack([(grid >> (bits * k)) & ((1 << bits) - 1) for k in range(n)], axis=1), bits)
    code: Column = F.lit(0)
    for k, c in enumerate(cells):
        code = code + c * (1 << (bits * k))
    text = ",".join(map(str, table.tolist()))
    return F.get(F.from_json(F.lit(f"[{text}]"), "array<bigint>"), code.cast("int"))


def shard(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", bits: int = BITS, rows_per_run: int = ROWS_PER_RUN, weight: str = "n_chars", unit: int = UNIT) -> DataFrame:
    """``docs`` with ``hilbert`` (index) and ``run``, sorted by both and the id; each run lies in one partition."""
    hilbert, run = common.fresh(docs, "hilbert"), common.fresh(docs, "run")
    now = docs.withColumn(hilbert, index([cell(docs, d, bits) for d in dimensions], bits))
    heavy = F.lit(1) + F.greatest(F.coalesce(F.floor(F.col(f"`{weight}`") / unit), F.lit(0)), F.lit(0)) if weight in docs.columns else F.lit(1)
    h_, n_, first_, parts_ = (common.fresh(now, x) for x in ("h_", "n_", "first_", "parts_"))
    # at most 2**(bits * dimensions) rows whatever the data
    count = common.cut(now.groupBy(F.col(f"`{hilbert}`").alias(h_)).agg(F.sum(heavy).alias(n_)))
    runs = -(-(count.agg(F.sum(n_)).first()[0] or 0) // rows_per_run)
    before = F.coalesce(F.sum(n_).over(Window.orderBy(h_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = count.select(h_, F.floor(before / rows_per_run).alias(first_), F.ceil(F.col(n_) / rows_per_run).alias(parts_))
    out = now.join(F.broadcast(cuts), F.col(f"`{hilbert}`") == F.col(h_), "left")
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    number = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(0)) if whole else F.xxhash64(F.col(f"`{doc_id}`"))
    # the runs of one index follow each other: there is room for 2**20
    out = out.withColumn(run, (F.col(first_) * (1 << 20) + F.when(F.col(parts_) > 1, F.pmod(number, F.col(parts_)) + 1).otherwise(0)).cast("bigint"))
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{hilbert}`"), F.col(f"`{run}`"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs // RUNS_PER_TASK))
    return out.repartitionByRange(parts, F.col(f"`{run}`")).sortWithinPartitions(run, hilbert, doc_id)


def manifest(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, run: str = "run") -> DataFrame:
    """(run, rows, least and largest value of each dimension)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for d in dimensions:
        aggs += [F.min(f"`{d}`").alias(f"min_{d}"), F.max(f"`{d}`").alias(f"max_{d}")]
    return sharded.groupBy(F.col(f"`{run}`").alias("run")).agg(*aggs)


def sql(table: str, columns: list[str], dimensions: tuple[str, ...] = DIMENSIONS, doc_id: str = "doc_id", bits: int = BITS, rows_per_run: int = ROWS_PER_RUN, weight: str = "n_chars", unit: int = UNIT) -> str:
    """DuckDB SQL for the rows of ``shard``."""
    n = len(dimensions)
    ctes, joins = [], []
    for k, d in enumerate(dimensions):
        ctes.append(f"r{k} as (select {d} as v, cast(floor(coalesce(sum(count(*)) over (order by {d} nulls first rows between unbounded preceding and 1 preceding), 0) * {1 << bits} / (select count(*) from {table})) as bigint) as c from {table} group by {d})")
        joins.append(f"join r{k} on r{k}.v is not distinct from t.{d}")
    ctes.append(f"s0 as (select t.*, {', '.join(f'case when t.{d} is null then 0 else r{k}.c end as x{k}' for k, d in enumerate(dimensions))} from {table} t {' '.join(joins)})")
    at = 0

    def step(**new: str) -> None:
        nonlocal at
        ctes.append(f"s{at + 1} as (select * replace ({', '.join(f'{e} as {c}' for c, e in new.items())}) from s{at})")
        at += 1

    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on, t = f"(x{i} & {q}) != 0", f"(xor(x0, x{i}) & {q - 1})"
            new = {"x0": f"case when {on} then xor(x0, {q - 1}) else xor(x0, {t}) end"}
            if i == 0:
                new = {"x0": f"case when {on} then xor(x0, {q - 1}) else x0 end"}
            else:
                new[f"x{i}"] = f"case when {on} then x{i} else xor(x{i}, {t}) end"
            step(**new)
        q >>= 1
    for i in range(1, n):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    t = "0"
    q = 1 << (bits - 1)
    while q > 1:
        t = f"xor({t}, case when (x{n - 1} & {q}) != 0 then {q - 1} else 0 end)"
        q >>= 1
    step(**{f"x{i}": f"xor(x{i}, {t})" for i in range(n)})
    h = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    cols = ", ".join(columns)
    ctes.append(f"h as (select {cols}, cast({h} as bigint) as hilbert, 1 + greatest(coalesce(cast(floor({weight} / {unit}) as bigint), 0), 0) as w_ from s{at})")
    ctes.append(f"k as (select hilbert as h_, cast(floor(coalesce(sum(sum(w_)) over (order by hilbert rows between unbounded preceding and 1 preceding), 0) / {rows_per_run}) as bigint) as f_, cast(ceil(sum(w_) / {rows_per_run}) as bigint) as p_ from h group by hilbert)")
    m = f"coalesce({doc_id}, 0)"
    return f"with {', '.join(ctes)} select {cols}, hilbert, f_ * {1 << 20} + case when p_ > 1 then (({m} % p_) + p_) % p_ + 1 else 0 end as run from h join k on hilbert = h_"
