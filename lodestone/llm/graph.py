"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SMALL_EDGES = 1_000_000


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] in ``label``, in place; the label of a class is its least member."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for each node of the edges (u, v) of one orderable type; root is the least node of its component.

    Up to ``small`` distinct edges, counted first, are joined in one task (some 50 MB); more of them by alternating
    large-star and small-star steps, whose number grows with the logarithm of the longest chain. Their minima are
    aggregated before the shuffle and joined back, so the edges of a hub are spread by the engine's skew handling.
    Edges with a null end and loops are left out. An empty table gives an empty one. Each round is cut from its lineage
    by a checkpoint, so a lost executor costs no more than the round.
    """
    kind = edges.schema["u"].dataType
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct())
    if now.count() <= small:

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches), names)
            if not len(t):
                return
            nodes = pc.unique(pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]))
            nodes = nodes.take(pc.array_sort_indices(nodes))
            a, b = (pc.index_in(t.column(k), nodes).to_numpy() for k in (0, 1))
            label = np.arange(len(nodes))
            union(label, a, b)
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "root"])

        from pyspark.sql.pandas.types import to_arrow_type

        names = pa.schema([("u", to_arrow_type(kind)), ("v", to_arrow_type(kind))])
        return now.coalesce(1).mapInArrow(join, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct())
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
