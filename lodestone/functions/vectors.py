"""Similarity of embeddings, as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A constant array of doubles."""
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null where the lengths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors and vectors of different lengths."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def text_literal(values: Sequence[float]) -> str:
    """A vector as text, eight significant digits a number."""
    return "[" + ",".join(f"{float(v):.8g}" for v in values) + "]"


def from_text(c: Column) -> Column:
    """The vector that a text literal says."""
    return F.from_json(c, "array<float>")
