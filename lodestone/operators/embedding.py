"""Vectors of chunks by an injected embedder, checked, and a deterministic one for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def check(vectors: Sequence[Sequence[float]], count: int, dimension: int) -> None:
    """Raises ValueError unless there are ``count`` finite vectors of the dimension."""
    if len(vectors) != count:
        raise ValueError(f"{len(vectors)} vectors for {count} texts")
    for v in vectors:
        if len(v) != dimension:
            raise ValueError(f"a vector of {len(v)} dimensions, not {dimension}")
        if not np.isfinite(np.asarray(v, float)).all():
            raise ValueError("a vector that isn't finite")


def embed(chunks: DataFrame, make: Callable[[], Embedder], model: str, dimension: int, text: str = "searchable_text", batch: int = 32) -> DataFrame:
    """``chunks`` with embedding and embedding_model. ``make`` builds the embedder once in each worker process; it gets
    ``batch`` texts at a time. Numbers keep eight significant digits."""
    if not model.strip() or not 1 <= dimension <= 4096 or batch < 1:
        raise ValueError("a model name, a dimension of 1 to 4096 and a positive batch are needed")
    rows = chunks.drop("embedding", "embedding_model")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make()
        for part in parts:
            vectors: list[list[float]] = []
            texts = part[text].fillna("").tolist()
            for lo in range(0, len(texts), batch):
                some = texts[lo : lo + batch]
                got = embedder(some)
                check(got, len(some), dimension)
                vectors += [[float(f"{float(x):.8g}") for x in v] for v in got]
            yield part.assign(embedding=vectors, embedding_model=model)

    return rows.mapInPandas(run, f"{fields}, embedding array<float>, embedding_model string")


def hashed(dimension: int) -> Embedder:
    """An embedder without a model: words fall into dimensions by their hash. For tests and offline use."""

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "big") % dimension] += 1 if h[4] & 1 else -1
        out[:, 0] += 1e-6  # no zero vector
        return out.tolist()

    return run
