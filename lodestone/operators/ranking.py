"""Relevance of documents from the scores of their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signal(c: Column, floor: float, full: float) -> Column:
    """How far a score is above its floor, 0 to 1."""
    return F.when(c <= floor, 0.0).otherwise(F.least(F.lit(1.0), (c - floor) / (full - floor)))


def finite(c: Column) -> Column:
    """The number that a column holds, 0 for nulls, texts that are none, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def rank(c: Column, missing: int = 999999) -> Column:
    """A rank of at least 1 and below ``missing``; everything else is ``missing``."""
    x = c.try_cast("int")
    return F.when((x >= 1) & (x < missing), x).otherwise(missing)


def rank_documents(rows: DataFrame, limit: int = 20, min_vector: float = 0.45, min_text: float = 0.01, text_full: float = 0.15, min_score: float = 0.05, cutoff: float = 0.55, competitive: float = 0.25, position: str = "position", by: str | None = None) -> DataFrame:
    """Documents by relevance. ``rows``: doc_id, vector_score, text_score, hybrid_score and the position of each hit;
    source_name, document_title, index_code, version, vector_rank and text_rank are used where they are there.

    A document is known by the first of doc_id, source_name and document_title that isn't empty; rows with none are
    ignored. Its names are the first ones that aren't empty, by position. It stays if a signal is above its floor, its
    score reaches ``min_score`` and either the score or a competitive signal is at least ``cutoff`` of the best one.
    With a query key ``by`` each query has its own documents, best ones and limit.
    """
    if limit < 1 or not 0 <= cutoff <= 1 or not min_vector < 1 or not min_text < text_full:
        raise ValueError("limit must be positive, the cutoff between 0 and 1, and floors below their full values")
    v, t = finite(F.col("vector_score")), finite(F.col("text_score"))
    named = [c for c in ("doc_id", "source_name", "document_title") if c in rows.columns]
    value = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    key = F.coalesce(*(F.concat(F.lit(f"{c}:"), value(c)) for c in named))
    keys = [by] if by else []
    ranks = {f"{side}_rank": rank(F.col(f"{side}_rank")) if f"{side}_rank" in rows.columns else F.lit(1) for side in ("vector", "text")}
    first = lambda c: F.min_by(F.when(value(c).isNotNull(), F.col(c)), F.when(value(c).isNotNull(), F.col(position))).alias(c)
    docs = rows.withColumn("document_key", key).where("document_key is not null").groupBy(*keys, "document_key").agg(
        *(first(c) for c in ("doc_id", "source_name", "document_title", "index_code", "version") if c in rows.columns),
        F.greatest(F.max(v), F.lit(0.0)).alias("best_vector"),
        F.greatest(F.max(t), F.lit(0.0)).alias("best_text"),
        F.greatest(F.max(finite(F.col("hybrid_score"))), F.lit(0.0)).alias("best_hybrid"),
        *(F.min(r).alias(f"best_{c}") for c, r in ranks.items() if c in rows.columns),
        F.count(F.lit(1)).alias("matched_chunks"),
        F.count_if((v > 0) & (ranks["vector_rank"] < 999999)).alias("vector_matched_chunks"),
        F.count_if((t > 0) & (ranks["text_rank"] < 999999)).alias("text_matched_chunks"),
        F.count_if((v > min_vector) | (t > min_text)).alias("evidence"),
        F.min(position).alias("first_position"),
    )
    docs = docs.withColumns({"v": signal(F.col("best_vector"), min_vector, 1.0), "t": signal(F.col("best_text"), min_text, text_full), "support": F.least(F.lit(1.0), F.log2(F.greatest(F.lit(1), F.col("evidence"))) / 2)})
    docs = docs.withColumn("score", F.least(F.lit(1.0), F.greatest("v", "t") * (1 + 0.06 * F.col("support")) + 0.10 * F.least("v", "t")))
    docs = docs.where(((F.col("best_vector") > min_vector) | (F.col("best_text") > min_text)) & (F.col("score") >= min_score))
    docs = docs.withColumns({c: F.round(c, 8) for c in ("score", "v", "t")})
    best = {c: F.max(c).over(Window.partitionBy(*keys)) for c in ("score", "v", "t")}  # after the aggregate: a row per document
    docs = docs.withColumns({f"best_{c}_": b for c, b in best.items()})
    keep = F.col("score") >= F.col("best_score_") * cutoff
    for c in ("v", "t"):
        keep |= (F.col(f"best_{c}_") >= competitive) & (F.col(c) >= F.col(f"best_{c}_") * cutoff)
    order = (F.desc("score"), F.desc("best_hybrid"), F.desc("best_vector"), F.desc("best_text"), "first_position", "document_key")
    out = docs.where(keep).drop("best_score_", "best_v_", "best_t_", "support")
    if by is None:
        return out.orderBy(*order).limit(limit)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= limit)
