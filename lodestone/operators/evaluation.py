"""Golden-set evaluation and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b to four digits, null for an empty denominator."""
    return F.round(F.try_divide(a, b), 4)


def evaluate(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Each case with its observation: matched and expected sources, titles and substrings, and whether it passed.

    cases: id, expected_route, expected_sources, expected_titles, expected_answer, forbidden (arrays), max_latency_ms.
    observations: id, route, sources, titles, answer, latency_ms. Comparison ignores case.
    """
    o = cases.join(observations, "id", "left")
    within = lambda needle, texts: F.exists(texts, lambda t: F.contains(F.lower(t), F.lower(needle)))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    hits = lambda want, got: F.size(F.filter(some(want), lambda n: within(n, some(got))))
    inside = lambda want: F.size(F.filter(some(want), lambda n: F.coalesce(F.contains(F.lower("answer"), F.lower(n)), F.lit(False))))
    o = o.withColumns({"sources_hit": hits("expected_sources", "sources"), "sources_want": F.size(some("expected_sources")), "titles_hit": hits("expected_titles", "titles"), "titles_want": F.size(some("expected_titles")), "answer_hit": inside("expected_answer"), "answer_want": F.size(some("expected_answer")), "forbidden_hit": inside("forbidden")})
    o = o.withColumn("route_ok", F.when(F.col("expected_route").isNotNull(), F.coalesce(F.lower("route") == F.lower("expected_route"), F.lit(False))))
    o = o.withColumn("latency_ok", F.when(F.col("max_latency_ms").isNotNull(), F.coalesce(F.col("latency_ms") <= F.col("max_latency_ms"), F.lit(False))))
    ok = (F.col("sources_hit") == F.col("sources_want")) & (F.col("titles_hit") == F.col("titles_want")) & (F.col("answer_hit") == F.col("answer_want")) & (F.col("forbidden_hit") == 0)
    return o.withColumn("passed", ok & F.coalesce("route_ok", F.lit(True)) & F.coalesce("latency_ok", F.lit(True)))


def summarize(results: DataFrame) -> DataFrame:
    """Cases passed and failed, route accuracy, and micro-averaged recall of sources and titles."""
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), ratio(F.count_if("route_ok"), F.count("route_ok")).alias("route_accuracy"), ratio(F.sum("sources_hit"), F.sum("sources_want")).alias("source_recall"), ratio(F.sum("titles_hit"), F.sum("titles_want")).alias("title_recall"))


def latencies(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, median, nearest-rank 95th percentile and maximum of a column of milliseconds."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"), F.median(value).alias("p50_ms"), F.expr(f"percentile_disc(0.95) within group (order by `{value}`)").alias("p95_ms"), F.max(value).alias("max_ms"))
