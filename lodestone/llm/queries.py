"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fertility, hilbert, langid, mpeg, ngram_join, packing, resample, toxicity
from . import repeats as repeats_


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents with their fertility measures."""
    out = fertility.assess(_table(spark, sf_dir, "documents"))
    return out.filter(out.reject.isNull()).drop("reject")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on weak labels calls toxic."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).where("flagged").drop("flagged")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class that word 3-gram sets with a Jaccard similarity of at least 0.5 tie them to."""
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive d as (
  select distinct doc_id, text from documents where doc_id is not null and text is not null
), t as (
  select *, row_number() over () as k from (select text, min(doc_id) as low, count(*) as copies from d group by text)
), w as (
  select k, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from t
), s as (
  select k, unnest(list_distinct(case when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end)) as g
  from w where len(ws) > 0
), c as (
  select k, count(*) as n from s group by k
), p as (
  select a.k as a, b.k as b, count(*) as m from s a join s b on a.g = b.g and a.k != b.k group by all
), e as (
  select a, b from p join c x on x.k = a join c y on y.k = b where m >= 0.5 * (x.n + y.n - m)
), r(a, b) as (
  select distinct a, a from e union select r.a, e.b from r join e on e.a = r.b
), q as (
  select r.a as k, min(low) as class_id from r join t on t.k = r.b group by r.a
), l as (
  select a as k, count(*) as links from e group by a
), z as (
  select k from c
)
select d.doc_id, case when z.k is null then d.doc_id else coalesce(class_id, low) end as class_id,
  cast(case when z.k is null then 1 else copies end as bigint) as copies, cast(coalesce(links, 0) as bigint) as links
from d join t using (text) left join z on z.k = t.k left join q on q.k = t.k left join l on l.k = t.k
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents with their language and its calibrated probability."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).where("accepted").drop("accepted")


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in runs along the Hilbert curve over length, language and source."""
    return hilbert.shard(_table(spark, sf_dir, "documents"))


OP5_SQL = hilbert.sql("documents", ["doc_id", "text", "lang", "source", "n_chars"])


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, tables, checksums, exact durations and frame offsets of a stream for every page, made from its markup."""
    pages = _table(spark, sf_dir, "pages")
    return mpeg.parse(mpeg.from_text(pages, "page_id", "url", "html"), "page_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 tokens over all documents."""
    return packing.pack_tokens(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op6_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of 85 % of all documents that looks like those that are labelled good."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample.resample(_table(spark, sf_dir, "documents"), good)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places at which maximal repeats of at least 50 words begin, with the longest one and the intervals that tell all
    occurrences of each."""
    return repeats_.repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fertility, op2_toxicity, op3_ngram_join, op4_langid, op5_hilbert, op6_resample, op7_mpeg_audio, op8_packing, op9_bpe, op10_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op5_hilbert": OP5_SQL}
