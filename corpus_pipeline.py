"""A corpus pipeline of five stages over ``documents``; each reads what the one before it has written.

Stages but the last return the columns of ``documents``:

1. quality rules: documents whose tokeniser fertility leaves its band go;
2. language ID: documents that the language model, trained on the stage's input, rejects go;
3. n-gram Jaccard join: one document of each group of near duplicates stays;
4. suffix-array dedup: of each repeat of at least 50 words the first occurrence stays, the others are cut;
5. packing: bins of 2048 tokens.

No stage can be said in SQL as a whole (public tokenizers, a trained model, first fit), so there is no ORACLE_SQL; the
tests compare the stages with brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, fertility, langid, ngram_join, packing, repeats
from lodestone.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that ``fertility`` rejects.

    Null and empty texts go (``empty``). Very long texts are measured whole. Rows with a null id, and repeated rows, are
    judged each by itself. An empty table gives an empty one; other columns stay as they are, whatever their names.
    """
    ship(spark)
    return fertility.accept(docs, owner="quality_rules")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those whose language ``langid``, trained on them, rejects.

    Null and empty texts and those without letters go; without a labelled row all go. Repeated rows, ties between
    languages, null ids, very long texts, empty tables and other columns: see ``langid``.
    """
    ship(spark)
    common.drop_written("quality_rules")  # what the stage before used is written by now
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of ``ngram_join``: that of the least id, null ids last.

    Null texts and texts without a word all stay. Of repeated rows one stays. A similarity equal to the threshold ties.
    """
    ship(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ``docs``, without the occurrences of repeats of at least 50 words but the first (by id, null ids last).

    Null, empty and short texts stay as they are. A text that is cut to nothing stays as an empty one; ``n_chars`` is
    counted again. Repeated rows are cut alike.
    """
    ship(spark)
    return repeats.cut_repeats(docs, owner="repeated_passages")


def packing_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of ``packing.pack_tokens``: a row per bin.

    Null and empty texts are in none; very long ones in several. Null ids are nulls in the lists; repeated rows are packed
    each; ties go by id.
    """
    ship(spark)
    common.drop_written("repeated_passages")
    return packing.pack_tokens(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing_bins)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written to the shared folder and read again.

    The texts that the last stage reads are packed to bins (ids and places) before this returns, so nothing that is
    written stays but those.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    owner = uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = common.written(out, f"{owner}-{k}") if k < len(STAGES) - 1 else common.cut(out)
        common.drop_written(f"{owner}-{k - 1}")  # its only reader has been written
    return docs
