import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("a b\r\n\n\nc", "a b\nc"), ("  ", ""), (None, None)])
def test_normalize_block(spark, given, want):
    assert one(spark, tx.normalize_block(F.lit(given).cast("string"))) == want


def test_normalizers_and_slug(spark):
    assert one(spark, tx.normalize_paragraphs(F.lit("a\n\n\n\nb"))) == "a\n\nb"
    assert one(spark, tx.normalize_space(F.lit(" a \n\t b "))) == "a b"
    assert one(spark, tx.slug(F.lit("  ИНДЕКС 1.0 / A"))) == "индекс-1-0-a"
    assert one(spark, tx.slug(F.lit("!!"))) == "document"
    assert one(spark, tx.words(F.lit("Ёлка, x1"))) == ["ёлка", "x1"]


def test_truncation_counts_characters(spark):
    got = one(spark, tx.middle_truncate(F.lit("я" * 100), 30))
    assert len(got) == 30 and got.startswith("я" * 10 + " [...] ")
    assert one(spark, tx.middle_truncate(F.lit("short"), 30)) == "short"


def test_ngram_count(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, tx.ngram_count(arr("a", "a", "a"), arr("a", "a"))) == 2
    assert one(spark, tx.ngram_count(arr("a"), arr("a", "b"))) == 0
    assert one(spark, tx.ngram_count(arr("a"), arr())) == 0


def test_similarity(spark):
    assert one(spark, tx.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, tx.similarity(F.lit(""), F.lit(""))) == 0


@pytest.mark.parametrize(
    ("given", "want"),
    [(" 2.1 ", ("bare", "2.1", None)), ("Приложение № 4", ("appendix", "4", None)), ("пункт 2.3", ("item", "2.3", None)), ("раздел 2.3", ("section", "2.3", None)), ("приложение № 3, пункт 2", ("item", "2", "3")), ("пункт 2 приложения № 3", ("item", "2", "3")), ("[2]", (None, None, None)), ("пункт [2]", ("item", "2", None)), ("Приложение к политике доступа", (None, None, None)), (" ", (None, None, None)), ("item 2.3 of appendix 4", ("item", "2.3", "4"))],
)
def test_reference(spark, given, want):
    assert tuple(one(spark, tx.reference(F.lit(given)))) == want


def test_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 4, 9, 14, 40, 90, 400, 1994, 3999, 4000)], "n int").select(tx.roman(F.col("n")).alias("r")).collect()
    assert [r.r for r in rows] == ["0", "I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX", "4000"]
    rows = spark.createDataFrame([(n,) for n in (0, 1, 26, 27, 702, 703)], "n int").select(tx.letters(F.col("n")).alias("r")).collect()
    assert [r.r for r in rows] == ["0", "a", "z", "aa", "zz", "aaa"]
    assert [one(spark, tx.plural(F.lit(n))) for n in (1, 3, 5, 11, 21, 112)] == ["документ", "документа", "документов", "документов", "документ", "документов"]
    assert [one(spark, tx.ordinal(F.lit(w))) for w in ("первый", "second", "7", "0", "много")] == [1, 2, 7, None, None]


def test_citations(spark):
    assert one(spark, tx.citations(F.lit("[2] [9] [1] [2]"), 5)) == [2, 1]


def test_cosine(spark):
    assert one(spark, vx.cosine(vx.literal([1, 0]), vx.literal([1, 1]))) == pytest.approx(2**-0.5)
    assert one(spark, vx.cosine(vx.literal([0, 0]), vx.literal([1, 1]))) is None
    assert one(spark, vx.cosine(vx.literal([1]), vx.literal([1, 1]))) is None
