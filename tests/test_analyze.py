import pytest
from pyspark.sql import functions as F

from lodestone.functions import analyze


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("electrical", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_english(word, want):
    assert analyze.english(word) == want


@pytest.mark.parametrize(("word", "want"), [("важная", "важн"), ("важнейшими", "важн"), ("вагонов", "вагон"), ("вагоны", "вагон"), ("валентиновичем", "валентинович"), ("политика", "политик"), ("документов", "документ"), ("прекрасная", "прекрасн"), ("ёлка", "елк"), ("бежавшая", "бежа"), ("доступность", "доступн")])
def test_russian(word, want):
    assert analyze.russian(word) == want


def test_lexemes(spark):
    got = spark.createDataFrame([("The cats и документы",), (None,)], "t string").select(analyze.analyze(F.col("t")).alias("x")).collect()
    assert [(x.lexeme, x.pos) for x in got[0].x] == [("cat", 2), ("документ", 4)] and got[1].x == []
