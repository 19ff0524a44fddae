from pyspark.sql import functions as F

from lodestone.operators.store import Buckets
from lodestone.sources import docx
from lodestone.streaming import ingest

LEVELS = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for k, f, t in ((0, "decimal", "%1"), (1, "decimal", "%1.%2"), (2, "lowerLetter", "%3)")))
NUMBERING = f'<w:abstractNum w:abstractNumId="0">{LEVELS}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'


def para(text, level=None, style=None):
    num = "" if level is None else f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>'
    sty = "" if style is None else f'<w:pStyle w:val="{style}"/>'
    return f"<w:p><w:pPr>{sty}{num}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_multilevel_numbering_restarts():
    data = docx.package([para("a", 0), para("b", 1), para("c", 1), para("d", 0), para("e", 1), para("f", 2)], NUMBERING)
    assert [b[4] for b in docx.raw_blocks(data)] == ["1", "1.1", "1.2", "2", "2.1", "a)"]


def test_styles_carry_numbers_and_tables_are_rows():
    styles = '<w:style w:styleId="H"><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="I"><w:basedOn w:val="H"/></w:style>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    got = docx.raw_blocks(docx.package([para("a", style="I"), table, para("1.2 typed", style="I")], NUMBERING, styles))
    assert [(b[1], b[3]) for b in got] == [("paragraph", "1.1 a"), ("table_row", "x | y"), ("paragraph", "1.2 typed")]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    notes = "<w:footnotes NS><w:footnote w:type='separator'><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote w:id='2'><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>"
    (tmp_path / "sub" / "a.DOCX").write_bytes(docx.package([para("hello"), "<w:p><w:r><w:footnoteReference w:id='2'/></w:r></w:p>"], extra={"word/footnotes.xml": notes}))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    files = docx.discover(spark, str(tmp_path))
    assert files.count() == 2
    rows = docx.read_blocks(files).collect()
    assert sorted(r.text or "" for r in rows) == ["", "hello"] and sum(r.error is not None for r in rows) == 1
    assert sorted((r.story, r.text) for r in docx.read_segments(files).where("error is null").collect()) == [("body", "hello"), ("footnote", "note")]


def test_numbers():
    assert [docx.number(4, k) for k in ("decimal", "upperRoman", "lowerLetter", "russianLower", "decimalZero")] == ["4", "IV", "d", "г", "04"]


def test_ingest(spark, tmp_path):
    source, root, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    schema = "doc_id int, version int, text string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).write.parquet(source)
    ingest.ingest(spark, source, schema, root, mark, buckets=8).awaitTermination()
    store = Buckets(spark, root, "doc_id", 8)
    before = store.folders()
    spark.createDataFrame([(2, 3, "d"), (1, 1, "old"), (3, 1, "e")], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, root, mark, buckets=8).awaitTermination()
    assert sorted(map(tuple, store.read().select("doc_id", "version", "text").collect())) == [(1, 2, "b"), (2, 3, "d"), (3, 1, "e")]
    old = store.folders()
    touched = store.merge(spark.createDataFrame([(3, 2, "f")], schema), "version")
    assert len(touched) == 1 and {b for b, p in store.folders().items() if old.get(b) != p} == {str(touched[0])} and before
    assert [r.text for r in store.read().where("doc_id = 3").collect()] == ["f"]


def test_windowed_counts(spark):
    events = spark.sql("select timestamp'2024-01-01 00:00:01' as ts, 'a' as event_type union all select timestamp'2024-01-01 00:04:00', 'a' union all select timestamp'2024-01-01 00:06:00', 'a'")
    assert [r.n for r in ingest.windowed_counts(events).orderBy(F.col("start")).collect()] == [2, 1]
