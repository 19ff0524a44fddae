import pytest

from lodestone.operators import answers, integrity
from lodestone.sources import docx, extract


def raw(*texts, **k):
    return [{"pos": i, "text": t, "source_kind": "paragraph", "style": None, "label": None, "bold_ratio": 0.0, **k} for i, t in enumerate(texts)]


def test_fold():
    got = extract.fold(raw("POLICY", "Contents", "1 General .... 3", "1 General", "1.1 Purpose", "1.1.1 It is so and ends with a dot.", "a) letter", "• bullet", "text", "Appendix 4", "Forms", "1 first", "- dash", "rest"))
    assert [(b["kind"], b["section_path"]) for b in got] == [
        ("front_matter", []), ("heading", ["1"]), ("heading", ["1", "1.1"]), ("numbered_paragraph", ["1", "1.1"]), ("letter_bullet", ["1", "1.1"]), ("list_item", ["1", "1.1"]), ("paragraph", ["1", "1.1"]),
        ("appendix_heading", []), ("appendix_title", []), ("appendix_numbered_item", []), ("appendix_bullet", []), ("appendix_paragraph", []),
    ]
    assert got[-1]["appendix_title"] == "Forms" and got[3]["item_number"] == "1.1.1"
    assert len({b["block_id"] for b in got}) == len(got)
    again = extract.fold(raw("1 General", "x", "x", "x"))
    assert [b["block_id"] for b in again] == ["section-1", "paragraph", "paragraph--2", "paragraph--3"]


def test_documents(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(docx.package([p("ИНДЕКС НД: TEST-1.0"), p("ПОЛИТИКА"), p("1 Общие положения"), p("1.1 Назначение")]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    blocks = docx.read_blocks(docx.discover(spark, str(tmp_path)))
    meta = extract.metadata(blocks).collect()
    assert [(m.index_code, m.version, m.doc_id, m.source_name) for m in meta] == [("TEST-1.0", "1.0", "test-1-0", "a.docx")]
    assert [b.kind for b in extract.typed_blocks(blocks).orderBy("pos").collect()] == ["front_matter", "front_matter", "heading", "heading"]
    assert extract.typed_blocks(blocks.limit(0)).count() == 0


def test_integrity(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    (tmp_path / "y").write_bytes(b"2")
    found = integrity.hashes(spark, str(tmp_path), "source_docx")
    rows = {r.path: r.sha256 for r in found.collect()}
    assert set(rows) == {"x", "y"} and integrity.differences(found, found).count() == 0
    other = spark.createDataFrame([("source_docx", "x", rows["x"]), ("source_docx", "x", rows["x"]), ("source_docx", "z", "0")], "kind string, path string, sha256 string")
    assert sorted((r.path, r.problem) for r in integrity.differences(other, found).collect()) == [("x", "repeated"), ("y", "unexpected"), ("z", "missing")]
    none = spark.createDataFrame([], "level string")
    mark = integrity.certify(found, none)
    integrity.verify(mark, found.repartition(5))
    with pytest.raises(ValueError):
        integrity.verify(mark, other)
    with pytest.raises(ValueError):
        integrity.certify(found, spark.createDataFrame([("error",)], "level string"))
    bound = spark.createDataFrame([("a", "extracted_json"), ("a", "chunk_json"), ("b", "chunk_json")], "source string, kind string")
    assert [r.source for r in integrity.unbound(bound).collect()] == ["b"]


def test_answers():
    rows = [{"document_title": "T", "index_code": "I"}, {"source_name": "f.docx"}]
    assert answers.listing(rows) == "Documents: 2\n1. T (I)\n2. f.docx"
    assert answers.listing([], language="ru") == "Ничего не найдено."
    assert answers.with_sources("x [2] [9]", ["a", "b"]).endswith("Sources:\n[2] b")
    assert answers.with_sources("x\nSources:\n[1] a", ["a"]).count("Sources") == 1
    hit = [{"citation_label": "A, 1", "raw_text": "one"}, {"citation_label": "B, 1", "raw_text": "two"}]
    assert answers.section("1", hit, 1) == "one\n\ntwo" and "- A, 1\n- B, 1" in answers.section("1", hit, 2)
    assert answers.section("9", [], 0) == "“9” was not found."
    assert answers.messages("q?", hit)[-1]["content"].endswith("q?")
    assert answers.benchmark_p95([3, 1, 2]) == 3
