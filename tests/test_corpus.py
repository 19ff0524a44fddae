"""Word files to blocks, chunks, candidates and audits."""

import json
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, chunking, embedding, store
from lodestone.sources import candidate, docx, extract, inventory

from .test_docx_stream import NUMBERING, para

FOOT = "<w:footnotes NS><w:footnote w:type='separator' w:id='0'><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote w:id='2'><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:footnote><w:footnote w:id='9'><w:p><w:r><w:t>orphan</w:t></w:r></w:p></w:footnote></w:footnotes>"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/header" Target="header1.xml"/><Relationship Id="r2" Type="x/header" Target="../../out.xml"/><Relationship Id="r3" Type="x/footer" Target="http://x/y" TargetMode="External"/><Relationship Id="r4" Type="x/footer" Target="/word/footer1.xml"/></Relationships>'


def policy(note="a note", index="TEST-1.0", extra=""):
    paragraphs = [para(f"ИНДЕКС НД: {index}"), para("ПОЛИТИКА ДОСТУПА"), para("ООО «Ромашка»"), para("Содержание"), para("1 Общие положения 3"), para("1 Общие положения"), para("1.1 Назначение"), para("1.1.1 Документ нужен всем."), para("а) один"), para("б) два"),
                  "<w:p><w:r><w:t>С примечанием</w:t></w:r><w:r><w:footnoteReference w:id='2'/></w:r></w:p>", extra, para("Приложение 1"), para("Форма"), para("1 Поле"), "<w:sectPr><w:headerReference r:id='r1'/><w:footerReference r:id='r4'/></w:sectPr>"]
    head = "<w:hdr NS><w:p><w:r><w:t>Для служебного пользования</w:t></w:r></w:p></w:hdr>"
    foot = "<w:ftr NS><w:p><w:r><w:t>Страница 1 из 9</w:t></w:r></w:p></w:ftr>"
    return docx.package(paragraphs, extra={"word/footnotes.xml": FOOT.format(note), "word/_rels/document.xml.rels": RELS, "word/header1.xml": head, "word/footer1.xml": foot})


def files(spark, *contents):
    return spark.createDataFrame([(f"dir/f{k}.docx", c) for k, c in enumerate(contents)], "path string, content binary")


def test_visible_text():
    box = "<mc:AlternateContent xmlns:mc='http://schemas.openxmlformats.org/markup-compatibility/2006'><mc:Choice><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent>"
    p = f"<w:p><w:r><w:t>seen</w:t></w:r><w:r><w:rPr><w:webHidden/></w:rPr><w:t>no</w:t></w:r><w:r><w:rPr><w:vanish w:val='off'/></w:rPr><w:t xml:space='preserve'> too</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r>{box}</w:r></w:p>"
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr><w:p><w:r><w:t>both</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>outer</w:t></w:r></w:p>{inner}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    data = docx.package([p, table])
    assert [b[3] for b in docx.raw_blocks(data)] == ["seen too", "both | outer inner", "both | x"]
    assert [(s[3], s[5]) for s in docx.segments(data)] == [("paragraph", "seen too"), ("textbox", "box"), ("table", "both"), ("table", "outer"), ("table", "inner"), ("table", "x")]


def test_unreadable_files_are_rows(spark):
    bad = docx.package(["<w:p><w:pPr><w:numPr><w:ilvl w:val='x'/><w:numId w:val='1'/></w:numPr></w:pPr><w:r><w:t>a</w:t></w:r></w:p>"], NUMBERING)
    rows = docx.read_blocks(files(spark, bad, b"", policy())).collect()
    assert {r.path for r in rows if r.error} == {"dir/f0.docx", "dir/f1.docx"} and any(r.text == "1.1 Назначение" for r in rows)
    assert {r.path for r in docx.read_segments(files(spark, b"no", policy())).where("error is not null").collect()} == {"dir/f0.docx"}


def test_upload_and_guards(spark):
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", b"\0" * (2 << 20))
    assert docx.guard(big.getvalue()) == "shrinks too well" and docx.guard(policy()) is None
    assert docx.guard(policy(), members=2) == "too many members" and docx.guard(policy(), expanded=10) == "expands too far" and docx.guard(b"x") == "not a package"
    rows = [("a%20b/Te%20xt.TXT", "﻿hello ".encode(), None), ("x.docx", policy(), None), ("y.bin", b"z", None), ("z.md", b"\xff", None), ("w.txt", b"", None), ("v.txt", b"  ", None), ("u", b"plain", "text/plain; charset=utf-8"), ("t.docx", big.getvalue(), None), ("s.txt", b"12345678901", None)]
    got = {r.path: r for r in docx.upload(spark.createDataFrame(rows, "path string, content binary, content_type string"), 10_000_000).collect()}
    assert (got["a%20b/Te%20xt.TXT"].file_name, got["a%20b/Te%20xt.TXT"].text, got["a%20b/Te%20xt.TXT"].parser) == ("Te xt.TXT", "hello", "text")
    assert "1.1 Назначение" in got["x.docx"].text and got["u"].text == "plain"
    assert [got[k].error for k in ("y.bin", "z.md", "w.txt", "v.txt", "t.docx")] == ["unsupported", "invalid: UnicodeDecodeError", "empty", "invalid: no text", "invalid: shrinks too well"]
    few = docx.upload(spark.createDataFrame(rows[-1:], "path string, content binary, content_type string"), 10).first()
    assert few.error == "too large" and few.text is None


def test_locate(spark):
    have = spark.createDataFrame([("/a/One.docx", b"1"), ("/b/one.DOCX", b"2"), ("/b/two.docx", policy())], "path string, content binary")
    import hashlib

    docs = spark.createDataFrame([("x", "/b/one.DOCX", "one.docx", ""), ("y", "/gone/one.docx", "ONE.docx", ""), ("z", None, "two.docx", hashlib.sha256(policy()).hexdigest()), ("n", None, "no.docx", "")], "doc_id string, source_path string, source_name string, source_sha256 string")
    got = docx.locate(docs, have)
    assert {r.doc_id: r.path for r in got.collect()} == {"x": "/b/one.DOCX", "y": "/a/One.docx", "z": "/b/two.docx"}
    text = {r.doc_id: r.text for r in docx.source_text(got, docs).collect()}
    assert "Назначение" in text["z"] and text["x"] is text["n"] is None


def test_partition_and_supplemental(spark):
    f = files(spark, policy(extra="<w:p><w:r><w:t>Дважды сказано</w:t></w:r><w:r><w:txbxContent><w:p><w:r><w:t>в рамке</w:t></w:r></w:p></w:txbxContent></w:r></w:p>"))
    segments = inventory.partition(docx.read_segments(f))
    ignored = {r.text for r in segments.where("ignored").collect()}
    assert ignored == {"Содержание", "1 Общие положения 3", "Страница 1 из 9"}
    assert "orphan" not in {r.text for r in segments.collect()}
    blocks = extract.typed_blocks(docx.read_blocks(f))
    extra = {(r.source_story, r.text, r.source_occurrences) for r in inventory.supplemental(segments, blocks).collect()}
    assert extra == {("header", "Для служебного пользования", 1), ("footnote", "a note", 1), ("body", "в рамке", 1)}
    whole = blocks.unionByName(inventory.supplemental(segments, blocks), allowMissingColumns=True)
    m = inventory.metrics(segments, whole).first()
    assert m.coverage == 1.0 and m.missing_segments == 0
    m = inventory.metrics(segments, blocks).first()
    assert m.coverage < 1 and m.critical == 2 and "рамке" in m.missing_tokens
    fewer = blocks.where("text not like 'С примечанием%'")
    assert ("body", "С примечанием", 1) in {(r.source_story, r.text, r.source_occurrences) for r in inventory.supplemental(segments, fewer).collect()}
    assert {(r.story, r.required, r.ignored) for r in inventory.counts(segments).where("story = 'footer'").collect()} == {("footer", 0, 1)}


def test_page_counters(spark):
    rows = [("12", False, True), ("Стр. 3 из 9", False, True), ("3 / 9", False, True), ("Page IV", True, True), ("Page IV", False, False), ("Раздел 4", True, False), ("", True, False)]
    df = spark.createDataFrame(rows, "t string, d boolean, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", inventory.is_page_counter(F.col("t"), F.col("d"))).collect())


def test_metadata_and_chunks(spark):
    f = files(spark, policy())
    meta = extract.metadata(docx.read_blocks(f)).first()
    assert (meta.index_code, meta.version, meta.display_title, meta.document_kind, meta.doc_id) == ("TEST-1.0", "1.0", "ПОЛИТИКА ДОСТУПА", "политика", "test-1-0") and "Ромашка" in meta.organization
    documents, blocks, _ = candidate.extracted(f)
    got = candidate.chunked(documents, blocks, language="ru").orderBy("ordinal").collect()
    assert got[0].chunk_type == "metadata" and "Индекс: TEST-1.0" in got[0].raw_text
    item = next(r for r in got if r.item_number == "1.1.1")
    assert item.raw_text == "1.1.1 Документ нужен всем.\nа) один\nб) два\nС примечанием"
    assert item.citation_label == "ПОЛИТИКА ДОСТУПА (версия 1.0), раздел 1 Общие положения / 1.1 Назначение, пункт 1.1.1"
    assert item.searchable_text.startswith("Документ: ПОЛИТИКА ДОСТУПА\nИндекс: TEST-1.0\nВерсия: 1.0\nРаздел: 1 Общие положения / 1.1 Назначение\nПункт: 1.1.1\n\n1.1.1")
    form = next(r for r in got if r.chunk_type == "appendix_item")
    assert form.citation_label.endswith("приложение № 1 Форма, пункт 1") and form.appendix_title == "Форма"
    assert {r.citation_label.split(", ")[-1] for r in got if r.chunk_type == "supplemental"} == {"верхний колонтитул", "сноска"}
    assert [r.chunk_id.split("-")[-2] for r in got] == [f"{k:04d}" for k in range(1, len(got) + 1)]
    assert chunking.block_text({"kind": "letter_bullet", "text": "x", "item_marker": "а"}) == "а) x" and chunking.block_text({"kind": "list_item", "text": "x", "item_marker": "•"}) == "• x"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    source = base / "docs"
    source.mkdir()
    (source / "a.docx").write_bytes(policy())
    (source / "b.docx").write_bytes(policy("another", "TEST-2.0"))
    out = str(base / "candidate")
    return source, out, candidate.build(spark, f"file:{source}", f"file:{out}", expected=2)


def test_candidate(spark, built, tmp_path):
    source, out, mark = built
    assert mark["documents"] == 2 and mark["state"] == "READY" and candidate.mark(spark, f"file:{out}") == mark
    assert candidate.verify(spark, f"file:{out}").count() == 0
    with pytest.raises(ValueError, match="not empty"):
        candidate.build(spark, f"file:{source}", f"file:{out}")
    with pytest.raises(ValueError, match="not 3"):
        candidate.build(spark, f"file:{source}", f"file:{tmp_path}/three", expected=3)
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="no mark"):
        candidate.mark(spark, f"file:{tmp_path}")
    found = candidate.corpus_audit(spark, f"file:{source}", f"file:{out}")
    assert [r for r in found.collect() if r.level == "error"] == []
    docs, blocks, chunks = candidate.load(spark, f"file:{out}")
    assert (docs.count(), chunks.count()) == (2, mark["chunks"])
    sums = audit.totals(docs, blocks, chunks, inventory.metrics(*(x[1] for x in ((0, inventory.partition(docx.read_segments(docx.discover(spark, f"file:{source}")))), (1, blocks.withColumn("path", F.col("doc_id"))))))).first()
    assert sums.documents == 2 and sums.supplemental_blocks == 4
    data = json.loads((next(iter(sorted((source.parent / "candidate" / "extracted").glob("*/*.json"))))).read_text().splitlines()[0])
    assert data["block_count"] == len(data["blocks"])


def test_tampering_is_found(spark, built, tmp_path):
    import shutil

    source, out, _ = built
    copy, docs = tmp_path / "c", tmp_path / "docs"
    shutil.copytree(out, copy)
    file = next(iter(sorted((copy / "chunks").glob("*/*.json"))))
    file.write_text(file.read_text().replace("Документ нужен", "Документ не нужен"))
    for crc in copy.rglob(".*.crc"):
        crc.unlink()
    assert {(r.kind, r.problem) for r in candidate.verify(spark, f"file:{copy}").collect()} == {("chunk_json", "changed")}
    with pytest.raises(ValueError, match="changed"):
        candidate.certify(spark, f"file:{copy}")
    codes = {r.code for r in candidate.corpus_audit(spark, f"file:{source}", f"file:{copy}").where("level = 'error'").collect()}
    assert "chunk_snapshot_changed" in codes and "chunk_char_count_mismatch" in codes
    shutil.copytree(source, docs)
    (docs / "b.docx").rename(docs / "c.docx")
    codes = {r.code for r in candidate.corpus_audit(spark, f"file:{docs}", f"file:{out}").collect()}
    assert {"source_not_extracted", "extracted_source_missing"} <= codes


def test_one_finding_for_each_defect(spark):
    docs = spark.createDataFrame([("a", "a.docx", 2, 2), ("b", "b.docx", 1, 0), ("c", "c.docx", 0, 0)], "doc_id string, source_name string, block_count long, chunk_count long")
    blocks = spark.createDataFrame([("a", "1", "paragraph", "alpha beta"), ("a", "1", "paragraph", "gamma"), ("a", "3", "paragraph", "delta"), ("b", "x", "paragraph", " ")], "doc_id string, block_id string, kind string, text string")
    chunks = spark.createDataFrame([("a", "k", "section_text", "alpha beta", "alpha beta", ["1"], 10), ("a", "k", "section_text", "", "", [], 3), ("a", "m", "section_text", "x", "x", ["9"], 1)], "doc_id string, chunk_id string, chunk_type string, raw_text string, searchable_text string, block_ids array<string>, char_count int")
    got = audit.document_findings(docs, blocks, chunks)
    codes = {(r.code, r.doc_id) for r in got.collect()}
    assert codes == {("extracted_block_count_mismatch", "a"), ("extraction_blocks_empty", "c"), ("indexable_blocks_missing", "b"), ("chunk_count_mismatch", "a"), ("metadata_chunk_count_invalid", "a"), ("chunk_block_ids_missing", "a"), ("empty_chunk_text", "a"), ("chunk_char_count_mismatch", "a"), ("duplicate_chunk_id", "a"), ("extraction_duplicate_block_id", "a"), ("chunk_blocks_missing", "a"), ("chunk_blocks_unknown", "a"), ("chunk_text_coverage_low", "a")}
    assert audit.first_failure(got).startswith("error: chunk_block_ids_missing, a") and audit.first_failure(got.limit(0)) == "no findings"
    bad = spark.createDataFrame([("A ", "x"), ("a", "y"), (None, "z"), ("q", "q")], "doc_id string, source_name string")
    cut = spark.createDataFrame([("a", "y"), ("b", "b")], "doc_id string, source_name string")
    assert {r.code for r in audit.match_documents(bad, cut).collect()} == {"extraction_doc_id_missing", "duplicate_doc_id", "extracted_document_not_chunked", "chunked_document_missing_extraction"}
    manifest = spark.createDataFrame([("p", "a", "a.docx", 2), ("q", "b", "b.docx", 1), ("q", "b", "b.docx", 1), ("r", "c", "c.docx", 1)], "path string, doc_id string, source_name string, block_count long")
    held = spark.createDataFrame([("p", "a", "A.docx", 3, 2, None), ("q", "x", "b.docx", 1, 1, None), ("s", "d", "d.docx", 0, 0, None), ("r", None, None, None, 0, "no valid JSON")], "path string, doc_id string, source_name string, block_count long, rows long, error string")
    assert {r.code for r in audit.manifest_findings(manifest, held, "extraction", "block_count").collect()} == {"extraction_artifact_orphaned", "extraction_artifact_unreadable", "extraction_manifest_path_repeated", "extraction_manifest_doc_id_mismatch", "extraction_manifest_source_mismatch", "extraction_count_mismatch"}
    limits, wrong = audit.max_chars(spark.createDataFrame([("p", "a", "a", "900"), ("q", "b", "b", "x"), ("r", "c", "c", None)], "path string, doc_id string, source_name string, max_chars string"))
    assert {r.path: r.max_chars for r in limits.collect()} == {"p": 900, "q": 1800, "r": 1800} and wrong.count() == 1


def test_store_findings_and_layout(spark):
    docs = spark.createDataFrame([("a", "t"), ("b", "u")], "doc_id string, document_title string")
    chunks = spark.createDataFrame([("a", "1", "x", [1.0, 2.0], "m"), ("a", "2", "y", None, "m"), ("b", "3", "z", [1.0], " ")], "doc_id string, chunk_id string, raw_text string, embedding array<float>, embedding_model string")
    want_docs = spark.createDataFrame([("a", "T"), ("c", "v")], "doc_id string, document_title string")
    want = spark.createDataFrame([("a", "1", "x"), ("a", "2", "Y"), ("c", "4", "w")], "doc_id string, chunk_id string, raw_text string")
    got = {(r.code, r.doc_id) for r in audit.store_findings(docs, chunks, want_docs, want, ["document_title"], ["raw_text"]).collect()}
    assert got == {("store_document_missing", "c"), ("store_document_stale", "b"), ("store_document_changed", "a"), ("store_chunk_missing", "c"), ("store_chunk_stale", "b"), ("store_chunk_changed", "a"), ("store_embedding_missing", "a"), ("store_embedding_profiles_mixed", None), ("store_embedding_model_blank", "b")}
    old = store.conform(chunks, store.CHUNKS).where("chunk_id = '1'").first()
    assert old.block_ids == [] and old.source_name == "" and old.item_number is None and old.embedding == [1.0, 2.0]
    assert [r.chunk_id for r in store.cascade(chunks, docs.where("doc_id = 'b'")).collect()] == ["3"] and tuple(store.counts(docs, chunks).first()) == (2, 3)


def test_publish_counts(spark, tmp_path):
    g = store.Generations(spark, f"file://{tmp_path}")
    df = spark.range(5)
    first = g.publish({"t": df}, {"t": 5})
    with pytest.raises(ValueError, match="5 rows, not 6"):
        g.publish({"t": df}, {"t": 6})
    assert g.current() == first and g.read("t").count() == 5
    names = [g.publish({"t": df}) for _ in range(3)]
    assert {p.name for p in tmp_path.iterdir() if p.is_dir()} <= {first, *names} and len([p for p in tmp_path.iterdir() if p.is_dir()]) <= 3
    with g.locked(), pytest.raises(ValueError, match="another writer"):
        g.publish({"t": df})


def test_embedding(spark):
    chunks = spark.createDataFrame([(k, f"word{k} same") for k in range(70)] + [(99, None)], "id int, searchable_text string")
    got = embedding.embed(chunks, lambda: embedding.hashed(16), "hash", 16, batch=8)
    assert got.count() == 71 and all(len(r.embedding) == 16 and r.embedding_model == "hash" for r in got.collect())
    with pytest.raises(Exception, match="not 16"):
        embedding.embed(chunks, lambda: embedding.hashed(8), "hash", 16).collect()
    with pytest.raises(Exception, match="0 vectors for"):
        embedding.embed(chunks, lambda: lambda texts: [], "hash", 16).collect()
    with pytest.raises(ValueError):
        embedding.embed(chunks, lambda: embedding.hashed(8), " ", 8)
