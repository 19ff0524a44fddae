"""A candidate corpus: documents read, typed, chunked and written as artifacts, verified before it appears under its name.

A folder holds ``extracted`` and ``chunks`` (JSON, a folder per document), their manifests, ``integrity`` (a hash of every
file) and a READY mark. It is built beside its name and renamed when all of it has been verified.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, chunking, integrity
from . import docx, extract, inventory

META = "source_path string, source_name string, source_sha256 string, doc_id string, index_code string, display_title string, version string, effective_date string, approval_date string, approval_order string, declared_pages int"
BLOCK = "pos: int, block_id: string, kind: string, text: string, source_kind: string, section_path: array<string>, section_labels: array<string>, heading_number: string, item_number: string, item_marker: string, appendix_number: string, appendix_title: string, heading_level: int, source_story: string, source_parts: array<string>, source_locations: array<string>, source_occurrences: int"
EXTRACTED = f"doc_id string, source_name string, metadata struct<{META.replace(' string', ': string').replace(' int', ': int')}>, block_count bigint, blocks array<struct<{BLOCK}>>"
CHUNKED = "doc_id string, source_name string, chunk_count bigint, chunks array<struct<" + ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ", 1) for c in chunking.SCHEMA.split(", "))) + ">>"


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blocks, segments) of Word files: metadata, typed blocks with supplemental ones, partitioned segments.

    All are by doc_id; a file that can't be read gives a document without one, and its error.
    """
    raw, segments = docx.read_blocks(files), inventory.partition(docx.read_segments(files))
    typed = extract.typed_blocks(raw)
    blocks = typed.unionByName(inventory.supplemental(segments, typed), allowMissingColumns=True)
    hashed = files.select("path", F.sha2("content", 256).alias("source_sha256"))
    documents = hashed.join(extract.metadata(raw), "path", "left").join(raw.where("error is not null").select("path", F.col("error").alias("read_error")).distinct(), "path", "left")
    documents = documents.withColumns({"source_path": F.col("path"), "source_name": F.coalesce("source_name", F.element_at(F.split("path", "/"), -1))})
    ids = documents.select("path", "doc_id")
    return documents, blocks.join(ids, "path"), segments.join(ids, "path")


def chunked(documents: DataFrame, blocks: DataFrame, most: int = chunking.MAX_CHARS, language: str = "en") -> DataFrame:
    meta = documents.select("doc_id", *(c for _, c in chunking.METADATA if c in documents.columns and c != "doc_id"))
    return chunking.chunk_blocks(blocks, most, meta, "doc_id", language)


def _folded(rows: DataFrame, order: str, name: str, schema: str) -> DataFrame:
    """(doc_id, <name>_count, <name>s): the rows of each document in order."""
    want = [c.split(":")[0].strip() for c in schema.split(", ") if ":" in c]
    cols = [(F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in ((x.split(":")[0].strip(), x.split(":", 1)[1].strip()) for x in schema.split(", ")) if c in want]
    held = rows.select("doc_id", F.struct(*cols).alias("r"))
    return held.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"{name}_count"), F.array_sort(F.collect_list("r"), lambda a, b: (a[order] - b[order]).cast("int")).alias(f"{name}s"))


def write_artifacts(documents: DataFrame, blocks: DataFrame, chunks: DataFrame, root: str) -> None:
    """JSON artifacts, a folder per document, and their manifests."""
    meta = F.struct(*(F.col(c) if c in documents.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in META.split(", "))))
    docs = documents.where("doc_id is not null").select("doc_id", "source_name", meta.alias("metadata"))
    whole = docs.join(_folded(blocks, "pos", "block", BLOCK), "doc_id", "left").na.fill(0, ["block_count"])
    pieces = ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ", 1) for c in chunking.SCHEMA.split(", ")))
    cut = docs.select("doc_id", "source_name").join(_folded(chunks, "ordinal", "chunk", pieces), "doc_id", "left").na.fill(0, ["chunk_count"])
    slug = tx.slug(F.col("doc_id"))
    for name, df in (("extracted", whole), ("chunks", cut)):
        df.withColumn("artifact", slug).write.partitionBy("artifact").json(f"{root}/{name}")
    spark = documents.sparkSession
    for name, count in (("extracted", "block_count"), ("chunks", "chunk_count")):
        read_artifacts(spark, f"{root}/{name}", name).select("path", "doc_id", "source_name", count).coalesce(1).write.json(f"{root}/{name}_manifest")


def read_artifacts(spark: SparkSession, path: str, kind: str = "extracted") -> DataFrame:
    """The artifacts below a folder with their relative path, what they say and hold, and ``error`` where they are no JSON."""
    schema = EXTRACTED if kind == "extracted" else CHUNKED
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)
    rel = F.substring_index(F.url_decode(F.regexp_replace("_metadata.file_path", r"\\+", "%2B")), path.split("//")[-1].rstrip("/") + "/", -1)
    held = "blocks" if kind == "extracted" else "chunks"
    return rows.select(rel.alias("path"), *(c for c in rows.columns if c != "_corrupt"), F.greatest(F.size(held), F.lit(0)).cast("bigint").alias("rows"), F.when(F.col("_corrupt").isNotNull(), "no valid JSON").alias("error"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """A manifest that is a JSON array of objects, or a line each, and how many entries are none."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", str(path.endswith(".json"))).json(path)
    bad = rows.where("_corrupt is not null").select(*rows.columns).count()
    return rows.where("_corrupt is null").drop("_corrupt"), bad


def validate(documents: DataFrame, blocks: DataFrame, chunks: DataFrame, expected: int | None = None) -> dict[str, int]:
    """Totals of a candidate; raises ValueError with the first thing that is wrong with it."""
    n = documents.count()
    if n == 0:
        raise ValueError("there are no documents")
    if expected is not None and n != expected:
        raise ValueError(f"{n} documents, not {expected}")
    counts = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("block_count")), chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    if "block_count" not in documents.columns:
        documents = documents.join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left").na.fill(0, ["block_count", "chunk_count"])
    found = audit.union(audit.match_documents(documents, chunks.select("doc_id", "source_name").distinct()), audit.document_findings(documents, blocks, chunks))
    wrong = found.where("level = 'error'")
    if wrong.limit(1).count():
        raise ValueError(audit.first_failure(wrong))
    told = blocks.where("trim(text) != ''").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).first()
    return {"documents": n, "substantive_blocks": told.n, "chunks": chunks.count(), "characters": told.c or 0}


def build(spark: SparkSession, folder: str, out: str, expected: int | None = None, most: int = chunking.MAX_CHARS, language: str = "en") -> dict:
    """Builds a candidate of the Word files below ``folder`` at ``out``; returns its mark.

    ``out`` must be empty or missing. Whatever goes wrong, what was written so far goes too.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(out).getFileSystem(hadoop)
    if fs.exists(path(out)):
        if len(fs.listStatus(path(out))):
            raise ValueError(f"{out} is not empty")
        fs.delete(path(out), False)
    staging = f"{out.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        documents, blocks, _ = extracted(docx.discover(spark, folder))
        bad = documents.where("read_error is not null or doc_id is null").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].source_path}: {bad[0].read_error or 'no doc_id'}")
        write_artifacts(documents, blocks, chunked(documents, blocks, most, language), staging)
        docs, made, cut = load(spark, staging)  # what is verified is what was written
        totals = validate(docs, made, cut, expected)
        files = integrity.hashes(spark, folder, "source_docx")
        for name, kind in (("extracted", "extracted_json"), ("chunks", "chunk_json"), ("extracted_manifest", "extraction_manifest"), ("chunks_manifest", "chunk_manifest")):
            files = files.union(integrity.hashes(spark, f"{staging}/{name}", kind))
        files.coalesce(1).write.json(f"{staging}/integrity")
        held = spark.read.schema("kind string, path string, sha256 string").json(f"{staging}/integrity")
        mark = {"schema_version": 1, "state": "READY", "source_root": folder, "max_chars": most, "digest": integrity.digest(held), **totals}
        stream = fs.create(path(f"{staging}/READY.json"))
        stream.write(bytearray(json.dumps(mark, ensure_ascii=False).encode()))
        stream.close()
        if not fs.rename(path(staging), path(out)):
            raise ValueError(f"{staging} can't be renamed")
        return mark
    except Exception:
        fs.delete(path(staging), True)
        raise


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blocks, chunks) of a candidate's artifacts."""
    whole, cut = read_artifacts(spark, f"{root}/extracted"), read_artifacts(spark, f"{root}/chunks", "chunks")
    documents = whole.select("doc_id", "source_name", "metadata.source_path", "metadata.source_sha256", "metadata.index_code", "metadata.display_title", "metadata.version", "block_count").join(cut.select("doc_id", "chunk_count"), "doc_id", "left")
    return documents, whole.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*"), cut.select(F.explode("chunks").alias("c")).select("c.*")


def mark(spark: SparkSession, root: str) -> dict:
    """The READY mark of a candidate; raises ValueError if there is none or it says nothing valid."""
    rows = spark.read.text(f"{root}/READY.json", wholetext=True).collect() if _exists(spark, f"{root}/READY.json") else []
    if not rows:
        raise ValueError(f"{root} has no mark")
    try:
        got = json.loads(rows[0][0])
    except ValueError as e:
        raise ValueError("the mark is no JSON") from e
    if not isinstance(got, dict) or got.get("schema_version") != 1 or got.get("state") not in ("READY", "AUDITED") or not all(isinstance(got.get(k), int) for k in ("documents", "substantive_blocks", "chunks", "characters")):
        raise ValueError("the mark says nothing valid")
    return got


def _exists(spark: SparkSession, name: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def verify(spark: SparkSession, root: str) -> DataFrame:
    """(kind, path, problem): every file of a candidate, and every source, that isn't the one that its mark was made for.

    Raises ValueError if the integrity manifest itself isn't.
    """
    ready = mark(spark, root)
    held = spark.read.schema("kind string, path string, sha256 string").json(f"{root}/integrity")
    if integrity.digest(held) != ready["digest"]:
        raise ValueError("the integrity manifest is not that of the mark")
    now = integrity.hashes(spark, ready["source_root"], "source_docx")
    for name, kind in (("extracted", "extracted_json"), ("chunks", "chunk_json"), ("extracted_manifest", "extraction_manifest"), ("chunks_manifest", "chunk_manifest")):
        now = now.union(integrity.hashes(spark, f"{root}/{name}", kind))
    return integrity.differences(held, now.where("path not like '%.crc'"))


def certify(spark: SparkSession, root: str) -> dict:
    """Audits a candidate against its sources and marks it AUDITED; raises ValueError at the first error or change."""
    ready = mark(spark, root)
    changed = verify(spark, root).limit(1).collect()
    if changed:
        raise ValueError(f"{changed[0].path}: {changed[0].problem}")
    found = corpus_audit(spark, ready["source_root"], root)
    done = ready | integrity.certify(spark.read.schema("kind string, path string, sha256 string").json(f"{root}/integrity"), found)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/READY.json")
    stream = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs_path, True)
    stream.write(bytearray(json.dumps(done, ensure_ascii=False).encode()))
    stream.close()
    return done


def corpus_audit(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """All findings about a candidate and its sources: files against extractions against chunks, rules inside documents, text
    that is missing, and artifacts that a fresh run would write otherwise."""
    files = docx.discover(spark, folder)
    fresh_docs, fresh_blocks, segments = extracted(files)
    docs, blocks, chunks = load(spark, root)
    sources = files.select(F.element_at(F.split("path", "/"), -1).alias("source_name"))
    bad = fresh_docs.where("read_error is not null")
    by_path = fresh_docs.select("path", "doc_id")
    seen = inventory.metrics(segments, blocks.join(by_path, "doc_id")).join(by_path, "path").drop("path")
    most = mark(spark, root).get("max_chars", chunking.MAX_CHARS)
    return audit.union(
        audit.match_sources(sources, docs), audit.match_documents(docs, chunks.select("doc_id", "source_name").distinct()),
        audit.finding(bad, "source_docx_unreadable", source="source_name", details=F.col("read_error")),
        audit.document_findings(docs, blocks, chunks, seen),
        audit.snapshot_findings(docs.withColumn("one", F.lit("metadata")), fresh_docs.where("doc_id is not null").withColumn("one", F.lit("metadata")), "one", ["source_name", "index_code", "version", "source_sha256"], "extraction_metadata"),
        audit.snapshot_findings(blocks, fresh_blocks.select(*blocks.columns), "block_id", [c for c in blocks.columns if c not in ("doc_id", "block_id", "pos")], "extraction_blocks"),
        audit.snapshot_findings(chunks, chunked(fresh_docs, fresh_blocks, most), "chunk_id", ["chunk_type", "citation_label", "raw_text", "searchable_text", "block_ids", "section_path", "item_number", "appendix_number", "char_count"], "chunk_snapshot"),
    )


def report(found: DataFrame, path: str) -> None:
    """Writes findings as JSON, a line each."""
    found.coalesce(1).write.mode("overwrite").json(path)


def newest_report(spark: SparkSession, root: str, suffix: str = ".json") -> str | None:
    """The report file below a folder that was written last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.endswith("path", F.lit(suffix)))
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
