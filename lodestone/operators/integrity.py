"""Integrity manifests: hashes of files, their binding to sources, and the audit gate."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("source_docx", "extracted_json", "chunk_json", "extraction_manifest", "chunk_manifest")


def hashes(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(kind, path, sha256) of all files below a folder; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), root, -1)
    return files.select(F.lit(kind).alias("kind"), rel.alias("path"), F.sha2("content", 256).alias("sha256"))


def differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, path, problem): missing, unexpected and changed files, and entries that a manifest repeats."""
    twice = manifest.groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "path", F.lit("repeated").alias("problem"))
    a = manifest.select("kind", "path", F.col("sha256").alias("a"), F.lit(1).alias("in_a")).dropDuplicates(["kind", "path"])
    both = a.join(found.select("kind", "path", F.col("sha256").alias("b"), F.lit(1).alias("in_b")), ["kind", "path"], "full")
    problem = F.when(F.col("in_a").isNull(), "unexpected").when(F.col("in_b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("kind", "path", problem.alias("problem")).where("problem is not null").union(twice)


def unbound(bindings: DataFrame, kinds: tuple[str, ...] = ("extracted_json", "chunk_json")) -> DataFrame:
    """(source, counts) of sources that the artifacts of some kind do not name exactly once. bindings: source, kind."""
    counts = bindings.groupBy("source").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    return counts.where(" or ".join(f"{k} != 1" for k in kinds))


def digest(manifest: DataFrame) -> str:
    """One hash of a manifest, whatever the order of its rows: a hash over 256 hashes of parts."""
    row = F.concat_ws("\0", "kind", "path", "sha256")
    part = F.pmod(F.xxhash64("kind", "path"), F.lit(256))
    rows = manifest.groupBy(part.alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("h")).orderBy("p").collect()
    return hashlib.sha256(json.dumps([tuple(r) for r in rows]).encode()).hexdigest()


def certify(manifest: DataFrame, issues: DataFrame) -> dict:
    """The mark of an audited corpus; raises ValueError if the audit has errors."""
    errors = issues.where("level = 'error'").count()
    if errors:
        raise ValueError(f"the audit has {errors} errors")
    return {"state": "AUDITED", "digest": digest(manifest), "warnings": issues.where("level = 'warning'").count()}


def verify(mark: dict, manifest: DataFrame) -> None:
    """Raises ValueError unless the mark is of an audited corpus and of this manifest."""
    if mark.get("state") != "AUDITED" or mark.get("digest") != digest(manifest):
        raise ValueError("the corpus is not the one that was audited")
