"""Versioned tables: upserts, replacement of documents, generations of a corpus, tables in buckets, layout and migration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def upsert(stored: DataFrame, batch: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """``stored`` with the rows of ``batch`` over those of the same key; the highest version of a batch counts."""
    new = batch
    if version:
        new = batch.withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("k_ = 1").drop("k_")
    return stored.join(batch.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def replace_documents(stored: DataFrame, batch: DataFrame, doc: str) -> DataFrame:
    """``stored`` with all rows of each document in ``batch`` replaced by those of the batch."""
    return upsert(stored, batch, doc)


def embedding_profile(chunks: DataFrame, model: str = "embedding_model", embedding: str = "embedding") -> DataFrame:
    return chunks.groupBy(F.col(model).alias("model"), F.size(embedding).alias("dimension")).agg(F.count(F.lit(1)).alias("chunks"))


def check_profile(chunks: DataFrame, model: str, dimension: int) -> None:
    """Raises ValueError unless all chunks have vectors of one model and dimension, the expected ones."""
    rows = embedding_profile(chunks).limit(3).collect()
    if not rows:
        raise ValueError("the index is empty")
    if any(not (r.model or "").strip() for r in rows):
        raise ValueError("chunks without an embedding model")
    if len({r.model for r in rows}) > 1:
        raise ValueError("vectors of several models")
    if len({r.dimension for r in rows}) > 1:
        raise ValueError("vectors of several dimensions")
    if (rows[0].model, rows[0].dimension) != (model, dimension):
        raise ValueError(f"the index holds {rows[0].model}/{rows[0].dimension}, not {model}/{dimension}")


DOCUMENTS = "doc_id string not null, source_name string not null, index_code string, document_title string, version string, metadata string, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string not null, doc_id string not null, source_name string not null, index_code string, document_title string, version string, chunk_type string, citation_label string, raw_text string, searchable_text string, block_ids array<string>, section_path array<string>, section_labels array<string>, section_title string, subsection_title string, item_number string, heading_number string, appendix_number string, appendix_title string, char_count int, embedding_model string, embedding array<float>, metadata string, created_at timestamp, updated_at timestamp"


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` in the columns of a schema, additively migrated: a column that is missing is null, an array or a needed text
    empty, and others are cast; columns that the schema doesn't have go."""
    out = []
    for f in T._parse_datatype_string(schema).fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType) and f.name != "embedding":
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif not f.nullable:
            c = F.coalesce(c, F.lit("").cast(f.dataType))
        out.append(c.alias(f.name))
    return rows.select(*out)


def cascade(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks of documents that are still there."""
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi")


def counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents and chunks."""
    return documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


class _Pointer:
    """A file that is replaced by a rename, so readers see the old or the new content."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.path = lambda p: self.jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        if not self.fs.exists(self.path(f"{self.root}/CURRENT")):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def point(self, content: str) -> None:
        fresh = self.path(f"{self.root}/CURRENT.{uuid.uuid4().hex}")
        out = self.fs.create(fresh)
        out.write(bytearray(content.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fresh, self.path(f"{self.root}/CURRENT"), options)

    def locked(self):
        """A lock file while a writer is at work; another writer gets an error."""
        return _Lock(self)


class _Lock:
    def __init__(self, pointer: _Pointer):
        self.fs, self.file = pointer.fs, pointer.path(f"{pointer.root}/LOCK")

    def __enter__(self) -> None:
        try:
            self.fs.create(self.file, False).close()  # fails if it is there
        except Exception as e:
            if self.fs.exists(self.file):
                raise ValueError("another writer is at work") from e
            raise

    def __exit__(self, *_: object) -> None:
        self.fs.delete(self.file, False)


class Generations(_Pointer):
    """Whole-corpus versions in folders, and a pointer that is renamed in place: readers see one or the other."""

    def publish(self, tables: dict[str, DataFrame], expected: dict[str, int] | None = None, keep: int = 2) -> str:
        """Writes a generation, counts it again, and points to it; all but the ``keep`` newest ones go.

        A table that isn't as long as ``expected`` says, or whose files hold another number of rows than was written, is an
        error: then the pointer stays, and what was written goes.
        """
        name = uuid.uuid4().hex
        with self.locked():
            before = self.current()
            try:
                for table, df in tables.items():
                    path = f"{self.root}/{name}/{table}"
                    df.write.parquet(path)
                    n = self.spark.read.parquet(path).count()
                    if n != (expected or {}).get(table, n):
                        raise ValueError(f"{table} has {n} rows, not {expected[table]}")
            except Exception:
                self.fs.delete(self.path(f"{self.root}/{name}"), True)
                raise
            self.point(name)
            self._sweep({name, before}, keep)
        return name

    def _sweep(self, in_use: set, keep: int) -> None:
        folders = sorted((s for s in self.fs.listStatus(self.path(self.root)) if s.isDirectory()), key=lambda s: -s.getModificationTime())
        kept = 0
        for s in folders:
            old = s.getPath().getName()
            kept += 1
            if old not in in_use and kept > keep:
                self.fs.delete(s.getPath(), True)

    def read(self, table: str) -> DataFrame:
        name = self.current()
        if name is None:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")


class Buckets(_Pointer):
    """A table in buckets by a hash of its key; a batch rewrites only the buckets that it touches. The pointer holds the
    folder of every bucket."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        super().__init__(spark, root)
        self.key, self.buckets = key, buckets

    def folders(self) -> dict[str, str]:
        now = self.current()
        return json.loads(now) if now else {}

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None if there is nothing."""
        paths = [p for b, p in self.folders().items() if only is None or int(b) in only]
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in paths)) if paths else None

    def merge(self, batch: DataFrame, version: str) -> list[int]:
        """Puts the newest version of each key of a batch over the stored one unless that is newer; returns the buckets."""
        bucket = F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets))
        with self.locked():
            touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most ``buckets``
            if not touched:
                return []
            have = self.read(touched)
            every = batch if have is None else have.unionByName(batch, allowMissingColumns=True)
            newest = every.groupBy(self.key).agg(F.max_by(F.struct(*every.columns), F.struct(F.col(version), F.xxhash64(*every.columns))).alias("r")).select("r.*")
            name = uuid.uuid4().hex
            newest.withColumn("bucket_", bucket).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.root}/{name}")
            self.point(json.dumps(self.folders() | {str(b): f"{name}/bucket_={b}" for b in touched}))
        return touched
