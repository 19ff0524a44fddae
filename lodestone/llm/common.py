"""Plumbing shared by the corpus operators: Arrow maps over rows, written scratch tables, row identity."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

_tables: dict[str, list[tuple[SparkSession, str]]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a private one in local mode; elsewhere an error,
    as executors on other machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables; Spark drops it when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, owner: str = "", compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder, for tables that hold texts; see ``drop_written``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _tables.setdefault(owner, []).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(owner: str) -> None:
    """Deletes the tables of ``owner``; call it only when no result that reads them is still needed."""
    for spark, path in _tables.pop(owner, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results have been written: it does so for those that the driver
    has collected as garbage, by itself only every half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def tidy() -> None:
    """Hands memory that is free back to the system; Python workers are reused by tasks that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def append(df: DataFrame, column: str, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[tuple[str, T.DataType]], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and those that ``make`` computes from slices of about 1 MB of ``column``."""
    src = df if keep is None else df.select(*dict.fromkeys([*keep, column]))
    out = [c for c in src.columns if keep is None or c in keep]
    schema = T.StructType([src.schema[c] for c in out] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.byte_slices(batch, column):
                new = make(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in out] + [new[n] for n, _ in fields], names=[*out, *(n for n, _ in fields)])
        tidy()

    return src.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], flush: int = 4_000_000) -> Iterator[pa.Table]:
    """Tables of about ``flush`` bytes that hold all rows of each group, from batches sorted by the keys."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.nbytes for t in held) > flush:
            t = pa.concat_tables(held).combine_chunks()
            same = np.ones(len(t), bool)
            for k in keys:
                c = t.column(k).to_numpy()
                same &= c == c[-1]
            done = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group begins
            if done:
                yield t.slice(0, done)
            held = [t.slice(done)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def row_id(doc_id: str = "doc_id", text: str = "text"):
    """64-bit identity of a row by id and text; equal rows share it, and a null differs from an empty text."""
    c = lambda name: F.col(f"`{name}`")
    return F.xxhash64(c(doc_id), c(text), c(doc_id).isNull(), c(text).isNull())
