"""What the operators share: table reading, the shared scratch folder and file access from tasks.

Executors see only the folder named by ``spark.checkpoint.dir``, the warehouse and the inputs, so every file that
outlives a task is written below that folder through :mod:`pyarrow.fs`, under a name that depends on the partition
alone. A task that runs again therefore replaces its own file and nothing else.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources import scratch as scratch_folders

#: Characters that separate words: space, and U+0009 to U+000D.
WORD_GAP = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (scratch.root), as a URI."""
    root = scratch_folders.root(spark)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the application's part of the shared root."""
    return f"{_own_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Removes all that this application's operators have stored. For when their results are written: DataFrames that they
    returned read from there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives a lost executor."""
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Plans that are run inside have Arrow batches of at most `rows` rows: the default of 10,000 is tens of MB of whole texts, in
    the JVM's direct memory and in the Python worker at once. The session's own setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(rows, int(before or 10_000) or rows)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a whole file; readers never see a part of it."""
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def get(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be none of df's columns in any case."""
    have = {c.lower() for c in df.columns}
    marks = "__"
    while any(f"{marks}{n}" in have for n in names):
        marks += "_"
    return [f"{marks}{n}" for n in names]


def doc_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text under fixed names; other columns, whatever their names, are left behind. Null text: empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns, ka and kb: 128 bits that name a row by its id and text. Rows that share them are equal in both."""
    return [F.xxhash64(F.col(f"`{id_col}`")).alias("ka"), F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), F.lit(1)).alias("kb")]


def parts_for(spark: SparkSession, amount: int, most: int, most_parts: int = 1 << 16) -> tuple[int, int]:
    """(partitions, pieces of each) so that a piece has about `most` of the amount: both grow with the input, and a task holds a
    piece at a time."""
    pieces = -(-amount // most)
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces // 8)), most_parts)
    return parts, max(4, -(-pieces // parts))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds much over `most` bytes of the given text column."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = batch.column(column).nbytes
        if size <= most or n == 1:
            yield batch
            continue
        step = max(1, n * most // size)
        for i in range(0, n, step):
            part = batch.slice(i, step)
            ends = part.column(column)
            yield from _halved(part, column, most) if ends.nbytes > 4 * most else (part,)


def _halved(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 1 or batch.column(column).nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halved(batch.slice(0, half), column, most)
    yield from _halved(batch.slice(half), column, most)


def crc(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF
