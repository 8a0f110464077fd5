"""What the operators of this package share: UTF-8 access to Arrow columns and shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WHITE = " \t\n\x0b\x0c\r"

# Texts of one Arrow batch are worked on in slices of at most this many bytes (one text at least).
SLICE_BYTES = 2 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, nulls as empty texts."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def release_memory() -> None:
    """Give memory that a worker no longer uses back to the system: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, text: str, most: int = SLICE_BYTES):
    """Arrow batches cut so that the texts of one slice stay near ``most`` bytes."""
    release_memory()  # what the task before left
    yield from _slices(batches, text, most)
    release_memory()


def _slices(batches, text: str, most: int):
    for batch in batches:
        lengths = batch.column(text).cast(pa.large_binary())
        start = size = 0
        for row in range(batch.num_rows):
            size += len(lengths[row].as_buffer()) if lengths[row].is_valid else 0
            if size >= most:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; it goes when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts without other letters than ASCII take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
