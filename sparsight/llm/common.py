"""What several operators share: table access, text defaults, folders that all executors see."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shuffles_removed

#: ASCII letters that the contracts lower-case; other letters stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of anything but these six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; higher-order functions have no other way to name a value."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one beside the warehouse's tables."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{context.applicationId}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written once as a table in the shared folder and read back: its lineage ends there, and a lost executor costs a read.

    The shuffle files that it took are removed when it is written.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Code units of text (bytes in Arrow's form) that a Python function works on at once.
BATCH_BYTES = 4_000_000


def by_size(batch: pa.RecordBatch, column: str | int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A record batch in parts that hold a bounded amount of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@functools.cache
def give_memory_back() -> None:
    """Called in a Python worker: arrays of a megabyte or more go back to the system when they are freed, not to the heap."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc's; elsewhere nothing is changed
    if mallopt:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing
