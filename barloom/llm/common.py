"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset and driver and executors are one process (a local master, as in tests), a new temporary
    folder is made and set as the context's; on a cluster, ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="barloom-checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder of a settled frame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of text that go to Python at once: with Spark's usual 10,000, long texts fill memory on both sides.
BATCH_ROWS = 1000


def to_python(df: DataFrame, run: Batches, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_ROWS, unless the session has its own number of rows.

    Frames are evaluated when the caller uses them, so the setting stays for the session. At its end a task gives free
    memory back to the system: Python workers live on between tasks.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory that Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of identifiers up to which small() sends a table to all executors.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS, within: DataFrame | None = None) -> DataFrame:
    """df, broadcast in joins if a count finds at most `rows` rows; beyond it, joined by shuffle.

    within: a frame with as many rows at least, which is counted instead because it is there already.
    """
    return F.broadcast(df) if (df if within is None else within).limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % n


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about most_bytes of text: (rows, bytes of all texts, offsets).

    A null text counts as empty. A longer single text makes a part of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        for first, last in _cuts(column, wide, most_bytes):
            part = column.slice(first, last - first)
            _, offsets, data = part.buffers()
            at = np.frombuffer(offsets, np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            whole = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
            yield batch.slice(first, last - first), whole[at[0] : at[-1]], at - at[0]


def _cuts(column: pa.Array, wide: bool, most: int) -> Iterator[tuple[int, int]]:
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, int(offsets[first]) + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up equal-length float64 vectors, the binary column `cells`, by keys.

    A group has one row for each task that made parts, so callers bound the number of those tasks.
    """

    def add(rows: pa.Table) -> pa.Table:
        cells = rows.column("cells")
        total = np.frombuffer(cells[0].as_py(), np.float64).copy()
        for other in cells[1:]:
            total += np.frombuffer(other.as_py(), np.float64)
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, "cells": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy(*keys).applyInArrow(add, parts.select(*keys, "cells").schema)
