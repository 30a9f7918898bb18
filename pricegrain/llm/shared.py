"""Shared places and small helpers of the operators in this subpackage."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs on this machine alone, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"

_KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What this Python worker keeps from one task of an operator to the next; what it kept for others goes.

    Spark gives a worker tasks of many stages, and their tables would add up otherwise.
    """
    if _KEPT.keys() - {operator}:
        _KEPT.clear()
    return _KEPT.setdefault(operator, {})


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete what was written to path when the driver ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of some such size in what is written meanwhile: by the session's rule of 10,000 rows, both the executor and its workers hold tens of MB of texts each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn labels from: crc32 of the id's text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and where each text begins (and the last ends).

    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Split texts into runs of at most so many bytes; a longer text is a run of its own."""
    out, first = [], 0
    for i in range(1, len(at)):
        if at[i] - at[first] > most and i - 1 > first:
            out.append((first, i - 1))
            first = i - 1
    if len(at) > 1:
        out.append((first, len(at) - 1))
    return out


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and how many words each text has."""
    mask = is_word[data]
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = at[1:-1]
    inner = inner[inner < len(mask)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def byte_table(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Bytes between words where a word is [^\x20\x09-\x0D]+; every byte of a non-ASCII character belongs to a word.
BLANK = b" \t\n\x0b\x0c\r"
