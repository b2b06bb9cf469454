"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

# A side is broadcast only if the measured bytes of its rows stay below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; where none is set, a temporary one if all tasks run in this process, and an error else."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@functools.cache
def _malloc_trim() -> Callable[[int], int] | None:
    """The C library's call that returns freed memory to the system; None where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return None


def release_memory() -> None:
    """Return this process's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, with freed memory returned at a partition's end: workers stay for later stages, and what they hold counts beside the heap."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released


def _bytes_of(value: Column, kind: DataType) -> Column:
    """Bytes that a value takes beside its eight in the row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + 8 + _bytes_of(x, kind.elementType)), F.lit(0).cast("long"))
        return F.coalesce(16 + 8 * F.size(value), F.lit(0)).cast("long")
    if isinstance(kind, StructType):
        return sum((8 + _bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(0).cast("long")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured bytes of the rows allow it; else leave the join to a shuffle.

    ``df`` must be materialised already (a checkpoint): measuring it runs it, over as many rows at most as could fit.
    """
    least = 16 + 8 * len(df.columns)
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(least).cast("long"))
    found = df.select(width.alias("w")).limit(limit // least + 1).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return F.broadcast(df) if found <= limit else df


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Java form of the word pattern's complement: every ASCII character that is no digit and no lower-case letter.
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does the same on pure ASCII, at a fraction of the time."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def words(text: Column) -> Column:
    """Words of a text: runs of lower-case a-z, digits and non-ASCII characters, after ``ascii_lower``.

    Null has no words.
    """
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD)
    return F.filter(parts, lambda w: w != "")
