"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.lineage import ensure_checkpoint_dir, small  # noqa: F401  small() is taken from here by the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Texts of plain ASCII take the quick way."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shield(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column], list[Column]]:
    """Rename the columns of ``df`` to ``in_0, in_1 ...`` so that no working column can clash.

    Returns the renamed frame, a lookup from an original name to its column, and the columns
    that restore the original names.
    """
    names = list(df.columns)
    inner = df.toDF(*[f"in_{i}" for i in range(len(names))])
    return inner, lambda name: F.col(f"in_{names.index(name)}"), [F.col(f"in_{i}").alias(n) for i, n in enumerate(names)]


def arrow_batches(spark: SparkSession, rows: int = 500, megabytes: int = 4) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def written(df: DataFrame, name: str, rows: int = 500, megabytes: int = 4) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, written now and read again.

    Rows are fixed once a task's files are committed, so numbers that tasks give to their rows
    hold for all that reads the table. ``rows`` and ``megabytes`` bound the Arrow batches of
    Python workers while it is written; the session's own bounds come back afterwards.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    arrow_batches(spark, rows, megabytes)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
