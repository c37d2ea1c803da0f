"""Record sources: which tables and columns they have, reading, typing and writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.text import log_time

#: Rows of a file that a writer may put together.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class Source:
    """A table, its time column, the columns read, and new names and types for them."""

    table: str
    time: str
    columns: tuple[str, ...]
    names: Mapping[str, str] | None = None
    types: Mapping[str, str] | None = None


def read_sources(spark: SparkSession, folder: str, catalog: Mapping[str, Source], wanted: Sequence[str] = ("all",)) -> DataFrame:
    """The wanted sources, or all, as one frame with a column ``ds``; columns that a source lacks are null."""
    names = list(catalog) if "all" in wanted else list(wanted)
    parts = []
    for name in names:
        s = catalog[name]
        rows = spark.read.parquet(f"{folder}/{s.table}.parquet").select(*dict.fromkeys([s.time, *s.columns]))
        rows = typed(rows.withColumnsRenamed(dict(s.names or {})), s.types or {})
        parts.append(rows.withColumn("ds", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns as the given types; ``timestamp`` from any known format of text; what does not fit is null."""
    as_type = {
        c: log_time(F.col(c)).cast("timestamp_ntz") if t == "timestamp" and dict(df.dtypes)[c] == "string" else F.col(c).try_cast("timestamp_ntz" if t == "timestamp" else t)
        for c, t in types.items()
    }
    return df.withColumns(as_type)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold JSON arrays of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_staged(df: DataFrame, path: str, file_format: str = "json") -> None:
    """Records by case and source, in files of a bounded number of rows."""
    df.write.mode("append").partitionBy("case_id", "ds").option("maxRecordsPerFile", FILE_ROWS).format(file_format).save(path)


def write_piped_csv(df: DataFrame, path: str) -> None:
    """Pipe-separated text with a header."""
    df.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)


def append_variant(df: DataFrame, text_col: str, path: str) -> None:
    """Append rows whose JSON text becomes a variant column."""
    df.withColumn(text_col, F.parse_json(text_col)).write.mode("append").parquet(path)


def columns_of(df: DataFrame) -> DataFrame:
    """``name, type`` of the columns of a table."""
    spark = df.sparkSession
    return spark.createDataFrame([(n, t) for n, t in df.dtypes], "name string, type string")


def from_adjacent_names(df: DataFrame) -> DataFrame:
    """Column names of logs in one form: lower-case, with ``_`` for ``-`` and spaces."""
    return df.withColumnsRenamed({c: c.lower().replace("-", "_").replace(" ", "_") for c in df.columns})
