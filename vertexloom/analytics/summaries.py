"""Profiles, time buckets and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """``column, non_null, distinct_about``: one pass over all columns."""
    names = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)], *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct_about")) for i, c in enumerate(names)])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def time_histogram(df: DataFrame, time_col: str, interval: str, *by: str) -> DataFrame:
    """Rows by time bucket and further columns: ``bucket_start, ..., n``."""
    return df.groupBy(F.window(time_col, interval)["start"].alias("bucket_start"), *by).agg(F.count("*").alias("n"))


def edge_counters(edges: DataFrame, counter: str = "counter", interval: str = "5 seconds") -> DataFrame:
    """Sums of an edge counter by ends, label and time bucket."""
    return edges.groupBy("src_id", "dst_id", "label", F.window("event_time", interval)["start"].alias("bucket_start")).agg(F.sum(counter).alias("total"))


def pairs_present(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of two columns that both have a value."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()


def rows_by_source(df: DataFrame, column: str = "ds") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
