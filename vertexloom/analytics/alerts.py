"""Grouping of alerts that share values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.analytics.components import connected_components

#: Alerts in one list of ids, about; a value with more has several.
CHUNK_IDS = 1000


def shared_values(alerts: DataFrame, families: Mapping[str, Sequence[str]], id_col: str = "id", same_column: bool = False) -> DataFrame:
    """``id, family, column, value``: values of an alert; columns of one family count as one unless ``same_column``."""
    cells = [
        F.struct(F.lit(c if same_column else family).alias("family"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for family, columns in families.items()
        for c in columns
    ]
    return alerts.select(F.col(id_col).alias("id"), F.explode(F.array(*cells)).alias("x")).select("id", "x.*").filter("value is not null and value <> ''")


def group_alerts(alerts: DataFrame, families: Mapping[str, Sequence[str]], id_col: str = "id", same_column: bool = False) -> DataFrame:
    """``id, group``: alerts that share values, over any number of steps, get the least id among them.

    Each value links its alerts to the least of them, so a value of any frequency gives as
    many links as it has alerts.
    """
    values = shared_values(alerts, families, id_col, same_column)
    least = values.groupBy("family", "value").agg(F.min("id").alias("least"))
    parts = connected_components(values.join(least, ["family", "value"]).select("id", "least"))
    return alerts.select(F.col(id_col).alias("id")).join(parts.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("group"))


def values_of_groups(alerts: DataFrame, groups: DataFrame, families: Mapping[str, Sequence[str]], id_col: str = "id") -> DataFrame:
    """``group, family, value, n_alerts``: values that occur in each group."""
    return shared_values(alerts, families, id_col).join(groups, "id").groupBy("group", "family", "value").agg(F.countDistinct("id").alias("n_alerts"))


def ids_of_values(alerts: DataFrame, families: Mapping[str, Sequence[str]], id_col: str = "id", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """``family, value, chunk, ids``: alerts that have each value, in order, dealt to rows of about ``chunk_ids``.

    The number of a value's chunks follows from how often it occurs and an alert's chunk from
    its id, so a value that many alerts share has many rows instead of one that grows.
    """
    values = shared_values(alerts, families, id_col)
    sizes = values.groupBy("family", "value").agg(F.ceil(F.count("*") / chunk_ids).alias("chunks"))
    dealt = values.join(sizes, ["family", "value"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    return dealt.groupBy("family", "value", "chunk").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def records_of_ids(alerts: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, records``: all rows of each alert."""
    return alerts.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("*")).alias("records"))


def why_grouped(alerts: DataFrame, families: Mapping[str, Sequence[str]], id_col: str = "id") -> DataFrame:
    """``id_a, id_b, value, column_a, column_b``: the link of each alert to the least one with the same value."""
    values = shared_values(alerts, families, id_col)
    least = values.groupBy("family", "value").agg(F.min_by(F.struct("id", "column"), F.struct("id", "column")).alias("m"))
    return (
        values.join(least, ["family", "value"])
        .filter("id <> m.id")
        .select(F.col("m.id").alias("id_a"), F.col("id").alias("id_b"), "value", F.col("m.column").alias("column_a"), F.col("column").alias("column_b"))
    )
