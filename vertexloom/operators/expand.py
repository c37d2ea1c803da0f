"""Expansion of entities over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.text import JUNK
from vertexloom.lineage import cut


def pivots(events: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """``event_id, value``: what the pivot columns of each event name, lower-cased."""
    values = F.array_distinct(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]))
    return events.select(F.col(id_col).alias("event_id"), F.explode(values).alias("value")).filter("value is not null")


def expand(named: DataFrame, seeds: DataFrame, levels: int = 3, skip: Sequence[str] = JUNK) -> DataFrame:
    """``event_id, level``: events around the seeds and the level at which each was first reached.

    ``named`` comes from :func:`pivots`, ``seeds`` has ``value``. Level 0 holds the events
    that name a seed; each further level those that name what the last level's events name.
    Values are followed once and junk never; each level's values and events are anti-joined
    with those seen, and checkpointed.
    """
    usable = named.filter(~F.col("value").isin(*skip))
    values = cut(seeds.select(F.lower("value").alias("value")).distinct())
    seen_values, out = values, None
    for level in range(levels):
        hit = usable.join(values, "value", "left_semi").select("event_id").distinct()
        fresh = cut((hit if out is None else hit.join(out, "event_id", "left_anti")).select("event_id", F.lit(level).alias("level")))
        out = fresh if out is None else out.unionByName(fresh)
        if level + 1 < levels:
            found = usable.join(fresh, "event_id", "left_semi").select("value").distinct()
            values = cut(found.join(seen_values, "value", "left_anti"))
            seen_values = seen_values.unionByName(values)
    return out


def in_window(events: DataFrame, time_col: str, start: str, end: str, any_of: Column | None = None) -> DataFrame:
    """Distinct events of a time range, and of any of the given conditions."""
    found = events.filter(F.col(time_col).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return (found if any_of is None else found.filter(any_of)).distinct()
