"""Expansion of typed values over several event sources."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.text import JUNK
from vertexloom.lineage import cut, ensure_checkpoint_dir


@dataclass(frozen=True)
class EventSource:
    """A table of events: its id and time, and the columns that name values of each kind (user, host, IP and so on)."""

    name: str
    events: DataFrame
    id_col: str
    time_col: str
    pivots: Mapping[str, Sequence[str]]

    def columns(self) -> list[tuple[str, str]]:
        return [(kind, c) for kind, columns in self.pivots.items() for c in columns]

    def between(self, time: tuple[dt.datetime, dt.datetime] | None) -> DataFrame:
        """Events of a time range, which reaches the scan."""
        return self.events if time is None else self.events.filter(F.col(self.time_col).between(*[F.lit(t).cast("timestamp_ntz") for t in time]))


#: Spark puts a Bloom filter of the frontier before the shuffle of sources of any size.
_RUNTIME_FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


@contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Plans made inside use runtime Bloom filters; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _RUNTIME_FILTERS}
    for k, v in _RUNTIME_FILTERS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def reached(source: EventSource, values: DataFrame, time: tuple[dt.datetime, dt.datetime] | None, skip: Sequence[str] = JUNK) -> DataFrame:
    """``source, event_id``: events of a source in a time range that name one of ``values`` (kind, value).

    A semi join for each pivot column. Small frontiers are broadcast by Spark; of larger ones
    a Bloom filter reaches the scan's side before it is shuffled.
    """
    parts = []
    for kind, column in source.columns():
        wanted = values.filter((F.col("kind") == kind) & ~F.col("value").isin(*skip)).select(F.col("value").alias("wanted"))
        events = source.between(time).select(F.col(source.id_col).cast("long").alias("event_id"), F.lower(F.col(column).cast("string")).alias("named"))
        parts.append(events.join(wanted, F.col("named") == F.col("wanted"), "left_semi").select("event_id"))
    return reduce(DataFrame.unionByName, parts).distinct().select(F.lit(source.name).alias("source"), "event_id")


def named_by(source: EventSource, events: DataFrame, time: tuple[dt.datetime, dt.datetime] | None, skip: Sequence[str] = JUNK) -> DataFrame:
    """``kind, value``: what events (source, event_id) of a source name, lower-cased, junk left out."""
    own = events.filter(F.col("source") == source.name).select("event_id")
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lower(F.col(c).cast("string")).alias("value")) for kind, c in source.columns()])
    rows = source.between(time).withColumn("event_id", F.col(source.id_col).cast("long")).join(own, "event_id", "left_semi")
    return rows.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull() & ~F.col("value").isin(*skip)).distinct()


def expand_sources(
    sources: Sequence[EventSource],
    seeds: DataFrame,
    levels: int = 3,
    time: tuple[dt.datetime, dt.datetime] | None = None,
    skip: Sequence[str] = JUNK,
) -> DataFrame:
    """``source, event_id, level``: events of all sources around the seeds and the level at which each was first reached.

    ``seeds`` has ``kind, value``. Level 0 holds the events of any source that name a seed;
    each further level those that name what the last level's events name, whichever source
    these are of. Values are followed once for each kind, and junk never. Each level's values
    and events are anti-joined with those seen and written to the shared folder, so the sizes
    by which Spark plans the next level's joins are measured ones.
    """
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/expansion-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    with runtime_filters(spark):
        values = keep(seeds.select("kind", F.lower("value").alias("value")).distinct(), "values-0")
        seen, out = values, None
        for level in range(levels):
            hits = reduce(DataFrame.unionByName, [reached(s, values, time, skip) for s in sources])
            fresh = hits if out is None else hits.join(out, ["source", "event_id"], "left_anti")
            fresh = keep(fresh.withColumn("level", F.lit(level)), f"events-{level}")
            out = fresh if out is None else out.unionByName(fresh)
            if level + 1 < levels:
                found = reduce(DataFrame.unionByName, [named_by(s, fresh, time, skip) for s in sources]).distinct()
                values = keep(found.join(seen, ["kind", "value"], "left_anti"), f"values-{level + 1}")
                seen = seen.unionByName(values)
    return cut(out)
