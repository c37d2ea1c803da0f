"""Raw records that wait to be loaded, by arrival and day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.plans.cases import next_delta

_ARRIVED = "row_id long, added_time timestamp_ntz, datasource string, batch long"


class DeltaStore:
    """Records under a folder, partitioned by arrival and day, with a tracker of what has arrived and what is loaded.

    An arrival counts once its tracker rows are written, after its records; a load once it is
    noted, after its rows are taken. Both may be tried again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, time_col: str, source_col: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.key, self.time_col, self.source_col = key, time_col, source_col

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def arrive(self, number: int, records: DataFrame) -> None:
        """Keep an arrival; the same number again replaces it."""
        dated = records.withColumn("day", F.to_date(self.time_col))
        dated.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/raw/batch={number}")
        tracked = records.select(F.col(self.key).cast("long").alias("row_id"), F.col(self.time_col).cast("timestamp_ntz").alias("added_time"), F.col(self.source_col).cast("string").alias("datasource"))
        tracked.write.mode("overwrite").parquet(f"{self.folder}/arrived/batch={number}")

    def waiting(self) -> DataFrame:
        """Tracker rows (as for :func:`next_delta`) of the arrivals that no load has taken; the others' files are not read."""
        loaded = [r.batch for r in self._table("loaded", "batch long").distinct().collect()]  # a row for each arrival
        rows = self._table("arrived", _ARRIVED).filter(~F.col("batch").isin(loaded))
        return rows.select("row_id", "added_time", F.lit(None).cast("timestamp_ntz").alias("processed_time"), F.array("datasource").alias("datasource"), "batch")

    def delta(self) -> tuple[int, DataFrame] | None:
        """The number of the next load and its records: those of the time range and the sources that wait, read from their days only."""
        waiting = self.waiting()
        due = next_delta(waiting).first()
        if due.status == "no":
            return None
        number = waiting.agg(F.max("batch")).first()[0]
        raw = self.spark.read.schema(f"{self.schema}, batch long, day date").parquet(f"{self.folder}/raw")
        rows = raw.filter(F.col("day").between(due.start_time.date(), due.end_time.date()) & (F.col("batch") <= number))
        rows = rows.filter(F.col(self.time_col).cast("timestamp_ntz").between(due.start_time, due.end_time))
        if "all" not in due.sources:
            rows = rows.filter(F.col(self.source_col).isin(due.sources))
        return number, rows.drop("batch", "day")

    def load(self, take: Callable[[int, DataFrame], object]) -> int | None:
        """Hand the next load to ``take`` (its number, its records) and note the arrivals in it; None if nothing waits.

        If a run breaks off in between, the next one hands over the same number again.
        """
        found = self.delta()
        if found is None:
            return None
        number, rows = found
        arrivals = self.waiting().select("batch").distinct()
        take(number, rows)
        arrivals.filter(F.col("batch") <= number).coalesce(1).write.mode("append").parquet(f"{self.folder}/loaded")
        return number
