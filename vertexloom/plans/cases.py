"""Cases and incremental loads as plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.lineage import cut, small

SLACK = "30 seconds"


def case_state(log: DataFrame) -> DataFrame:
    """Latest state of each case from its append-only log (``case_id, status, at``): status, its time, and all in order."""
    entry = F.struct("at", "status")
    return log.groupBy("case_id").agg(
        F.max_by("status", entry).alias("status"), F.max("at").alias("at"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["status"]).alias("tracker")
    )


def status_of(log: DataFrame, cases: Sequence[str] | DataFrame) -> DataFrame:
    """``case_id, status, at`` of the cases asked for: some ids, or a frame of any number of them (``case_id``)."""
    asked = log.join(cases, "case_id", "left_semi") if isinstance(cases, DataFrame) else log.filter(F.col("case_id").isin(*cases))
    return asked.groupBy("case_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def case_ids(log: DataFrame) -> DataFrame:
    """``case_id``: every case once."""
    return log.select("case_id").distinct()


def case_nodes(nodes: DataFrame) -> DataFrame:
    """``case_id, nodes``: the vertices of each case as an array of node_id, property, value."""
    return nodes.groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("node_id", "property", "value"))).alias("nodes"))


def query_array(spark: SparkSession, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row with the query of a case, from the values asked for by property."""
    pairs = [(k, v) for k, values in wanted.items() for v in values]
    rows = spark.createDataFrame(pairs, "propertyKey string, propertyValue string")
    return rows.agg(F.array_sort(F.collect_list(F.struct("propertyKey", "propertyValue"))).alias("query"))


def covering_cases(cases: DataFrame, wanted: Mapping[str, str], start: str, end: str, sources: Sequence[str]) -> DataFrame:
    """Cases that already hold an export: every pair asked for, a time range that contains it, and all sources.

    A pair may stand in the case's query or, failing that, among its nodes.
    """
    inside = (F.col("query_start") <= F.lit(start).cast("timestamp_ntz")) & (F.col("query_end") >= F.lit(end).cast("timestamp_ntz"))
    has_sources = F.size(F.array_except(F.array(*[F.lit(s) for s in sources]), "datasources")) == 0
    lower = lambda c: F.lower(c)

    def asked(k: str, v: str) -> Column:
        in_query = F.exists("query", lambda q: (q["propertyKey"] == k) & (lower(q["propertyValue"]) == v.lower()))
        in_nodes = F.exists("nodes", lambda n: (n["property"] == k) & (lower(n["value"]) == v.lower()))
        return in_query | in_nodes

    found = cases.filter(inside & (has_sources | F.array_contains("datasources", "all")))
    for k, v in wanted.items():
        found = found.filter(F.coalesce(asked(k, v), F.lit(False)))
    return found


def _pairs(items: str, key: str, value: str) -> Column:
    return F.transform(F.coalesce(items, F.array()), lambda x: F.struct(x[key].alias("k"), F.lower(x[value]).alias("v")))


#: Pairs of property and value that may be broadcast, which are counted first; more are shuffled.
BROADCAST_PAIRS = 100_000


def _second(at: str, kind: str) -> Column:
    """Whole seconds of a time column since 1970, in no zone if it has none."""
    since = F.col(at).cast(kind) - F.lit("1970-01-01").cast(kind)
    part = lambda name: F.extract(F.lit(name), since)
    return F.floor(part("DAY").cast("bigint") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("bigint")


def _level(low: Column, high: Column) -> Column:
    """Stretches of time of two to this power seconds: a time range touches two of them at most."""
    return F.ceil(F.log2(high - low + 1)).cast("int")


def _stretch(second: Column, level: Column) -> Column:
    return F.floor(second / F.pow(F.lit(2.0), level)).cast("bigint")


def covered_requests(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, case_id``: for each of many requests the cases that already hold its export, as :func:`covering_cases` says.

    ``requests``: request_id, query (array of propertyKey, propertyValue), query_start,
    query_end, datasources (array). ``cases``: case_id, query, nodes, query_start, query_end,
    datasources.

    A join by containment of sets, then one by time. Requests that ask for the same pairs of
    property and value are one set. All pairs are counted over the cases; a set meets the
    cases only under the rarest of its pairs, and the join itself compares the others. A pair
    that no case has rules its set out before any join. A case then lies in the stretches of
    time that it touches, of a length of its own size, and meets the requests for its sets
    that begin there; the join itself compares times and sources, so only results leave it.
    Defined cases: letters of values may differ in case; a pair asked for twice counts once;
    a request without pairs, or with a null in one, is covered by none.
    """
    times = [t for df in (cases, requests) for n, t in df.dtypes if n in ("query_start", "query_end")]
    kind = "timestamp" if "timestamp" in times else "timestamp_ntz"
    spans = lambda side: [F.col("query_start").alias(f"{side}_start"), F.col("query_end").alias(f"{side}_end"), F.col("datasources").alias(f"{side}_sources")]
    low, high = _second("query_start", kind).alias("low"), _second("query_end", kind).alias("high")

    asked = requests.select("request_id", *spans("request"), low, high, F.array_sort(F.array_distinct(_pairs("query", "propertyKey", "propertyValue"))).alias("pairs"))
    asked = asked.filter((F.size("pairs") > 0) & F.forall("pairs", lambda p: p["k"].isNotNull() & p["v"].isNotNull())).withColumn("asks", F.to_json("pairs"))
    sets = cut(asked.select("asks", "pairs").distinct())
    each = sets.select("asks", F.explode("pairs").alias("p")).select("asks", "p.*")
    held = cases.select("case_id", *spans("case"), low, high, F.array_distinct(F.concat(_pairs("query", "propertyKey", "propertyValue"), _pairs("nodes", "property", "value"))).alias("held"))
    counted = held.select(F.explode("held").alias("p")).select("p.*").join(small(each.select("k", "v").distinct(), BROADCAST_PAIRS), ["k", "v"], "left_semi")
    counts = counted.groupBy("k", "v").agg(F.count("*").alias("n"))
    known = each.join(counts, ["k", "v"]).groupBy("asks").agg(F.count("*").alias("found"), F.min(F.struct("n", "k", "v")).alias("rarest"))
    possible = cut(sets.join(known, "asks").filter(F.col("found") == F.size("pairs")).select("asks", "pairs", "rarest.k", "rarest.v"))

    at = held.withColumn("p", F.explode("held")).select("*", "p.*").drop("p").join(small(possible.select("k", "v").distinct(), BROADCAST_PAIRS), ["k", "v"], "left_semi")
    others = F.forall("pairs", lambda p: F.array_contains("held", p))
    met = at.join(possible, (at["k"] == possible["k"]) & (at["v"] == possible["v"]) & others)
    met = cut(met.select("asks", "case_id", "case_start", "case_end", "case_sources", "low", "high", _level(F.col("low"), F.col("high")).alias("level")))

    # A request whose end is before its begin has no stretch, and meets all cases that hold its set.
    levels = sorted(r.level for r in met.filter("low <= high").select("level").distinct().collect())
    place = lambda level, stretch: F.struct(F.lit(level).cast("int").alias("level"), F.lit(stretch).cast("bigint").alias("stretch"))
    nowhere = F.array(place(-1, 0))
    own = F.col("level")
    touched = F.transform(F.sequence(_stretch(F.col("low"), own), _stretch(F.col("high"), own)), lambda s: place(own, s))
    there = met.select("asks", "case_id", "case_start", "case_end", "case_sources", F.explode(F.when(F.col("low") <= F.col("high"), F.concat(touched, nowhere)).otherwise(nowhere)).alias("x"))
    begins = F.filter(F.array(*[place(n, _stretch(F.col("low"), F.lit(n))) for n in levels]).cast("array<struct<level:int,stretch:bigint>>"), lambda x: x["level"] >= _level(F.col("low"), F.col("high")))
    here = asked.select("asks", "request_id", "request_start", "request_end", "request_sources", F.explode(F.when(F.col("low") <= F.col("high"), begins).otherwise(nowhere)).alias("x"))
    inside = (F.col("case_start") <= F.col("request_start")) & (F.col("case_end") >= F.col("request_end"))
    sources = (F.size(F.array_except("request_sources", "case_sources")) == 0) | F.array_contains("case_sources", "all")
    placed = lambda df: df.select("*", "x.*").drop("x")
    return placed(here).join(placed(there), ["asks", "level", "stretch"]).filter(inside & sources).select("request_id", "case_id")


def arrivals(raw: DataFrame, key: str, time_col: str, source_col: str) -> DataFrame:
    """Tracker rows (as for :func:`next_delta`) of records that have just arrived and wait to be loaded."""
    waits = F.lit(None).cast("timestamp_ntz").alias("processed_time")
    return raw.select(F.col(key).alias("row_id"), F.col(time_col).alias("added_time"), waits, F.array(source_col).alias("datasource"))


def delta_rows(raw: DataFrame, tracker: DataFrame, time_col: str, source_col: str) -> DataFrame:
    """The records that :func:`next_delta` says are to be loaded: of its time range and sources, the delta being one row."""
    delta = next_delta(tracker).filter("status = 'yes'").select("start_time", "end_time", "sources")
    wanted = F.array_contains("sources", F.lit("all")) | F.array_contains("sources", F.col(source_col))
    return raw.join(F.broadcast(delta), F.col(time_col).between(F.col("start_time"), F.col("end_time")) & wanted, "left_semi")


def next_delta(tracker: DataFrame) -> DataFrame:
    """What waits to be loaded: whether anything does, the time range with some slack, and the sources (``all`` stands for all).

    ``tracker``: row_id, added_time, processed_time, datasource (array).
    """
    waiting = tracker.filter("processed_time is null").select("row_id", "added_time", F.explode_outer("datasource").alias("source"))
    sums = waiting.agg(
        F.count("row_id").alias("n"), F.min("added_time").alias("low"), F.max("added_time").alias("high"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    everything = F.array_contains("sources", "all")
    return sums.select(
        F.when(F.col("n") > 0, "yes").otherwise("no").alias("status"),
        (F.col("low") - F.expr(f"INTERVAL {SLACK}")).alias("start_time"), (F.col("high") + F.expr(f"INTERVAL {SLACK}")).alias("end_time"),
        F.when(everything, F.array(F.lit("all"))).otherwise(F.col("sources")).alias("sources"),
    )


def mark_processed(tracker: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """The tracker with the waiting rows of a time range marked."""
    due = F.col("processed_time").isNull() & F.col("added_time").between(start, end)
    return tracker.withColumn("processed_time", F.when(due, now).otherwise(F.col("processed_time")))


def recent(df: DataFrame, time_col: str, amount: int, unit: str) -> DataFrame:
    """Rows of the last ``amount`` hours, minutes or days (``h``, ``m``, ``d``) before the latest one."""
    name = {"h": "HOURS", "m": "MINUTES", "d": "DAYS"}[unit]
    latest = df.agg((F.max(time_col) - F.expr(f"INTERVAL {int(amount)} {name}")).alias("since"))
    return df.join(F.broadcast(latest), F.col(time_col) >= F.col("since")).drop("since")
