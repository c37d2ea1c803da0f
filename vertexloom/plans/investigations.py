"""Named investigations: fixed traversals with labels, a time range and sources as parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.operators.graph import Graph
from vertexloom.operators.predicates import P
from vertexloom.operators.traversal import Branch, Traversal


@dataclass(frozen=True)
class Scope:
    """What every hop of an investigation keeps: a time range, sources, and other names for labels."""

    time: tuple[dt.datetime, dt.datetime] | None = None
    sources: tuple[str, ...] | None = None
    labels: Mapping[str, str] | None = None

    def label(self, name: str | None) -> str | None:
        return (self.labels or {}).get(name, name) if name else None

    def hop(self, at: Traversal, direction: str, edge: str | None = None, vertex: str | None = None) -> Traversal:
        step = {"out": at.outE, "in": at.inE, "both": at.bothE}[direction](self.label(edge))
        if self.time:
            step = step.with_("event_time", P.between(*self.time))
            if "day" in at.graph.edges.columns:  # a partition column: other days are not read
                step = step.with_("day", P.between(*[t.date() for t in self.time]))
        if self.sources:
            step = step.with_("source", P.within(list(self.sources)))
        return {"out": step.inV, "in": step.outV, "both": step.otherV}[direction](self.label(vertex))

    def path(self, *steps: tuple) -> Branch:
        """A branch of hops (direction, edge label, vertex label), the labels being optional."""

        def run(at: Traversal) -> Traversal:
            for step in steps:
                at = self.hop(at, *step)
            return at

        return run


def _plain(*steps: tuple):  # noqa: ANN202
    return lambda at, scope: scope.path(*steps)(at)


def _user_process(at: Traversal, scope: Scope) -> Traversal:
    reached = at.union(scope.path(("both", "resolved"), ("out", "hasIP")), scope.path(("out", "hasIP")))
    return scope.hop(reached, "out", "runningProcess")


#: Fixed compositions by name, in the labels of a security graph.
INVESTIGATIONS = {
    "process_user": _plain(("both", "downloadedOn"), ("both", "hasIP")),
    "process_ip_communicated": _plain(("both", "downloadedOn"), ("both", "IPsCommunicated")),
    "user_process": _user_process,
    "user_email_user": _plain(("in", "receivedEmail"), ("in", "sentEmail"), ("out", "sentEmail"), ("out", "receivedEmail"), ("out", "clicked")),
    "user_URL_user": _plain(("out", "clicked"), ("in", "clicked")),
    "ip_user": lambda at, scope: at.union(scope.path(("in", "hasIP")), scope.path(("in", "userInteracted"))),
    "process_ip": _plain(("in", "runningProcess")),
    "process_downloaded_on": lambda at, scope: at.coalesce(scope.path(("out", "downloadedOn", "IP")), scope.path(("out", "childProcessOn", "hosts"))),
    "user_touched_host": _plain(("out", "loggedIn", "IP")),
    "user_clicked_url": _plain(("out", "clicked", "URLs")),
}


def investigate(graph: Graph, name: str, starts: DataFrame, scope: Scope = Scope()) -> Traversal:  # noqa: B008
    """Run a named investigation from any number of start vertices (``node_id``) in one plan."""
    return INVESTIGATIONS[name](Traversal(graph, starts.select("node_id").distinct()), scope)


def ego(graph: Graph, starts: DataFrame, hops: int, direction: str = "both", edge: str | None = None, scope: Scope = Scope()) -> Traversal:  # noqa: B008
    """The neighbourhood of the start vertices up to a number of hops."""
    return scope.path(*[(direction, edge)] * hops)(Traversal(graph, starts.select("node_id").distinct()))


def communicated_after(graph: Graph, starts: DataFrame, window: str, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """Communications of the places where a process was first seen, within ``window`` after that.

    The places are those of ``downloadedOn``, or of ``childProcessOn`` and ``withIP`` if no
    process has any of those; an edge of ``IPsCommunicated`` at a place counts if
    ``first <= time < first + window``. ``window`` is an interval such as ``2 hours``.
    Returns ``process_id, place_id, first_time, edge_id, other_id, event_time``.
    """
    start = Traversal(graph, starts.select("node_id").distinct())
    timed = lambda label: graph.labelled(scope.label(label)).select("edge_id", "event_time")
    downloads = scope.hop(start, "out", "downloadedOn").last.join(timed("downloadedOn"), "edge_id").select(F.col("prev_id").alias("process_id"), F.col("cur_id").alias("place_id"), "event_time")
    child = scope.hop(start, "out", "childProcessOn")
    children = child.last.join(timed("childProcessOn"), "edge_id")
    onward = scope.hop(child, "out", "withIP").last.select(F.col("prev_id").alias("cur_id"), F.col("cur_id").alias("place_id"))
    second = children.join(onward, "cur_id").select(F.col("prev_id").alias("process_id"), "place_id", "event_time")
    both = cut(downloads.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1))))
    first_branch = both.agg(F.min("branch").alias("branch"))
    places = both.join(first_branch, "branch", "left_semi")
    least = places.groupBy("process_id").agg(F.min("event_time").alias("first_time"))
    first = cut(places.select("process_id", "place_id").distinct().join(least, "process_id"))
    talk = scope.hop(Traversal(graph, first.select(F.col("place_id").alias("node_id"))), "both", "IPsCommunicated").last.join(timed("IPsCommunicated"), "edge_id")
    # An interval join: both sides are dealt by place and stretch of time of the window's length, so a busy place is split.
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), c)
    length = graph.edges.sparkSession.range(1).select(micros(F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.expr(f"INTERVAL {window}")).alias("n")).first().n
    until = F.col("first_time") + F.expr(f"INTERVAL {window}")
    stretches = F.sequence(F.floor(micros(F.col("first_time")) / length), F.floor(micros(until) / length))
    seen = first.withColumn("until", until).withColumn("stretch", F.explode(stretches))
    said = talk.select(F.col("prev_id").alias("place_id"), F.floor(micros(F.col("event_time")) / length).alias("stretch"), "edge_id", F.col("cur_id").alias("other_id"), "event_time")
    met = seen.join(said, ["place_id", "stretch"]).filter("event_time >= first_time and event_time < until")
    return met.select("process_id", "place_id", "first_time", "edge_id", "other_id", "event_time")
