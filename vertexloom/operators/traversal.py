"""Traversals: filters and hops that build a DataFrame plan.

A traversal never changes: each step returns a new one. Every hop is the left-semi join of
the edges with the distinct frontier, then, only if there are filters on the far vertices,
another one with those. Frames carry ids and labels; properties are joined on projection.
A hop from a hop checkpoints the first one's frame, so plans grow with the hops, not with
their number of paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.operators.graph import Graph, bucket_of
from vertexloom.operators.predicates import P, Value, matches, property_matches

#: Levels of a repeat with a condition; vertices that are left beyond them are an error, not a shorter result.
MAX_DEPTH = 64


@dataclass(frozen=True)
class _Hop:
    """An edge step that waits for its vertex step."""

    direction: str
    label: str | None
    filters: tuple[Column, ...] = ()


@dataclass(frozen=True)
class Traversal:
    """``frames``: (level, frame) pairs; a frame has prev_id, cur_id, lvl, edge_id, direction, edge_label."""

    graph: Graph
    root: DataFrame
    frames: tuple[tuple[int, DataFrame], ...] = ()
    pending: _Hop | None = None
    tags: dict[str, int] = field(default_factory=dict)
    anonymous: bool = False

    # Filters

    def with_(self, key: str, test: P | Value) -> Traversal:
        """Keep vertices, or edges after an edge step, of which a value of the property passes."""
        if self.pending:
            if key in ("event_time", "source", "day"):
                return self._edge_filter(matches(test)(F.col(key)))  # a null is no match, and plain comparisons reach the scan
            return self._edge_filter(property_matches("properties", key, test))
        return self._vertex_filter(property_matches("properties", key, test))

    def with_id(self, test: P | int | str) -> Traversal:
        """Keep vertices, or edges after an edge step, by id."""
        if self.pending:
            return self._edge_filter(matches(test)(F.col("edge_id")))
        return self._keep(F.col("cur_id") if self.frames else F.col("node_id"), matches(test))

    def with_label(self, test: P | str) -> Traversal:
        """Keep vertices, or edges after an edge step, by label."""
        return self._edge_filter(matches(test)(F.col("label"))) if self.pending else self._vertex_filter(matches(test)(F.col("label")))

    def with_case(self, cases: DataFrame, case_id: str) -> Traversal:
        """Keep vertices of a case that match its own query, any case of letters, ``all`` being any value.

        ``cases``: case_id, nodes (array of node_id, property, value), query (array of
        propertyKey, propertyValue).
        """
        case = cases.filter(F.col("case_id") == case_id)
        nodes = case.select(F.explode("nodes").alias("n")).select("n.*")
        asked = case.select(F.explode("query").alias("q")).select("q.*")
        same = (F.lower("propertyValue") == "all") | (F.lower("value") == F.lower("propertyValue"))
        ids = nodes.join(asked, (F.col("property") == F.col("propertyKey")) & same, "left_semi").select("node_id").distinct()
        return self._semi(ids)

    def _edge_filter(self, condition: Column) -> Traversal:
        return replace(self, pending=replace(self.pending, filters=(*self.pending.filters, condition)))

    def _vertex_filter(self, condition: Column) -> Traversal:
        if not self.frames and {"label", "properties"} <= set(self.root.columns):  # the root still has what is asked
            return replace(self, root=self.root.filter(condition))
        return self._semi(self.graph.vertices.filter(condition).select("node_id"))

    def _keep(self, column: Column, test: P) -> Traversal:
        if not self.frames:
            return replace(self, root=self.root.filter(test(column)))
        return self._with_last(self.last.filter(test(column)))

    def _semi(self, ids: DataFrame) -> Traversal:
        if not self.frames:
            return replace(self, root=self.root.join(ids, "node_id", "left_semi"))
        frame = self.last
        return self._with_last(frame.join(ids, frame["cur_id"] == ids["node_id"], "left_semi"))

    def _with_last(self, frame: DataFrame) -> Traversal:
        return replace(self, frames=(*self.frames[:-1], (self.frames[-1][0], frame)))

    # Hops

    @property
    def last(self) -> DataFrame:
        if not self.frames:
            raise ValueError("there is no hop yet")
        return self.frames[-1][1]

    @property
    def level(self) -> int:
        return self.frames[-1][0] if self.frames else 0

    def frontier(self) -> DataFrame:
        """Distinct ids of the vertices that are reached."""
        return (self.last.select(F.col("cur_id").alias("node_id")) if self.frames else self.root.select("node_id")).distinct()

    def outE(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._edge("out", label)

    def inE(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._edge("in", label)

    def bothE(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._edge("both", label)

    def inV(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._vertex("out", label)

    def outV(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._vertex("in", label)

    def otherV(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._vertex("both", label)

    def out(self, label: str | None = None) -> Traversal:
        return self.outE(label).inV()

    def in_(self, label: str | None = None) -> Traversal:
        return self.inE(label).outV()

    def both(self, label: str | None = None) -> Traversal:
        return self.bothE(label).otherV()

    def _edge(self, direction: str, label: str | None) -> Traversal:
        if self.pending:
            raise ValueError("an edge step needs its vertex step first")
        return replace(self, pending=_Hop(direction, label))

    def _settled(self) -> Traversal:
        """With the last frame checkpointed: a later level then starts from its rows instead of repeating its plan."""
        return self._with_last(cut(self.last)) if self.frames else self

    def _left(self) -> Traversal:
        """Of an anonymous traversal, which only gives its last level: from what it has reached, whose ids alone are checkpointed."""
        return replace(self, root=cut(self.frontier()), frames=()) if self.frames else self

    def _vertex(self, direction: str, label: str | None) -> Traversal:
        if not self.pending or self.pending.direction != direction:
            raise ValueError(f"this vertex step follows an edge step of direction {direction!r} only")
        self = self._left() if self.anonymous else self._settled()
        frame = self._crossed(self.pending).withColumn("lvl", F.lit(self.level + 1))
        done = replace(self, pending=None, frames=(*self.frames, (self.level + 1, frame)))
        return done.with_label(label) if label else done

    def _crossed(self, hop: _Hop) -> DataFrame:
        """Each edge at the frontier once for each direction in which it is crossed."""
        edges = reduce(lambda e, c: e.filter(c), hop.filters, self.graph.labelled(hop.label))
        ids = self.frontier()
        near_blocks = _in_blocks(ids) if self.frames or self.anonymous else None
        if near_blocks:
            ends_at = {"out": ("src_id",), "in": ("dst_id",), "both": ("src_id", "dst_id")}[hop.direction]
            edges = edges.filter(reduce(lambda a, b: a | b, [near_blocks(F.col(c)) for c in ends_at]))
        if self.graph.buckets and hop.direction == "out":  # stored by source vertex: other buckets are not read
            found = [r.bucket for r in ids.select(bucket_of(F.col("node_id"), self.graph.buckets).alias("bucket")).distinct().collect()]
            edges = edges.filter(F.col("bucket").isin(found))
        held = ("edge_id", F.col("label").alias("edge_label"))
        ways = {"out": ("src_id", "dst_id"), "in": ("dst_id", "src_id")}
        if hop.direction != "both":
            near, far = ways[hop.direction]
            ends = edges.select(F.col(near).alias("prev_id"), F.col(far).alias("cur_id"), *held, F.lit(hop.direction).alias("direction"))
        else:
            end = [F.struct(F.col(near).alias("prev_id"), F.col(far).alias("cur_id"), F.lit(way).alias("direction")) for way, (near, far) in ways.items()]
            ends = edges.select(*held, F.explode(F.array(*end)).alias("end")).select("end.*", "edge_id", "edge_label")
            ends = ends.filter(near_blocks(F.col("prev_id"))) if near_blocks else ends
        return ends.join(ids, ends["prev_id"] == ids["node_id"], "left_semi").select("prev_id", "cur_id", "edge_id", "direction", "edge_label")

    # Branches and repeats

    def _start(self) -> Traversal:
        """An anonymous traversal from the frontier."""
        return Traversal(self.graph, self.frontier(), anonymous=True)

    def _run(self, branches: tuple[Branch, ...]) -> list[DataFrame]:
        start = self._start()
        return [branch(start).last.withColumn("lvl", F.lit(self.level + 1)) for branch in branches]

    def union(self, *branches: Branch) -> Traversal:
        """The last levels of all branches, each from the frontier; rows that several give stay."""
        self = self._settled()
        return replace(self, frames=(*self.frames, (self.level + 1, reduce(DataFrame.unionByName, self._run(branches)))))

    def coalesce(self, *branches: Branch, per_vertex: bool = False) -> Traversal:
        """The last level of the first branch that gives any row: over all, or for each vertex before the last hop.

        One pass over the checkpointed branches: rows carry the number of theirs, and those of
        the least number stay.
        """
        self = self._settled()
        return replace(self, frames=(*self.frames, (self.level + 1, _first(self._run(branches), per_vertex))))

    def optional(self, branch: Branch) -> Traversal:
        """The branch if it gives any row, else what there is."""
        self = self._settled()
        chosen = _first([*self._run((branch,)), self.last.withColumn("lvl", F.lit(self.level + 1))], per_vertex=False)
        return replace(self, frames=(*self.frames, (self.level + 1, chosen)))

    def repeat(self, branch: Branch, times: int | None = None, until: P | None = None, key: str = "label", emit: str = "all", max_depth: int = MAX_DEPTH) -> Traversal:
        """Run a branch again and again from what it reached.

        ``times`` runs give as many levels. With ``until`` vertices whose ``key`` (a property,
        or ``label``) passes are reached but not left, and the run ends when none is left to
        go on from. If some are after ``max_depth`` levels, as on a cycle that never passes,
        it raises. ``emit``: ``all`` levels or the ``last`` one. Every run from which another
        one goes on is checkpointed.
        """
        if (times is None) == (until is None):
            raise ValueError("give either times or until")
        self = self._settled()
        at, new = self, []
        for n in range(times if times is not None else max_depth):
            frame = branch(at._start()).last.withColumn("lvl", F.lit(self.level + n + 1))  # noqa: SLF001
            frame = frame if n + 1 == times else cut(frame)  # the last of a number of runs is not left again here
            new.append((self.level + n + 1, frame))
            at = replace(self, frames=(new[-1],))
            if until is not None:
                condition = until(F.col("label")) if key == "label" else property_matches("properties", key, until)
                ends = self.graph.vertices.filter(condition).select("node_id")
                left = frame.join(ends, frame["cur_id"] == ends["node_id"], "left_anti")
                if left.isEmpty():
                    break
                at = replace(self, frames=((new[-1][0], left),))
        else:
            if until is not None:
                raise RuntimeError(f"vertices are left to go on from after {max_depth} levels")
        if emit == "last":
            new = new[-1:]
        return replace(self, frames=(*self.frames, *new))

    def as_(self, tag: str) -> Traversal:
        """Name the current level for :meth:`tagged`."""
        return replace(self, tags={**self.tags, tag: self.level})

    # Steps on what is reached

    def dedup(self) -> Traversal:
        """Each reached vertex once: of the last level's rows to it that of the least edge."""
        if not self.frames:
            return replace(self, root=self.root.dropDuplicates(["node_id"]))
        frame = self.last
        rest = F.struct("edge_id", "direction", "prev_id", "lvl", "edge_label")
        one = frame.groupBy("cur_id").agg(F.min(rest).alias("r")).select("cur_id", "r.*")
        return self._with_last(one.select(*frame.columns))

    def order(self, by: str = "cur_id", descending: bool = False) -> Traversal:
        """The last level by one of its columns, or the root by one of its own; ties go by edge or vertex id."""
        tie = "edge_id" if self.frames else "node_id"
        turn = F.desc(by) if descending else F.asc(by)
        ordered = lambda df: df.orderBy(turn, tie)
        return self._with_last(ordered(self.last)) if self.frames else replace(self, root=ordered(self.root))

    def limit(self, n: int) -> Traversal:
        """The first ``n`` rows of the last level, as ordered before, or any."""
        return self._with_last(self.last.limit(n)) if self.frames else replace(self, root=self.root.limit(n))

    def count(self) -> DataFrame:
        """``count``: rows of the last level, or of the root."""
        return (self.last if self.frames else self.root).agg(F.count("*").alias("count"))

    def group(self, *keys: str) -> DataFrame:
        """Rows ``n`` of the last level for each value of the keys, columns of :meth:`project` ``basic``."""
        return self.project("basic", self.last).groupBy(*keys).agg(F.count("*").alias("n"))

    # Results

    def levels(self, *only: int) -> DataFrame:
        """The frames of all levels, or of those given."""
        chosen = [f for n, f in self.frames if not only or n in only]
        if not chosen:
            raise ValueError("there is no such level")
        return reduce(DataFrame.unionByName, chosen)

    def ids(self, frame: DataFrame | None = None) -> DataFrame:
        """Ids, direction, level and edge of every row: source and target as the edge is stored."""
        frame = self.levels() if frame is None else frame
        stored = F.col("direction") == "out"
        return frame.select(
            F.when(stored, F.col("prev_id")).otherwise(F.col("cur_id")).alias("src_id"),
            F.when(stored, F.col("cur_id")).otherwise(F.col("prev_id")).alias("dst_id"),
            "direction", F.col("lvl").cast("int").alias("lvl"), "edge_id", "edge_label",
        )

    def project(self, mode: str = "all", frame: DataFrame | None = None) -> DataFrame:
        """``id``: ids; ``basic``: with labels of both ends; ``all``: with their properties. Self loops are left out."""
        rows = self.ids(frame).filter("src_id <> dst_id")
        if mode == "id":
            return rows
        if mode not in ("basic", "all"):
            raise ValueError(f"unknown projection {mode!r}")
        columns = ["node_id", "label", *(["properties"] if mode == "all" else [])]
        for side in ("src", "dst"):
            ends = self.graph.vertices.select(*[F.col(c).alias(f"{side}_{'id' if c == 'node_id' else c}") for c in columns])
            rows = rows.join(ends, f"{side}_id")
        return rows

    def select_level(self, level: int, mode: str = "id") -> DataFrame:
        return self.project(mode, self.levels(level))

    def first_level(self, mode: str = "id") -> DataFrame:
        return self.select_level(self.frames[0][0], mode)

    def last_level(self, mode: str = "id") -> DataFrame:
        """The last level, known when the plan is built."""
        return self.select_level(self.level, mode)

    def tagged(self, *tags: str, mode: str = "id") -> DataFrame:
        """Rows of the named levels, with their name."""
        parts = [self.select_level(self.tags[t], mode).withColumn("tag", F.lit(t)) for t in tags]
        return reduce(DataFrame.unionByName, parts)

    def properties(self) -> DataFrame:
        """The last level with the properties of edges and both ends; of vertices if there is no hop."""
        if not self.frames:
            return self.root
        edges = self.graph.edges.select("edge_id", F.col("properties").alias("edge_properties"))
        return self.project("all", self.last).join(edges, "edge_id")

    def result(self) -> tuple[DataFrame, DataFrame]:
        """Distinct vertices and edges of all levels."""
        rows = cut(self.ids())
        ends = rows.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
        nodes = self.graph.vertices.join(ends, "node_id", "left_semi")
        edges = self.graph.edges.join(rows.select("edge_id").distinct(), "edge_id", "left_semi")
        return nodes, edges


Branch = Callable[[Traversal], Traversal]

#: Ids of a block have all but so many low bits in common.
BLOCK_BITS = 20
#: Blocks by which edges are filtered, at most; ids that lie in more, as hashes do, are only joined.
MAX_BLOCKS = 1000


def _in_blocks(ids: DataFrame) -> Callable[[Column], Column] | None:
    """A test whether an id lies in a block of one of ``ids``, plain enough to reach the scans below distincts; none if the blocks are many.

    It only spares edges the shuffle of the join with ``ids`` that follows.
    """
    if dict(ids.dtypes)["node_id"] != "bigint":
        return None
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    found = [r.block for r in ids.filter("node_id is not null").select(block(F.col("node_id")).alias("block")).distinct().limit(MAX_BLOCKS + 1).collect()]
    return (lambda c: block(c).isin(found)) if len(found) <= MAX_BLOCKS else None


def by(*choices: str) -> Column:
    """The first of some columns that is not null; the last choice is a constant."""
    return F.coalesce(*[F.col(c) for c in choices[:-1]], F.lit(choices[-1]))


def _first(frames: list[DataFrame], per_vertex: bool) -> DataFrame:
    rows = cut(reduce(DataFrame.unionByName, [f.withColumn("branch", F.lit(n)) for n, f in enumerate(frames)]))
    keys = ["prev_id"] if per_vertex else []
    least = rows.groupBy(*keys).agg(F.min("branch").alias("branch"))
    return rows.join(least, [*keys, "branch"], "left_semi").drop("branch").select(*frames[0].columns)


def V(graph: Graph) -> Traversal:  # noqa: N802
    """All vertices."""
    return Traversal(graph, graph.vertices)


def E(graph: Graph, label: str | None = None) -> Traversal:  # noqa: N802
    """All edges, as a first level crossed outwards."""
    frame = graph.labelled(label).select(
        F.col("src_id").alias("prev_id"), F.col("dst_id").alias("cur_id"), "edge_id", F.lit("out").alias("direction"), F.col("label").alias("edge_label"), F.lit(1).alias("lvl")
    )
    return Traversal(graph, graph.vertices, ((1, frame),))


def reachable(graph: Graph, starts: DataFrame, direction: str = "both", depth: int = 3, label: str | None = None) -> DataFrame:
    """``node_id, depth``: vertices within ``depth`` hops and the fewest hops to each; starts have 0.

    Breadth first: what was reached is anti-joined away, so hops do not go over it again.
    """
    seen = starts.select("node_id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for n in range(1, depth + 1):
        step = Traversal(graph, front.select("node_id"))
        hop = {"out": step.out, "in": step.in_, "both": step.both}[direction](label)
        front = hop.frontier().join(seen, "node_id", "left_anti").withColumn("depth", F.lit(n))
        front = cut(front)
        seen = seen.unionByName(front)
    return seen
