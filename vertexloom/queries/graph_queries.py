"""Traversal queries over the order graph and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators import graph as g
from vertexloom.operators.predicates import P
from vertexloom.operators.traversal import E, Traversal, V, by, reachable
from vertexloom.plans import investigations as inv
from vertexloom.sources.tables import SPAN, order_graph, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SPAN = str(SPAN)

#: The graph as SQL views: v(node_id, label, name, status, segment, size) and e(edge_id, src_id, dst_id, label, event_time, source, quantity).
GRAPH_SQL = f"""
    k(name, n) AS (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 4), ('view', 5)),
    v AS MATERIALIZED (
        SELECT 1 * {_SPAN} + c_custkey AS node_id, 'customer' AS label, c_name AS name, NULL AS status, c_mktsegment AS segment, NULL AS size FROM customer
        UNION ALL SELECT 2 * {_SPAN} + o_orderkey, 'order', NULL, o_orderstatus, NULL, NULL FROM orders
        UNION ALL SELECT 3 * {_SPAN} + p_partkey, 'part', p_name, NULL, NULL, p_size FROM part
        UNION ALL SELECT 4 * {_SPAN} + s_suppkey, 'supplier', s_name, NULL, NULL, NULL FROM supplier
        UNION ALL SELECT 5 * {_SPAN} + n_nationkey, 'nation', n_name, NULL, NULL, NULL FROM nation
        UNION ALL SELECT 6 * {_SPAN} + r_regionkey, 'region', r_name, NULL, NULL, NULL FROM region
        UNION ALL SELECT DISTINCT 7 * {_SPAN} + user_id, 'user', 'user' || user_id, NULL, NULL, NULL FROM events
        UNION ALL SELECT DISTINCT 8 * {_SPAN} + n, 'event_type', name, NULL, NULL, NULL FROM events JOIN k ON event_type = name),
    e AS MATERIALIZED (
        SELECT 'placed:' || o_orderkey AS edge_id, 1 * {_SPAN} + o_custkey AS src_id, 2 * {_SPAN} + o_orderkey AS dst_id, 'placed' AS label,
               o_orderdate AS event_time, 'orders' AS source, NULL::bigint AS quantity FROM orders
        UNION ALL SELECT 'contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || strftime(l_shipdate, '%Y-%m-%d'),
               2 * {_SPAN} + l_orderkey, 3 * {_SPAN} + l_partkey, 'contains', l_shipdate, 'lineitem', l_quantity::bigint FROM lineitem
        UNION ALL SELECT DISTINCT 'suppliedBy:' || l_partkey || ':' || l_suppkey, 3 * {_SPAN} + l_partkey, 4 * {_SPAN} + l_suppkey, 'suppliedBy', NULL::timestamp, NULL, NULL::bigint FROM lineitem
        UNION ALL SELECT 'inNation:c:' || c_custkey, 1 * {_SPAN} + c_custkey, 5 * {_SPAN} + c_nationkey, 'inNation', NULL, NULL, NULL FROM customer
        UNION ALL SELECT 'inNation:s:' || s_suppkey, 4 * {_SPAN} + s_suppkey, 5 * {_SPAN} + s_nationkey, 'inNation', NULL, NULL, NULL FROM supplier
        UNION ALL SELECT 'inRegion:' || n_nationkey, 5 * {_SPAN} + n_nationkey, 6 * {_SPAN} + n_regionkey, 'inRegion', NULL, NULL, NULL FROM nation
        UNION ALL SELECT 'did:' || event_id, 7 * {_SPAN} + user_id, 8 * {_SPAN} + n, 'did', ts, 'events', NULL FROM events JOIN k ON event_type = name)"""


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {GRAPH_SQL}{sql}"
        return f

    return register


def _hop(name: str, before: str, lvl: int, ways: str, where: str = "TRUE") -> str:
    """A view of the edges at the ids of ``before`` (a view with cur), crossed in the given directions."""
    parts = [
        f"SELECT {near} AS prev, {far} AS cur, src_id, dst_id, '{way}' AS direction, {lvl}::int AS lvl, edge_id, label AS edge_label "
        f"FROM e WHERE {near} IN (SELECT cur FROM {before}) AND {where.replace('{far}', far)}"
        for way, near, far in (("out", "src_id", "dst_id"), ("in", "dst_id", "src_id"))
        if ways in (way, "both")
    ]
    return f", {name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_COLUMNS = "src_id, dst_id, direction, lvl, edge_id, edge_label"


def _rows(*views: str) -> str:
    return " UNION ALL ".join(f"SELECT {_COLUMNS} FROM {x} WHERE src_id <> dst_id" for x in views)


def _start(where: str) -> str:
    return f", s AS (SELECT node_id AS cur FROM v WHERE {where})"


def _nation(spark: SparkSession, sf_dir: str, n: int = 3) -> Traversal:
    return V(order_graph(spark, sf_dir)).with_label("nation").with_("name", f"NATION_{n}")


_NATION = _start("label = 'nation' AND name = 'NATION_3'")


@_query(" SELECT node_id, label, name FROM v")
def v_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).properties().select("node_id", "label", g.first_value("properties", "name").alias("name"))


@_query(f" {_rows('(SELECT *, 1::int AS lvl, label AS edge_label, ' + chr(39) + 'out' + chr(39) + ' AS direction FROM e) x')}")
def e_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E(order_graph(spark, sf_dir)).project("id")


@_query(" SELECT node_id, name FROM v WHERE label = 'customer' AND segment = 'BUILDING'")
def v_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("customer").with_("segment", "BUILDING")
    return t.properties().select("node_id", g.first_value("properties", "name").alias("name"))


@_query(" SELECT node_id, size FROM v WHERE label = 'part' AND (size IN (1, 5, 9) OR size > 45) AND size <> 47 AND name LIKE '%ring%'")
def v_filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label(P.within("part")).with_("size", P.or_(P.within(1, 5, 9), P.gt(45))).with_("size", P.neq(47)).with_("name", P.like("%ring%"))
    return t.properties().select("node_id", g.first_value("properties", "size").cast("int").alias("size"))


@_query(" SELECT node_id, status FROM v WHERE label = 'order' AND status IN ('F', 'P')")
def v_filter_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("order").with_("status", P.within(["F", "P"]))
    return t.properties().select("node_id", g.first_value("properties", "status").alias("status"))


@_query(f" SELECT 2 * {_SPAN} + o_orderkey AS node_id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def v_filter_between_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("order").with_("orderdate", P.between(dt.datetime(1996, 1, 1), dt.datetime(1996, 6, 30)))
    return t.properties().select("node_id")


@_query(f" SELECT node_id, label, name FROM v WHERE node_id = 5 * {_SPAN} + 7")
def v_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_id(5 * SPAN + 7)
    return t.properties().select("node_id", "label", g.first_value("properties", "name").alias("name"))


@_query(_start("segment = 'MACHINERY'") + _hop("h1", "s", 1, "out", "label = 'placed'") + f" {_rows('h1')}")
def hop_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_("segment", "MACHINERY").out("placed").project("id")


@_query(_NATION + _hop("h1", "s", 1, "in") + f" {_rows('h1')}")
def hop_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).in_().project("id")


@_query(_NATION + _hop("h1", "s", 1, "both") + f" {_rows('h1')}")
def hop_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).both().project("id")


@_query(
    _NATION + _hop("h1", "s", 1, "in", "label = 'inNation'") + _hop("h2", "h1", 2, "out", "label = 'placed'") + _hop("h3", "h2", 3, "out", "label = 'contains'") + f" {_rows('h1', 'h2', 'h3')}"
)
def hop3_customers_orders_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).in_("inNation").out("placed").out("contains").project("id")


@_query(_start("label = 'order' AND status = 'P'") + _hop("h1", "s", 1, "out", "label = 'contains' AND quantity >= 40 AND source IN ('lineitem') AND event_time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'") + f" {_rows('h1')}")
def hop_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("order").with_("status", "P").outE("contains").with_("quantity", P.gte(40))
    return t.with_("source", P.within("lineitem")).with_("event_time", P.between(dt.datetime(1997, 1, 1), dt.datetime(1998, 12, 31))).inV().project("id")


@_query(_start("segment = 'FURNITURE'") + _hop("h1", "s", 1, "out", "label = 'placed' AND {far} IN (SELECT node_id FROM v WHERE label = 'order' AND status = 'P')") + f" {_rows('h1')}")
def hop_far_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_("segment", "FURNITURE").out("placed").with_label("order").with_("status", "P").project("id")


_ENDS = " JOIN v a ON a.node_id = src_id JOIN v b ON b.node_id = dst_id"


@_query(_NATION + _hop("h1", "s", 1, "both") + f" SELECT {_COLUMNS}, a.label AS src_label, b.label AS dst_label, a.name AS src_name, b.name AS dst_name FROM h1" + _ENDS + " WHERE src_id <> dst_id")
def project_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation(spark, sf_dir).both().project("all")
    names = [g.first_value(f"{s}_properties", "name").alias(f"{s}_name") for s in ("src", "dst")]
    return rows.select("src_id", "dst_id", "direction", "lvl", "edge_id", "edge_label", "src_label", "dst_label", *names)


@_query(_start("segment = 'BUILDING'") + _hop("h1", "s", 1, "out", "label = 'placed'") + f" SELECT {_COLUMNS}, a.label AS src_label, b.label AS dst_label FROM h1" + _ENDS)
def project_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_("segment", "BUILDING").out("placed").project("basic")


_TWO = _NATION + _hop("h1", "s", 1, "in", "label = 'inNation'") + _hop("h2", "h1", 2, "out", "label = 'placed'")


def _two(spark: SparkSession, sf_dir: str) -> Traversal:
    return _nation(spark, sf_dir).in_("inNation").as_("customers").out("placed").as_("orders")


@_query(f"{_TWO} {_rows('h1')}")
def select_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).select_level(1)


@_query(f"{_TWO} {_rows('h2')}")
def last_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).last_level()


@_query(f"{_TWO} {_rows('h1')}")
def first_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).first_level()


@_query(f"{_TWO} SELECT {_COLUMNS}, 'customers' AS tag FROM h1 UNION ALL SELECT {_COLUMNS}, 'orders' FROM h2")
def as_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).tagged("customers", "orders")


@_query(f"{_TWO} SELECT {_COLUMNS}, quantity, coalesce(source, 'none') AS by_source FROM h2 JOIN (SELECT edge_id, quantity, source FROM e) q USING (edge_id)")
def edge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _two(spark, sf_dir)
    rows = t.properties().join(t.graph.edges.select("edge_id", "source"), "edge_id")
    quantity = g.first_value("edge_properties", "quantity").cast("bigint").alias("quantity")
    return rows.select("src_id", "dst_id", "direction", "lvl", "edge_id", "edge_label", quantity, by("source", "none").alias("by_source"))


@_query(f"{_TWO}" + _hop("h3", "h2", 3, "out", "label = 'contains'") + " SELECT count(DISTINCT dst_id) AS count FROM h3")
def count_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).out("contains").dedup().count()


@_query(f"{_TWO} SELECT edge_id, dst_id FROM h2 ORDER BY dst_id DESC LIMIT 25")
def limit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).order("cur_id", descending=True).limit(25).last_level().select("edge_id", "dst_id")


@_query(" SELECT e.label AS edge_label, a.label AS src_label, b.label AS dst_label, count(*) AS n FROM e" + _ENDS + " GROUP BY ALL")
def group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E(order_graph(spark, sf_dir)).group("edge_label", "src_label", "dst_label")


@_query(
    _NATION + _hop("h1", "s", 1, "in", "label = 'inNation'") + _hop("a", "h1", 2, "out", "label = 'placed'") + _hop("b1", "h1", 2, "in", "label = 'suppliedBy'")
    + _hop("b2", "b1", 2, "in", "label = 'contains'") + f" {_rows('h1', 'a', 'b2')}"
)
def union_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).in_("inNation").union(lambda t: t.out("placed"), lambda t: t.in_("suppliedBy").in_("contains")).project("id")


@_query(_NATION + _hop("a", "s", 1, "in") + _hop("b", "s", 1, "out") + f" {_rows('a', 'b')}")
def union_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).union(lambda t: t.in_(), lambda t: t.out()).project("id")


@_query(_start("label = 'supplier'") + _hop("a", "s", 1, "out", "label = 'inNation'") + f" {_rows('a')}")
def coalesce_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("supplier")
    return t.coalesce(lambda x: x.out("placed"), lambda x: x.out("inNation"), lambda x: x.in_("suppliedBy")).project("id")


@_query(
    _start("label IN ('customer', 'supplier', 'nation')") + _hop("a", "s", 1, "out", "label = 'placed'") + _hop("b", "s", 1, "out", "label IN ('inNation', 'inRegion')")
    + f", c AS (SELECT * FROM b WHERE prev NOT IN (SELECT prev FROM a)) {_rows('a', 'c')}"
)
def coalesce_per_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label(P.within("customer", "supplier", "nation"))
    return t.coalesce(lambda x: x.out("placed"), lambda x: x.outE().with_label(P.within("inNation", "inRegion")).inV(), per_vertex=True).project("id")


@_query(_TWO + _hop("h3", "h2", 3, "out", "label = 'contains'") + f", h4 AS (SELECT * REPLACE (4::int AS lvl) FROM h3) {_rows('h1', 'h2', 'h3', 'h4')}")
def optional_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).optional(lambda x: x.out("contains")).optional(lambda x: x.out("placed")).project("id")


_REGION = _start("label = 'region' AND name = 'ASIA'")


@_query(_REGION + _hop("h1", "s", 1, "both") + _hop("h2", "h1", 2, "both") + _hop("h3", "h2", 3, "both") + f" {_rows('h1', 'h2', 'h3')}")
def repeat_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_label("region").with_("name", "ASIA").repeat(lambda t: t.both(), times=3).project("id")


_LEFT = "SELECT cur FROM {} WHERE cur NOT IN (SELECT node_id FROM v WHERE label IN ('part', 'supplier'))"


@_query(
    _REGION + _hop("h1", "s", 1, "in") + _hop("h2", f"({_LEFT.format('h1')})", 2, "in") + ", h2out AS (" + _LEFT.format("h2") + ")" + _hop("h3", "h2out", 3, "in") + f" {_rows('h1', 'h2', 'h3')}"
)
def repeat_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("region").with_("name", "ASIA")
    return t.repeat(lambda x: x.in_(), until=P.within("part", "supplier")).project("id")


@_query(_REGION + _hop("h1", "s", 1, "in") + _hop("h2", "h1", 2, "in") + f" {_rows('h2')}")
def repeat_emit_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_label("region").with_("name", "ASIA").repeat(lambda x: x.in_(), times=2, emit="last").project("id")


@_query(_start(f"node_id = 5 * {_SPAN} + 7") + _hop("h1", "s", 1, "both") + _hop("h2", "h1", 2, "both") + f" {_rows('h1', 'h2')}")
def ego_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = order_graph(spark, sf_dir)
    return inv.ego(graph, V(graph).with_id(5 * SPAN + 7).root, 2).project("id")


_IN_1997 = "event_time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND source IN ('orders', 'lineitem')"
_SCOPE = inv.Scope((dt.datetime(1997, 1, 1), dt.datetime(1997, 12, 31)), ("orders", "lineitem"))


@_query(_start("segment = 'HOUSEHOLD'") + _hop("h1", "s", 1, "out", _IN_1997) + _hop("h2", "h1", 2, "out", _IN_1997) + f" {_rows('h1', 'h2')}")
def ego_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = order_graph(spark, sf_dir)
    return inv.ego(graph, V(graph).with_("segment", "HOUSEHOLD").root, 2, "out", scope=_SCOPE).project("id")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each nation: its customers by name and segment; queries ask for a segment, or for all names."""
    rows = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("case"), "c_nationkey").alias("case_id"),
        F.explode(F.array(F.struct(F.lit("segment").alias("property"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("name").alias("property"), F.col("c_name").alias("value")))).alias("p"),
        (F.lit(SPAN) + F.col("c_custkey")).alias("node_id"),
    )
    ask = F.struct(F.when(F.col("case_id") == "case4", "name").otherwise("segment").alias("propertyKey"), F.when(F.col("case_id") == "case4", "all").otherwise("building").alias("propertyValue"))
    return rows.groupBy("case_id").agg(F.collect_list(F.struct("node_id", "p.property", "p.value")).alias("nodes")).withColumn("query", F.array(ask))


@_query(f", s AS (SELECT 1 * {_SPAN} + c_custkey AS cur FROM customer WHERE c_nationkey = 3 AND lower(c_mktsegment) = 'building')" + _hop("h1", "s", 1, "both") + f" {_rows('h1')}")
def ego_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_case(_cases(spark, sf_dir), "case3").both().project("id")


@_query(f" SELECT 1 * {_SPAN} + c_custkey AS node_id FROM customer WHERE c_nationkey = 4")
def case_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V(order_graph(spark, sf_dir)).with_case(_cases(spark, sf_dir), "case4").properties().select("node_id")


SQL["reachability_both"] = f"""WITH RECURSIVE {GRAPH_SQL},
    b AS (SELECT src_id AS x, dst_id AS y FROM e UNION SELECT dst_id, src_id FROM e),
    r(node_id, depth) AS (
        SELECT node_id, 0 FROM v WHERE label = 'region' AND name = 'ASIA'
        UNION SELECT y, depth + 1 FROM r JOIN b ON x = node_id WHERE depth < 3)
    SELECT node_id, min(depth)::int AS depth FROM r GROUP BY node_id"""


def reachability_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = order_graph(spark, sf_dir)
    return reachable(graph, V(graph).with_label("region").with_("name", "ASIA").root, "both", 3)


QUERIES["reachability_both"] = reachability_both


@_query(
    """ SELECT v.node_id, v.label, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(o.d, 0) AS n_out_vertices, coalesce(i.d, 0) AS n_in_vertices
    FROM v LEFT JOIN (SELECT src_id, count(*) AS n, count(DISTINCT dst_id) AS d FROM e GROUP BY src_id) o ON o.src_id = node_id
    LEFT JOIN (SELECT dst_id, count(*) AS n, count(DISTINCT src_id) AS d FROM e GROUP BY dst_id) i ON i.dst_id = node_id"""
)
def adjacency_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(order_graph(spark, sf_dir))


@_query(" SELECT edge_id, src_id, dst_id, label FROM e")
def edge_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = order_graph(spark, sf_dir)
    return g.edges_of_adjacency(g.adjacency(graph), g.unlisted_sources(graph))


@_query(f"{_TWO}, r AS ({_rows('h1', 'h2')}) SELECT DISTINCT node_id, v.label FROM v JOIN r ON node_id IN (src_id, dst_id)")
def result_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).result()[0].select("node_id", "label")


@_query(f"{_TWO}, r AS ({_rows('h1', 'h2')}) SELECT DISTINCT e.edge_id, e.src_id, e.dst_id, e.label, e.event_time, e.source, e.quantity FROM e JOIN r USING (edge_id)")
def result_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = g.first_value("properties", "quantity").cast("bigint").alias("quantity")
    return _two(spark, sf_dir).result()[1].select("edge_id", "src_id", "dst_id", "label", "event_time", "source", quantity)


# Named investigations with the order graph's labels in place of the security graph's.

_AS_ORDERS = {
    "downloadedOn": "contains", "hasIP": "placed", "IPsCommunicated": "suppliedBy", "resolved": "inNation", "runningProcess": "contains",
    "receivedEmail": "contains", "sentEmail": "placed", "clicked": "placed", "userInteracted": "suppliedBy", "loggedIn": "placed", "childProcessOn": "suppliedBy",
    "IP": "order", "URLs": "order", "hosts": "supplier", "withIP": "inNation",
}


def _investigation(name: str, start: Callable[[Traversal], Traversal], labels: dict[str, str] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = order_graph(spark, sf_dir)
        scope = inv.Scope(labels=_AS_ORDERS | (labels or {}))
        return inv.investigate(graph, name, start(V(graph)).root, scope).project("id")

    return run


_RED = "label = 'part' AND name LIKE 'red%' AND size = 7"
_BUILDING = "label = 'customer' AND segment = 'BUILDING'"


def _red(t: Traversal) -> Traversal:
    return t.with_label("part").with_("name", P.like("red%")).with_("size", 7)


def _building(t: Traversal) -> Traversal:
    return t.with_label("customer").with_("segment", "BUILDING")


for _name, _from, _where, _labels, _sql in (
    ("process_user", _red, _RED, {}, _hop("h1", "s", 1, "both", "label = 'contains'") + _hop("h2", "h1", 2, "both", "label = 'placed'") + f" {_rows('h1', 'h2')}"),
    ("process_ip_communicated", _red, _RED, {"downloadedOn": "suppliedBy"}, _hop("h1", "s", 1, "both", "label = 'suppliedBy'") + _hop("h2", "h1", 2, "both", "label = 'suppliedBy'") + f" {_rows('h1', 'h2')}"),
    ("user_process", _building, _BUILDING, {}, _hop("x", "s", 1, "both", "label = 'inNation'") + _hop("a", "x", 1, "out", "label = 'placed'") + _hop("b", "s", 1, "out", "label = 'placed'")
        + f", u AS (SELECT cur FROM a UNION ALL SELECT cur FROM b)" + _hop("h2", "u", 2, "out", "label = 'contains'") + f" {_rows('a', 'b', 'h2')}"),
    ("user_email_user", _red, _RED, {}, _hop("h1", "s", 1, "in", "label = 'contains'") + _hop("h2", "h1", 2, "in", "label = 'placed'") + _hop("h3", "h2", 3, "out", "label = 'placed'")
        + _hop("h4", "h3", 4, "out", "label = 'contains'") + _hop("h5", "h4", 5, "out", "label = 'placed'") + f" {_rows('h1', 'h2', 'h3', 'h4', 'h5')}"),
    ("user_URL_user", _building, _BUILDING, {"clicked": "inNation"}, _hop("h1", "s", 1, "out", "label = 'inNation'") + _hop("h2", "h1", 2, "in", "label = 'inNation'") + f" {_rows('h1', 'h2')}"),
    ("ip_user", _red, _RED, {"hasIP": "contains"}, _hop("a", "s", 1, "in", "label = 'contains'") + _hop("b", "s", 1, "in", "label = 'suppliedBy'") + f" {_rows('a', 'b')}"),
    ("process_ip", _red, _RED, {}, _hop("h1", "s", 1, "in", "label = 'contains'") + f" {_rows('h1')}"),
    ("process_downloaded_on", _red, _RED, {}, _hop("b", "s", 1, "out", "label = 'suppliedBy' AND {far} IN (SELECT node_id FROM v WHERE label = 'supplier')") + f" {_rows('b')}"),
    ("user_touched_host", _building, _BUILDING, {}, _hop("h1", "s", 1, "out", "label = 'placed' AND {far} IN (SELECT node_id FROM v WHERE label = 'order')") + f" {_rows('h1')}"),
    ("user_clicked_url", _building, _BUILDING, {}, _hop("h1", "s", 1, "out", "label = 'placed' AND {far} IN (SELECT node_id FROM v WHERE label = 'order')") + f" {_rows('h1')}"),
):
    QUERIES[f"investigate_{_name}"] = _investigation(_name, _from, _labels)
    SQL[f"investigate_{_name}"] = f"WITH {GRAPH_SQL}{_start(_where)}{_sql}"


@_query(
    f"""{_start(_BUILDING)},
    d AS (SELECT src_id AS process_id, dst_id AS place_id, min(event_time) OVER (PARTITION BY src_id) AS first_time FROM e WHERE label = 'placed' AND src_id IN (SELECT cur FROM s)),
    f AS (SELECT DISTINCT * FROM d),
    c AS (SELECT src_id AS prev, dst_id AS cur, edge_id, event_time FROM e WHERE label = 'contains' UNION ALL SELECT dst_id, src_id, edge_id, event_time FROM e WHERE label = 'contains')
    SELECT process_id, place_id, first_time, edge_id, cur AS other_id, event_time FROM f JOIN c ON place_id = prev AND event_time >= first_time AND event_time < first_time + INTERVAL 90 DAYS"""
)
def investigate_communicated_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = order_graph(spark, sf_dir)
    scope = inv.Scope(labels=_AS_ORDERS | {"downloadedOn": "placed", "IPsCommunicated": "contains"})
    return inv.communicated_after(graph, _building(V(graph)).root, "90 days", scope)
