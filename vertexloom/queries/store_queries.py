"""Queries over graphs that are mapped from security records, streamed into stored tables and read back, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.text import JUNK
from vertexloom.lineage import ensure_checkpoint_dir
from vertexloom.operators.mapper import node_key
from vertexloom.operators.nested import nested_ego, store_adjacency
from vertexloom.operators.traversal import V
from vertexloom.plans import cases as cs
from vertexloom.plans import investigations as inv
from vertexloom.plans import many
from vertexloom.plans.delta import DeltaStore
from vertexloom.plans.expansion import EventSource, expand_sources
from vertexloom.plans.security import MAPPERS
from vertexloom.queries.graph_queries import _IN_1997, _REGION, _SCOPE, GRAPH_SQL, _cases, _hop, _rows
from vertexloom.queries.record_queries import _EXPECTED, _security
from vertexloom.queries.table_queries import _case_table
from vertexloom.sources.tables import SPAN, order_graph, read
from vertexloom.streaming.ingest import ingest, ingest_counters
from vertexloom.streaming.store import GraphTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Rows from this time on arrive in a second file, after which some of the rows before are repeated.
_HALF = "2024-01-16"


def _arrive(records: DataFrame, time_col: str, path: str, halves: bool) -> int | None:
    """Files of records: all at once, or by time in two halves, of which the second repeats a tenth of the first; the files of a half."""
    if not halves:
        return records.write.parquet(path)
    early = F.col(time_col) < F.lit(_HALF).cast("timestamp_ntz")
    records.filter(early).write.mode("append").parquet(path)
    files = len(records.sparkSession.read.schema(records.schema).parquet(path).inputFiles())
    records.filter(~early | (F.col("record") % 10 == 0)).coalesce(files).write.mode("append").parquet(path)
    return files


def _loaded(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], buckets: int = 2) -> GraphTables:
    """The events as records of some kinds, all streamed into the same tables, two of the kinds in two micro-batches, then compacted."""
    folder = _folder(spark, "stored")
    tables = GraphTables(spark, f"{folder}/graph", buckets)
    for kind in kinds:
        records = _security(spark, sf_dir, kind, spark.sparkContext.defaultParallelism).withColumn("ds", F.lit(kind))
        files = _arrive(records, "event_ts", f"{folder}/{kind}", kind in ("sysmon", "mail"))
        ingest(
            spark, f"{folder}/{kind}", records.schema, tables, f"{folder}/state-{kind}", MAPPERS[kind], "record", "event_ts", "ds", late="1 day", stream=kind, files_per_batch=files
        ).awaitTermination()
    tables.compact()
    return tables


_KINDS = ("sysmon", "windows", "mail", "firewall", "endpoint")
_TIME = (dt.datetime(2024, 1, 14), dt.datetime(2024, 1, 17, 12))
_SOURCES = ("sysmon", "windows", "mail", "firewall")


def _edges_sql(kinds: tuple[str, ...], where: str = "TRUE") -> str:
    """A view e of the edges of records, ids being label and name."""
    parts, views = [], []
    for kind in kinds:
        lists, labels, links = _EXPECTED[kind]
        views.append(f"r_{kind} AS (SELECT event_id, ts, {lists} FROM events)")
        for x, label, y in (link.split() for link in links.split(",")):
            parts.append(
                f"SELECT DISTINCT '{label}' AS label, '{labels[x]}' AS src_label, x AS src_name, '{labels[y]}' AS dst_label, y AS dst_name, ts AS event_time, '{kind}' AS source"
                f" FROM (SELECT ts, unnest({x}) AS x, {y} AS ys FROM r_{kind}), unnest(ys) u(y)"
            )
    return f"""{', '.join(views)}, p AS ({' UNION '.join(parts)}), e AS MATERIALIZED (
        SELECT concat_ws('|', src_label, src_name, label, dst_label, dst_name, event_time, source) AS edge_id, src_label || ':' || src_name AS src_id, dst_label || ':' || dst_name AS dst_id,
               label, event_time, source FROM p WHERE src_name <> '-' AND dst_name <> '-' AND {where})"""


def _label(*labels: str) -> str:
    return f"label IN ({', '.join(repr(x) for x in labels)})"


def _far(label: str) -> str:
    return f" AND {{far}} LIKE '{label}:%'"


#: Investigations by name: start vertices, hops as (view, the view before, level, direction, condition), and the views of the result.
_STORED = {
    "process_user": (["process:parent1.exe", "process:parent3.exe"], [("1", "s", 1, "both", _label("downloadedOn")), ("2", "1", 2, "both", _label("hasIP"))], ["1", "2"]),
    "process_ip_communicated": (["process:parent2.exe"], [("1", "s", 1, "both", _label("downloadedOn")), ("2", "1", 2, "both", _label("IPsCommunicated"))], ["1", "2"]),
    "user_process": (["user:user7", "user:target9"], [("x", "s", 1, "both", _label("resolved")), ("a", "x", 1, "out", _label("hasIP")), ("b", "s", 1, "out", _label("hasIP"))], ["a", "b"]),
    "user_email_user": (
        ["user:list2@acme.com"],
        [
            ("1", "s", 1, "in", _label("receivedEmail")), ("2", "1", 2, "in", _label("sentEmail")), ("3", "2", 3, "out", _label("sentEmail")), ("4", "3", 4, "out", _label("receivedEmail")),
            ("5", "4", 5, "out", _label("clicked")),
        ],
        ["1", "2", "3", "4", "5"],
    ),
    "user_URL_user": (["user:user5@acme.com"], [("1", "s", 1, "out", _label("clicked")), ("2", "1", 2, "in", _label("clicked"))], ["1", "2"]),
    "ip_user": (["IP:10.1.0.5", "IP:10.6.0.7"], [("a", "s", 1, "in", _label("hasIP")), ("b", "s", 1, "in", _label("userInteracted"))], ["a", "b"]),
    "process_ip": (["process:parent1.exe"], [("1", "s", 1, "in", _label("runningProcess"))], ["1"]),
    "process_downloaded_on": (["process:parent4.exe", "process:child2.exe"], [("1", "s", 1, "out", _label("downloadedOn") + _far("IP"))], ["1"]),
    "user_touched_host": (["user:target5", "user:user8"], [("1", "s", 1, "out", _label("loggedIn") + _far("IP"))], ["1"]),
    "user_clicked_url": (["user:user5@acme.com", "user:svc1"], [("1", "s", 1, "out", _label("clicked") + _far("URLs"))], ["1"]),
}


def _stored_sql() -> str:
    start, end = (t.isoformat(" ") for t in _TIME)
    sql = "WITH " + _edges_sql(_SOURCES, f"event_time BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'")
    results = []
    for n, (name, (starts, hops, views)) in enumerate(_STORED.items()):
        sql += f", i{n}s AS (SELECT unnest({starts}) AS cur)"
        sql += "".join(_hop(f"i{n}{view}", f"i{n}{before}", lvl, way, where) for view, before, lvl, way, where in hops)
        results.append(f"SELECT '{name}' AS name, * FROM ({_rows(*[f'i{n}{v}' for v in views])})")
    return f"{sql} SELECT name, src_id AS src, dst_id AS dst, direction, lvl, edge_label, count(*) AS n FROM ({' UNION ALL '.join(results)}) GROUP BY ALL"


@_query(_stored_sql())
def stored_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named investigations with a time range and sources over a graph that five kinds of records were streamed into."""
    graph = _loaded(spark, sf_dir, _KINDS).graph(time=_TIME)
    scope = inv.Scope(_TIME, _SOURCES, {"hosts": "host"})
    found = None
    for name, (starts, _, _) in _STORED.items():
        named = spark.createDataFrame([tuple(s.split(":", 1)) for s in starts], "label string, identifier string")
        ids = named.select(node_key(F.col("label"), F.col("identifier")).alias("node_id"))
        rows = inv.investigate(graph, name, ids, scope).project("id").withColumn("name", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    counted = found.groupBy("name", "src_id", "dst_id", "direction", "lvl", "edge_label").agg(F.count("*").alias("n"))
    for side in ("src", "dst"):
        names = graph.vertices.select(F.col("node_id").alias(f"{side}_id"), F.concat_ws(":", "label", "identifier").alias(side))
        counted = counted.join(names, f"{side}_id")
    return counted.select("name", "src", "dst", "direction", "lvl", "edge_label", "n")


# Many cases, many requests, nested rows


@_query(f"""WITH {GRAPH_SQL},
    s AS (SELECT 'case' || c_nationkey AS case_id, 1 * {SPAN} + c_custkey AS cur FROM customer WHERE c_nationkey = 4 OR lower(c_mktsegment) = 'building'),
    t AS MATERIALIZED (SELECT * FROM e WHERE {_IN_1997}),
    h1 AS MATERIALIZED (SELECT case_id, dst_id AS cur, src_id, dst_id, 'out' AS direction, 1::int AS lvl, edge_id, label AS edge_label FROM t JOIN s ON src_id = s.cur WHERE label = 'placed'),
    h2 AS MATERIALIZED (SELECT case_id, dst_id AS cur, src_id, dst_id, 'out' AS direction, 2::int AS lvl, edge_id, label AS edge_label FROM t JOIN (SELECT DISTINCT case_id, cur FROM h1) f ON src_id = f.cur WHERE label = 'contains'),
    h3 AS MATERIALIZED (SELECT case_id, src_id AS cur, src_id, dst_id, 'in' AS direction, 3::int AS lvl, edge_id, label AS edge_label FROM t JOIN (SELECT DISTINCT case_id, cur FROM h2) f ON dst_id = f.cur WHERE label = 'contains')
    SELECT case_id, src_id, dst_id, direction, lvl, edge_id, edge_label FROM h1 UNION ALL SELECT case_id, src_id, dst_id, direction, lvl, edge_id, edge_label FROM h2
    UNION ALL SELECT case_id, src_id, dst_id, direction, lvl, edge_id, edge_label FROM h3""")
def cases_of_all_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of all nations at once: orders of their customers, their parts, and other orders of these."""
    starts = many.case_starts(_cases(spark, sf_dir))
    hops = [("out", "placed", "order"), ("out", "contains", None), ("in", "contains", None)]
    return many.investigate_cases(order_graph(spark, sf_dir), starts, hops, _SCOPE).rows()


#: A request for each customer's last order: its priority and its first supplier, for a few days, of one or two sources.
_REQUESTS_SQL = """SELECT o_orderkey AS request_id, o_custkey, o_orderpriority AS priority, o_orderdate + INTERVAL 3 DAYS AS query_start, o_orderdate + INTERVAL 9 DAYS AS query_end,
    CASE WHEN o_orderstatus = 'P' THEN ['web'] ELSE ['mail', 'web'] END AS datasources, 'S' || (o_orderkey % 100) AS supplier FROM orders"""


@_query(f"""WITH r AS ({_REQUESTS_SQL}),
    c AS (SELECT o_orderkey AS case_id, lower(o_orderpriority) AS priority, o_orderdate AS query_start, o_orderdate + INTERVAL 30 DAYS AS query_end,
        CASE o_orderstatus WHEN 'F' THEN ['mail', 'web'] WHEN 'O' THEN ['all'] ELSE ['web'] END AS datasources FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    n AS (SELECT DISTINCT l_orderkey AS case_id, 's' || l_suppkey AS supplier FROM lineitem)
    SELECT request_id, c.case_id FROM r JOIN n ON n.supplier = lower(r.supplier) JOIN c ON c.case_id = n.case_id AND c.priority = lower(r.priority)
        AND c.query_start <= r.query_start AND c.query_end >= r.query_end AND (list_has_all(c.datasources, r.datasources) OR list_contains(c.datasources, 'all'))""")
def requests_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a request made of each order, the cases that already hold its export: every pair, the time range and the sources."""
    pair = lambda k, v: F.struct(F.lit(k).alias("propertyKey"), v.alias("propertyValue"))
    o = read(spark, sf_dir, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("request_id"), F.array(pair("priority", F.upper("o_orderpriority")), pair("supplier", F.concat(F.lit("S"), F.col("o_orderkey") % 100))).alias("query"),
        (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("query_start"), (F.col("o_orderdate") + F.expr("INTERVAL 9 DAYS")).alias("query_end"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("web"))).otherwise(F.array(F.lit("mail"), F.lit("web"))).alias("datasources"),
    )
    return cs.covered_requests(_case_table(spark, sf_dir), requests)


@_query(f"WITH {GRAPH_SQL}{_REGION}" + _hop("h1", "s", 1, "both") + _hop("h2", "h1", 2, "both") + _hop("h3", "h2", 3, "both") + f" {_rows('h1', 'h2', 'h3')}")
def nested_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood of a region up to three hops, over nested rows that are stored in buckets by vertex."""
    graph = order_graph(spark, sf_dir)
    stored = store_adjacency(graph, f"adjacency_{uuid.uuid4().hex}", _folder(spark, "adjacency"), 8)
    return nested_ego(stored, V(graph).with_label("region").with_("name", "ASIA").root, 3)


# Counters in stretches of time


@_query(f"""WITH {_edges_sql(("windows",))},
    r AS (SELECT 'user:' || t[1] AS src, 'IP:' || a[1] AS dst, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS begin FROM r_windows WHERE a[1] <> '-')
    SELECT src, dst, begin, count(*) AS counter FROM r WHERE begin + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY src, dst, begin""")
def windowed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins counted in stretches of twelve hours by a stream over two files, some rows of the first stretch arriving late in the second."""
    folder = _folder(spark, "counters")
    records = _security(spark, sf_dir, "windows").withColumn("ds", F.lit("windows"))
    half = F.lit(_HALF).cast("timestamp_ntz")
    late = (F.col("record") % 7 == 3) & (F.col("event_ts") >= half - F.expr("INTERVAL 12 HOURS"))
    early = (F.col("event_ts") < half) & ~late
    records.filter(early).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    records.filter(~early | (F.col("record") % 10 == 0)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    logins = tuple(replace(e, aggregate="counter-eventTime-12h") for e in MAPPERS["windows"].edges if e.label == "loggedIn")
    tables = GraphTables(spark, f"{folder}/graph", 2)
    ingest_counters(
        spark, f"{folder}/in", records.schema, tables, f"{folder}/state", replace(MAPPERS["windows"], edges=logins), "record", "event_ts", "ds", late="1 day", files_per_batch=1
    ).awaitTermination()
    graph = tables.graph()
    rows = graph.edges.select("src_id", "dst_id", F.col("event_time").alias("begin"), F.try_element_at(F.try_element_at("properties", F.lit("counter")), F.lit(1)).cast("bigint").alias("counter"))
    for side in ("src", "dst"):
        rows = rows.join(graph.vertices.select(F.col("node_id").alias(f"{side}_id"), F.concat_ws(":", "label", "identifier").alias(side)), f"{side}_id")
    return rows.select("src", "dst", "begin", "counter")


# Loads


@_query(f"""WITH a AS (SELECT *, ts >= TIMESTAMP '{_HALF}' AS second FROM events WHERE event_type <> 'signup'),
    d AS (SELECT second, min(ts) - INTERVAL 30 SECONDS AS low, max(ts) + INTERVAL 30 SECONDS AS high, list(DISTINCT event_type) AS sources FROM a GROUP BY second)
    SELECT second::bigint AS load, event_id FROM d JOIN (SELECT event_id, ts, event_type, second AS own FROM a) x
        ON ts BETWEEN low AND high AND list_contains(sources, event_type) AND own <= second""")
def delta_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals, each loaded by its time range and sources from the days of the range only; a third run finds nothing."""
    events = read(spark, sf_dir, "events").filter("event_type <> 'signup'")
    store = DeltaStore(spark, _folder(spark, "delta"), "event_id long, ts timestamp_ntz, event_type string", "event_id", "ts", "event_type")
    taken = _folder(spark, "taken")
    for number, condition in enumerate((f"ts < '{_HALF}'", f"ts >= '{_HALF}'")):
        store.arrive(number, events.filter(condition).select("event_id", "ts", "event_type"))
        for _ in range(2):  # the second one finds nothing
            store.load(lambda n, rows: rows.select("event_id").write.mode("overwrite").parquet(f"{taken}/load={n}"))
    return spark.read.schema("event_id long, load long").parquet(taken)


_PEOPLE_SQL = "SELECT c_custkey AS k, lower(c_name) AS name, CASE WHEN c_custkey % 10 = 0 THEN 'atlantis' ELSE 'nation_' || c_nationkey END AS nation FROM customer"


@_query(f"""WITH p AS ({_PEOPLE_SQL}),
    n AS (SELECT DISTINCT 'nation' AS label, lower(n_name) AS identifier FROM nation UNION ALL SELECT 'customer', name FROM p)
    SELECT 'vertex' AS kind, label AS a, identifier AS b FROM n
    UNION ALL SELECT 'edge', name, nation FROM p WHERE nation <> 'atlantis'
    UNION ALL SELECT 'vertex is known', 'customer:' || name, '1' FROM p WHERE k % 3 = 0
    UNION ALL SELECT 'edge is known', 'e' || k, '1' FROM p WHERE k % 3 = 0 AND nation <> 'atlantis'
    UNION ALL SELECT 'end is unknown', 'e' || k, '0' FROM p WHERE k % 3 = 0 AND nation = 'atlantis'
    UNION ALL SELECT 'end is unknown', 'e' || k, '1' FROM p WHERE nation = 'atlantis'""")
def inserts_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices, edges and the error report after two inserts, the second of which was tried twice and repeats a third of the first."""
    tables = GraphTables(spark, _folder(spark, "inserts"), 4)
    none = F.create_map().cast("map<string,array<string>>")
    people = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.lower("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, "atlantis").otherwise(F.concat(F.lit("nation_"), "c_nationkey")).alias("nation")
    )
    nations = read(spark, sf_dir, "nation").select(F.lit("nation").alias("label"), F.lower("n_name").alias("identifier"))
    for number, some in ((0, people.filter("k % 3 = 0")), (1, people), (1, people)):
        nodes = some.select(F.lit("customer").alias("label"), F.col("name").alias("identifier"))
        nodes = nodes if number else nodes.unionByName(nations)
        edges = some.select(
            F.concat(F.lit("e"), "k").alias("edge_id"), node_key(F.lit("customer"), F.col("name")).alias("src_id"), node_key(F.lit("nation"), F.col("nation")).alias("dst_id"),
            F.lit("inNation").alias("label"), none.alias("properties"),
        )
        tables.insert(number, nodes.withColumn("properties", none), edges)
    nodes, edges = tables.read()
    name = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("identifier").alias(side))
    ends = edges.join(name("src"), "src_id").join(name("dst"), "dst_id")
    return (
        nodes.select(F.lit("vertex").alias("kind"), F.col("label").alias("a"), F.col("identifier").alias("b"))
        .unionByName(ends.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))
        .unionByName(tables.errors().select(F.col("error").alias("kind"), F.col("element").alias("a"), F.col("number").cast("string").alias("b")))
    )


# Expansion over several sources


_EXPANDED_TIME = (dt.datetime(1997, 1, 1), dt.datetime(2024, 1, 12))


def _expanded_sql() -> str:
    low, high = (f"TIMESTAMP '{t.isoformat(' ')}'" for t in _EXPANDED_TIME)
    named = f"""n AS MATERIALIZED (
        SELECT 'events' AS source, event_id, 'person' AS kind, 'u' || user_id AS value FROM events WHERE ts BETWEEN {low} AND {high}
        UNION SELECT 'events', event_id, 'day', strftime(ts, '%m-%d') || event_type FROM events WHERE ts BETWEEN {low} AND {high}
        UNION SELECT 'orders', o_orderkey, 'person', 'u' || o_custkey FROM orders WHERE o_orderdate BETWEEN {low} AND {high}
        UNION SELECT 'orders', o_orderkey, 'order', 'o' || o_orderkey FROM orders WHERE o_orderdate BETWEEN {low} AND {high}
        UNION SELECT 'lineitem', l_orderkey * 10 + l_linenumber, 'order', 'o' || l_orderkey FROM lineitem WHERE l_shipdate BETWEEN {low} AND {high}
        UNION SELECT 'lineitem', l_orderkey * 10 + l_linenumber, 'part', 'p' || l_partkey FROM lineitem WHERE l_shipdate BETWEEN {low} AND {high}),
    m AS MATERIALIZED (SELECT * FROM n WHERE value NOT IN ('p7', 'u3')),
    v0 AS (SELECT * FROM (VALUES ('person', 'u5'), ('person', 'u11'), ('part', 'p12'), ('order', 'u5'), ('person', 'u3')) x(kind, value)),
    e0 AS MATERIALIZED (SELECT DISTINCT source, event_id FROM m JOIN v0 USING (kind, value))"""
    for k in (1, 2):
        seen = " UNION ALL ".join(f"SELECT source, event_id FROM e{i}" for i in range(k))
        named += f""", v{k} AS MATERIALIZED (SELECT DISTINCT kind, value FROM m JOIN e{k - 1} USING (source, event_id)),
        e{k} AS MATERIALIZED (SELECT DISTINCT source, event_id FROM m JOIN v{k} USING (kind, value) EXCEPT ({seen}))"""
    return f"WITH {named} " + " UNION ALL ".join(f"SELECT source, event_id, {k}::int AS level FROM e{k}" for k in range(3))


@_query(_expanded_sql())
def sources_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels around some people and a part, over events, orders and lines, each value followed in its kind only."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("U"), "user_id").alias("who"), F.concat(F.date_format("ts", "MM-dd"), "event_type").alias("day"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("u"), "o_custkey").alias("who"), F.concat(F.lit("O"), "o_orderkey").alias("number"))
    lines = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_shipdate", F.concat(F.lit("o"), "l_orderkey").alias("number"), F.concat(F.lit("P"), "l_partkey").alias("part")
    )
    sources = [
        EventSource("events", events, "event_id", "ts", {"person": ["who"], "day": ["day"]}),
        EventSource("orders", orders, "o_orderkey", "o_orderdate", {"person": ["who"], "order": ["number"]}),
        EventSource("lineitem", lines, "line", "l_shipdate", {"order": ["number"], "part": ["part"]}),
    ]
    seeds = spark.createDataFrame([("person", "U5"), ("person", "u11"), ("part", "p12"), ("order", "u5"), ("person", "u3")], "kind string, value string")
    return expand_sources(sources, seeds, 3, _EXPANDED_TIME, skip=("p7", "u3", *JUNK))
