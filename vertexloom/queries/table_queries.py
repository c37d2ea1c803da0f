"""Queries of mapping, upserts, expansion, grouping, cases and logs over the driver tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.analytics import alerts as al
from vertexloom.analytics import summaries as su
from vertexloom.functions import logs, text
from vertexloom.lineage import ensure_checkpoint_dir
from vertexloom.operators import expand as ex
from vertexloom.operators import upsert as up
from vertexloom.operators.mapper import Call, EdgeMap, Mapper, NodeMap, edge_key, first_of_each, map_edges, map_nodes, node_key, unpaired
from vertexloom.plans import cases as cs
from vertexloom.sources.records import Source, columns_of, read_sources
from vertexloom.sources.tables import read
from vertexloom.streaming.ingest import GraphTables, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Mapping

#: Events as a log: who did what, through which address.
EVENTS = Mapper(
    nodes=(
        NodeMap("user", {"userName": "user_name", "seenBy": "default=Events"}, "userName"),
        NodeMap("action", {"fileName": "event_type"}, "fileName"),
        NodeMap("IP", {"ip": "analyze-addresses"}, "ip"),
    ),
    edges=(
        EdgeMap("did", "user.userName(user_name)", "action.fileName(event_type)", {"key": "event_type+bucket", "size": "size|bucket"}),
        EdgeMap("hasIP", "user.userName(user_name)", "IP.ip(analyze-addresses)"),
        EdgeMap("talked", "IP.ip(analyze-addresses)", "IP.ip(analyze-sources)"),
    ),
    calls={"addresses": Call("recipients", ("addresses",), many=True), "sources": Call("recipients", ("sources",), many=True)},
)


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with fields as logs write them: domains, semicolon lists, dashes for nothing."""
    k = F.get_json_object("props", "$.k").cast("int")
    quad = lambda a, b: F.concat(F.lit("10.0."), a.cast("string"), F.lit("."), b.cast("string"))
    a, b = quad(k % 4, F.col("user_id") % 200), quad(k % 3, F.col("user_id") % 100)
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("User"), "user_id").alias("user_name"), "event_type", (k % 10).cast("string").alias("bucket"),
        F.when(k % 5 == 0, "-").otherwise((k % 7).cast("string")).alias("size"),
        F.when(k % 2 == 0, a).otherwise(F.concat(a, F.lit(";"), b)).alias("addresses"),
        F.when(k % 3 == 0, F.concat(b, F.lit(";"), a)).when(k % 3 == 1, b).otherwise(F.concat(a, F.lit(";"), b, F.lit(";10.9.9.9"))).alias("sources"),
        F.lit("events").alias("ds"),
    )


_LOG = """
    p AS (SELECT event_id, ts, 'User' || user_id AS user_name, event_type, (props->>'k')::int AS k, user_id FROM events),
    q AS (SELECT *, '10.0.' || (k % 4) || '.' || (user_id % 200) AS a, '10.0.' || (k % 3) || '.' || (user_id % 100) AS b FROM p),
    log AS (SELECT event_id, ts, lower(user_name) AS user_name, event_type, k % 10 AS bucket, CASE WHEN k % 5 = 0 THEN '-' ELSE (k % 7)::varchar END AS size,
                   CASE WHEN k % 2 = 0 THEN [a] ELSE [a, b] END AS l,
                   CASE WHEN k % 3 = 0 THEN [b, a] WHEN k % 3 = 1 THEN [b] ELSE [a, b, '10.9.9.9'] END AS r FROM q)"""


@_query(f"""WITH {_LOG} SELECT event_id, 'user' AS label, user_name AS identifier, 'events' AS seen_by FROM log
    UNION ALL SELECT event_id, 'action', event_type, NULL FROM log UNION ALL SELECT event_id, 'IP', unnest(l), NULL FROM log""")
def mapper_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = map_nodes(_event_log(spark, sf_dir), EVENTS, ("event_id",))
    return nodes.select("event_id", "label", "identifier", F.try_element_at(F.try_element_at("properties", F.lit("seenBy")), F.lit(1)).alias("seen_by"))


_EDGES = f"""WITH {_LOG}, pairs AS (
        SELECT event_id, ts, 'did' AS label, user_name AS src_identifier, event_type AS dst_identifier, event_type || bucket AS key,
               CASE WHEN size IN ('-', '') THEN bucket::varchar ELSE size END AS size FROM log
        UNION ALL SELECT event_id, ts, 'hasIP', user_name, unnest(l), NULL, NULL FROM log
        UNION ALL SELECT event_id, ts, 'talked', l[least(i, len(l))], r[least(i, len(r))], NULL, NULL
            FROM log, LATERAL (SELECT unnest(range(1, greatest(len(l), len(r)) + 1)) AS i) WHERE len(l) = 1 OR len(r) = 1 OR len(l) = len(r))"""


@_query(f"{_EDGES} SELECT event_id, label, src_identifier, dst_identifier, key, size FROM pairs")
def mapper_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k: F.try_element_at(F.try_element_at("properties", F.lit(k)), F.lit(1)).alias(k)
    return map_edges(_event_log(spark, sf_dir), EVENTS, ("event_id",)).select("event_id", "label", "src_identifier", "dst_identifier", one("key"), one("size"))


@_query(f"WITH {_LOG} SELECT event_id, 'talked' AS labels FROM log WHERE len(l) <> 1 AND len(r) <> 1 AND len(l) <> len(r)")
def mapper_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpaired(_event_log(spark, sf_dir), EVENTS).select("event_id", F.array_join("unpaired_labels", ",").alias("labels"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(map_nodes(_event_log(spark, sf_dir), EVENTS, ("event_id",)), "event_id")


@_query(f"""WITH {_LOG} SELECT DISTINCT 'user' AS label, user_name AS identifier FROM log
    UNION ALL SELECT DISTINCT 'action', event_type FROM log UNION ALL SELECT DISTINCT 'IP', unnest(l) FROM log""")
def dedup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("label", "identifier")


def _mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = map_edges(_event_log(spark, sf_dir), EVENTS, ("event_id", "ts"))
    keys = [F.col(c) for c in ("src_label", "src_identifier", "label", "dst_label", "dst_identifier")]
    return ends.withColumn("edge_id", edge_key(*keys, F.lit("events"), F.lit("")))


_EDGE_ID = """sha256(CASE label WHEN 'talked' THEN 'IP' ELSE 'user' END || '|' || src_identifier || '|' || label || '|'
    || CASE label WHEN 'did' THEN 'action' ELSE 'IP' END || '|' || dst_identifier || '|events|')"""


@_query(f"{_EDGES} SELECT DISTINCT {_EDGE_ID} AS edge_id, label FROM pairs")
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped_edges(spark, sf_dir).dropDuplicates(["edge_id"]).select("edge_id", "label")


@_query(f"""{_EDGES}, known AS (SELECT DISTINCT unnest(l) AS ip FROM log)
    SELECT DISTINCT label, src_identifier, dst_identifier FROM pairs
    WHERE (label <> 'talked' OR src_identifier IN (SELECT ip FROM known)) AND (label = 'did' OR dst_identifier IN (SELECT ip FROM known))""")
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).withColumn("node_id", node_key(F.col("label"), F.col("identifier")))
    return up.resolve_ends(_mapped_edges(spark, sf_dir), nodes).select("label", "src_identifier", "dst_identifier").distinct()


# Upserts


def _people(spark: SparkSession, sf_dir: str, nations: DataFrame | None, segment: str) -> DataFrame:
    """Customers as vertices: their segment as one value, their nation and another one as a list."""
    c = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") >= segment)
    value = F.array(F.lit("old") if segment == "A" else F.col("c_mktsegment"))
    places = F.array(F.col("c_nationkey").cast("string"), F.lit("x" if segment == "A" else "y"))
    held = F.map_from_arrays(F.array(F.lit("segment"), F.lit("places"), F.lit("a" if segment == "A" else "b")), F.array(value, places, F.array(F.lit("1"))))
    return c.select(F.lit("customer").alias("label"), F.lower("c_name").alias("identifier"), held.alias("properties"))


_PEOPLE = """
    o AS (SELECT lower(c_name) AS identifier, 'old' AS segment, c_nationkey AS n FROM customer WHERE c_nationkey < 15),
    i AS (SELECT lower(c_name) AS identifier, c_mktsegment AS segment, c_nationkey AS n FROM customer WHERE c_mktsegment >= 'F')"""


def _upserted(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    inside = customers.filter("c_nationkey < 15").select(F.lower("c_name").alias("identifier"))
    old = _people(spark, sf_dir, None, "A").join(inside, "identifier", "left_semi").withColumn("node_id", node_key(F.col("label"), F.col("identifier")))
    merged = up.upsert_nodes(old, _people(spark, sf_dir, None, "F"), keep)
    joined = lambda k: F.array_join(F.array_sort(F.try_element_at("properties", F.lit(k))), ",").alias(k)
    return merged.select("identifier", joined("segment"), joined("places"), F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys"))


def _upsert_sql(keep: str) -> str:
    return f"""WITH {_PEOPLE} SELECT identifier, CASE WHEN i.n IS NULL THEN o.segment WHEN o.n IS NULL THEN i.segment ELSE {keep}.segment END AS segment,
        CASE WHEN i.n IS NULL THEN o.n || ',x' WHEN o.n IS NULL THEN i.n || ',y' ELSE o.n || ',x,y' END AS places,
        CASE WHEN i.n IS NULL THEN 'a,places,segment' WHEN o.n IS NULL THEN 'b,places,segment' ELSE 'a,b,places,segment' END AS keys
        FROM o FULL JOIN i USING (identifier)"""


@_query(_upsert_sql("o"))
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, "old")


@_query(_upsert_sql("i"))
def upsert_nodes_keep_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, "new")


@_query("""SELECT 'placed:' || o_orderkey AS edge_id, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN 'big,done' WHEN o_totalprice > 200000 THEN 'big' ELSE 'done' END AS marks
    FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'F'""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("placed:"), "o_orderkey").alias("edge_id"), F.col("o_custkey").alias("src_id"), F.col("o_orderkey").alias("dst_id"), F.lit("placed").alias("label"), "o_totalprice", "o_orderstatus"
    )
    marked = lambda df, m: df.withColumn("properties", F.create_map(F.lit("mark"), F.array(F.lit("z"), F.lit(m))))
    merged = up.upsert_edges(marked(orders.filter("o_totalprice > 200000"), "big"), marked(orders.filter("o_orderstatus = 'F'"), "done"))
    marks = F.filter(F.try_element_at("properties", F.lit("mark")), lambda m: m != "z")
    return merged.select("edge_id", F.array_join(F.array_sort(marks), ",").alias("marks"))


@_query("SELECT lower(c_name) AS identifier, c_nationkey < 15 AS known FROM customer WHERE c_mktsegment >= 'F' OR c_nationkey < 15")
def insert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("label"), F.lower("c_name").alias("identifier"), F.create_map().cast("map<string,array<string>>").alias("properties"), "c_nationkey", "c_mktsegment")
    old = c.filter("c_nationkey < 15").withColumn("node_id", node_key(F.col("label"), F.col("identifier")))
    after, _ = up.insert_nodes(old, c.filter("c_mktsegment >= 'F'"))
    return after.join(old.select("identifier", F.lit(True).alias("known")), "identifier", "left").select("identifier", F.coalesce("known", F.lit(False)).alias("known"))


@_query("SELECT o_orderkey, min(c_custkey) AS src_id FROM orders JOIN customer ON c_mktsegment = CASE o_orderstatus WHEN 'F' THEN 'FURNITURE' WHEN 'O' THEN 'BUILDING' ELSE 'MACHINERY' END GROUP BY ALL")
def edge_ends_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.create_map(F.lit("segment"), F.array("c_mktsegment")).alias("properties"))
    wanted = F.when(F.col("o_orderstatus") == "F", "FURNITURE").when(F.col("o_orderstatus") == "O", "BUILDING").otherwise("MACHINERY")
    elements = read(spark, sf_dir, "orders").select("o_orderkey", wanted.alias("src_value"), wanted.alias("dst_value"))
    return up.ends_by_property(elements, vertices, "segment").select("o_orderkey", "src_id")


# Expansion, alerts, summaries


@_query("""WITH l AS (SELECT DISTINCT l_orderkey AS id, 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem),
    x AS (SELECT id, a AS v FROM l UNION SELECT id, b FROM l), y AS (SELECT * FROM x WHERE v <> 'p7'),
    s0 AS (SELECT DISTINCT id FROM y WHERE v IN ('p11', 'p12', 'p13', 'p14', 'p15')),
    s1 AS (SELECT DISTINCT id FROM y WHERE v IN (SELECT v FROM y WHERE id IN (SELECT id FROM s0)) AND id NOT IN (SELECT id FROM s0)),
    s2 AS (SELECT DISTINCT id FROM y WHERE v IN (SELECT v FROM y WHERE id IN (SELECT id FROM s1)) AND id NOT IN (SELECT id FROM s0) AND id NOT IN (SELECT id FROM s1))
    SELECT id AS event_id, 0::int AS level FROM s0 UNION ALL SELECT id, 1 FROM s1 UNION ALL SELECT id, 2 FROM s2""")
def entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("O"), "l_orderkey").alias("a"), F.concat(F.lit("P"), "l_partkey").alias("b"))
    named = ex.pivots(events, "id", ["a", "b"]).distinct()
    seeds = spark.createDataFrame([(f"P{k}",) for k in range(11, 16)], "value string")
    return ex.expand(named, seeds, 3, skip=("p7", *text.JUNK))


@_query("SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND (event_type IN ('error') OR user_id IN (3, 4, 5))")
def time_bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = F.col("event_type").isin("error") | F.col("user_id").isin(3, 4, 5)
    return ex.in_window(read(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-12", either).select("event_id", "event_type")


_ALERTS_SQL = "a AS (SELECT l_orderkey AS id, min(l_partkey) AS part_1, max(l_partkey) AS part_2, max(l_suppkey) AS supplier FROM lineitem GROUP BY 1)"
FAMILIES = {"part": ["part_1", "part_2"], "supplier": ["supplier"]}
_CELLS_SQL = """c AS (SELECT id, 'part' AS family, 'part_1' AS col, part_1 AS v FROM a UNION ALL SELECT id, 'part', 'part_2', part_2 FROM a UNION ALL SELECT id, 'supplier', 'supplier', supplier FROM a),
    x AS MATERIALIZED (SELECT DISTINCT id, family, v FROM c WHERE v IS NOT NULL)"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("part_1"), F.max("l_partkey").alias("part_2"), F.max("l_suppkey").alias("supplier"))


# Each round gives an alert the least group known under any of its values, until none changes.
_GROUPS_SQL = f"""WITH RECURSIVE {_ALERTS_SQL}, {_CELLS_SQL},
    r(id, grp) USING KEY (id) AS (SELECT id, id FROM a UNION
        SELECT x.id, min(m.grp) FROM x JOIN (SELECT x.family, x.v, min(k.grp) AS grp FROM recurring.r k JOIN x ON x.id = k.id GROUP BY ALL) m ON m.family = x.family AND m.v = x.v
        JOIN recurring.r old ON old.id = x.id GROUP BY x.id, old.grp HAVING min(m.grp) < old.grp)"""


def alert_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.group_alerts(_alerts(spark, sf_dir), FAMILIES)


QUERIES["alert_groups"] = alert_groups


@_query(f"WITH {_ALERTS_SQL}, {_CELLS_SQL} SELECT family, v::varchar AS value, id FROM x")
def alert_ids_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.ids_of_values(_alerts(spark, sf_dir), FAMILIES).select("family", "value", F.explode("ids").alias("id"))


@_query()
def alert_group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alerts(spark, sf_dir)
    return al.values_of_groups(rows, al.group_alerts(rows, FAMILIES), FAMILIES)


@_query(f"""WITH {_ALERTS_SQL}, {_CELLS_SQL}, m AS (SELECT family, v, min(id) AS i, arg_min(col, (id, col)) AS first_col FROM c WHERE v IS NOT NULL GROUP BY ALL)
    SELECT m.i AS id_a, c.id AS id_b, c.v::varchar AS value, m.first_col AS column_a, c.col AS column_b FROM c JOIN m ON m.family = c.family AND m.v = c.v WHERE c.id <> m.i""")
def alert_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.why_grouped(_alerts(spark, sf_dir), FAMILIES)


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.column_profile(read(spark, sf_dir, "documents")).select("column", "non_null")


@_query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS bucket_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.time_histogram(read(spark, sf_dir, "events"), "ts", "6 hours", "event_type")


@_query("SELECT user_id AS src_id, event_type AS dst_id, 'did' AS label, to_timestamp(floor(epoch(ts) / 5) * 5)::timestamp AS bucket_start, count(*)::bigint AS total FROM events GROUP BY ALL")
def edge_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "events").select(F.col("user_id").alias("src_id"), F.col("event_type").alias("dst_id"), F.lit("did").alias("label"), F.col("ts").alias("event_time"), F.lit(1).alias("counter"))
    return su.edge_counters(edges)


@_query("SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.pairs_present(read(spark, sf_dir, "documents"), "lang", "source")


# Sources and cases

CATALOG = {
    "events": Source("events", "ts", ("event_id", "user_id", "event_type"), {"ts": "time", "user_id": "actor", "event_type": "what"}, {"actor": "string"}),
    "orders": Source("orders", "o_orderdate", ("o_custkey", "o_orderpriority", "o_totalprice"), {"o_orderdate": "time", "o_custkey": "actor", "o_orderpriority": "what"}, {"actor": "string", "o_totalprice": "bigint"}),
}


@_query("""SELECT 'events' AS ds, ts AS time, event_id, user_id::varchar AS actor, event_type AS what, NULL::bigint AS o_totalprice FROM events
    UNION ALL SELECT 'orders', o_orderdate, NULL, o_custkey::varchar, o_orderpriority, trunc(o_totalprice)::bigint FROM orders""")
def routed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sources(spark, sf_dir, CATALOG)


@_query("SELECT x.*, n AS non_null FROM (VALUES ('conv_id', 'bigint'), ('turn', 'bigint'), ('role', 'string'), ('text', 'string')) x(name, type) JOIN ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM conversations" for c in ("conv_id", "turn", "role", "text")) + ") USING (name)")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table with their types and how many values they hold."""
    df = read(spark, sf_dir, "conversations")
    return columns_of(df).join(su.column_profile(df).select(F.col("column").alias("name"), "non_null"), "name")


def _case_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat(F.lit("case"), "user_id").alias("case_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"))


@_query("SELECT 'case' || user_id AS case_id, arg_max(event_type, ts) AS status, max(ts) AS at, string_agg(event_type, ',' ORDER BY ts, event_type) AS tracker FROM events GROUP BY user_id")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.case_state(_case_log(spark, sf_dir)).withColumn("tracker", F.array_join("tracker", ","))


def _case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each order: its query asks for the priority, its nodes name the parts' suppliers, its sources depend on the status."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("node_id"), F.lit("supplier").alias("property"), F.concat(F.lit("S"), "l_suppkey").alias("value"))
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.array(F.struct(F.lit("priority").alias("propertyKey"), F.col("o_orderpriority").alias("propertyValue"))).alias("query"),
        F.col("o_orderdate").alias("query_start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("query_end"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("mail"), F.lit("web"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("all"))).otherwise(F.array(F.lit("web"))).alias("datasources"),
    ).join(cs.case_nodes(lines), "case_id")


@_query("""SELECT o_orderkey AS case_id FROM orders WHERE o_orderdate <= TIMESTAMP '1997-05-20' AND o_orderdate + INTERVAL 30 DAYS >= TIMESTAMP '1997-05-25'
    AND o_orderstatus IN ('F', 'O') AND lower(o_orderpriority) = '2-high' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def query_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.covering_cases(_case_table(spark, sf_dir), {"priority": "2-High"}, "1997-05-20", "1997-05-25", ["mail"]).select("case_id")


@_query("""SELECT o_orderkey AS case_id FROM orders WHERE o_orderdate <= TIMESTAMP '1997-05-20' AND o_orderdate + INTERVAL 30 DAYS >= TIMESTAMP '1997-05-25'
    AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5)""")
def query_covered_by_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.covering_cases(_case_table(spark, sf_dir), {"supplier": "s5"}, "1997-05-20", "1997-05-25", ["web"]).select("case_id")


@_query("SELECT l_orderkey AS case_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def case_node_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_table(spark, sf_dir).select("case_id", F.size("nodes").cast("bigint").alias("n"))


def _tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    done = F.when(k > 90, None).otherwise(F.col("ts"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("ts").alias("added_time"), done.alias("processed_time"), F.array("event_type", F.lit("base")).alias("datasource"))


@_query("""SELECT CASE WHEN count(*) > 0 THEN 'yes' ELSE 'no' END AS status, min(ts) - INTERVAL 30 SECONDS AS start_time, max(ts) + INTERVAL 30 SECONDS AS end_time,
    'base,' || string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events WHERE (props->>'k')::int > 90""")
def next_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.next_delta(_tracker(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@_query("SELECT event_id AS row_id FROM events WHERE (props->>'k')::int > 90 AND NOT ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def mark_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return cs.mark_processed(_tracker(spark, sf_dir), at("2024-01-05"), at("2024-01-20"), at("2024-02-01")).filter("processed_time is null").select("row_id")


@_query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 12 HOURS FROM events)")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.recent(read(spark, sf_dir, "events"), "ts", 12, "h").select("event_id")


# Logs and functions


def _firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("src_user=User"), "user_id", F.lit("@local; op="), "event_type", F.lit(" sent_bytes="), F.get_json_object("props", "$.k"), F.lit("; arg=/usr/bin/run"), F.col("user_id") % 7,
        F.when(F.col("user_id") % 2 == 0, " geo_dst=US;").otherwise(""),
    )
    return logs.firewall_fields(read(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")


@_query("""SELECT event_id, 'User' || user_id || '@acme.com' AS src_user, event_type AS operation, props->>'k' AS sent_bytes, 'run' || (user_id % 7) AS process,
    CASE WHEN user_id % 2 = 0 THEN 'US' ELSE '' END AS dst_geo, '' AS url FROM events""")
def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firewall(spark, sf_dir).select("event_id", "src_user", "operation", "sent_bytes", "process", "dst_geo", "url")


@_query("SELECT event_id, event_type AS kind, props->>'k' AS k, value::varchar AS v FROM (SELECT event_id, event_type, props, round(value)::int AS value FROM events)")
def log_kv_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("kind=view; kind="), "event_type", F.lit(" ;k="), F.get_json_object("props", "$.k"), F.lit(";v="), F.round("value").cast("int"), F.lit(";junk"))
    pairs = read(spark, sf_dir, "events").select("event_id", logs.pairs_to_map(line).alias("m"))
    return pairs.select("event_id", *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("kind", "k", "v")])


@_query("SELECT event_id, 'user' || user_id AS client_name, event_type AS message_id, '' AS missing FROM events")
def positional_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit(" User"), "user_id", F.lit(" ,"), F.upper("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return logs.split_fields(rows, "line", ["Client-Name", "message-id", "missing"]).drop("line")


@_query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'ipv4' WHEN user_id % 3 = 1 THEN 'ipv6' ELSE 'NA' END AS kind, 'user' || user_id AS account,
    ['user' || user_id, 'b']::varchar AS users, 'run.exe' AS process, '/opt/x' AS folder, CASE WHEN user_id % 3 = 2 THEN '1.2.3.999' ELSE '' END AS url FROM events""")
def record_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    ip = F.when(u % 3 == 0, F.concat(F.lit("10.2.3."), (u % 250).cast("string"))).when(u % 3 == 1, "fe80::1:2").otherwise("1.2.3.999")
    users = text.windows_user(F.concat(F.lit("ACME\\User"), u, F.lit("$;B")))
    listed = F.concat(F.lit("["), F.array_join(users, ", "), F.lit("]"))
    path = F.lit("/opt/x/Run.EXE")
    return read(spark, sf_dir, "events").select(
        "event_id", text.ip_kind(ip).alias("kind"), text.normal_user(F.concat(F.lit("ACME\\User"), u)).alias("account"), listed.alias("users"),
        F.element_at(text.base_names(path), 1).alias("process"), text.dir_name(path).alias("folder"), logs.proxy_url(ip).alias("url"),
    )


@_query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    as_text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 2, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).otherwise("soon")
    )
    return read(spark, sf_dir, "events").select("event_id", text.log_time(as_text).cast("timestamp_ntz").alias("at"))


@_query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the events after a streaming load of them into versioned tables, with the number of their edges."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    _event_log(spark, sf_dir).write.parquet(f"{folder}/in")
    tables = GraphTables(spark, f"{folder}/graph")
    schema = spark.read.parquet(f"{folder}/in").schema
    ingest(spark, f"{folder}/in", schema, tables, f"{folder}/state", EVENTS, "event_id", "ts", "ds").awaitTermination()
    nodes, edges = tables.read()
    degrees = edges.groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.join(degrees, "node_id", "left").select("label", "identifier", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_edges"))


SQL["stream_ingest"] = f"""{_EDGES}, d AS (SELECT DISTINCT label, src_identifier, dst_identifier, ts FROM pairs),
    n AS (SELECT DISTINCT 'user' AS label, user_name AS identifier FROM log UNION ALL SELECT DISTINCT 'action', event_type FROM log UNION ALL SELECT DISTINCT 'IP', unnest(l) FROM log),
    c AS (SELECT CASE label WHEN 'talked' THEN 'IP' ELSE 'user' END AS label, src_identifier AS identifier, count(*) AS k FROM d GROUP BY ALL)
    SELECT label, identifier, coalesce(k, 0)::bigint AS n_edges FROM n LEFT JOIN c USING (label, identifier)"""
SQL["alert_groups"] = f'{_GROUPS_SQL} SELECT id, grp AS "group" FROM r'
SQL["alert_group_values"] = f"""{_GROUPS_SQL} SELECT grp AS "group", family, v::varchar AS value, count(DISTINCT x.id) AS n_alerts FROM r JOIN x ON x.id = r.id GROUP BY ALL"""
