"""A property graph over the driver's order and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.graph import PROPERTIES, Graph, properties

SPAN = 1_000_000_000_000
#: Fixed numbers of the vertex types in node ids.
TYPES = {"customer": 1, "order": 2, "part": 3, "supplier": 4, "nation": 5, "region": 6, "user": 7, "event_type": 8}
#: Fixed numbers of event types, by name.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def node_id(kind: str, key: Column) -> Column:
    return F.lit(TYPES[kind] * SPAN) + key.cast("bigint")


def event_type_key(name: Column) -> Column:
    return reduce(lambda c, k: c.when(name == EVENT_TYPES[k], F.lit(k + 1)), range(1, len(EVENT_TYPES)), F.when(name == EVENT_TYPES[0], F.lit(1)))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations, regions, users and event types with their edges."""
    t = {n: read(spark, sf_dir, n) for n in ("customer", "orders", "part", "supplier", "nation", "region", "lineitem", "events")}

    def vertices(df: DataFrame, kind: str, key: str, **values: Column) -> DataFrame:
        return df.select(node_id(kind, F.col(key)).alias("node_id"), F.lit(kind).alias("label"), properties(**values).alias("properties"))

    c = F.col
    kinds = t["events"].select("event_type").distinct()
    nodes = [
        vertices(t["customer"], "customer", "c_custkey", name=c("c_name"), segment=c("c_mktsegment")),
        vertices(t["orders"], "order", "o_orderkey", status=c("o_orderstatus"), priority=c("o_orderpriority"), orderdate=c("o_orderdate")),
        vertices(t["part"], "part", "p_partkey", name=c("p_name"), brand=c("p_brand"), size=c("p_size")),
        vertices(t["supplier"], "supplier", "s_suppkey", name=c("s_name")),
        vertices(t["nation"], "nation", "n_nationkey", name=c("n_name")),
        vertices(t["region"], "region", "r_regionkey", name=c("r_name")),
        vertices(t["events"].select("user_id").distinct(), "user", "user_id", name=F.concat(F.lit("user"), c("user_id"))),
        kinds.select(
            node_id("event_type", event_type_key(c("event_type"))).alias("node_id"), F.lit("event_type").alias("label"), properties(name=c("event_type")).alias("properties")
        ),
    ]
    none = F.lit(None)

    def edges(df: DataFrame, label: str, src: Column, dst: Column, keys: list[Column], time: Column = none, source: Column = none, **values: Column) -> DataFrame:
        held = properties(**values) if values else F.create_map().cast(PROPERTIES)
        return df.select(
            F.concat_ws(":", F.lit(label), *keys).alias("edge_id"), src.alias("src_id"), dst.alias("dst_id"), F.lit(label).alias("label"),
            held.alias("properties"), time.cast("timestamp_ntz").alias("event_time"), source.cast("string").alias("source"),
        )

    pairs = t["lineitem"].select("l_partkey", "l_suppkey").distinct()
    links = [
        edges(t["orders"], "placed", node_id("customer", c("o_custkey")), node_id("order", c("o_orderkey")), [c("o_orderkey")], c("o_orderdate"), F.lit("orders")),
        edges(
            t["lineitem"], "contains", node_id("order", c("l_orderkey")), node_id("part", c("l_partkey")),
            [c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM-dd")],
            c("l_shipdate"), F.lit("lineitem"), quantity=c("l_quantity").cast("bigint"), flag=c("l_returnflag"),
        ),
        edges(pairs, "suppliedBy", node_id("part", c("l_partkey")), node_id("supplier", c("l_suppkey")), [c("l_partkey"), c("l_suppkey")]),
        edges(t["customer"], "inNation", node_id("customer", c("c_custkey")), node_id("nation", c("c_nationkey")), [F.lit("c"), c("c_custkey")]),
        edges(t["supplier"], "inNation", node_id("supplier", c("s_suppkey")), node_id("nation", c("s_nationkey")), [F.lit("s"), c("s_suppkey")]),
        edges(t["nation"], "inRegion", node_id("nation", c("n_nationkey")), node_id("region", c("n_regionkey")), [c("n_nationkey")]),
        edges(
            t["events"], "did", node_id("user", c("user_id")), node_id("event_type", event_type_key(c("event_type"))), [c("event_id")], c("ts"), F.lit("events"),
            value=c("value"),
        ),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, links))
