"""Queries of security records, record files, case reading and further functions over the driver tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.analytics import alerts as al
from vertexloom.analytics import summaries as su
from vertexloom.functions import logs, text
from vertexloom.lineage import ensure_checkpoint_dir
from vertexloom.operators.mapper import composite_edge_key, first_of_each, is_empty_node, map_edges, map_nodes, natural_key
from vertexloom.operators.predicates import P
from vertexloom.operators.traversal import V
from vertexloom.plans import cases as cs
from vertexloom.plans import investigations as inv
from vertexloom.plans.security import MAPPERS
from vertexloom.queries.graph_queries import GRAPH_SQL, _hop, _rows, _start
from vertexloom.sources.records import append_variant, read_json, write_piped_csv, write_staged
from vertexloom.sources.tables import SPAN, order_graph, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Records in one file of a JSON array.
ARRAY_RECORDS = 5000


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# Security records: the five kinds made of the rows of events, in SQL that Spark and DuckDB both read

_FIELDS = {
    "sysmon": {
        "User": "'ACME' || chr(92) || 'User' || user_id || '$'", "UserID": "'S-' || user_id", "Hostname": "'Host' || (user_id % 50)", "SourceIp": "'10.1.0.' || (user_id % 250)",
        "DestinationIp": "CASE WHEN event_id % 4 = 0 THEN '-' ELSE '10.2.0.' || (event_id % 250) END", "Image": "'/opt/Child' || (event_id % 9) || '.EXE'",
        "ParentImage": "'C:' || chr(92) || 'bin' || chr(92) || 'Parent' || (user_id % 5) || '.exe'", "TargetFilename": "'/tmp/Target' || (event_id % 3)", "EventTime": "CAST(ts AS STRING)", "EventID": "'3'",
    },
    "windows": {
        "TargetUserName": "'acme' || chr(92) || 'Target' || (user_id % 60) || '$'", "SubjectUserName": "'Subject' || (user_id % 7) || ';System'", "Hostname": "'Host' || (user_id % 50)",
        "IpAddress": "CASE WHEN user_id % 3 = 0 THEN '127.0.0.1' ELSE '10.3.0.' || (user_id % 250) END", "FullFileName": "'/opt/Run' || (event_id % 6)", "FileName": "'Run' || (event_id % 6)", "EventID": "'4624'",
    },
    "endpoint": {"Hostname": "'Host' || (user_id % 50)", "FullFileName": "CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE '/srv/Job' || (event_id % 8) END", "FileName": "'Job' || (event_id % 8)", "Action": "event_type"},
}
#: Fields of comma-separated lines by name; the others are empty.
_LINES = {
    "mail": (logs.MAIL_FIELDS, {
        "datetime": "'2024-01-01'", "client-ip": "'10.4.0.' || (user_id % 250)", "client-hostname": "'Desk' || (user_id % 90)", "server-ip": "'10.5.0.' || (event_id % 5)", "server-hostname": "' Relay' || (event_id % 5)",
        "event-id": "'SEND'", "recipient-address": "'User' || (event_id % 100) || '@acme.com;List' || (user_id % 5) || '@acme.com'", "message-subject": "'Subject ' || (event_id % 40)",
        "sender-address": "'User' || user_id || '@acme.com'", "total-bytes": "event_id",
    }),
    "firewall": (logs.FIREWALL_FIELDS, {
        "policy": "'allow'", "ip_src_addr": "'10.6.0.' || (user_id % 250)", "ip_dst_addr": "'10.7.0.' || (event_id % 250)", "ip_src_port": "'4' || (event_id % 10)",
        "msg": "'src_user=User' || user_id || '@local; dst_user=Svc' || (event_id % 4) || '; dstname=site' || (event_id % 30) || '.example; arg=/get/File' || (event_id % 12) || '; sent_bytes=' || event_id",
    }),
}


def _security(spark: SparkSession, sf_dir: str, kind: str, tasks: int | None = None) -> DataFrame:
    """The events as records of a kind, made in the tasks that read them or in so many."""
    events = read(spark, sf_dir, "events")
    events = events.repartition(tasks) if tasks else events
    if kind in _FIELDS:
        return events.selectExpr("event_id AS record", "ts AS event_ts", *[f"{e} AS {c}" for c, e in _FIELDS[kind].items()])
    fields, held = _LINES[kind]
    line = F.concat_ws(",", *[F.expr(f"CAST({held[f]} AS STRING)") if f in held else F.lit("") for f in fields])
    rows = logs.split_fields(events.select(F.col("event_id").alias("record"), F.col("ts").alias("event_ts"), line.alias("line")), "line", fields).drop("line")
    return logs.firewall_fields(rows, "msg") if kind == "firewall" else rows


#: What each kind names: event_id and one list of names for each end, in SQL over events, then ends (label, name), and edges (end, label, end).
_EXPECTED = {
    "sysmon": (
        "['user' || user_id] AS usr, ['host' || (user_id % 50)] AS hst, ['10.1.0.' || (user_id % 250)] AS a, [CASE WHEN event_id % 4 = 0 THEN '-' ELSE '10.2.0.' || (event_id % 250) END] AS b,"
        " ['child' || (event_id % 9) || '.exe'] AS c, ['parent' || (user_id % 5) || '.exe'] AS p, ['target' || (event_id % 3)] AS t",
        {"usr": "user", "hst": "host", "a": "IP", "b": "IP", "c": "process", "p": "process", "t": "process"},
        "usr loggedIn hst, usr hasIP a, hst withIP a, hst runningProcess p, usr createdProcess p, usr createdProcess t, p createdChildProcess c, c childProcessOn hst, p downloadedBy usr, p downloadedOn a,"
        " p processCommunicated b, a IPsCommunicated b",
    ),
    "windows": (
        "['target' || (user_id % 60)] AS t, ['subject' || (user_id % 7), 'system'] AS s, ['host' || (user_id % 50)] AS hst,"
        " [CASE WHEN user_id % 3 = 0 THEN '-' ELSE '10.3.0.' || (user_id % 250) END] AS a, ['/opt/run' || (event_id % 6)] AS p",
        {"t": "user", "s": "user", "hst": "host", "a": "IP", "p": "process"},
        "t loggedIn a, t hasIP a, t createdProcess p, hst withIP a",
    ),
    "endpoint": ("['host' || (user_id % 50)] AS hst, [CASE WHEN event_id % 5 = 0 THEN '-' ELSE '/srv/job' || (event_id % 8) END] AS p", {"hst": "host", "p": "process"}, "hst runningProcess p"),
    "mail": (
        "['user' || user_id || '@acme.com'] AS s, ['user' || (event_id % 100) || '@acme.com', 'list' || (user_id % 5) || '@acme.com'] AS r, ['subject ' || (event_id % 40)] AS m,"
        " ['10.5.0.' || (event_id % 5)] AS a, ['10.4.0.' || (user_id % 250)] AS b, ['relay' || (event_id % 5)] AS c, ['desk' || (user_id % 90)] AS d",
        {"s": "user", "r": "user", "m": "email", "a": "IP", "b": "IP", "c": "host", "d": "host"},
        "s sentEmail m, m receivedEmail r, m emailOriginatedFrom a, m emailSentTo b, s hasIP a, r hasIP b, c withIP a, d withIP b",
    ),
    "firewall": (
        "['10.6.0.' || (user_id % 250)] AS a, ['10.7.0.' || (event_id % 250)] AS b, ['user' || user_id || '@acme.com'] AS s, ['svc' || (event_id % 4)] AS d,"
        " ['site' || (event_id % 30) || '.example'] AS w, ['file' || (event_id % 12)] AS p",
        {"a": "IP", "b": "IP", "s": "user", "d": "user", "w": "URLs", "p": "process"},
        "a IPsCommunicated b, p downloadedFrom w, s clicked w, d clicked w, s hasIP a, d hasIP b, p downloadedOn a, p downloadedOn b, p downloadedBy s, p downloadedBy d",
    ),
}


def _security_queries(kind: str) -> None:
    def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = map_nodes(_security(spark, sf_dir, kind), MAPPERS[kind], ("record",))
        return found.select(F.col("record").alias("event_id"), "label", "identifier", F.try_element_at(F.try_element_at("properties", F.lit("dataSourceName")), F.lit(1)).alias("source"))

    def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        return map_edges(_security(spark, sf_dir, kind), MAPPERS[kind], ("record",)).drop("properties").withColumnRenamed("record", "event_id")

    lists, labels, links = _EXPECTED[kind]
    r = f"WITH r AS (SELECT event_id, {lists} FROM events)"
    ends = " UNION ALL ".join(f"SELECT event_id, '{label}' AS label, unnest({c}) AS identifier FROM r" for c, label in labels.items())
    pairs = " UNION ALL ".join(
        f"SELECT event_id, '{label}' AS label, '{labels[x]}' AS src_label, x AS src_identifier, '{labels[y]}' AS dst_label, y AS dst_identifier FROM (SELECT event_id, unnest({x}) AS x, {y} AS ys FROM r), unnest(ys) u(y)"
        for x, label, y in (link.split() for link in links.split(","))
    )
    QUERIES[f"mapper_{kind}_nodes"], SQL[f"mapper_{kind}_nodes"] = nodes, f"{r} SELECT *, '{kind}' AS source FROM ({ends}) WHERE identifier <> '-'"
    QUERIES[f"mapper_{kind}_edges"], SQL[f"mapper_{kind}_edges"] = edges, f"{r} SELECT * FROM ({pairs}) WHERE src_identifier <> '-' AND dst_identifier <> '-'"


for _kind in MAPPERS:
    _security_queries(_kind)


_TIME_ONLY = {"eventTime": "ts::varchar"}
_SEEN = {**_TIME_ONLY, "processID": "''", "eventId": "'3'"}
_COMMAND = {**_TIME_ONLY, "commandLine": "''"}
_TALK = {**_TIME_ONLY, "processID": "''", "srcPort": "''", "dstPort": "''"}
_LOGON = {"eventTime": "''", "processID": "''", "eventId": "'4624'", "category": "''", "severityValue": "''"}
_SENT = {"emailTime": "'2024-01-01'", "category": "'send'"}
_SIZES = {"sentBytes": "event_id::varchar", "receivedBytes": "''", "elapsedTime": "''", "operation": "''"}
_PORTS = {**_SIZES, "srcPort": "'4' || (event_id % 10)", "dstPort": "''"}
#: Properties of each kind's edges by label, in SQL over events; fields that the records lack are empty.
_HELD = {
    "sysmon": {
        "loggedIn": {**_TIME_ONLY, "eventId": "'3'"}, "hasIP": _SEEN, "withIP": _SEEN, "runningProcess": _SEEN, "createdProcess": _COMMAND, "createdChildProcess": _COMMAND, "childProcessOn": _COMMAND,
        "downloadedBy": _TIME_ONLY, "downloadedOn": _TIME_ONLY, "processCommunicated": _TALK, "IPsCommunicated": _TALK,
    },
    "windows": {"loggedIn": {**_LOGON, "workStationName": "''"}, "hasIP": _LOGON, "createdProcess": _LOGON, "withIP": _LOGON},
    "endpoint": {"runningProcess": {"eventTime": "''", "eventId": "''"}},
    "mail": {
        "sentEmail": {**_SENT, "srcHost": "'desk' || (user_id % 90)"}, "receivedEmail": {**_SENT, "dstHost": "'relay' || (event_id % 5)"}, "emailOriginatedFrom": _SENT, "emailSentTo": _SENT,
        "hasIP": {"eventTime": "'2024-01-01'"}, "withIP": {"eventTime": "'2024-01-01'"},
    },
    "firewall": {
        "IPsCommunicated": {**_PORTS, "policy": "'allow'", "eventTime": "''"}, "downloadedFrom": _PORTS, "clicked": _SIZES, "hasIP": {}, "downloadedOn": {}, "downloadedBy": {"downloadSize": "''"},
    },
}


def _properties_sql() -> str:
    views, parts = [], []
    for kind, (lists, _, links) in _EXPECTED.items():
        views.append(f"r_{kind} AS (SELECT *, {lists} FROM events)")
        for x, label, y in (link.split() for link in links.split(",")):
            pairs = f"(SELECT *, unnest({x}) AS src_name FROM r_{kind}), unnest({y}) u(dst_name) WHERE src_name <> '-' AND dst_name <> '-'"
            parts += [f"SELECT '{kind}' AS kind, '{label}' AS label, '{k}' AS key, {v} AS value FROM {pairs}" for k, v in {**_HELD[kind][label], "dataSourceName": f"'{kind}'"}.items()]
    return f"WITH {', '.join(views)} SELECT kind, label, key, value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY kind, label, key, value"


@_query(_properties_sql())
def mapper_edge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of all properties of the edges of the five kinds, with how many edges hold them."""
    found = [map_edges(_security(spark, sf_dir, kind), MAPPERS[kind], ("record",)).select(F.lit(kind).alias("kind"), "label", F.explode("properties").alias("key", "values")) for kind in MAPPERS]
    rows = reduce(DataFrame.unionByName, found).select("kind", "label", "key", F.explode("values").alias("value"))
    return rows.groupBy("kind", "label", "key", "value").agg(F.count("*").alias("n"))


@_query("""WITH m AS (SELECT 'subject ' || (event_id % 40) AS identifier, event_id, date_trunc('day', ts) AS day FROM events),
    f AS (SELECT identifier, arg_min(event_id::varchar, (day, event_id::varchar)) AS bytes FROM m GROUP BY identifier)
    SELECT identifier, key, value FROM (SELECT identifier, unnest(['emailSubject', 'messageID', 'messageBytes', 'dataSourceName']) AS key,
        unnest([identifier, '', bytes, 'mail']) AS value FROM f)""")
def first_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of each mail as the records of its first day have them; of several on that day those that read first."""
    records = _security(spark, sf_dir, "mail").withColumn("day", F.date_trunc("day", "event_ts"))
    mails = replace(MAPPERS["mail"], nodes=tuple(n for n in MAPPERS["mail"].nodes if n.label == "email"))
    first = first_of_each(map_nodes(records, mails, ("day",)), "day")
    return first.select("identifier", F.explode("properties").alias("key", "values")).select("identifier", "key", F.explode("values").alias("value"))


# Record files


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/records-{uuid.uuid4().hex}"


@_query("SELECT event_id, user_id, event_type FROM events")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through files that each hold one JSON array."""
    path = _folder(spark)
    record = F.to_json(F.struct("event_id", "user_id", "event_type"))
    dealt = read(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / ARRAY_RECORDS).alias("n")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    dealt.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json(spark, path, "event_id bigint, user_id bigint, event_type string")


@_query("SELECT event_id, 'case' || (user_id % 4) AS case_id, event_type AS ds FROM events")
def staged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("case"), F.col("user_id") % 4).alias("case_id"), F.col("event_type").alias("ds"))
    write_staged(rows, path)
    return spark.read.schema("event_id bigint, case_id string, ds string").json(path)


@_query("SELECT p_partkey, p_name, p_brand FROM part")
def piped_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    write_piped_csv(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    return spark.read.schema("p_partkey bigint, p_name string, p_brand string").option("sep", "|").option("header", True).csv(path)


@_query("SELECT event_id, (props->>'k')::bigint AS k FROM events UNION ALL SELECT event_id, (props->>'k')::bigint FROM events WHERE event_type = 'error'")
def variant_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as variants, errors once more."""
    path = _folder(spark)
    events = read(spark, sf_dir, "events").select("event_id", "props", "event_type")
    append_variant(events, "props", path)
    append_variant(events.filter("event_type = 'error'"), "props", path)
    return spark.read.parquet(path).select("event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"))


# Vertices and edges of records


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vertices: some are named by an address, some by a user name, some hold junk only."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "N/A").otherwise(F.lower("c_name"))
    other = F.when(k % 3 == 0, "-").otherwise(F.col("c_mktsegment"))
    held = F.when(k % 2 == 0, F.create_map(F.lit("userName"), F.array(name), F.lit("ip"), F.array(k.cast("string")))).otherwise(F.create_map(F.lit("segment"), F.array(other), F.lit("userName"), F.array(name)))
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("identifier"), F.when(k % 7 == 0, F.create_map(F.lit("x"), F.array(F.lit("null"), F.lit(" ")))).otherwise(held).alias("properties"))


@_query("SELECT c_custkey, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS empty FROM customer")
def empty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", is_empty_node(F.col("properties"), F.col("identifier")).alias("empty"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_custkey::varchar WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE lower(c_name) END AS name FROM customer")
def natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", natural_key(F.col("properties")).alias("name"))


@_query("SELECT event_id, user_id || '_' || event_id || '_did_' || event_type AS edge_id FROM events")
def composite_edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", composite_edge_key(F.col("user_id"), F.col("event_id"), F.lit("did"), F.col("event_type")).alias("edge_id"))


@_query("SELECT l_orderkey AS id, count(*) AS n, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_partkey || ':' || l_linenumber) AS lines FROM lineitem GROUP BY 1")
def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = al.records_of_ids(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    line = lambda r: F.concat_ws(":", r["l_partkey"], r["l_linenumber"])
    return rows.select("id", F.size("records").cast("bigint").alias("n"), F.array_join(F.array_sort(F.transform("records", line)), ",").alias("lines"))


@_query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def rows_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.rows_by_source(read(spark, sf_dir, "documents"), "source")


# Cases


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def case_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that the query of a case asks for."""
    asked = cs.query_array(spark, {"segment": ["BUILDING", "MACHINERY"]}).select(F.explode("query").alias("q")).select("q.*")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.lit("segment").alias("propertyKey"), F.col("c_mktsegment").alias("propertyValue"))
    return customers.join(asked, ["propertyKey", "propertyValue"], "left_semi").select("c_custkey")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))


@_query("""SELECT o_custkey AS case_id, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS status, max(o_orderdate) AS at FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1""")
def status_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("case_id"))
    return cs.status_of(_log(spark, sf_dir), asked)


@_query("SELECT DISTINCT o_custkey AS case_id FROM orders")
def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.case_ids(_log(spark, sf_dir))


@_query("SELECT event_id AS row_id, ts AS added_time, NULL::timestamp AS processed_time, event_type AS sources FROM events")
def record_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.arrivals(read(spark, sf_dir, "events"), "event_id", "ts", "event_type").select("row_id", "added_time", "processed_time", F.array_join("datasource", ",").alias("sources"))


@_query("""WITH w AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15' AND event_type IN ('error', 'view'))
    SELECT event_id, 'user' AS label, 'user' || user_id AS identifier FROM events
    WHERE event_type IN (SELECT event_type FROM w) AND ts BETWEEN (SELECT min(ts) - INTERVAL 30 SECONDS FROM w) AND (SELECT max(ts) + INTERVAL 30 SECONDS FROM w)""")
def load_next_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices mapped from the records of the next delta: errors and views after a day have arrived, the others are loaded."""
    events = read(spark, sf_dir, "events")
    arrived = cs.arrivals(events.filter(F.col("event_type").isin("error", "view")), "event_id", "ts", "event_type")
    day = F.lit("2024-01-15").cast("timestamp_ntz")
    tracker = cs.mark_processed(arrived, F.lit("1970-01-01").cast("timestamp_ntz"), day, day)
    rows = cs.delta_rows(events, tracker, "ts", "event_type").select("event_id", F.concat(F.lit("User"), "user_id").alias("User"))
    return map_nodes(rows, MAPPERS["sysmon"], ("event_id",)).select("event_id", "label", "identifier")


# Functions


@_query("SELECT event_id, event_type AS kind, (props->>'k') AS k FROM events")
def braced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("{kind="), "event_type", F.lit(", k= "), F.get_json_object("props", "$.k"), F.lit("}"))
    m = logs.braced_to_map(line)
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(m, F.lit("kind")).alias("kind"), F.try_element_at(m, F.lit("k")).alias("k"))


@_query("""SELECT event_id, 'user' || user_id AS sysmon_name, event_type AS token, CASE WHEN user_id % 2 = 0 THEN 'target' || user_id ELSE 'subject' END AS account,
    CASE WHEN user_id % 3 = 0 THEN 'src' ELSE 'dest' END AS side, CASE WHEN user_id % 2 = 0 THEN '10.8.0.1' ELSE '10.9.0.' || (user_id % 9) END AS internal,
    CASE WHEN user_id % 2 = 0 THEN '10.9.0.' || (user_id % 9) ELSE '' END AS external, CASE WHEN user_id % 2 = 0 THEN 'external' ELSE '' END AS external_type,
    CASE WHEN user_id % 2 = 0 THEN 'ipv4' ELSE 'NA' END || ',ipv4' AS kinds, 'a@x;b@x;u' || user_id AS people, '10.9.0.' || (user_id % 9) AS source, '' AS destination FROM events""")
def record_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    virtual, seen = F.when(u % 2 == 0, "10.8.0.1"), F.concat(F.lit("10.9.0."), u % 9)
    kinds = logs.address_kinds(virtual, seen)
    rows = read(spark, sf_dir, "events").withColumn("seen", seen)
    return rows.select(
        "event_id", F.element_at(text.sysmon_user(F.concat(F.lit("%ACME\\User"), u, F.lit("$%"))), 1).alias("sysmon_name"), text.first_token(F.concat("event_type", F.lit(" s"))).alias("token"),
        logs.windows_account(F.when(u % 2 == 0, F.concat(F.lit("ACME\\target"), u)), F.lit("subject")).alias("account"), logs.side_name(F.when(u % 3 == 0, "source").otherwise("destination")).alias("side"),
        logs.inner_and_outer(virtual, F.col("seen")).alias("io"), F.concat_ws(",", kinds["first"], kinds["second"]).alias("kinds"),
        F.array_join(logs.sender_and_recipients(F.lit("a@x;b@x"), F.concat(F.lit("u"), u)), ";").alias("people"), logs.both_sides(rows, "seen", "absent").alias("sides"),
    ).select("event_id", "sysmon_name", "token", "account", "side", "io.*", "kinds", "people", "sides.*")


@_query("SELECT event_id, date_trunc('second', ts) - CASE WHEN event_id % 5 IN (1, 2) THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END AS at FROM events")
def log_times_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with zones, a small t, a weekday or an offset, as UTC: the session's zone is named for those without one."""
    k = F.col("event_id") % 5
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    as_text = (
        F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(plain, F.lit("+02:00"))).when(k == 2, F.concat(F.translate(plain, " ", "T"), F.lit("+02:00")))
        .when(k == 3, F.date_format("ts", "EEE MMM dd HH:mm:ss 'UTC' yyyy")).otherwise(F.concat(F.translate(plain, " ", "T"), F.lit(".000Z")))
    )
    at = F.to_utc_timestamp(text.log_time(as_text), F.current_timezone())
    return read(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("at"))


# Traversals


@_query(f"WITH {GRAPH_SQL} SELECT node_id FROM v WHERE label = 'part' AND size IN (3, 4, 5) AND size > 3 AND size <= 20")
def v_filter_in_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("part").with_("size", P.in_(3, 4, 5)).with_("size", P.and_(P.gt(3), P.lte(20)))
    return t.properties().select("node_id")


_BUILDING = "label = 'customer' AND segment = 'BUILDING'"


@_query(f"WITH {GRAPH_SQL}{_start(_BUILDING)}" + _hop("a", "s", 1, "out") + _hop("b", "a", 1, "out") + _hop("c", "b", 2, "out") + _hop("d", "c", 2, "out") + f" {_rows('b', 'd')}")
def repeat_long_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("customer").with_("segment", "BUILDING")
    return t.repeat(lambda x: x.out().out(), times=2).project("id")


@_query(f"""WITH {GRAPH_SQL}{_start("label = 'region' AND name = 'ASIA'")}""" + _hop("a", "s", 1, "in") + _hop("b", "a", 2, "both") + _hop("c", "b", 3, "both") + f" {_rows('a', 'b', 'c')}")
def repeat_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V(order_graph(spark, sf_dir)).with_label("region").with_("name", "ASIA")
    return t.repeat(lambda x: x.in_(), times=1).repeat(lambda x: x.both(), times=2).project("id")


#: Labels of the order graph for investigations with a scope: edges that have a time and a source.
_TIMED = {
    "downloadedOn": "contains", "hasIP": "placed", "IPsCommunicated": "contains", "runningProcess": "contains", "receivedEmail": "contains", "sentEmail": "placed", "clicked": "placed",
    "resolved": "contains", "userInteracted": "placed", "childProcessOn": "contains", "loggedIn": "placed", "IP": "order", "hosts": "part", "URLs": "order",
}
_SCOPED = inv.Scope((dt.datetime(1996, 1, 1), dt.datetime(1996, 12, 31)), ("orders", "lineitem"), _TIMED)
_IN_SCOPE = "event_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND source IN ('orders', 'lineitem')"
_PLACED, _CONTAINS = (f"label = '{x}' AND {_IN_SCOPE}" for x in ("placed", "contains"))
_PARTS, _PEOPLE, _ORDERS = "label = 'part' AND size = 7", _BUILDING, "label = 'order' AND status = 'P'"
_IS_ORDER = " AND {far} IN (SELECT node_id FROM v WHERE label = 'order')"
_IS_PART = " AND {far} IN (SELECT node_id FROM v WHERE label = 'part')"


def _scoped(name: str, start: str, sql: str) -> None:
    ids = {_PARTS: lambda t: t.with_label("part").with_("size", 7), _PEOPLE: lambda t: t.with_label("customer").with_("segment", "BUILDING"), _ORDERS: lambda t: t.with_label("order").with_("status", "P")}[start]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = order_graph(spark, sf_dir)
        return inv.investigate(graph, name, ids(V(graph)).root, _SCOPED).project("id")

    QUERIES[f"scoped_{name}"], SQL[f"scoped_{name}"] = run, f"WITH {GRAPH_SQL}{_start(start)}{sql}"


_scoped("process_user", _PARTS, _hop("h1", "s", 1, "both", _CONTAINS) + _hop("h2", "h1", 2, "both", _PLACED) + f" {_rows('h1', 'h2')}")
_scoped("process_ip_communicated", _PARTS, _hop("h1", "s", 1, "both", _CONTAINS) + _hop("h2", "h1", 2, "both", _CONTAINS) + f" {_rows('h1', 'h2')}")
_scoped("user_URL_user", _PEOPLE, _hop("h1", "s", 1, "out", _PLACED) + _hop("h2", "h1", 2, "in", _PLACED) + f" {_rows('h1', 'h2')}")
_scoped("process_ip", _PARTS, _hop("h1", "s", 1, "in", _CONTAINS) + f" {_rows('h1')}")
_scoped("user_touched_host", _PEOPLE, _hop("h1", "s", 1, "out", _PLACED + _IS_ORDER) + f" {_rows('h1')}")
_scoped("user_clicked_url", _PEOPLE, _hop("h1", "s", 1, "out", _PLACED + _IS_ORDER) + f" {_rows('h1')}")
_scoped("process_downloaded_on", _ORDERS, _hop("h1", "s", 1, "out", _CONTAINS + _IS_PART) + f" {_rows('h1')}")
