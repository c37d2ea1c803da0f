"""Mapping, upserts, expansion, alerts, cases and logs on a few rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vertexloom.analytics import alerts, summaries
from vertexloom.functions import logs, text
from vertexloom.operators import expand, mapper, upsert
from vertexloom.plans import cases
from vertexloom.sources import records

SPEC = {
    "nodes": [
        {"label": "user", "properties": {"userName": "analyze-users", "kind": "default=Mail"}, "unique": "userName"},
        {"label": "IP", "properties": {"ip": "ip|alt"}, "unique": "ip"},
    ],
    "edges": [
        {"label": "hasIP", "left": "user.userName(analyze-users)", "right": "IP.ip(ip|alt)", "properties": {"key": "ip+alt", "none": "missing"}},
        {"label": "sent", "left": "user.userName(analyze-users)", "right": "user.userName(analyze-others)"},
    ],
    "calls": {"users": {"function": "recipients", "fields": ["to"], "many": True}, "others": {"function": "recipients", "fields": ["cc"], "many": True}},
}
ROWS = [(1, "A;b'", "x;y", "1.1.1.1", "-"), (2, "-", "x", "", ""), (3, "Cé", "p;q", "-", "2.2.2.2"), (4, "a;b", "x;y;z", "3", "4"), (5, None, None, None, None)]


def test_mapper(spark):
    m = mapper.Mapper.from_dict(SPEC)
    df = spark.createDataFrame(ROWS, "id long, to string, cc string, ip string, alt string")
    nodes = sorted((r.id, r.label, r.identifier) for r in mapper.map_nodes(df, m, ("id",)).collect())
    assert nodes == [(1, "IP", "1.1.1.1"), (1, "user", "a"), (1, "user", "b"), (3, "IP", "2.2.2.2"), (3, "user", "c"), (4, "IP", "3"), (4, "user", "a"), (4, "user", "b")]
    edges = sorted((r.id, r.label, r.src_identifier, r.dst_identifier) for r in mapper.map_edges(df, m, ("id",)).collect())
    assert edges == [
        (1, "hasIP", "a", "1.1.1.1"), (1, "hasIP", "b", "1.1.1.1"), (1, "sent", "a", "x"), (1, "sent", "b", "y"), (3, "hasIP", "c", "2.2.2.2"),
        (3, "sent", "c", "p"), (3, "sent", "c", "q"), (4, "hasIP", "a", "3"), (4, "hasIP", "b", "3"),
    ]
    first = mapper.map_edges(df, m, ("id",)).filter("id = 1 and label = 'hasIP'").first()
    assert first.properties == {"key": ["1.1.1.1-"], "none": [""]}
    assert [(r.id, r.unpaired_labels) for r in mapper.unpaired(df, m).collect()] == [(4, ["sent"])]
    with pytest.raises(ValueError):
        mapper.map_edges(df, mapper.Mapper((), (mapper.EdgeMap("x", "bad", "IP.ip(ip)"),)))


def test_keys_and_validity(spark):
    df = spark.createDataFrame([({"userName": ["u"], "ip": ["i"]}, "u"), ({"x": ["-"]}, "k"), ({"x": ["v"]}, "-")], "p map<string,array<string>>, k string")
    got = df.select(mapper.natural_key(F.col("p")), mapper.is_empty_node(F.col("p"), F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("i", False), (None, True), (None, True)]
    again = df.select(mapper.node_key(F.lit("a"), F.col("k")), mapper.composite_edge_key(F.lit("s"), F.lit("1"), F.lit("l"), F.lit("d")))
    assert again.collect() == again.collect() and again.first()[1] == "s_1_l_d"


def test_upserts_are_idempotent(spark):
    schema = "label string, identifier string, properties map<string,array<string>>"
    old = spark.createDataFrame([("u", "a", {"x": ["1"], "l": ["1", "2"]}), ("u", "b", None)], schema)
    old = old.withColumn("node_id", mapper.node_key(F.col("label"), F.col("identifier")))
    new = spark.createDataFrame([("u", "a", {"x": ["9"], "l": ["2", "3"], "k": ["n"]}), ("u", "c", {"x": ["5"]})], schema)
    once = upsert.upsert_nodes(old, new)
    rows = {r.identifier: r.properties for r in once.collect()}
    assert rows["a"] == {"x": ["1"], "l": ["1", "2", "3"], "k": ["n"]} and rows["b"] is None and rows["c"] == {"x": ["5"]}
    twice = {r.identifier: (r.node_id, r.properties) for r in upsert.upsert_nodes(once, new).collect()}
    assert twice == {r.identifier: (r.node_id, r.properties) for r in once.collect()}
    assert {r.identifier: r.properties for r in upsert.upsert_nodes(old, new, "new").collect()}["a"]["x"] == ["9"]
    added, known = upsert.insert_nodes(old, new)
    assert sorted(r.identifier for r in added.collect()) == ["a", "b", "c"] and [r.identifier for r in known.collect()] == ["a"]
    with pytest.raises(ValueError):
        upsert.merge_properties(F.lit(None), F.lit(None), "other")


def test_expansion_ignores_junk_and_follows_once(spark):
    log = [(1, "s", "a"), (2, "a", "b"), (3, "b", "c"), (4, "c", "d"), (5, "-", "z"), (6, "s", "-"), (7, "z", "y")]
    named = expand.pivots(spark.createDataFrame(log, "id long, p string, q string"), "id", ["p", "q"])
    got = {r.event_id: r.level for r in expand.expand(named, spark.createDataFrame([("S",)], "value string"), 3).collect()}
    assert got == {1: 0, 6: 0, 2: 1, 3: 2}


def test_alerts(spark):
    rows = [(1, "a", None, "k"), (2, None, "a", None), (3, "b", "c", None), (4, "c", None, None), (5, "d", None, "k2"), (6, None, None, None), (7, "k", None, None)]
    df = spark.createDataFrame(rows, "id long, ip1 string, ip2 string, s3 string")
    families = {"ip": ["ip1", "ip2"], "s3": ["s3"]}
    groups = lambda **k: {r.id: r.group for r in alerts.group_alerts(df, families, **k).collect()}
    assert groups() == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}
    assert groups(same_column=True) == {i: i for i in range(1, 8)}
    assert sorted((r.id_a, r.id_b, r.column_a, r.column_b) for r in alerts.why_grouped(df, families).collect()) == [(1, 2, "ip1", "ip2"), (3, 4, "ip2", "ip1")]
    assert {r.value: r.ids for r in alerts.ids_of_values(df, families).collect()}["a"] == [1, 2]
    many = spark.range(500).select("id", F.lit("x").alias("ip1"), F.lit(None).cast("string").alias("ip2"), F.lit(None).cast("string").alias("s3"))
    lists = [r.ids for r in alerts.ids_of_values(many, families, chunk_ids=50).collect()]
    assert len(lists) == 10 and max(map(len, lists)) < 100 and sorted(i for x in lists for i in x) == list(range(500))
    assert alerts.records_of_ids(df).filter("id = 1").first().records[0].s3 == "k"


def test_cases(spark):
    t = dt.datetime
    tracker = spark.createDataFrame(
        [(1, t(2024, 1, 1), t(2024, 1, 2), ["a"]), (2, t(2024, 1, 3), None, ["b"]), (3, t(2024, 1, 4), None, ["all"])],
        "row_id long, added_time timestamp_ntz, processed_time timestamp_ntz, datasource array<string>",
    )
    delta = cases.next_delta(tracker).first()
    assert (delta.status, delta.start_time, delta.end_time, delta.sources) == ("yes", t(2024, 1, 2, 23, 59, 30), t(2024, 1, 4, 0, 0, 30), ["all"])
    assert cases.next_delta(tracker.filter("row_id = 1")).first().status == "no"
    assert cases.query_array(spark, {"ip": ["2", "1"]}).first().query[0].propertyValue == "1"
    assert cases.recent(tracker, "added_time", 24, "h").count() == 2


def test_logs(spark):
    line = "src_user=Bob@local; dst_user=eve op=read write sent_bytes=12; arg=/a/b.exe"
    df = spark.createDataFrame([(line,), ("",), (None,)], "line string")
    got = logs.firewall_fields(df, "line").collect()
    assert (got[0].src_user, got[0].operation, got[0].sent_bytes, got[0].process, got[0].url) == ("Bob@acme.com", "read write", "12", "b.exe", "")
    assert got[2].argument == ""
    pairs = spark.createDataFrame([("a=1; b=x=y;c;a=2",), (None,)], "s string").select(logs.pairs_to_map(F.col("s")).alias("m")).collect()
    assert pairs[0].m == {"b": "x=y", "a": "2"} and pairs[1].m is None
    assert spark.range(1).select(logs.braced_to_map(F.lit("{k=v, l=w}")).alias("m")).first().m == {"k": "v", "l": "w"}
    kinds = spark.createDataFrame([("1.2.3.4",), ("1.2.3.256",), ("::1",), ("fe80::1",), ("a::b::c",), ("x",)], "s string")
    assert [r[0] for r in kinds.select(text.ip_kind(F.col("s"))).collect()] == ["ipv4", "NA", "ipv6", "ipv6", "NA", "NA"]
    one = spark.range(1).select(
        text.clean(F.lit("a$'\"\\é\tb")), text.without_domain(F.lit("D\\u")), text.dir_name(F.lit("/a/b")), text.first_token(F.lit("5 s")), text.normal_user(F.lit("X$@acme.com")),
        F.array_join(text.sysmon_user(F.lit("ACME\\A%$;b")), ","), F.array_join(text.base_names(F.lit("/x/A,c\\d")), ","), logs.windows_account(F.lit(None), F.lit("D\\s")),
    ).first()
    assert tuple(one) == ("a\tb", "u", "/a", "5", "x", "a,b", "a,c\\d", "s")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "s", "2024-01-02T03:04:05"), (2, "c", "s", "bad")], "n long, case_id string, ds string, t string")
    assert [r.t for r in records.typed(df, {"t": "timestamp"}).orderBy("n").collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5), None]
    records.write_staged(df, f"{tmp_path}/staged")
    assert spark.read.json(f"{tmp_path}/staged").count() == 2
    records.write_piped_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("sep", "|").option("header", True).csv(f"{tmp_path}/csv").columns == df.columns
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert records.read_json(spark, f"{tmp_path}/a.json", "a int").agg(F.sum("a")).first()[0] == 3
    records.append_variant(spark.createDataFrame([('{"a": {"b": 7}}',)], "v string"), "v", f"{tmp_path}/variant")
    assert spark.read.parquet(f"{tmp_path}/variant").select(F.variant_get("v", "$.a.b", "int")).first()[0] == 7
    assert summaries.rows_by_source(df).first().n == 2
    assert records.from_adjacent_names(df.toDF("N-a", "b c", "ds", "t")).columns == ["n_a", "b_c", "ds", "t"]


def test_time_formats(spark):
    at = dt.datetime(2024, 3, 5, 10, 20, 30)
    texts = ["2024-03-05 10:20:30", "2024-03-05T10:20:30", "2024-03-05 10:20:30Z", "2024-03-05T12:20:30+02:00", "2024-03-05t10:20:30", "Tue Mar 05 10:20:30 UTC 2024", "2024-03-05T10:20:30.000Z"]
    df = spark.createDataFrame([(t, at) for t in texts] + [("later", None), (None, None)], "t string, at timestamp_ntz")
    rows = df.withColumn("got", text.log_time(F.col("t")).cast("timestamp_ntz")).collect()
    assert [r.got for r in rows] == [r.at for r in rows]


def test_file_names_and_sides(spark):
    df = spark.createDataFrame([("C:\\bin\\A.exe,/opt/B", "1.1.1.1"), (None, None)], "path string, seen string")
    rows = df.select(text.file_names(F.col("path")).alias("p"), logs.both_sides(df, "seen", "absent").alias("s")).collect()
    assert [(r.p, tuple(r.s)) for r in rows] == [(["a.exe", "b"], ("1.1.1.1", "")), ([""], ("", ""))]


def test_field_layouts():
    assert (len(logs.MAIL_FIELDS), len(logs.FIREWALL_FIELDS)) == (26, 45)
    assert len(set(logs.FIREWALL_FIELDS)) == 45


def test_delta_and_status(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a"), (2, dt.datetime(2024, 1, 2), "b"), (3, dt.datetime(2024, 1, 9), "a")], "id long, ts timestamp_ntz, ds string")
    tracker = cases.arrivals(raw.filter("id < 3 and ds = 'a'"), "id", "ts", "ds")
    assert [r.id for r in cases.delta_rows(raw, tracker, "ts", "ds").collect()] == [1]
    done = cases.mark_processed(tracker, F.lit("2023-01-01").cast("timestamp_ntz"), F.lit("2025-01-01").cast("timestamp_ntz"), F.lit("2025-01-01").cast("timestamp_ntz"))
    assert cases.delta_rows(raw, done, "ts", "ds").count() == 0
    log = raw.select(F.col("ds").alias("case_id"), F.col("id").cast("string").alias("status"), F.col("ts").alias("at"))
    assert [(r.case_id, r.status) for r in cases.status_of(log, ["a"]).collect()] == [("a", "3")]
    assert sorted(r.case_id for r in cases.case_ids(log).collect()) == ["a", "b"]
