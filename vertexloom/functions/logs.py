"""Fields of log lines and of records of several sources, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.text import ip_kind, without_domain

#: Fixed keys of firewall lines and the columns that they become.
FIREWALL_KEYS = {
    "src_user": "src_user", "dst_user": "dst_user", "dstname": "url", "arg": "argument", "geo_src": "src_geo", "geo_dst": "dst_geo",
    "sent_bytes": "sent_bytes", "rcvd_bytes": "rcvd_bytes", "elapsed_time": "elapsed_time", "op": "operation",
}

#: Fixed order of the fields of a mail tracking line.
MAIL_FIELDS = (
    "datetime", "client-ip", "client-hostname", "server-ip", "server-hostname", "source-context", "connector-id", "source", "event-id", "internal-message-id", "message-id",
    "recipient-address", "recipient-status", "total-bytes", "recipient-count", "related-recipient-address", "reference", "message-subject", "sender-address", "return-path",
    "message-info", "directionality", "tenant-id", "original-client-ip", "original-server-ip", "custom-data",
)
#: Fixed order of the fields of a firewall line; those without a name are called by their position.
FIREWALL_FIELDS = (
    "sid", "cluster", "sn", "messageID", "tag_id", "raw_id", "disp", "direction", "pri", "policy", "protocol", "ip_src_addr", "ip_src_port", "ip_dst_addr", "ip_dst_port", "src_ip_nat",
    "src_port_nat", "dst_ip_nat", "dst_port_nat", "src_intf", "dst_intf", "rc", "pckt_len", "ttl", "pr_info", "proxy_act", "alarm_name", "alarm_type", "alarm_id", "info_1", "info_2",
    "info_3", "info_4", "info_5", "info_6", *[f"property{n}" for n in range(35, 41)], "log_type", "msg", "bucket", "timestamp",
)


def key_value(line: Column, key: str) -> Column:
    """The value of ``key=value`` in a line of such pairs parted by spaces; empty if it is not there.

    A value runs up to the next `` key=`` or the end; semicolons are dropped.
    """
    found = F.regexp_extract(F.coalesce(line, F.lit("")), rf"(?:^|\W){key}=([^=]*?)(?=\s\w+=|$)", 1)
    return F.translate(found, ";", "")


def firewall_fields(df: DataFrame, line: str) -> DataFrame:
    """Every known field of a firewall line as a column, and the process that its argument names."""
    out = df.withColumns({name: key_value(F.col(line), key) for key, name in FIREWALL_KEYS.items()})
    local = lambda c: F.regexp_replace(c, "@local$", "@acme.com")
    return out.withColumns(
        {"src_user": local(F.col("src_user")), "dst_user": local(F.col("dst_user")), "process": F.regexp_extract("argument", "([^/]*)$", 1)}
    )


def pairs_to_map(text: Column, separator: str = ";", between: str = "=") -> Column:
    """``k=v;k=v`` as a map with trimmed keys and values; the last of equal keys wins."""
    parts = F.filter(F.split(text, f"\\Q{separator}\\E"), lambda p: p.contains(between))
    keys = F.transform(parts, lambda p: F.trim(F.substring_index(p, between, 1)))
    values = F.transform(parts, lambda p: F.trim(F.substring(p, F.locate(between, p) + len(between), F.length(p))))
    last = F.filter(F.transform(keys, lambda k, i: F.when(~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k), F.struct(k.alias("k"), values[i].alias("v")))), lambda e: e.isNotNull())
    return F.map_from_entries(last)


def braced_to_map(text: Column, separator: str = ",") -> Column:
    """``{k=v, k=v}`` as a map."""
    return pairs_to_map(F.translate(text, "{}", ""), separator)


def split_fields(df: DataFrame, line: str, fields: Sequence[str], separator: str = ",") -> DataFrame:
    """Named columns from a line by position: trimmed, lower-cased, missing ones empty; names with ``_`` for ``-``."""
    parts = F.split(F.coalesce(F.col(line), F.lit("")), f"\\Q{separator}\\E")
    return df.select("*", *[F.lower(F.trim(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")))).alias(f.lower().replace("-", "_")) for i, f in enumerate(fields)])


def sender_and_recipients(sender: Column, receiver: Column) -> Column:
    """All users, or addresses, of both fields, semicolons parting them."""
    return F.concat(F.split(F.coalesce(sender, F.lit("")), ";"), F.split(F.coalesce(receiver, F.lit("")), ";"))


def side_name(kind: Column) -> Column:
    return F.when(kind == "source", "src").otherwise("dest")


def inner_and_outer(virtual: Column, seen: Column) -> Column:
    """Internal and external address of an event: the virtual one is internal if there is one, else the one seen."""
    has = F.coalesce(virtual, F.lit("")) != ""
    return F.struct(
        F.when(has, virtual).otherwise(seen).alias("internal"), F.when(has, seen).otherwise("").alias("external"), F.when(has, "external").otherwise("").alias("external_type")
    )


def address_kinds(first: Column, second: Column) -> Column:
    """Kinds of a pair of addresses; empty ones are ``NA``."""
    return F.struct(ip_kind(F.coalesce(first, F.lit(""))).alias("first"), ip_kind(F.coalesce(second, F.lit(""))).alias("second"))


def both_sides(df: DataFrame, source: str, destination: str) -> Column:
    """Source and destination address, or host, of a record; empty where it lacks the field or has a null."""
    side = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return F.struct(side(source).alias("source"), side(destination).alias("destination"))


def windows_account(target: Column, subject: Column) -> Column:
    """The target user, or else the subject, without domain."""
    return without_domain(F.coalesce(target, subject, F.lit("")))


def proxy_url(name: Column) -> Column:
    """A destination name unless it is an address."""
    return F.when(name.isNotNull() & (ip_kind(name) == "NA"), name).otherwise("")
