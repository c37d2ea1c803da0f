"""Mappings of five kinds of security records to one graph of users, hosts, addresses, processes, mails and URLs.

Fixed values: labels, property names, field names and which ends an edge has. Left out: the constant ``counter``
(equal edges are counted where an edge has an ``aggregate``), the ``edge_label`` property, which repeats the label,
and ``isAlert`` and ``objectName``, which nothing here reads. Corrected: names are cut out of paths and addresses by
own functions (``calls``), so that both ends of an edge and the vertices are written alike.
"""

from __future__ import annotations

from vertexloom.operators.mapper import Mapper

SYSMON = {
    "nodes": [
        {"label": "IP", "unique": "ip", "properties": {"ip": "SourceIp", "eventId": "EventID", "dataSourceName": "default=sysmon"}},
        {"label": "IP", "unique": "ip", "properties": {"ip": "DestinationIp", "eventId": "EventID", "dataSourceName": "default=sysmon"}},
        {"label": "host", "unique": "hostname", "properties": {"hostname": "Hostname", "dataSourceName": "default=sysmon"}},
        {"label": "user", "unique": "userName", "properties": {"userName": "analyze-user", "userId": "UserID", "dataSourceName": "default=sysmon"}},
        {"label": "process", "unique": "fileName", "properties": {"fileName": "analyze-child", "fullFileName": "Image", "dataSourceName": "default=sysmon"}},
        {"label": "process", "unique": "fileName", "properties": {"fileName": "analyze-parent", "fullFileName": "ParentImage", "dataSourceName": "default=sysmon"}},
        {"label": "process", "unique": "fileName", "properties": {"fileName": "analyze-target", "fullFileName": "TargetFilename", "dataSourceName": "default=sysmon"}},
    ],
    "edges": [
        {"label": "loggedIn", "left": "user.userName(analyze-user)", "right": "host.hostname(Hostname)", "properties": {"eventTime": "EventTime", "eventId": "EventID", "dataSourceName": "default=sysmon"}},
        {"label": "hasIP", "left": "user.userName(analyze-user)", "right": "IP.ip(SourceIp)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "dataSourceName": "default=sysmon"}},
        {"label": "withIP", "left": "host.hostname(Hostname)", "right": "IP.ip(SourceIp)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "dataSourceName": "default=sysmon"}},
        {"label": "runningProcess", "left": "host.hostname(Hostname)", "right": "process.fileName(analyze-parent)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "dataSourceName": "default=sysmon"}},
        {"label": "createdProcess", "left": "user.userName(analyze-user)", "right": "process.fileName(analyze-parent)", "properties": {"eventTime": "EventTime", "commandLine": "CommandLine", "dataSourceName": "default=sysmon"}},
        {"label": "createdProcess", "left": "user.userName(analyze-user)", "right": "process.fileName(analyze-target)", "properties": {"eventTime": "EventTime", "commandLine": "CommandLine", "dataSourceName": "default=sysmon"}},
        {"label": "createdChildProcess", "left": "process.fileName(analyze-parent)", "right": "process.fileName(analyze-child)", "properties": {"eventTime": "EventTime", "commandLine": "CommandLine", "dataSourceName": "default=sysmon"}},
        {"label": "childProcessOn", "left": "process.fileName(analyze-child)", "right": "host.hostname(Hostname)", "properties": {"eventTime": "EventTime", "commandLine": "CommandLine", "dataSourceName": "default=sysmon"}},
        {"label": "downloadedBy", "left": "process.fileName(analyze-parent)", "right": "user.userName(analyze-user)", "properties": {"eventTime": "EventTime", "dataSourceName": "default=sysmon"}},
        {"label": "downloadedOn", "left": "process.fileName(analyze-parent)", "right": "IP.ip(SourceIp)", "properties": {"eventTime": "EventTime", "dataSourceName": "default=sysmon"}},
        {"label": "processCommunicated", "left": "process.fileName(analyze-parent)", "right": "IP.ip(DestinationIp)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "srcPort": "SourcePort", "dstPort": "DestinationPort", "dataSourceName": "default=sysmon"}},
        {"label": "IPsCommunicated", "left": "IP.ip(SourceIp)", "right": "IP.ip(DestinationIp)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "srcPort": "SourcePort", "dstPort": "DestinationPort", "dataSourceName": "default=sysmon"}},
    ],
    "calls": {
        "user": {"function": "sysmon_user", "fields": ["User"], "many": True},
        "child": {"function": "file_names", "fields": ["Image"], "many": True},
        "parent": {"function": "file_names", "fields": ["ParentImage"], "many": True},
        "target": {"function": "file_names", "fields": ["TargetFilename"], "many": True},
    },
}

WINDOWS = {
    "nodes": [
        {"label": "user", "unique": "userName", "properties": {"userName": "analyze-target", "userId": "TargetUserSid", "dataSourceName": "default=windows"}},
        {"label": "user", "unique": "userName", "properties": {"userName": "analyze-subject", "userId": "SubjectUserSid", "dataSourceName": "default=windows"}},
        {"label": "host", "unique": "hostname", "properties": {"hostname": "Hostname", "dataSourceName": "default=windows"}},
        {"label": "IP", "unique": "ip", "properties": {"ip": "IpAddress", "ports": "IpPort", "dataSourceName": "default=windows"}},
        {"label": "process", "unique": "fullFileName", "properties": {"fullFileName": "FullFileName", "fileName": "FileName", "filePath": "Path", "dataSourceName": "default=windows"}},
    ],
    "edges": [
        {"label": "loggedIn", "left": "user.userName(analyze-target)", "right": "IP.ip(IpAddress)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "category": "Category", "severityValue": "SeverityValue", "workStationName": "WorkStationName", "dataSourceName": "default=windows"}},
        {"label": "hasIP", "left": "user.userName(analyze-target)", "right": "IP.ip(IpAddress)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "category": "Category", "severityValue": "SeverityValue", "dataSourceName": "default=windows"}},
        {"label": "createdProcess", "left": "user.userName(analyze-target)", "right": "process.fullFileName(FullFileName)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "category": "Category", "severityValue": "SeverityValue", "dataSourceName": "default=windows"}},
        {"label": "withIP", "left": "host.hostname(Hostname)", "right": "IP.ip(IpAddress)", "properties": {"eventTime": "EventTime", "processID": "ProcessID", "eventId": "EventID", "category": "Category", "severityValue": "SeverityValue", "dataSourceName": "default=windows"}},
    ],
    "calls": {
        "target": {"function": "windows_user", "fields": ["TargetUserName"], "many": True},
        "subject": {"function": "windows_user", "fields": ["SubjectUserName"], "many": True},
    },
}

MAIL = {
    "nodes": [
        {"label": "user", "unique": "userName", "properties": {"userName": "sender_address", "dataSourceName": "default=mail"}},
        {"label": "user", "unique": "userName", "properties": {"userName": "analyze-recipients", "recipients": "recipient_count", "dataSourceName": "default=mail"}},
        {"label": "IP", "unique": "ip", "properties": {"ip": "server_ip", "eventId": "event_id", "dataSourceName": "default=mail"}},
        {"label": "IP", "unique": "ip", "properties": {"ip": "client_ip", "eventId": "event_id", "dataSourceName": "default=mail"}},
        {"label": "host", "unique": "hostname", "properties": {"hostname": "server_hostname", "dataSourceName": "default=mail"}},
        {"label": "host", "unique": "hostname", "properties": {"hostname": "client_hostname", "dataSourceName": "default=mail"}},
        {"label": "email", "unique": "emailSubject", "properties": {"emailSubject": "message_subject", "messageID": "message_id", "messageBytes": "total_bytes", "dataSourceName": "default=mail"}},
    ],
    "edges": [
        {"label": "sentEmail", "left": "user.userName(sender_address)", "right": "email.emailSubject(message_subject)", "properties": {"emailTime": "datetime", "category": "event_id", "srcHost": "client_hostname", "dataSourceName": "default=mail"}},
        {"label": "receivedEmail", "left": "email.emailSubject(message_subject)", "right": "user.userName(analyze-recipients)", "properties": {"emailTime": "datetime", "category": "event_id", "dstHost": "server_hostname", "dataSourceName": "default=mail"}},
        {"label": "emailOriginatedFrom", "left": "email.emailSubject(message_subject)", "right": "IP.ip(server_ip)", "properties": {"emailTime": "datetime", "category": "event_id", "dataSourceName": "default=mail"}},
        {"label": "emailSentTo", "left": "email.emailSubject(message_subject)", "right": "IP.ip(client_ip)", "properties": {"emailTime": "datetime", "category": "event_id", "dataSourceName": "default=mail"}},
        {"label": "hasIP", "left": "user.userName(sender_address)", "right": "IP.ip(server_ip)", "properties": {"eventTime": "datetime", "dataSourceName": "default=mail"}},
        {"label": "hasIP", "left": "user.userName(analyze-recipients)", "right": "IP.ip(client_ip)", "properties": {"eventTime": "datetime", "dataSourceName": "default=mail"}},
        {"label": "withIP", "left": "host.hostname(server_hostname)", "right": "IP.ip(server_ip)", "properties": {"eventTime": "datetime", "dataSourceName": "default=mail"}},
        {"label": "withIP", "left": "host.hostname(client_hostname)", "right": "IP.ip(client_ip)", "properties": {"eventTime": "datetime", "dataSourceName": "default=mail"}},
    ],
    "calls": {
        "recipients": {"function": "recipients", "fields": ["recipient_address"], "many": True},
    },
}

FIREWALL = {
    "nodes": [
        {"label": "IP", "unique": "ip", "properties": {"ip": "ip_src_addr", "dataSourceName": "default=firewall"}},
        {"label": "IP", "unique": "ip", "properties": {"ip": "ip_dst_addr", "dataSourceName": "default=firewall"}},
        {"label": "user", "unique": "userName", "properties": {"userName": "src_user", "dataSourceName": "default=firewall"}},
        {"label": "user", "unique": "userName", "properties": {"userName": "dst_user", "dataSourceName": "default=firewall"}},
        {"label": "URLs", "unique": "URL", "properties": {"URL": "url", "dataSourceName": "default=firewall"}},
        {"label": "process", "unique": "fileName", "properties": {"fileName": "process", "filePath": "analyze-folder", "fullFileName": "argument", "dataSourceName": "default=firewall"}},
    ],
    "edges": [
        {"label": "IPsCommunicated", "left": "IP.ip(ip_src_addr)", "right": "IP.ip(ip_dst_addr)", "properties": {"sentBytes": "sent_bytes", "receivedBytes": "rcvd_bytes", "elapsedTime": "analyze-elapsed", "operation": "operation", "srcPort": "ip_src_port", "dstPort": "ip_dst_port", "policy": "policy", "eventTime": "timestamp", "dataSourceName": "default=firewall"}},
        {"label": "downloadedFrom", "left": "process.fileName(process)", "right": "URLs.URL(url)", "properties": {"sentBytes": "sent_bytes", "receivedBytes": "rcvd_bytes", "elapsedTime": "analyze-elapsed", "operation": "operation", "srcPort": "ip_src_port", "dstPort": "ip_dst_port", "dataSourceName": "default=firewall"}},
        {"label": "clicked", "left": "user.userName(src_user)", "right": "URLs.URL(url)", "properties": {"sentBytes": "sent_bytes", "receivedBytes": "rcvd_bytes", "elapsedTime": "analyze-elapsed", "operation": "operation", "dataSourceName": "default=firewall"}},
        {"label": "clicked", "left": "user.userName(dst_user)", "right": "URLs.URL(url)", "properties": {"sentBytes": "sent_bytes", "receivedBytes": "rcvd_bytes", "elapsedTime": "analyze-elapsed", "operation": "operation", "dataSourceName": "default=firewall"}},
        {"label": "hasIP", "left": "user.userName(src_user)", "right": "IP.ip(ip_src_addr)", "properties": {"dataSourceName": "default=firewall"}},
        {"label": "hasIP", "left": "user.userName(dst_user)", "right": "IP.ip(ip_dst_addr)", "properties": {"dataSourceName": "default=firewall"}},
        {"label": "downloadedOn", "left": "process.fileName(process)", "right": "IP.ip(ip_src_addr)", "properties": {"dataSourceName": "default=firewall"}},
        {"label": "downloadedOn", "left": "process.fileName(process)", "right": "IP.ip(ip_dst_addr)", "properties": {"dataSourceName": "default=firewall"}},
        {"label": "downloadedBy", "left": "process.fileName(process)", "right": "user.userName(src_user)", "properties": {"downloadSize": "rcvd_bytes", "dataSourceName": "default=firewall"}},
        {"label": "downloadedBy", "left": "process.fileName(process)", "right": "user.userName(dst_user)", "properties": {"downloadSize": "rcvd_bytes", "dataSourceName": "default=firewall"}},
    ],
    "calls": {
        "elapsed": {"function": "first_token", "fields": ["elapsed_time"]},
        "folder": {"function": "dir_name", "fields": ["argument"]},
    },
}

ENDPOINT = {
    "nodes": [
        {"label": "host", "unique": "hostname", "properties": {"hostname": "Hostname", "eventId": "EventID", "dataSourceName": "default=endpoint"}},
        {"label": "process", "unique": "fullFileName", "properties": {"fullFileName": "FullFileName", "fileName": "FileName", "filePath": "Path", "action": "Action", "dataSourceName": "default=endpoint"}},
    ],
    "edges": [
        {"label": "runningProcess", "left": "host.hostname(Hostname)", "right": "process.fullFileName(FullFileName)", "properties": {"eventTime": "EventTime", "eventId": "EventID", "dataSourceName": "default=endpoint"}},
    ],
    "calls": {
    },
}

#: Mappers by kind of record.
MAPPERS = {kind: Mapper.from_dict(spec) for kind, spec in {"sysmon": SYSMON, "windows": WINDOWS, "mail": MAIL, "firewall": FIREWALL, "endpoint": ENDPOINT}.items()}
