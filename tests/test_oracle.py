"""Every query that has SQL against DuckDB at the smallest size."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, views, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = views.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()]
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
