"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from lakeload.__main__ import parser, run

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    rows = result.collect()
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    expected = comparable(columns, cursor.fetchall())
    assert comparable(result.columns, rows) == expected
    assert expected


def test_entry_returns_a_row(spark):
    assert contract.entry(spark).count() == 1


def test_command_line(spark, inbox, capsys):
    def command(*words):
        run(spark, parser().parse_args(words))
        return capsys.readouterr().out

    command("generate", inbox.folder + "/made", "a.gz=20", "b.gz=30")
    out = command("ingest", inbox.folder, inbox.root, "--recursive")
    assert "loaded" in out and "50" in out
    first = command("preview", inbox.root).splitlines()[3].split("|")[1].strip()
    assert first in command("lookup", inbox.root, first)
