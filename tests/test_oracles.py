"""Every registered query of the engine against its SQL twin, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quantloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def table(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, db, name):
    found = queries.QUERIES[name](spark, SF)
    cursor = db.execute(queries.ORACLES[name])
    assert table(found.columns, found.collect()) == table([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_without_sql_runs(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns and found.count() > 0
