"""Queries against their SQL on the smallest tables, where those are present."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def shape(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_equals_sql(spark, connection, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DIR)
    got = shape([tuple(r) for r in df.collect()], df.columns)
    rel = connection.sql(entry.oracle_sql()[name])
    expected = shape(rel.fetchall(), rel.columns)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_greedy_query_runs(spark):
    import __spark_entry__ as entry

    assert 0 < entry.queries()["greedy_dedup"](spark, DIR).count() <= 200
