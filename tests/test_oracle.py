"""Each registered query that has SQL gives the rows that DuckDB gives for it; the others run and have a stable schema."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from casemill import link_queries, record_queries, store_queries  # noqa: F401
from casemill import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"l5_detection_metrics", "l11_open_cases", "l13_rates"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(cursor_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6)
        return str(v) if not isinstance(v, (bool, int)) else v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    want = duck.sql(own.ORACLE_SQL[name])
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert got == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE_SQL) - SLOW))
def test_query_without_sql_runs_and_repeats(spark, name):
    first = own.QUERIES[name](spark, SF)
    rows = sorted(map(repr, first.collect()))
    assert rows and rows == sorted(map(repr, own.QUERIES[name](spark, SF).collect()))


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
