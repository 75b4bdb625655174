"""Every registered query against its SQL at the smallest scale, and the driver's entry."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillmark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(round(r[k], 9) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    query, sql = registry.QUERIES[name]
    df = query(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if not sql:
        assert df.columns
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
