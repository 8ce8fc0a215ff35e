"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from veilspark.plans import queries as Q


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_sql(spark, data, name):
    df = Q.queries()[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    sql = Q.oracle_sql()[name]
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, res.fetchall())


def test_every_query_has_its_sql():
    assert set(Q.oracle_sql()) == set(Q.queries())
