"""Every registered query of the evidence operators against its DuckDB SQL, on the small tables."""

import math
import os

import duckdb
import pytest

from casemill import queries, queries_browser, queries_case, queries_sources

SF = "/root/testdata/sf0.001"
QUERIES = {**queries.queries(), **queries_browser.queries(), **queries_sources.queries(), **queries_case.queries()}
ORACLES = {**queries.oracle_sql(), **queries_browser.oracle_sql(), **queries_sources.oracle_sql(), **queries_case.oracle_sql()}


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if sql := ORACLES.get(name):
        got = con.sql(sql)
        assert sorted(df.columns) == sorted(got.columns)
        assert plain(rows, df.columns) == plain(got.fetchall(), got.columns)
