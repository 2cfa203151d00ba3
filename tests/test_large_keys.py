"""Queries against their SQL on keys that only larger copies of the tables reach."""

import duckdb
import pytest

from casemill import queries_case


@pytest.mark.parametrize("key", [0, 249_999, 3_090_368, 3_090_369, 8_999_999, 1_000_000_000, 1_164_287_360, 1_164_287_361, 2_602_444_799, 2_602_444_800, 10_344_473_600, 10_344_473_601, 31_000_000_000])
def test_hinted_times_of_large_keys(spark, tmp_path, key):
    spark.createDataFrame([(key,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries_case.QUERIES["H-3hints"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    wanted = con.sql(queries_case.ORACLES["H-3hints"])
    assert got.columns == list(wanted.columns)
    assert [tuple(r) for r in got.collect()] == wanted.fetchall()
