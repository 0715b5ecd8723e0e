import duckdb
import pytest
from oracle import assert_same, connect

from quern.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["q6_forecast_revenue"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


def test_range_join_compares_no_pairs(spark, tmp_path):
    """Parts meet suppliers by equal keys, in all cores; nulls and repeated keys as in SQL."""
    spark.createDataFrame([(1, 20), (1, 20), (2, 22), (3, 23), (4, None), (None, 21), (5, 17), (6, 50)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, None), (None, 2), (4, -3), (5, 28)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.QUERIES["join_theta_range"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert_same(df, con, catalogue.ORACLES["join_theta_range"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
