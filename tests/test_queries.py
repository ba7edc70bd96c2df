import pytest

from keystrata.queries import QUERIES, SQL

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, SQL[name])


def test_kv_store_holds_all_events(spark):
    from keystrata.queries import _events_kv

    sf = "/root/testdata/sf0.01"
    assert _events_kv(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count() > 3000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_key_range_reaches_the_scan(spark):
    plan = QUERIES["key_range_incl"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
