import pytest

import __spark_entry__
from spindle.plans import catalog
from tests.conftest import SMALL, duck, same_rows


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_agrees_with_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck(SMALL, catalog.ORACLE_SQL[name]))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    from spindle.operators.frames import Frames

    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    found = Frames(orders, orders, "o_orderkey", where="o_orderstatus == 'F'").changes("added")
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan or "EqualNullSafe(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan.split("== Physical Plan ==")[1]


def test_places_where_ranges_are_sampled(spark, tmp_path):
    """More rows than the sample that ranges are drawn from: computed twice, they differ."""
    spark.range(60_000).withColumnRenamed("id", "p_partkey").repartition(8).write.parquet(f"{tmp_path}/part.parquet")
    same_rows(catalog.QUERIES["canonical_order"](spark, str(tmp_path)), duck(tmp_path, catalog.ORACLE_SQL["canonical_order"]))
