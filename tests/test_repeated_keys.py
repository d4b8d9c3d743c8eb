"""Queries over orders whose NEW side has keys twice, once keys go beyond a million."""

import pytest
from pyspark.sql import functions as F

from spindle import diff
from spindle.operators import reconcile
from spindle.operators.frames import Frames
from spindle.plans import catalog
from spindle.report import lines_df
from tests.conftest import SMALL, duck, same_rows

QUERIES = [
    "changes_added", "changes_all", "changes_modified", "changes_deleted", "field_patch", "field_summary", "ignore_fields", "summary", "where_filter", "where_side_transition",
    "text_changes", "text_field_patch", "text_field_summary", "text_summary", "text_where",
]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """orders with keys that others are moved to; some of these have other content, some are moved on themselves."""
    folder = tmp_path_factory.mktemp("repeated")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    moved = [orders.withColumn("o_orderkey", F.col("o_orderkey") + 1000000 * k).withColumn("o_totalprice", F.col("o_totalprice") + F.col("o_orderkey") % (k + 1)).withColumn("o_custkey", F.col("o_custkey") + k) for k in (1, 2)]
    orders.unionByName(moved[0]).unionByName(moved[1]).toPandas().to_parquet(folder / "orders.parquet", coerce_timestamps="us", index=False)
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_repeated_keys_are_joined_as_in_sql(spark, repeated, name):
    same_rows(catalog.QUERIES[name](spark, repeated), duck(repeated, catalog.ORACLE_SQL[name]))


def test_rows_of_a_key_meet_all_of_the_other_side(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, v string")
    both = Frames(make([(1, "a"), (1, "b"), (2, "x"), (2, "x")]), make([(1, "a"), (1, "c"), (3, "y"), (3, "y")]), "id", duplicates="pairs")
    assert sorted(tuple(r) for r in both.changes().collect()) == [(1, "modified")] * 3 + [(2, "deleted")] * 2 + [(3, "added")] * 2
    assert [sorted(r["id"] for r in both.changes(x).collect()) for x in ("added", "deleted", "modified")] == [[3, 3], [2, 2], [1, 1, 1]]
    assert tuple(both.summary().first()) == (1, 2, 2, 3)
    assert both.field_changes().count() == 3 and both.duplicates().count() == 0


def test_records_of_a_key_meet_all_of_the_other_side(spark, lines):
    old = lines("old.jsonl", ['{"id":1,"v":"a"}', '{"id":2,"v":"x"}', '{"id":1,"v":"b"}', '{"id":2,"v":"x"}', '{"id":4,"v":1}'])
    new = lines("new.jsonl", ['{"id":3,"v":"y"}', '{"id":1,"v":"a"}', '{"id":1,"v":"c"}', '{"id":4,"v":2}'])
    with diff(old, new, key="id", duplicates="pairs", field_diff=True, spark=spark) as r:
        assert [(c.operation.value, c.key[0], c.old_line, c.new_line) for c in r.changes()] == [
            ("modified", 1, 1, 3), ("modified", 1, 3, 2), ("modified", 1, 3, 3), ("deleted", 2, 2, None), ("deleted", 2, 4, None), ("added", 3, None, 1), ("modified", 4, 5, 4),
        ]
        assert [c.patch[0].value for c in r.changes("modified")] == ["c", "a", "c", 2]
        assert (r.equal, r.added, r.deleted, r.modified, r.has_duplicates, list(r.duplicates())) == (1, 1, 2, 4, False, [])
        assert lines_df(r, spark).where("line LIKE '%patch%'").count() == 4


@pytest.mark.parametrize("most", [1 << 28, 1 << 16])
def test_a_sieve_keeps_what_is_asked_for(spark, monkeypatch, most):
    monkeypatch.setattr(reconcile, "SIEVE_BITS", most)
    rows = spark.range(200_000).select(F.concat(F.lit("["), "id", F.lit("]")).cast("binary").alias("identity"), "id")
    asked = rows.where("id % 10 = 3").select("identity")
    kept = reconcile.sieved(rows, asked, 20_000)
    assert kept.where("id % 10 = 3").count() == 20_000
    assert kept.count() < (35_000 if most > 1 << 16 else 100_000)
    assert reconcile.sieved(rows, asked.limit(0), 0).count() == 0


def shuffled(spark):
    """Rows that all stages so far have put into shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_only_rows_that_are_asked_for_are_shuffled(spark, tmp_path):
    """Joins that are too large to be broadcast get the few rows of repeated identities, and the bodies of what is modified."""
    told = spark.range(100_000, numPartitions=4).select((F.col("id") % 2).cast("int").alias("side"), F.concat(F.lit("["), F.floor(F.col("id") / 2) % 49_900, F.lit("]")).cast("binary").alias("identity"), F.col("id").alias("line"))
    rows = told.select("*", F.lit(1).cast("long").alias("length"), *(F.xxhash64("line").alias(f"d{k}") for k in range(4)), F.col("line").cast("string").cast("binary").alias("body"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    several = rows.groupBy("identity").count().where("count > 2").select("identity").toPandas()
    asked = spark.createDataFrame(several)
    pairs = asked.select("identity", F.lit(0).cast("long").alias("old_line"), F.lit(1).cast("long").alias("new_line"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found, n in ((reconcile.every_pair(rows, asked, len(several)), 400), (reconcile.bodies(rows, pairs, len(several)), 1), (reconcile.bodies_of_each(rows, pairs, len(several)), 1)):
            before = shuffled(spark)
            assert len(found.collect()) == n
            assert shuffled(spark) - before < 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
