"""Pairs of OLD and NEW made from the test tables, the same in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of SQL views over the tables, with the text of each.
SQL = {
    "orders_new": """
      SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
        CASE WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority
      FROM orders WHERE o_orderkey % 10 <> 3
      UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 5""",
    "flipped": "SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus) FROM orders_new",
    "turns_new": "SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn <> 3",
    "customer_old": "SELECT c_custkey, nullif(c_nationkey % 4, 0) AS nk, c_name, c_mktsegment FROM customer",
    "customer_new": "SELECT c_custkey, nullif(c_nationkey % 4, 0) AS nk, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 8 <> 1",
    "lines": "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS BIGINT) AS line FROM lineitem",
    "baskets": """
      SELECT l_orderkey, items, list_transform(items, lambda x: x.flag) AS names, list_transform(items, lambda x: [x.price, x.qty]) AS pairs, {'lo': items[1].n, 'hi': items[-1].n} AS meta
      FROM (SELECT l_orderkey, list_sort(list({'n': l_linenumber, 'price': l_extendedprice, 'flag': l_returnflag, 'qty': l_quantity})) AS items FROM lineitem GROUP BY l_orderkey)""",
    "deep_old": "SELECT event_id, event_type AS kind, user_id AS n, true AS deep FROM events",
    "deep_new": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || '2' ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS n, event_id % 5 <> 0 AS deep FROM events",
    "lines_new": "SELECT l_orderkey, l_linenumber, CASE WHEN line % 13 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus, line FROM lines WHERE l_orderkey % 10 <> 7",
}


def with_views(query: str) -> str:
    """SQL with the views that it names, and those that these name."""
    needed: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        more = {name for name in SQL if re.search(rf"\b{name}\b", text)} - needed
        needed |= more
        todo += [SQL[name] for name in more]
    return "".join(f"{', ' if k else 'WITH '}{name} AS ({SQL[name]})" for k, name in enumerate(n for n in SQL if n in needed)) + " " + query


def before(*names: str) -> str:
    """The start of SQL that defines these views, with a comma for more."""
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in names) + ", "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The DataFrame of a name above."""
    t = lambda x: table(spark, sf_dir, x)
    changed = lambda test, new, old: F.when(F.expr(test), new).otherwise(F.col(old)).alias(old)
    if name == "orders_new":
        o = t("orders")
        kept = o.where("o_orderkey % 10 <> 3").select("o_orderkey", "o_custkey", "o_orderstatus", changed("o_orderkey % 7 = 0", F.col("o_totalprice") + 1, "o_totalprice"), "o_orderdate", changed("o_orderkey % 11 = 0", F.lit("changed"), "o_orderpriority"))
        return kept.unionByName(o.where("o_orderkey % 10 = 5").withColumn("o_orderkey", F.col("o_orderkey") + 1000000))
    if name == "flipped":
        return view(spark, sf_dir, "orders_new").withColumn("o_orderstatus", changed("o_orderkey % 9 = 0", F.lit("F"), "o_orderstatus"))
    if name == "turns_new":
        return t("conversations").where("turn <> 3").withColumn("text", changed("conv_id % 5 = 0", F.concat("text", F.lit("!")), "text"))
    if name in ("customer_old", "customer_new"):
        c = t("customer").select("c_custkey", F.expr("nullif(c_nationkey % 4, 0)").alias("nk"), "c_name", "c_mktsegment")
        return c if name == "customer_old" else c.where("c_custkey % 8 <> 1").withColumn("c_name", changed("c_custkey % 6 = 0", F.lit(""), "c_name"))
    if name == "baskets":
        one = F.struct(F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"))
        b = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("items"))
        return b.select(
            "l_orderkey", "items", F.transform("items", lambda x: x["flag"]).alias("names"), F.transform("items", lambda x: F.array(x["price"], x["qty"])).alias("pairs"),
            F.struct(F.col("items")[0]["n"].alias("lo"), F.element_at("items", -1)["n"].alias("hi")).alias("meta"),
        )
    if name in ("deep_old", "deep_new"):
        e, new = t("events"), name == "deep_new"
        kind = F.when(F.lit(new) & (F.col("event_id") % 4 == 0), F.concat("event_type", F.lit("2"))).otherwise(F.col("event_type"))
        n = F.when(F.lit(new) & (F.col("event_id") % 3 == 0), F.col("user_id") + 1).otherwise(F.col("user_id"))
        deep = F.when(F.lit(not new) | (F.col("event_id") % 5 != 0), F.struct(n.alias("n"), kind.alias("a/b")))
        return e.select("event_id", F.struct(kind.alias("kind"), deep.alias("deep")).alias("meta"))
    line = (F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("line")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", line)
    if name == "lines":
        return lines
    return lines.where("l_orderkey % 10 <> 7").withColumn("l_returnflag", changed("line % 13 = 0", F.lit("X"), "l_returnflag"))


def events(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """events with a nested object; the new side lacks a column, has another, nulls, strings for numbers, and objects that are null."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.struct(F.col("props").alias("raw"), F.col("user_id").alias("a/b")).alias("meta"))
    if not new:
        return e
    e = e.drop("user_id").withColumn("event_type", F.when(F.col("event_id") % 50 != 0, F.col("event_type"))).withColumn("value", F.col("value").cast("string"))
    return e.withColumn("extra", F.col("event_id") % 2 == 0).withColumn("meta", F.when(F.col("event_id") % 20 != 0, F.col("meta")))


_ZERO = "0 AS booleans, 0 AS integers, 0 AS numbers, 0 AS strings, 0 AS objects, 0 AS arrays"


def _row(side: int, path: str, parents: str, present: str, nulls: str, **kinds: str) -> str:
    counts = ", ".join(f"CAST({kinds.get(k, '0')} AS BIGINT) AS {k}" for k in ("booleans", "integers", "numbers", "strings", "objects", "arrays"))
    return f"SELECT {side} AS side, '{path}' AS path, CAST({parents} AS BIGINT) AS parent_objects, CAST({present} AS BIGINT) AS present, CAST({nulls} AS BIGINT) AS nulls, {counts} FROM events"


_WHOLE, _SOME = "count(*) FILTER (value = floor(value))", "count(*) FILTER (value <> floor(value))"
_META = "count(*) FILTER (event_id % 20 <> 0)"
PROFILE_SQL = " UNION ALL ".join([
    _row(0, "/event_id", "count(*)", "count(*)", "0", integers="count(event_id)"), _row(0, "/user_id", "count(*)", "count(*)", "count(*) - count(user_id)", integers="count(user_id)"),
    _row(0, "/event_type", "count(*)", "count(*)", "count(*) - count(event_type)", strings="count(event_type)"), _row(0, "/value", "count(*)", "count(*)", "count(*) - count(value)", integers=_WHOLE, numbers=_SOME),
    _row(0, "/meta", "count(*)", "count(*)", "0", objects="count(*)"), _row(0, "/meta/raw", "count(*)", "count(*)", "count(*) - count(props)", strings="count(props)"),
    _row(0, "/meta/a~1b", "count(*)", "count(*)", "count(*) - count(user_id)", integers="count(user_id)"),
    _row(1, "/event_id", "count(*)", "count(*)", "0", integers="count(event_id)"),
    _row(1, "/event_type", "count(*)", "count(*)", "count(*) - count(event_type) FILTER (event_id % 50 <> 0)", strings="count(event_type) FILTER (event_id % 50 <> 0)"),
    _row(1, "/value", "count(*)", "count(*)", "count(*) - count(value)", strings="count(value)"), _row(1, "/extra", "count(*)", "count(*)", "0", booleans="count(*)"),
    _row(1, "/meta", "count(*)", "count(*)", f"count(*) - {_META}", objects=_META), _row(1, "/meta/raw", _META, _META, f"{_META} - count(props) FILTER (event_id % 20 <> 0)", strings="count(props) FILTER (event_id % 20 <> 0)"),
    _row(1, "/meta/a~1b", _META, _META, f"{_META} - count(user_id) FILTER (event_id % 20 <> 0)", integers="count(user_id) FILTER (event_id % 20 <> 0)"),
])
