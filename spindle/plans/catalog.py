"""Queries of the reconciliation operators over the test tables, with the SQL each must agree with."""

from __future__ import annotations

import atexit
import functools
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.columns import where
from spindle.operators import reconcile
from spindle.operators.frames import Frames, identity
from spindle.operators.profile import summary as schema_counts
from spindle.plans.cases import PROFILE_SQL, before, events, table, view, with_views
from spindle.report import lines_df
from spindle.result import DiffResult, diff
from spindle.sources.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_views(sql) if not sql.startswith("!") else sql[1:]
        return run

    return put


# --- DataFrame lane --------------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str, new: str = "orders_new", **kw) -> Frames:
    """Keys that were moved by a million may meet others there, and SQL joins all rows of a key."""
    return Frames(table(spark, sf_dir, "orders"), view(spark, sf_dir, new), "o_orderkey", duplicates="pairs", **kw)


def _pairs(old: str, new: str, keys: list[str], content: list[str]) -> str:
    """SQL that classifies each identity of two relations."""
    on = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in keys)
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in content) or "true"
    key = ", ".join(f"CASE WHEN o.here THEN o.{k} ELSE n.{k} END AS {k}" for k in keys)
    return f"""SELECT {key}, CASE WHEN o.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'deleted' WHEN {same} THEN 'equal' ELSE 'modified' END AS operation
      FROM (SELECT *, true AS here FROM {old}) o FULL JOIN (SELECT *, true AS here FROM {new}) n ON {on}"""


def _totals(pairs: str) -> str:
    return "SELECT " + ", ".join(f"count(*) FILTER (operation = '{x}') AS {x}" for x in ("equal", "added", "deleted", "modified")) + f" FROM ({pairs})"


_CONTENT = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDERS = _pairs("orders", "orders_new", ["o_orderkey"], _CONTENT)


@query("summary", _totals(_ORDERS))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).summary()


@query("changes_all", f"SELECT * FROM ({_ORDERS}) WHERE operation <> 'equal'")
def changes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).changes()


for _op in ("added", "deleted", "modified"):
    query(f"changes_{_op}", f"SELECT * FROM ({_ORDERS}) WHERE operation = '{_op}'")(functools.partial(lambda spark, sf_dir, op: _orders(spark, sf_dir).changes(op), op=_op))


@query("composite_key", f"SELECT * FROM ({_pairs('conversations', 'turns_new', ['conv_id', 'turn'], ['role', 'text'])}) WHERE operation <> 'equal'")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frames(table(spark, sf_dir, "conversations"), view(spark, sf_dir, "turns_new"), ["turn", "conv_id"]).changes()


@query("null_key_component", f"SELECT * FROM ({_pairs('customer_old', 'customer_new', ['c_custkey', 'nk'], ['c_name', 'c_mktsegment'])}) WHERE operation <> 'equal'")
def null_key_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frames(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), ["c_custkey", "nk"]).changes()


@query("ignore_fields", _totals(_pairs("orders", "orders_new", ["o_orderkey"], [c for c in _CONTENT if c not in ("o_totalprice", "o_orderpriority")])))
def ignore_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, ignore=["/o_totalprice", "/o_orderpriority", "/absent"]).summary()


@query("ignore_nested", "!SELECT event_id, 'modified' AS operation FROM events WHERE event_id % 4 = 0 AND event_type IS NOT NULL")
def ignore_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two members of an object that change, one is ignored."""
    e = table(spark, sf_dir, "events")
    nested = lambda seen, kind: F.struct(seen.alias("at"), kind.alias("kind"))
    old = e.select("event_id", nested(F.col("ts").cast("string"), F.col("event_type")).alias("meta"))
    new = e.select("event_id", nested(F.lit("later"), F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit("2"))).otherwise(F.col("event_type"))).alias("meta"))
    return Frames(old, new, "event_id", ignore=["/meta/at"]).changes()


def _where(test: str, new: str = "orders_new") -> str:
    return _pairs(f"(SELECT * FROM orders WHERE {test})", f"(SELECT * FROM {new} WHERE {test})", ["o_orderkey"], _CONTENT)


@query("where_filter", _totals(_where("o_orderstatus = 'F' AND o_totalprice > 1000.5 OR contains(o_orderpriority, 'HIGH')")))
def where_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, where="o_orderstatus == 'F' && o_totalprice > `1000.5` || contains(o_orderpriority, 'HIGH')").summary()


@query("where_side_transition", f"SELECT * FROM ({_where(chr(39).join(['o_orderstatus = ', 'F', '']), 'flipped')}) WHERE operation <> 'equal'")
def where_side_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that only one side's filter selects counts as added or deleted."""
    return _orders(spark, sf_dir, "flipped", where="o_orderstatus == 'F'").changes()


@query("where_truthiness", _totals(_pairs("customer_old", "(SELECT * FROM customer_new WHERE c_name <> '')", ["c_custkey", "nk"], ["c_name", "c_mktsegment"])))
def where_truthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty string is false, and zero is true."""
    return Frames(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), ["c_custkey", "nk"], where="c_name && c_custkey").summary()


#: JMESPath filters over baskets of lines, with the SQL of each: one or more for each kind of expression.
FILTERS = {
    "current_pipe": ('@.l_orderkey > `50` && (items[0] | n == `1`) && "l_orderkey" != `77`', "l_orderkey > 50 AND items[1].n = 1 AND l_orderkey <> 77"),
    "index": ("items[-1].flag == 'R' || items[9]", "items[-1].flag = 'R' OR len(items) > 9"),
    "slice": ("(items[::-1] | [0].n) > `2` && items[1:3] && (items[-2:] | [1].qty) > `3` && items[::2].n", "items[-1].n > 2 AND len(items) >= 2 AND items[-1].qty > 3"),
    "projection_flatten": ("length(items[*].flag) > `2` && length(pairs[]) < `9`", "len(items) > 2 AND 2 * len(items) < 9"),
    "object_projection": ("max(meta.*) > `3` && length(meta.*) == `2`", "greatest(meta.lo, meta.hi) > 3"),
    "filter_projection": ("items[?flag == 'R' && qty > `30`].n", "len(list_filter(items, lambda x: x.flag = 'R' AND x.qty > 30)) > 0"),
    "multiselect": ("max([meta.lo, meta.hi, `2`]) == `2` || {a: meta.lo, b: l_orderkey}.b < `40`", "greatest(meta.lo, meta.hi, 2) = 2 OR l_orderkey < 40"),
    "by_expression": ("sort_by(items, &qty)[0].n == `1` && max_by(items, &n).flag != min_by(items, &n).flag", "items[list_position(list_transform(items, lambda x: x.qty), list_min(list_transform(items, lambda x: x.qty)))].n = 1 AND items[list_position(list_transform(items, lambda x: x.n), list_max(list_transform(items, lambda x: x.n)))].flag <> items[1].flag"),
    "numbers": ("avg(items[*].qty) > `25` && sum(items[*].n) >= `3` && abs(meta.lo) == `1` && floor(items[0].price) <= ceil(items[0].price)", "list_avg(list_transform(items, lambda x: x.qty)) > 25 AND list_sum(list_transform(items, lambda x: x.n)) >= 3 AND meta.lo = 1"),
    "sort": ("sort(names)[0] == 'A' && min(names) == 'A' && max(names) == 'R'", "list_min(names) = 'A' AND list_max(names) = 'R'"),
    "length": ("length(names) == `3` || length(join('', names)) == `5`", "len(items) IN (3, 5)"),
    "conversions": ("to_number(to_string(l_orderkey)) == `7` || type(items) == 'array' && type(absent) == 'null' && l_orderkey < `100` && to_number('1e1') == `10`", "l_orderkey = 7 OR l_orderkey < 100"),
    "objects": ("contains(keys(meta), 'hi') && merge(meta, {hi: `0`}).hi == `0` && length(values(meta)) == `2` && contains(map(&flag, items), 'R')", "list_contains(names, 'R')"),
    "not_null": ("not_null(absent, meta.hi) == `4` && length(to_array(meta.lo)) == `1` && to_array(names)[0] != 'N'", "meta.hi = 4 AND names[1] <> 'N'"),
    "strings": ("join('', reverse(names)) != join('', names) && starts_with(reverse(join('', names)), 'R') && ends_with(names[-1], 'R')", "list_aggregate(list_reverse(names), 'string_agg', '') <> list_aggregate(names, 'string_agg', '') AND names[-1] = 'R'"),
}


def _filtered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    baskets = view(spark, sf_dir, "baskets")
    return baskets.where(where(FILTERS[kind][0], baskets.schema)).select("l_orderkey")


for _kind, (_, _sql) in FILTERS.items():
    query(f"where_{_kind}", f"SELECT l_orderkey FROM baskets WHERE {_sql}")(functools.partial(_filtered, kind=_kind))


_LINE_KEYS = ["l_orderkey", "l_linenumber"]


def _lines(spark: SparkSession, sf_dir: str, policy: str) -> Frames:
    return Frames(view(spark, sf_dir, "lines"), view(spark, sf_dir, "lines_new"), _LINE_KEYS, duplicates=policy, order="line", ignore=["/line"])


def _selected(relation: str, end: str) -> str:
    return f"(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY line {end}) AS k FROM {relation}) WHERE k = 1)"


for _policy, _end in (("first", "ASC"), ("last", "DESC")):
    _sql = _pairs(_selected("lines", _end), _selected("lines_new", _end), _LINE_KEYS, ["l_returnflag", "l_linestatus"])
    query(f"duplicates_{_policy}", f"SELECT * FROM ({_sql}) WHERE operation <> 'equal'")(functools.partial(lambda spark, sf_dir, p: _lines(spark, sf_dir, p).changes(), p=_policy))


def _identity_sql(*keys: str) -> str:
    return "'[' || " + " || ',' || ".join(keys) + " || ']'"


@query("duplicate_counts", "SELECT side, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT 0 AS side, count(*) AS n FROM lines GROUP BY l_orderkey, l_linenumber UNION ALL SELECT 1, count(*) FROM lines_new GROUP BY l_orderkey, l_linenumber) GROUP BY side")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "first").duplicate_counts()


_DUPLICATES = " UNION ALL ".join(
    f"SELECT {side} AS side, {_identity_sql('l_linenumber', 'l_orderkey')} AS identity, s AS selected_line, line AS discarded_line, l_returnflag = f AND l_linestatus = t AS content_equal FROM (SELECT *, first_value(line) OVER w AS s, first_value(l_returnflag) OVER w AS f, first_value(l_linestatus) OVER w AS t FROM {name} WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY line)) WHERE line <> s"
    for side, name in enumerate(("lines", "lines_new"))
)


@query("duplicate_records", _DUPLICATES)
def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "first").duplicates().withColumn("identity", F.col("identity").cast("string"))


@query("duplicate_error_detect", f"SELECT {_identity_sql('l_linenumber', 'l_orderkey')} AS identity, a[1] AS first, a[2] AS again FROM (SELECT l_orderkey, l_linenumber, list(line ORDER BY line) AS a FROM lines GROUP BY ALL HAVING count(*) > 1)")
def duplicate_error_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Frames(view(spark, sf_dir, "lines"), view(spark, sf_dir, "lines_new"), _LINE_KEYS, order="line", ignore=["/line"]).faults()
    return found.where("side = 0 and fault = 'duplicate key'").select("identity", "first", "again")


def _faults_sql(relation: str, side: int) -> str:
    return f"""SELECT {side} AS side, CASE WHEN nk IS NULL THEN 'null key' ELSE 'duplicate key' END AS fault, '[' || coalesce(CAST(nk AS VARCHAR), 'null') || ']' AS identity, count(*) AS n
      FROM {relation} GROUP BY nk HAVING nk IS NULL OR count(*) > 1"""


@query("frame_faults", _faults_sql("customer_old", 0) + " UNION ALL " + _faults_sql("customer_new", 1))
def frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null key, and identities of several rows, as rows and not as an error."""
    return Frames(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), "nk").faults().select("side", "fault", "identity", "n")


_TIES = " UNION ALL ".join(
    f"""SELECT {side} AS side, '[' || l_orderkey || ']' AS identity, CAST(s.n AS BIGINT) AS selected_line, CAST(l_linenumber AS BIGINT) AS discarded_line, {{'a': l_linestatus, 'b': l_returnflag}} = s.c AS content_equal
      FROM (SELECT *, first_value({{'n': l_linenumber, 'c': {{'a': l_linestatus, 'b': l_returnflag}}}}) OVER w AS s, row_number() OVER w AS k FROM {name}
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag)) WHERE k > 1"""
    for side, name in enumerate(("lines", "lines_new"))
)


@query("duplicate_ties", _TIES)
def duplicate_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one identity and place are told apart by content, and none of them is lost."""
    found = Frames(view(spark, sf_dir, "lines"), view(spark, sf_dir, "lines_new"), "l_orderkey", duplicates="first", order="l_linenumber", ignore=["/line", "/l_linenumber"]).duplicates()
    return found.withColumn("identity", F.col("identity").cast("string"))


@query("odd_columns", "!SELECT p_partkey, 'modified' AS operation FROM part WHERE p_size % 3 = 0 OR p_partkey % 10 = 0")
def odd_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with dots and backquotes, and a map whose entries are in another order."""
    part = table(spark, sf_dir, "part")
    size = lambda new: F.when(F.lit(new) & (F.col("p_size") % 3 == 0), F.col("p_size") + 1).otherwise(F.col("p_size"))
    pair = lambda name, value: (F.lit(name), value.cast("string"))
    brand = lambda new: F.when(F.lit(new) & (F.col("p_partkey") % 10 == 0), F.lit("other")).otherwise(F.col("p_brand"))
    old = part.select(F.col("p_partkey").alias("p.key"), size(False).alias("p`size"), F.create_map(*pair("brand", brand(False)), *pair("name", F.col("p_name"))).alias("m.x"))
    new = part.select(F.col("p_partkey").alias("p.key"), size(True).alias("p`size"), F.create_map(*pair("name", F.col("p_name")), *pair("brand", brand(True))).alias("m.x"))
    return Frames(old, new, "p.key").changes().withColumnRenamed("p.key", "p_partkey")


def _events(spark: SparkSession, sf_dir: str, **kw) -> Frames:
    return Frames(events(spark, sf_dir, False), events(spark, sf_dir, True), "event_id", **kw)


@query("schema_profile", "!" + PROFILE_SQL)
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).profiles()


_TYPES = "list_filter([CASE WHEN booleans > 0 THEN 'boolean' END, CASE WHEN integers > 0 THEN 'integer' END, CASE WHEN numbers > 0 THEN 'number' END, CASE WHEN strings > 0 THEN 'string' END, CASE WHEN objects > 0 THEN 'object' END, CASE WHEN arrays > 0 THEN 'array' END], lambda x: x IS NOT NULL)"


def _schema_sql(drop: str = "true") -> str:
    return f"""WITH p AS (SELECT *, {_TYPES} AS types FROM ({PROFILE_SQL}) WHERE {drop}), o AS (SELECT * FROM p WHERE side = 0), n AS (SELECT * FROM p WHERE side = 1),
      b AS (SELECT coalesce(o.path, n.path) AS path, o.path IS NULL AS added, n.path IS NULL AS removed, o.types <> n.types AS t, (o.nulls > 0) <> (n.nulls > 0) AS u,
        (o.parent_objects = o.present) <> (n.parent_objects = n.present) AS r FROM o FULL JOIN n ON o.path = n.path),
      c AS (SELECT path, 'field_removed' AS operation FROM b WHERE removed UNION ALL SELECT path, 'field_added' FROM b WHERE added UNION ALL SELECT path, 'types_changed' FROM b WHERE t
        UNION ALL SELECT path, 'nullability_changed' FROM b WHERE u UNION ALL SELECT path, 'requiredness_changed' FROM b WHERE r)"""


@query("schema_changes", "!" + _schema_sql() + " SELECT path, operation FROM c")
def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).schema_changes().select("path", "operation")


_COUNTS = ("parent_objects", "present", "nulls", "booleans", "integers", "numbers", "strings", "objects", "arrays")
_SIDES_SQL = ", ".join(f"{side}.{c} AS {side}_{c}" for side in "on" for c in _COUNTS)


@query("schema_change_profiles", "!" + _schema_sql() + f" SELECT path, operation, {_SIDES_SQL} FROM c LEFT JOIN o USING (path) LEFT JOIN n USING (path)")
def schema_change_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the counts of both sides."""
    return _profiles_of(_events(spark, sf_dir).schema_changes())


def _profiles_of(found: DataFrame) -> DataFrame:
    return found.select("path", "operation", *(F.col(f"{side}.{c}").alias(f"{side[0]}_{c}") for side in ("old", "new") for c in _COUNTS))


@query("schema_ignore", "!" + _schema_sql("path NOT IN ('/value', '/meta/raw')") + " SELECT path, operation FROM c")
def schema_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, schema_ignore=["/value", "/meta/raw"]).schema_changes().select("path", "operation")


_SCHEMA_COUNTS = "SELECT " + ", ".join(f"count(*) FILTER (operation = '{o}') AS {n}" for n, o in (("fields_added", "field_added"), ("fields_removed", "field_removed"), *((x, x) for x in ("types_changed", "nullability_changed", "requiredness_changed")))) + " FROM c"


@query("schema_summary", "!" + _schema_sql() + " " + _SCHEMA_COUNTS)
def schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_counts(_events(spark, sf_dir).schema_changes())


_PATCH = """SELECT o.o_orderkey, 'replace' AS op, '/o_totalprice' AS path FROM orders o JOIN orders_new n USING (o_orderkey) WHERE o.o_totalprice IS DISTINCT FROM n.o_totalprice
  UNION ALL SELECT o.o_orderkey, 'replace', '/o_orderpriority' FROM orders o JOIN orders_new n USING (o_orderkey) WHERE o.o_orderpriority IS DISTINCT FROM n.o_orderpriority"""


def _told(found: DataFrame) -> DataFrame:
    """Of all fields that differ, those that the SQL above tells: in pairs of a key that was moved onto another, the rest may differ too."""
    return found.where(F.col("path").isin("/o_totalprice", "/o_orderpriority"))


@query("field_patch", _PATCH)
def field_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_orders(spark, sf_dir).field_changes()).select("o_orderkey", "op", "path")


_DEEP = """b AS (SELECT o.event_id, o.kind AS ok, n.kind AS nk, o.n AS x, n.n AS y, n.deep FROM deep_old o JOIN deep_new n USING (event_id))
  SELECT event_id, 'replace' AS op, '/meta/kind' AS path, '"' || ok || '"' AS old, '"' || nk || '"' AS value FROM b WHERE ok IS DISTINCT FROM nk
  UNION ALL SELECT event_id, 'replace', '/meta/deep', '{"n":' || x || ',"a/b":"' || ok || '"}', 'null' FROM b WHERE NOT deep
  UNION ALL SELECT event_id, 'replace', '/meta/deep/n', CAST(x AS VARCHAR), CAST(y AS VARCHAR) FROM b WHERE deep AND x IS DISTINCT FROM y
  UNION ALL SELECT event_id, 'replace', '/meta/deep/a~1b', '"' || ok || '"', '"' || nk || '"' FROM b WHERE deep AND ok IS DISTINCT FROM nk"""


@query("nested_field_patch", "!" + before("deep_old", "deep_new") + _DEEP)
def nested_field_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of objects on both sides, one by one, with both values."""
    return Frames(view(spark, sf_dir, "deep_old"), view(spark, sf_dir, "deep_new"), "event_id").field_changes()


_PATCH_VALUES = """SELECT c.c_custkey, c.nk, 'replace' AS op, '/c_name' AS path, '"' || c.c_name || '"' AS old, '"' || n.c_name || '"' AS value
  FROM customer_old c JOIN customer_new n ON c.c_custkey = n.c_custkey WHERE c.c_name IS DISTINCT FROM n.c_name"""


@query("field_patch_values", _PATCH_VALUES)
def field_patch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frames(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), ["c_custkey", "nk"]).field_changes()


_FIELD_SUMMARY = f"SELECT path, count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'remove') AS removed, count(*) FILTER (op = 'replace') AS replaced FROM ({_PATCH}) GROUP BY path"


@query("field_summary", _FIELD_SUMMARY)
def field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_orders(spark, sf_dir).field_summary())


@query("canonical_order", "!SELECT p_partkey, '[' || p_partkey || ']' AS identity, row_number() OVER (ORDER BY '[' || p_partkey || ']') AS place FROM part")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order of identities, counted in parallel: within ranges, and by the sizes of the ranges before.

    Ranges are drawn from a sample that differs each time they are computed, so rows are written with theirs, and both are read from there.
    """
    rows = table(spark, sf_dir, "part").select("p_partkey", identity(["p_partkey"]).alias("identity"))
    ranged = rows.repartitionByRange(16, "identity").sortWithinPartitions("identity").select("*", F.monotonically_increasing_id().alias("m"))
    ranged = ranged.select("*", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("within"))
    _ANSWERS.append(Workspace(spark))
    ranged = _ANSWERS[-1].store("ranged", ranged.drop("m"))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return ranged.join(before, "part").select("p_partkey", F.col("identity").cast("string").alias("identity"), (F.col("within") + F.col("before") + 1).alias("place"))


@query("fingerprint", """!SELECT p_partkey, CAST(strlen(c) AS BIGINT) AS length, sha256(c) AS digest
  FROM (SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}' AS c FROM part)""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").drop("p_retailprice")
    found = Frames(part, part, "p_partkey").records().where("side = 0")
    key = F.regexp_extract(F.col("identity").cast("string"), r"\[(.*)\]", 1).cast("long")
    return found.select(key.alias("p_partkey"), "length", F.lower(F.hex("digest")).alias("digest"))


# --- text lane -------------------------------------------------------------------------------------------------------


#: Where answers of the text lane are kept until Python ends. Sources and sessions go at once.
_ANSWERS: list[Workspace] = []


@atexit.register
def _forget() -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for place in _ANSWERS:
            place.close()


def _written(place: Workspace, name: str, df: DataFrame, order: list[str], one: bool = False, nulls: bool = True) -> str:
    """df as JSON lines in that order, packed with gzip; as one array if asked; without members that are null if asked."""
    path = f"{place.path}/{name}.jsonl"
    text = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes)), {"ignoreNullFields": str(not nulls).lower()})
    rows = df.orderBy(*order).select(text.alias("value"))
    if one:
        rows = rows.agg(F.concat(F.lit("[ "), F.array_join(F.collect_list("value"), " ,\n"), F.lit(" ]\n")).alias("value"))
    rows.write.text(path, compression=None if one else "gzip")
    return path


def _text(old: DataFrame, new: DataFrame, key: str | list[str], answer: Callable[[DiffResult], DataFrame], nulls: bool = True, order: tuple[str, ...] = (), **kw) -> DataFrame:
    """What a comparison of both, written as text, answers."""
    spark, keys, one = old.sparkSession, [key] if isinstance(key, str) else key, kw.get("format") == "json"
    place = Workspace(spark)
    try:
        paths = [_written(place, name, df, [*keys, *order], one, nulls) for name, df in (("old", old), ("new", new))]
        with diff(*paths, key=key, spark=spark, **kw) as found:
            _ANSWERS.append(Workspace(spark))
            return _ANSWERS[-1].store("answer", answer(found))
    finally:
        place.close()


def _text_orders(spark: SparkSession, sf_dir: str, answer: Callable[[DiffResult], DataFrame], **kw) -> DataFrame:
    return _text(table(spark, sf_dir, "orders"), view(spark, sf_dir, "orders_new"), "o_orderkey", answer, duplicates="pairs", **kw)


def _totals_of(found: DiffResult) -> DataFrame:
    return reconcile.totals(found.pairs_df)


def _read(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("identity", F.col("identity").cast("string")).select(*(columns or df.columns))


@query("text_summary", _totals(_ORDERS))
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_orders(spark, sf_dir, _totals_of)


_OLD_LINES = "SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders"
_NEW_LINES = "SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders_new"
_LINED = f"SELECT '[' || p.o_orderkey || ']' AS identity, operation, o.line AS old_line, n.line AS new_line FROM ({_ORDERS}) p LEFT JOIN ({_OLD_LINES}) o USING (o_orderkey) LEFT JOIN ({_NEW_LINES}) n ON n.o_orderkey = p.o_orderkey WHERE operation <> 'equal'"


@query("text_changes", _LINED)
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the lines of both sides, across the files that each was written to."""
    return _text_orders(spark, sf_dir, lambda found: _read(_lined(found)))


def _lined(found: DiffResult) -> DataFrame:
    """Changes with their lines as the SQL joins these: by key, so an identity that has several gets all of them with each operation."""
    lines = lambda name: found.each_df.select("identity", F.col(name).alias(f"its_{name}")).distinct()
    changes = found.changes_df().join(lines("old_line"), "identity", "left").join(lines("new_line"), "identity", "left")
    return changes.select("identity", "operation", *(F.coalesce(f"its_{x}", x).alias(x) for x in ("old_line", "new_line")))


def _patches(found: DiffResult) -> DataFrame:
    return _read(found.changes_df("modified")).select("identity", F.explode("patch").alias("p")).select("identity", "p.*")


@query("text_field_patch", _PATCH.replace("o.o_orderkey, ", "'[' || o.o_orderkey || ']' AS identity, "))
def text_field_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_text_orders(spark, sf_dir, _patches, field_diff=True)).select("identity", "op", "path")


@query("text_patch_values", f"SELECT '[' || c_custkey || ',' || coalesce(CAST(nk AS VARCHAR), 'null') || ']' AS identity, op, path, old, value FROM ({_PATCH_VALUES})")
def text_patch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), ["c_custkey", "nk"], _patches, field_diff=True)


@query("text_field_summary", _FIELD_SUMMARY)
def text_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_orders(spark, sf_dir, lambda found: _told(found.field_summary_df()), field_diff=True)


@query("text_where", _totals(_where("starts_with(o_orderpriority, '1') OR o_totalprice >= 400000 AND o_orderstatus <> 'P'")))
def text_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_orders(spark, sf_dir, _totals_of, where="starts_with(o_orderpriority, '1') || max([o_totalprice, `0`]) >= `400000` && !contains(['P'], o_orderstatus)")


_EVERY_FILTER = " OR ".join(f"({sql})" for _, sql in FILTERS.values())


@query("text_where_functions", f"SELECT '[' || l_orderkey || ']' AS identity FROM baskets WHERE NOT ({_EVERY_FILTER}) OR l_orderkey % 2 = 0 AND ({FILTERS['filter_projection'][1]})")
def text_where_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of expressions in one filter of records, against an empty side."""
    baskets = view(spark, sf_dir, "baskets").withColumn("even", F.col("l_orderkey") % 2 == 0)
    none = " || ".join(f"({jmes})" for jmes, _ in FILTERS.values())
    test = f"!({none}) || even && ({FILTERS['filter_projection'][0]})"
    return _text(baskets, baskets.limit(0), "l_orderkey", lambda found: _read(found.changes_df("deleted"), "identity"), where=test)


@query("text_duplicates", f"SELECT * FROM ({_pairs(_selected('lines', 'DESC'), _selected('lines_new', 'DESC'), _LINE_KEYS, ['l_returnflag', 'l_linestatus'])}) WHERE operation <> 'equal'")
def text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _text(view(spark, sf_dir, "lines"), view(spark, sf_dir, "lines_new"), _LINE_KEYS, lambda found: _read(found.changes_df()), order=("line",), duplicates="last", ignore=["/line"])
    part = lambda k: F.regexp_extract("identity", r"\[(\d+),(\d+)\]", k)
    return found.select(part(2).cast("long").alias("l_orderkey"), part(1).cast("int").alias("l_linenumber"), "operation")


_TEXT_DUPLICATES = " UNION ALL ".join(
    f"""SELECT {side} AS side, {_identity_sql('l_linenumber', 'l_orderkey')} AS identity, s AS selected_line, m AS discarded_line, l_returnflag = f AND l_linestatus = t AS content_equal
      FROM (SELECT *, first_value(m) OVER w AS s, first_value(l_returnflag) OVER w AS f, first_value(l_linestatus) OVER w AS t
        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, line, l_returnflag, l_linestatus) AS m FROM {name}) WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY m)) WHERE m <> s"""
    for side, name in enumerate(("lines", "lines_new"))
)


@query("text_duplicate_records", _TEXT_DUPLICATES)
def text_duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that was not selected, with its line and that of the selected one."""
    return _text(view(spark, sf_dir, "lines"), view(spark, sf_dir, "lines_new"), _LINE_KEYS, lambda found: _read(found.duplicates_df()), order=("line", "l_returnflag", "l_linestatus"), duplicates="first", ignore=["/line"])


_NULL_KEYS = _pairs("customer_old", "customer_new", ["c_custkey", "nk"], ["c_name", "c_mktsegment"])


@query("text_missing_key", f"SELECT '[' || c_custkey || ',' || coalesce(CAST(nk AS VARCHAR), 'null') || ']' AS identity, operation FROM ({_NULL_KEYS}) WHERE operation <> 'equal'")
def text_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent members of a composite identity count as null."""
    return _text(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), ["c_custkey", "nk"], lambda found: _read(found.changes_df(), "identity", "operation"), nulls=False, missing_key="null")


@query("text_schema", "!" + _schema_sql() + " SELECT path, operation FROM c")
def text_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(events(spark, sf_dir, False), events(spark, sf_dir, True), "event_id", lambda found: found.schema_changes_df().select("path", "operation"), schema_diff=True)


@query("text_schema_profiles", "!" + ORACLE_SQL["schema_change_profiles"])
def text_schema_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(events(spark, sf_dir, False), events(spark, sf_dir, True), "event_id", lambda found: _profiles_of(found.schema_changes_df()), schema_diff=True)


@query("text_array", _totals(_pairs("customer_old", "customer_new", ["c_custkey"], ["nk", "c_name", "c_mktsegment"])))
def text_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are one JSON array each."""
    return _text(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), "c_custkey", _totals_of, format="json")


def _report_sql() -> str:
    side = lambda name, alias: f"(SELECT *, row_number() OVER (ORDER BY c_custkey) AS line FROM {name}) {alias}"
    pairs = f"SELECT coalesce(o.c_custkey, n.c_custkey) AS k, o.line AS a, n.line AS b, o.c_name AS x, n.c_name AS y FROM {side('customer_old', 'o')} FULL JOIN {side('customer_new', 'n')} ON o.c_custkey = n.c_custkey"
    counts = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in (("added", "a IS NULL"), ("deleted", "b IS NULL"), ("equal", "x = y"), ("modified", "x <> y")))
    return f"""p AS ({pairs}), c AS (SELECT {counts} FROM p)
      SELECT '{{"duplicates":"error","field_diff":true,"ignore":[],"key":["c_custkey"],"missing_key":"error","schema_diff":true,"schema_ignore":[],"type":"meta","where":null}}' AS line
      UNION ALL SELECT '{{"key":[' || k || '],"old_line":' || a || ',"op":"deleted","type":"change"}}' FROM p WHERE b IS NULL
      UNION ALL SELECT '{{"key":[' || k || '],"new_line":' || b || ',"old_line":' || a || ',"op":"modified","patch":[{{"old":"' || x || '","op":"replace","path":"/c_name","value":"' || y || '"}}],"type":"change"}}' FROM p WHERE x <> y
      UNION ALL SELECT '{{"added":0,"path":"/c_name","removed":0,"replaced":' || modified || ',"type":"field_summary"}}' FROM c
      UNION ALL SELECT '{{"added":' || added || ',"deleted":' || deleted || ',"equal":' || equal || ',"modified":' || modified || ',"new_duplicates":0,"old_duplicates":0,"schema":{{"fields_added":0,"fields_removed":0,"nullability_changed":0,"requiredness_changed":0,"types_changed":0}},"type":"summary"}}' FROM c"""


@query("details_report", "!" + before("customer_old", "customer_new") + _report_sql())
def details_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a full report."""
    return _text(view(spark, sf_dir, "customer_old"), view(spark, sf_dir, "customer_new"), "c_custkey", lambda found: lines_df(found, spark), field_diff=True, schema_diff=True)
