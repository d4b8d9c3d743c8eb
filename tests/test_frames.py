import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spindle import ConfigurationError, DuplicateKeyError, InputError
from spindle.functions import columns, jmespath
from spindle.operators.frames import Frames
from spindle.plans.catalog import FILTERS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, old, new, schema, key="id", **kw):
    return Frames(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), key, **kw)


def test_repeated_identities_are_an_error(spark):
    two = frames(spark, [(1, "a"), (1, "b"), (2, "c")], [(1, "a"), (1, "b"), (1, "c")], "id long, v string")
    for answer in (two.summary, two.changes, lambda: two.changes("added"), two.field_changes):
        with pytest.raises(DuplicateKeyError, match=r"duplicate key \[1\] in OLD") as e:
            answer()
        assert (e.value.key, e.value.lines, e.value.source) == ((1,), None, "OLD")
    assert rows(two.faults()) == [(0, "duplicate key", "[1]", 2, None, None), (1, "duplicate key", "[1]", 3, None, None)]
    placed = frames(spark, [(1, 5), (2, 9), (2, 3), (2, 7)], [(1, 5)], "id long, at long", order="at")
    with pytest.raises(DuplicateKeyError, match=r"duplicate key \[2\] on lines 3, 7 in OLD"):
        placed.summary()


def test_null_keys(spark):
    with pytest.raises(InputError, match="identity field 'id' must be a non-null scalar in NEW"):
        frames(spark, [(1, "a")], [(None, "a"), (1, "a")], "id long, v string").summary()
    both = frames(spark, [(1, None, "a")], [(1, None, "b")], "id long, k long, v string", key=["id", "k"])
    assert rows(both.changes()) == [(1, None, "modified")]
    with pytest.raises(InputError, match="missing identity field 'k' in OLD"):
        frames(spark, [(1, "a")], [(1, "a")], "id long, v string", key=["id", "k"])
    absent = frames(spark, [(1, "a")], [(1, "b")], "id long, v string", key=["id", "k"], missing_key="null")
    assert rows(absent.changes()) == [(1, None, "modified")]


def test_first_and_last_need_an_order_and_break_ties_by_content(spark):
    with pytest.raises(ConfigurationError, match="order"):
        frames(spark, [], [], "id long, v string", duplicates="first")
    old = [(1, 5, "b"), (1, 5, "a"), (1, 5, "a"), (1, 6, "c"), (2, 1, "x")]
    for policy, kept, found in (("first", "a", [(5, 5, False), (5, 5, True), (5, 6, False)]), ("last", "c", [(6, 5, False)] * 3)):
        for n in (1, 5):
            one = Frames(spark.createDataFrame(old, "id long, at long, v string").repartition(n), spark.createDataFrame([(1, 1, kept), (2, 1, "y")], "id long, at long, v string"), "id", order="at", ignore=["/at"], duplicates=policy)
            assert rows(one.changes()) == [(2, "modified")]
            assert sorted((r["selected_line"], r["discarded_line"], r["content_equal"]) for r in one.duplicates().collect()) == found
            assert rows(one.duplicate_counts()) == [(0, 3)]


def test_names_and_maps(spark):
    schema = "`a.id` long, `v.x` string, `b``c` long, m map<string,array<map<string,int>>>"
    same = Frames(
        spark.createDataFrame([(1, "s", 1, {"p": [{"x": 1, "y": 2}], "q": []}), (2, "s", 1, None), (3, None, None, {})], schema),
        spark.createDataFrame([(1, "s", 1, {"q": [], "p": [{"y": 2, "x": 1}]}), (2, "s", 1, {}), (3, "t", None, {})], schema), "a.id",
    )
    assert rows(same.changes()) == [(2, "modified"), (3, "modified")]
    assert rows(same.field_changes()) == [(2, "replace", "/m", "null", "{}"), (3, "replace", "/v.x", "null", '"t"')]
    assert {r["path"] for r in same.profiles().collect()} == {"/a.id", "/v.x", "/b`c", "/m"}
    last = Frames(same.sides[0].unionAll(same.sides[0]), same.sides[1], "a.id", order="b`c", duplicates="last")
    assert rows(last.changes()) == [(2, "modified"), (3, "modified")]


def test_nested_patches(spark):
    old = spark.createDataFrame([(1, (1, (2, [1])), "x"), (2, (1, None), "x"), (3, None, "x"), (4, (1, (2, [1])), "x")], "id long, m struct<a:long, `b/c`:struct<d:long, e:array<int>>>, gone string")
    new = spark.createDataFrame([(1, (1, (3, [1], True))), (2, (1, (2, [1], True))), (3, (1, None)), (4, (1, (2, [1, 2], None)))], "id long, m struct<a:long, `b/c`:struct<d:long, e:array<int>, f:boolean>>")
    found = [tuple(r) for r in Frames(old, new, "id").field_changes(ordered=True).collect()]
    gone = [(i, "remove", "/gone", '"x"', None) for i in range(1, 5)]
    want = [
        gone[0], (1, "replace", "/m/b~1c/d", "2", "3"), (1, "add", "/m/b~1c/f", None, "true"), gone[1], (2, "replace", "/m/b~1c", "null", '{"d":2,"e":[1],"f":true}'),
        gone[2], (3, "replace", "/m", "null", '{"a":1,"b/c":null}'), gone[3], (4, "replace", "/m/b~1c/e", "[1]", "[1,2]"), (4, "add", "/m/b~1c/f", None, "null"),
    ]
    assert found == want
    assert rows(Frames(old, old.select("id", "m", "gone"), "id").field_changes()) == []
    with pytest.raises(ConfigurationError, match="may not traverse arrays"):
        Frames(old, new, "id", ignore=["/m/b~1c/e/x"]).summary()
    assert rows(Frames(old, new, "id", ignore=["/m/b~1c/e", "/m/b~1c/f", "/m/b~1c/d", "/gone"]).changes()) == [(2, "modified"), (3, "modified")]


def test_types_that_differ(spark):
    old = spark.createDataFrame([(1, 1, "1", 1.0), (2, None, None, None)], "id long, a long, b string, c double")
    new = spark.createDataFrame([(1, 1.0, 1, "1.0"), (2, None, None, None)], "id long, a double, b long, c string")
    assert rows(Frames(old, new, "id").field_changes()) == [(1, "replace", "/b", '"1"', "1"), (1, "replace", "/c", "1.0", '"1.0"')]


def test_canonical_order(spark):
    found = frames(spark, [(i, "a") for i in (1, 2, 10, 3)], [(20, "b"), (3, "a")], "id long, v string").changes(ordered=True)
    assert [r["id"] for r in found.collect()] == [10, 1, 20, 2]  # the text of an identity tells, byte by byte: "]" comes after digits


ITEMS = "id long, xs array<struct<n:long,t:string,w:double>>, deep array<array<long>>, o struct<a:long,b:long>, m map<string,long>, s string, f boolean"
RECORDS = [
    {"id": 1, "xs": [{"n": 3, "t": "b", "w": 0.5}, {"n": 1, "t": "a", "w": 2.5}, {"n": 3, "t": None, "w": 1.0}], "deep": [[1, 2], [3]], "o": {"a": 1, "b": 2}, "m": {"k": 5}, "s": "text", "f": True},
    {"id": 2, "xs": [], "deep": [[]], "o": {"a": 7, "b": 7}, "m": {}, "s": "", "f": False},
    {"id": 3, "xs": [{"n": 9, "t": "z", "w": 9.0}], "deep": [[4], []], "o": {"a": 0, "b": -1}, "m": {"k": 0, "j": 1}, "s": "10", "f": True},
]


@pytest.mark.parametrize("text", [
    "xs", "xs[0]", "xs[5]", "xs[-1].t", "xs[1:]", "xs[::2]", "(xs[::-1] | [0].n) == `9`", "xs[::-1].n | [2] == `3`", "xs[-5:5:1]", "xs[2:0:-1]", "xs[*].t", "xs[*].missing", "xs[?n > `2`]", "xs[?t].w", "deep[]", "deep[][0]", "deep[*][0]", "o.*", "m.*", "[id, o.a]",
    "{x: id, y: s}.y", "xs[*].[n, n][]", "xs[*].{q: t}.q", "length(xs) > `1`", "length(s) == `2`", "length(o) == `2`", "length(m) == `1`", "max(xs[*].n) == `3`", "min(xs[*].w) < `1`", "sum(deep[]) > `3`", "avg(deep[]) == `2`", "abs(o.b) == `1`",
    "xs && ceil(xs[0].w) == `1`", "xs && floor(xs[0].w) == `0`", "sort(deep[])[0] == `1`", "sort_by(xs, &w)[0].n == `3`", "sort_by(xs, &n)[1].t == 'b'", "max_by(xs, &n).t == 'b'", "min_by(xs, &w).n == `3`", "map(&n, xs)", "contains(map(&n, xs), `9`)", "contains(s, 'ex')",
    "contains(deep[0], `2`)", "contains(deep, `[4]`)", "keys(o)[0] == 'a'", "contains(keys(m), 'k')", "values(o)[1] == `7`", "merge(o, {b: `0`}).b == `0`", "not_null(missing, s)", "reverse(s) == 'txet'", "reverse(xs)[0].n == `9`", "join('-', xs[?t].t) == 'b-a'",
    "to_string(id) == '1'", "to_string(s) == 'text'", "to_number(s) == `10`", "to_array(id)[0] == `1`", "to_array(xs)[0].n == `3`", "type(xs) == 'array'", "type(o) == 'object'", "type(missing) == 'null'", "type(w)", "f && id", "f || s", "!f", "!xs", "id == `1` || s", "xs == `[]`", "deep == `[[4], []]`", "xs[*].n == `[9.0]`",
    "o == `{\"a\": 7, \"b\": 7}`", "@.id > `1`", "s | length(@) > `2`", "missing.x", "s.x", "s[0]", "s == id", "o.a < s", "starts_with(s, 't')", "ends_with(s, '0')", "xs[*].n | [0]", "keys(@)[0] == 'id'",
])
def test_filters_agree_with_the_evaluator(spark, text):
    df = spark.createDataFrame(RECORDS, ITEMS)
    node = jmespath.parse(text)
    want = [r["id"] for r in json.loads(json.dumps(RECORDS), parse_float=Decimal) if jmespath.truth(jmespath.search(node, r))]
    assert sorted(r["id"] for r in df.where(columns.where(text, df.schema)).select("id").collect()) == want


@pytest.mark.parametrize("text", ["[id, s]", "*.a", "abs(s)", "length(id)", "m == m", "sum(xs)"])
def test_what_needs_the_text_lane(spark, text):
    with pytest.raises(columns.Unsupported):
        columns.where(text, spark.createDataFrame(RECORDS, ITEMS).schema)


def test_filters_stay_in_the_plan(spark):
    df = spark.createDataFrame(RECORDS, ITEMS)
    for jmes, _ in FILTERS.values():
        jmespath.parse(jmes)
    plan = df.where(columns.where("sort_by(xs, &w)[0].n == `3`", df.schema)).select(F.col("id"))._jdf.queryExecution().toString()
    assert "Python" not in plan
