import bz2
import gzip
import io
import json
import lzma
import threading
from decimal import Decimal
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest

from spindle import ChangeOperation, ConfigurationError, DuplicateKeyError, InputError, ReconcileError, diff
from spindle.cli import main

OLD = ['{"id":1,"a":1,"b":{"c":1.0}}', '{"id":2,"a":1,"gone":[1]}', '{"id":3}']
NEW = ['{"id":2,"a":2,"z":true}', '{"id":1,"a":2,"b":{"c":1.00}}', '{"id":4}']


@pytest.fixture
def run(spark, lines):
    def both(old, new, key="id", **kw):
        return diff(lines("old.jsonl", old), lines("new.jsonl", new), key=key, spark=spark, **kw)

    return both


def test_changes_in_canonical_order(run):
    with run([f'{{"id":{i}}}' for i in (1, 2, 10)], ['{"id":2}', '{"id":[3]}']) as r:
        assert [(c.operation.value, c.key, c.old_line, c.new_line) for c in r.changes()] == [("deleted", (10,), 3, None), ("deleted", (1,), 1, None), ("added", ([3],), None, 2)]
        assert [c.key for c in r.changes("added")] == [([3],)]
        assert (r.equal, r.added, r.deleted, r.modified, r.has_issues) == (1, 1, 2, 0, True)
    assert r.summary.deleted == 2
    with pytest.raises(RuntimeError, match="closed"):
        next(r.changes())
    with pytest.raises(RuntimeError, match="more than once"):
        r.__enter__()


@pytest.mark.parametrize(("a", "b", "equal"), [("1", "1.0", 0), ("1.0", "1.00", 0), ("1000", "1e3", 0), ("1e3", "1E3", 1), ('"1"', "1", 0), ("true", "1", 0), ("-0.0", "0.0", 0), ("1e50000000", "1e50000000", 1), ('{"x":1,"y":2}', '{"y":2,"x":1}', 1), ("[1,2]", "[2,1]", 0)])
def test_representation_matters(run, a, b, equal):
    with run([f'{{"id":1,"v":{a}}}', f'{{"id":{a}}}'.replace('"id":1}', '"id":"one"}')], [f'{{"id":1,"v":{b}}}', f'{{"id":{b}}}'.replace('"id":1}', '"id":"one"}')]) as r:
        assert r.modified == 1 - equal


def test_composite_and_missing_keys(run):
    old, new = ['{"a":1,"b":null,"v":1}', '{"a":2,"v":1}'], ['{"b":null,"a":1,"v":2}', '{"a":2,"b":null,"v":1}']
    with run(old, new, key=["b", "a"], missing_key="null") as r:
        assert (r.equal, r.modified) == (0, 2)  # null is not the same content as nothing
        assert next(r.changes()).key == (1, None)
    with pytest.raises(InputError, match="missing identity field 'b' in OLD at line 2"), run(old, new, key=["b", "a"]):
        pass


@pytest.mark.parametrize(("policy", "kept", "found"), [("first", 1, [(2, False), (3, True)]), ("last", 3, [(1, True), (2, False)])])
def test_duplicates(run, policy, kept, found):
    with run(['{"id":1,"v":"s"}', '{"id":1,"v":"c"}', '{"id":1,"v":"s"}'], ['{"id":1,"v":"s"}'], duplicates=policy) as r:
        assert [(d.source, d.key, d.selected_line, d.discarded_line, d.content_equal) for d in r.duplicates()] == [("OLD", (1,), kept, line, same) for line, same in found]
        assert (r.equal, r.old_duplicates, r.new_duplicates, r.has_issues, r.different) == (1, 2, 0, True, False)


def test_duplicate_error(run):
    with pytest.raises(DuplicateKeyError, match=r"duplicate key \[2\] on lines 2, 3 in NEW") as e, run([], ['{"id":1}', '{"id":2}', '{"id":2}', '{"id":1}']):
        pass
    assert (e.value.key, e.value.lines, e.value.source, e.value.line) == ((2,), (2, 3), "NEW", None)


@pytest.mark.parametrize(("rows", "kw", "message"), [
    (['{"id":1}', '{"id":}'], {}, "invalid input (JSONDecodeError) in OLD at line 2"), (['{"id":1}', "", "{}"], {}, "invalid input (JSONDecodeError) in OLD at line 2"), (["[1]"], {}, "each record must be a JSON object in OLD at line 1"),
    (['{"id":null}'], {}, "identity field 'id' must be a non-null scalar in OLD at line 1"), (['{"x":1}'], {}, "missing identity field 'id' in OLD at line 1"), ([b'{"id":"\xff"}'], {}, "invalid input (UnicodeDecodeError) in OLD at line 1"),
    (['{"id":1,"a":[1]}'], {"ignore": ["/a/b"]}, "ignore paths may not traverse arrays in OLD at line 1"), (['{"id":1e9999999999999999999}'], {}, "invalid input (InvalidOperation) in OLD at line 1"),
    (['{"id":1,"a":[1]}'], {"schema_diff": True, "schema_ignore": ["/a/b"]}, "schema ignore paths may not traverse arrays in OLD at line 1"), (['{"id":1,"x":"a"}'], {"where": "abs(x)"}, "in OLD at line 1"),
])
def test_faults(run, rows, kw, message):
    with pytest.raises(InputError) as e, run(rows, ['{"id":'], **kw):
        pass
    assert message in str(e.value)


@pytest.mark.parametrize(("kw", "message"), [
    ({"key": ""}, "at least one non-empty identity field is required"), ({"key": ["a", "a"]}, "identity fields must not be repeated"), ({"key": "id", "ignore": ["/id"]}, "identity field 'id' cannot be ignored"),
    ({"key": "id", "ignore": ["x"]}, "ignore paths must be non-empty RFC 6901 JSON Pointers"), ({"key": "id", "ignore": ["/~2"]}, "invalid JSON Pointer escape in '/~2'"), ({"key": "id", "schema_ignore": ["/x"]}, "schema_ignore requires schema_diff=True"),
    ({"key": "id", "where": "a["}, "invalid --where expression 'a['"), ({"key": "id", "duplicates": "x"}, "invalid duplicate policy 'x'"), ({"key": "id", "missing_key": "x"}, "invalid missing-key policy 'x'"), ({"key": "id", "format": "x"}, "invalid format 'x'"),
])
def test_configuration(kw, message):
    with pytest.raises(ConfigurationError, match=__import__("re").escape(message)) as e:
        diff("a", "b", **kw)
    assert isinstance(e.value, ValueError) and isinstance(e.value, ReconcileError)


def test_where_and_ignore(run):
    old = ['{"id":1,"v":1,"n":0}', '{"id":2,"v":1,"n":null}', '{"id":3,"v":1,"n":""}', '{"id":4,"n":[],"v":1}']
    with run(old, [x.replace('"v":1', '"v":2') for x in old], where="n", ignore=["/v"]) as r:
        assert (r.equal, r.different) == (1, False)


def test_schema(run):
    with run(['{"id":1,"age":1,"p":{"c":"x"}}', '{"id":1.0,"age":1.0,"p":{}}'], ['{"id":1,"age":"x","e":null,"a/x":1,"a":{"x":1}}'], schema_diff=True) as r:
        found = [(c.operation.value, c.path) for c in r.schema_changes()]
        assert found == [("field_added", "/a"), ("field_added", "/a/x"), ("types_changed", "/age"), ("field_added", "/a~1x"), ("field_added", "/e"), ("field_removed", "/p"), ("field_removed", "/p/c")]
        one = next(r.schema_changes("types_changed"))
        assert one.old.type_counts == {"integer": 2} and one.new.types == ("string",)
        gone = [c for c in r.schema_changes() if c.path == "/p/c"][0].old
        assert (gone.parent_objects, gone.missing, gone.required, gone.nullable) == (2, 1, False, False)
        assert (r.schema_summary.fields_added, r.schema_summary.fields_removed, r.schema_summary.types_changed) == (4, 2, 1)
    with pytest.raises(RuntimeError, match="field diff was not enabled"), run([], []) as r:
        next(r.field_summary())


@pytest.mark.parametrize("pack", [None, gzip.compress, bz2.compress, lzma.compress])
def test_sources(spark, tmp_path, pack):
    suffix = {None: "", gzip.compress: ".gz", bz2.compress: ".bz2", lzma.compress: ".xz"}[pack]
    pack = pack or (lambda x: x)
    names = tmp_path / f"o [1] #%.jsonl{suffix}", tmp_path / f"new.jsonl{suffix}"
    for path, rows in zip(names, (OLD, NEW), strict=True):
        path.write_bytes(pack("\r\n".join(rows).encode()))
    with diff(names[0].as_uri(), names[1], key="id", spark=spark) as r:
        assert (r.added, r.deleted, r.modified) == (1, 1, 2)


def test_duplicates_of_old_come_before_faults_of_new(spark, lines, tmp_path):
    old = lines("o.jsonl", ['{"id":1}', '{"id":1}'])
    for new in (lines("n.jsonl", ["{"]), lines("m.jsonl", ['{"id":2}', '{"id":2}']), tmp_path / "absent"):
        with pytest.raises(DuplicateKeyError, match=r"duplicate key \[1\] on lines 1, 2 in OLD"), diff(old, new, key="id", spark=spark):
            pass
    with diff(old, lines("k.jsonl", ['{"id":1}']), key="id", duplicates="first", spark=spark) as r:
        assert (r.equal, r.old_duplicates) == (1, 1)


def test_broken_sources(spark, lines, tmp_path):
    """OLD's faults come first, whatever is wrong with NEW; a broken archive is an unreadable source."""
    with pytest.raises(InputError, match="OLD at line 1"), diff(lines("o.jsonl", ["{"]), tmp_path / "absent", key="id", spark=spark):
        pass
    with pytest.raises(InputError, match="FileNotFoundError.*NEW"), diff(lines("o.jsonl", ['{"id":1}']), tmp_path / "absent", key="id", spark=spark):
        pass
    (tmp_path / "n.jsonl.gz").write_bytes(b"no archive")
    with pytest.raises(InputError, match="NEW"), diff(lines("o.jsonl", ['{"id":1}']), tmp_path / "n.jsonl.gz", key="id", spark=spark):
        pass


def test_streams_http_and_arrays(spark, tmp_path):
    (tmp_path / "new.json").write_text("[" + ",\n".join(NEW) + "]")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with diff(io.StringIO("[" + ",".join(OLD) + "]"), f"http://127.0.0.1:{server.server_port}/new.json", key="id", format="json", spark=spark) as r:
            assert [(c.key, c.old_line, c.new_line) for c in r.changes()] == [((1,), 1, 2), ((2,), 2, 1), ((3,), 3, None), ((4,), None, 3)]
    finally:
        server.shutdown()
    (tmp_path / "bad.json").write_text('[{"id":1},')
    with pytest.raises(InputError) as e, diff(tmp_path / "new.json", tmp_path / "bad.json", key="id", format="json", spark=spark):
        pass
    assert e.value.line is None and e.value.source == "NEW"


def test_field_diff_and_details(spark, lines, tmp_path, capsys):
    details = tmp_path / "changes.jsonl"
    code = main([str(lines("old.jsonl", OLD)), str(lines("new.jsonl", NEW)), "--key", "id", "--details", str(details), "--field-diff", "--quiet"])
    assert code == 1 and not capsys.readouterr().out
    found = details.read_text().splitlines()
    assert found[1] == '{"key":[1],"new_line":2,"old_line":1,"op":"modified","patch":[{"old":1,"op":"replace","path":"/a","value":2},{"old":1.0,"op":"replace","path":"/b/c","value":1.00}],"type":"change"}'
    assert [json.loads(x)["type"] for x in found] == ["meta", *["change"] * 4, *["field_summary"] * 4, "summary"]
    with diff(lines("old.jsonl", OLD), lines("new.jsonl", NEW), key="id", field_diff=True, spark=spark) as r:
        one = next(r.changes(ChangeOperation.MODIFIED))
        assert one.patch[1].old == Decimal("1.0") and str(one.patch[1].value) == "1.00"
        assert [(f.path, f.added, f.removed, f.replaced) for f in r.field_summary()] == [("/a", 0, 0, 2), ("/b/c", 0, 0, 1), ("/gone", 0, 1, 0), ("/z", 1, 0, 0)]


def test_command_line(spark, lines, capsys, monkeypatch):
    old, new = str(lines("old.jsonl", OLD)), str(lines("new.jsonl", NEW))
    assert main([old, new, "--key", "id"]) == 1
    assert capsys.readouterr().out == "Records:\n  equal:     0\n  added:     1\n  deleted:   1\n  modified:  2\n  OLD duplicates:  0\n  NEW duplicates:  0\n"
    assert main([old, old, "--key", " id , a", "--missing-key", "null", "--quiet"]) == 0
    monkeypatch.setattr("sys.stdin", type("S", (), {"buffer": io.BytesIO("\n".join(OLD).encode())}))
    assert main(["-", old, "--key", "id", "--quiet"]) == 0
    capsys.readouterr()
    for bad in (["-", "-", "--key", "id"], [old, new], [old, new, "--key", ","], [old, new, "--key", "id", "--field-diff"], [old, new, "--key", "id", "--schema-ignore", "/x"], [old, new, "--key", "id", "--details", old], [old, new, "--key", "id", "--details", " "]):
        assert main(bad) == 3
    assert main([old + "x", new, "--key", "id"]) == 2
    assert "ERROR: invalid input (FileNotFoundError) in OLD" in capsys.readouterr().err


def test_line_numbers_in_many_blocks(spark, lines, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(f'{{"id":"{i:06d}","line":{i},"pad":"{"x" * (i % 97)}"}}\n' for i in range(1, 20_001)))
    from spindle.sources.text import lines as numbered

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert numbered(spark, f"file://{path}").rdd.getNumPartitions() > 4
        with diff(path, lines("none.jsonl", []), key="line", field_diff=True, spark=spark) as r:
            rows = r.records_df.selectExpr("line", "cast(substring(cast(identity as string), 2, length(identity) - 2) as bigint) as wanted")
            assert rows.where("line <> wanted").count() == 0 and rows.count() == 20_000
            plan = r.index_df._jdf.queryExecution().toString()
            assert "SortMergeJoin" not in plan  # rows find their block's number where they are
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("n", [1, 80, 81, 82, 83, 300])
def test_contents_that_are_short_or_digests(run, n):
    v = "x" * n
    with run([f'{{"id":1,"v":"{v}"}}', f'{{"id":1,"v":"{v[1:]}y"}}', f'{{"id":1,"v":"{v}"}}'], [f'{{"v":"{v}","id":1}}'], duplicates="first") as r:
        assert [(d.discarded_line, d.content_equal) for d in r.duplicates()] == [(2, False), (3, True)]
        assert r.equal == 1


def test_selected_records_move_once_and_are_small(run):
    from pathlib import Path

    from spindle.operators import reconcile

    with run([f'{{"id":{i // 2},"v":"a"}}' for i in range(20_000)], [], duplicates="last") as r:
        plan = reconcile.selected(r.records_df, r.config.duplicates)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Aggregate(") == 2  # one aggregate, in its two halves
        size = sum(p.stat().st_size for p in Path(r._workspace.path.removeprefix("file://"), "index-0").glob("*.parquet"))
        assert size < 20_000 * 24  # a digest alone has 32 bytes
        assert (r.deleted, r.old_duplicates, r.new_duplicates) == (10_000, 10_000, 0)
