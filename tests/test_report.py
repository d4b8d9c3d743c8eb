import json
import os
import sys

import pytest
import zstandard

import __spark_entry__
from spindle import diff
from spindle.cli import main
from spindle.report import lines_df, write_details


def test_every_kind_of_event(spark, lines, tmp_path):
    old = lines("old.jsonl", ['{"id":1,"a":1}', '{"id":1,"a":1}', '{"id":2,"b\\u0001/~":1e3,"n":{"x":null}}', '{"id":3}'])
    new = lines("new.jsonl", ['{"id":1,"a":1}', '{"id":2,"b\\u0001/~":"y","n":{"x":"é\\u007f"}}', '{"id":2,"c":0}', '{"id":"4"}'])
    with diff(old, new, key="id", duplicates="first", field_diff=True, schema_diff=True, spark=spark) as r:
        write_details(r, tmp_path / "report.jsonl")
        found = (tmp_path / "report.jsonl").read_text().splitlines()
        assert sorted(found) == sorted(x["line"] for x in lines_df(r, spark).collect())
    types = [json.loads(x)["type"] for x in found]
    assert types == ["meta", *["schema_change"] * types.count("schema_change"), "duplicate", "duplicate", "change", "change", "change", "field_summary", "field_summary", "summary"]
    for x in found:  # canonical: names in order, no blanks, numbers as they are written
        assert x == json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("1000.0", "1E+3")
    assert found[types.index("duplicate")] == '{"content_equal":true,"discarded_line":2,"key":[1],"selected_line":1,"source":"OLD","type":"duplicate"}'
    assert [x for x in found if '"change"' in x] == [
        '{"key":["4"],"new_line":4,"op":"added","type":"change"}',
        '{"key":[2],"new_line":2,"old_line":3,"op":"modified","patch":[{"old":1E+3,"op":"replace","path":"/b\\u0001~1~0","value":"y"},{"old":null,"op":"replace","path":"/n/x","value":"é\x7f"}],"type":"change"}',
        '{"key":[3],"old_line":4,"op":"deleted","type":"change"}',
    ]
    changed = json.loads(next(x for x in found if '"types_changed"' in x))
    assert changed == {"type": "schema_change", "op": "types_changed", "path": "/b\x01~1~0", "old": {"parent_objects": 4, "present": 1, "missing": 3, "nulls": 0, "types": {"integer": 1}}, "new": {"parent_objects": 4, "present": 1, "missing": 3, "nulls": 0, "types": {"string": 1}}}
    assert json.loads(found[-1]) == {"type": "summary", "equal": 1, "added": 1, "deleted": 1, "modified": 1, "old_duplicates": 1, "new_duplicates": 1, "schema": json.loads(found[-1])["schema"]}


def test_the_report_never_overwrites_a_source(spark, lines, tmp_path, capsys):
    old, new = lines("old #1.jsonl", ['{"id":1}']), lines("new.jsonl", ['{"id":1}'])
    os.symlink(old, tmp_path / "soft")
    os.link(new, tmp_path / "hard")
    for source, details in ((old.as_uri(), old), (old, tmp_path / "soft"), (old, tmp_path / "hard"), (f"file://localhost{old.as_uri()[7:]}", tmp_path / "soft")):
        assert main([str(source), str(new), "--key", "id", "--details", str(details)]) == 3
    assert "must not be the same file as" in capsys.readouterr().err
    assert old.read_text() == new.read_text() == '{"id":1}\n'
    assert main([str(old), str(new), "--key", "id", "--details", str(tmp_path / "absent" / "x"), "--quiet"]) == 2
    assert "output failed (FileNotFoundError)" in capsys.readouterr().err
    assert main(["--help"]) == 0


def test_zstandard(spark, lines, tmp_path):
    path = tmp_path / "old.jsonl.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress(b'{"id":1}\n{"id":2}\n'))
    with diff(path, lines("new.jsonl", ['{"id":2}']), key="id", spark=spark) as r:
        assert (r.equal, r.deleted, r.config.key) == (1, 1, ("id",))


def test_only_absence_passes(tmp_path, monkeypatch):
    """A part that can be left out may be absent, but not broken."""
    monkeypatch.syspath_prepend(str(tmp_path))
    assert __spark_entry__.present("no_such_part.queries") is None
    (tmp_path / "broken_part.py").write_text("import no_such_dependency\n")
    with pytest.raises(ModuleNotFoundError, match="no_such_dependency"):
        __spark_entry__.present("broken_part")
    sys.modules.pop("broken_part", None)
