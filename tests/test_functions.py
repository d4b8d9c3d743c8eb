from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.functions import canonical, pointer
from spindle.functions.jmespath import parse, search
from spindle.functions.patch import patch

scalars = st.none() | st.booleans() | st.integers() | st.decimals(allow_nan=False, allow_infinity=False) | st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=5)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="ab/~é", max_size=2), x, max_size=3), max_leaves=12)
records = st.dictionaries(st.text(alphabet="ab/~é", max_size=2), values, max_size=4)


@pytest.mark.parametrize(("text", "same"), [("1e3", "1E+3"), ("1.00", "1.00"), ("-0.0", "-0.0"), ("1e-50000000", "1E-50000000"), ("[10,1]", "[10,1]"), ('{"b":1,"a":{"d":1,"c":null}}', '{"a":{"c":null,"d":1},"b":1}'), ('{"a":1,"a":2}', '{"a":2}'), ('"\\u00e9\\u0000"', '"é\\u0000"')])
def test_canonical_text(text, same):
    assert canonical.canonical(canonical.decode(text.encode())).decode() == same


@pytest.mark.parametrize("text", ["NaN", "Infinity", '{"a":}', "", "[1,]", '{"a":1} x', b'"\xff"'])
def test_strict_decoding(text):
    with pytest.raises(ValueError):
        canonical.decode(text if isinstance(text, bytes) else text.encode())


@given(values)
def test_canonical_text_reads_back(value):
    text = canonical.canonical(value)
    assert canonical.canonical(canonical.decode(text)) == text


@given(values)
def test_quick_and_slow_encoders_agree(value):
    assert canonical.encode(value) == canonical.walk(value, True)


def test_marks_cannot_be_forged():
    for forged in (["\udfff1"], ["\udfff1", Decimal("2.0")], {"\udfff": Decimal("2.0")}):
        assert canonical.encode(forged) == canonical.walk(forged, True)
        with pytest.raises(UnicodeEncodeError):
            canonical.canonical(forged)


def test_deep_values_need_no_stack():
    value = 1
    for _ in range(5000):
        value = {"a": [value]}
    assert canonical.encode(value).startswith('{"a":[{"a":[')


@pytest.mark.parametrize(("number", "whole"), [("1.0", True), ("1.5", False), ("0.00", True), ("1E+3", True), ("1E-50000000", False), ("1200E-2", True)])
def test_whole_numbers(number, whole):
    assert canonical.is_whole(Decimal(number)) is whole


def test_array_elements():
    assert [t for _, t in canonical.elements(' [ {"a":1.0},\n[2] ] ')] == ['{"a":1.0}', "[2]"]
    assert list(canonical.elements("[]")) == []
    for bad in ("{}", "[1", "[1,]", "[1] 2", "1", ""):
        with pytest.raises(ValueError):
            list(canonical.elements(bad))


def test_pointers():
    assert pointer.parse("/") == ("",)
    assert pointer.parse("/a~1b/c~0d") == ("a/b", "c~d")
    assert pointer.child("/x", "a/b~") == "/x/a~1b~0"
    for bad in ("", "a", "/~2", "/~"):
        with pytest.raises(ValueError):
            pointer.parse(bad)


def test_ignoring():
    record = {"id": 1, "m": {"a": 1, "b": 2}, "s": "x", "l": [1]}
    drop = lambda *p: pointer.without(record, pointer.trie(p))
    assert drop("/m/a", "/absent/x") == {"id": 1, "m": {"b": 2}, "s": "x", "l": [1]}
    assert drop("/m/a", "/m") == drop("/m", "/m/a") == {"id": 1, "s": "x", "l": [1]}
    assert drop("/s/x") == record
    assert drop("/l")["m"] == {"a": 1, "b": 2}
    with pytest.raises(pointer.CrossesArray):
        drop("/l/0")
    assert record["m"] == {"a": 1, "b": 2}


@pytest.mark.parametrize(("old", "new", "found"), [
    ('{"a":1}', '{"a":1.0}', [("replace", "/a", "1", "1.0")]), ('{"a":1}', '{"a":true}', [("replace", "/a", "1", "true")]), ('{"a":[1,2]}', '{"a":[2,1]}', [("replace", "/a", "[1,2]", "[2,1]")]),
    ('{"a":{"a":1}}', '{"a":"x"}', [("replace", "/a", '{"a":1}', '"x"')]), ('{"a":null}', "{}", [("remove", "/a", "null", None)]), ('{"a":{"x":1,"y":2}}', '{"a":{}}', [("remove", "/a/x", "1", None), ("remove", "/a/y", "2", None)]),
    ("{}", '{"a/b":1,"c~d":2}', [("add", "/a~1b", None, "1"), ("add", "/c~0d", None, "2")]), ('{"a":1,"b":{"x":1,"y":{"z":1}}}', '{"a":2,"b":{"x":2,"y":{"z":2}},"c":0}', [("replace", "/a", "1", "2"), ("replace", "/b/x", "1", "2"), ("replace", "/b/y/z", "1", "2"), ("add", "/c", None, "0")]),
])
def test_patches(old, new, found):
    assert patch(canonical.decode(old.encode()), canonical.decode(new.encode())) == found


@settings(max_examples=200)
@given(records, records)
def test_a_patch_turns_old_into_new(old, new):
    import copy

    result = copy.deepcopy(old)
    for op, path, before, after in patch(old, new):
        *front, last = pointer.parse(path)
        target = result
        for name in front:
            target = target[name]
        if op == "add":
            assert last not in target
        else:
            assert canonical.encode(target[last]) == before
        if op == "remove":
            del target[last]
        else:
            target[last] = canonical.decode(after.encode())
    assert canonical.canonical(result) == canonical.canonical(new)


@pytest.mark.parametrize(("expression", "value", "result"), [
    ("a.b", {"a": {"b": 1}}, 1), ("a[0].b[?c>`1`].c|[0]", {"a": [{"b": [{"c": 1}, {"c": 2}]}]}, 2), ("a[*].b", {"a": [{"b": 1}, {"c": 2}, {"b": 3}]}, [1, 3]), ("*.x", {"p": {"x": 1}, "q": {"x": 2}}, [1, 2]),
    ("a[]", {"a": [[1], [2, 3], 4]}, [1, 2, 3, 4]), ("[a,b]", {"a": 1, "b": 2}, [1, 2]), ("{x:a,y:b.c}", {"a": 1, "b": {"c": 3}}, {"x": 1, "y": 3}), ("a||b", {"a": "", "b": 5}, 5),
    ("!a && b==`0.10`", {"a": [], "b": Decimal("0.1")}, True), ("sort_by(a,&x)[*].x", {"a": [{"x": 2}, {"x": 1}]}, [1, 2]), ("a[1:3]", {"a": [1, 2, 3, 4]}, [2, 3]), ("a[::-1]", {"a": [1, 2]}, [2, 1]),
    ("a[*].b[*].c", {"a": [{"b": [{"c": 1}, {"c": 2}]}, {"b": [{"c": 3}]}]}, [[1, 2], [3]]), ("a[].b[].c", {"a": [{"b": [{"c": 1}, {"c": 2}]}, {"b": [{"c": 3}]}]}, [1, 2, 3]),
    ("to_number('1.50')", {}, Decimal("1.50")), ("to_number('x')", {}, None), ("to_string(@)", {"b": "é\x7f", "a": Decimal("1.0")}, '{"b":"\\u00e9\\u007f","a":1.0}'), ("avg(@)", [], None),
    ("avg(@)", [1, Decimal("2.0")], Decimal("1.5")), ("abs(@)", Decimal("-1.50"), Decimal("1.50")), ("`ES`", {}, "ES"), ("'a\\'b'", {}, "a'b"), ("max_by(@,&x).x", [{"x": 1}, {"x": 3}], 3), ("map(&x,@)", [{"x": 1}, {}], [1, None]),
    ("merge(@,`{\"b\":2}`)", {"a": 1}, {"a": 1, "b": 2}), ("not_null(a,b)", {"b": 1}, 1), ("type(@)", Decimal("1"), "number"), ("a == b", {"a": 1, "b": Decimal("1.0")}, True), ("a == b", {"a": 1, "b": True}, False), ("a < 'x'", {"a": 1}, None),
])
def test_jmespath(expression, value, result):
    assert search(parse(expression), value) == result


@pytest.mark.parametrize("bad", ["", " ", "a.", "a[", "foo(a)", "a b", "length()", "length(a,b)", "a[::0]", "a.'b'", "[?a", "&&"])
def test_bad_jmespath(bad):
    with pytest.raises(ValueError):
        parse(bad)


@pytest.mark.parametrize("wrong", ["abs('x')", "sum(['x'])", "sort([`1`,'x'])", "length(`1`)", "keys(`1`)", "sort_by([{x:`1`},{x:'a'}],&x)", "join(`1`,@)"])
def test_wrong_arguments(wrong):
    with pytest.raises(ValueError):
        search(parse(wrong), {})
