"""JMESPath filters as Columns, so Catalyst can push them down to the scan.

Types are those of the schema. A wrong type is told when the filter is built; a null argument gives null, and a null among
values to be summed or averaged makes the whole null, where the text lane would tell a fault of that record. What has no single type,
such as a list of a string and a number, raises Unsupported: such filters need the text lane.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions.jmespath import Node, parse


class Unsupported(ValueError):
    pass


class Value(NamedTuple):
    """A column and its type. The whole row has no column."""

    column: Column | None
    kind: T.DataType



def _null() -> Value:
    return Value(F.lit(None), T.NullType())


def truth(column: Column, kind: T.DataType) -> Column:
    """False for null, false, and empty strings, arrays and maps; zero is true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(column != "", F.lit(False))
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    if isinstance(kind, T.NullType):
        return F.lit(False)
    return column.isNotNull()


def _is(kind: T.DataType, *types: type) -> bool:
    return isinstance(kind, types)


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _common(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type that values of these types have in one array."""
    known = [k for k in kinds if not _is(k, T.NullType)]
    if not known:
        return T.NullType()
    typed = [k for k in known if k != T.ArrayType(T.NullType())] or known  # an empty array is one of any type
    if all(k == typed[0] for k in typed):
        return typed[0]
    if all(map(_number, known)):
        if all(_is(k, T.IntegralType) for k in known):
            return T.LongType()
        return T.DecimalType(38, 18) if all(_is(k, T.DecimalType, T.IntegralType) for k in known) else T.DoubleType()
    raise Unsupported("values of several types need the text lane")


def _array(values: Sequence[Value]) -> Value:
    if not values:
        return Value(F.array().cast("array<void>"), T.ArrayType(T.NullType()))
    kind = _common([v.kind for v in values])
    if _is(kind, T.NullType):
        kind = T.StringType()
    cast = [v.column if v.kind == kind else v.column.cast(kind) for v in values]
    return Value(F.array(*cast), T.ArrayType(kind))


def _struct(values: dict[str, Value]) -> Value:
    typed = {n: Value(v.column.cast("string"), T.StringType()) if _is(v.kind, T.NullType) else v for n, v in values.items()}
    return Value(F.struct(*(v.column.alias(n) for n, v in typed.items())), T.StructType([T.StructField(n, v.kind) for n, v in typed.items()]))


def _literal(value: Any) -> Value:
    if value is None:
        return _null()
    for python, kind in ((bool, T.BooleanType()), (int, T.LongType()), (Decimal, T.DecimalType(38, 18)), (str, T.StringType())):
        if isinstance(value, python):
            return Value(F.lit(value), kind)
    if isinstance(value, list):
        return _array([_literal(x) for x in value])
    if not value:
        raise Unsupported("an empty object needs the text lane")
    return _struct({name: _literal(x) for name, x in value.items()})


def _whole(at: Value) -> Value:
    """A value that has a column: a row becomes a struct of its columns."""
    if at.column is not None:
        return at
    return Value(F.struct(*(_member(at, f.name).column.alias(f.name) for f in at.kind)), at.kind)


def _member(at: Value, name: str) -> Value:
    if _is(at.kind, T.MapType) and _is(at.kind.keyType, T.StringType):
        return Value(F.try_element_at(at.column, F.lit(name)), at.kind.valueType)
    if not _is(at.kind, T.StructType) or name not in at.kind.names:
        return _null()
    column = F.col("`" + name.replace("`", "``") + "`") if at.column is None else at.column.getField(name)
    return Value(column, at.kind[name].dataType)


def _mapped(values: Value, node: Node, keep_null: bool = False) -> Value:
    """The node over each element; what is null then goes, as in a projection, if it is not to be kept."""
    if not _is(values.kind, T.ArrayType):
        return _null()
    found: list[T.DataType] = []

    def one(x: Column) -> Column:
        value = _whole(build(node, Value(x, values.kind.elementType)))
        found.append(value.kind)
        return value.column.cast("string") if _is(value.kind, T.NullType) else value.column

    column = F.transform(values.column, one)
    kind = T.StringType() if _is(found[-1], T.NullType) else found[-1]
    return Value(column if keep_null else F.filter(column, lambda x: x.isNotNull()), T.ArrayType(kind))


def _slice(at: Value, start: int | None, stop: int | None, step: int | None) -> Value:
    if not _is(at.kind, T.ArrayType):
        return _null()
    n, step = F.size(at.column), 1 if step is None else step
    first, last = (0, n) if step > 0 else (-1, n - 1)  # what places are held within
    held = lambda k: F.greatest(F.lit(first), F.least(last if isinstance(last, Column) else F.lit(last), F.lit(k) if k >= 0 else n + k))
    low = (F.lit(0) if step > 0 else n - 1) if start is None else held(start)
    high = (n if step > 0 else F.lit(-1)) if stop is None else held(stop)
    some = low < high if step > 0 else low > high
    places = F.when(some, F.sequence(low, high - (1 if step > 0 else -1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return Value(F.when(at.column.isNotNull(), F.transform(places, lambda i: F.get(at.column, i))), at.kind)


def _objects_values(at: Value) -> Value:
    """The values of an object, as an array."""
    if _is(at.kind, T.MapType):
        return Value(F.map_values(at.column), T.ArrayType(at.kind.valueType))
    if not _is(at.kind, T.StructType):
        return _null()
    out = _array([_member(at, n) for n in at.kind.names])
    return out if at.column is None else Value(F.when(at.column.isNotNull(), out.column), out.kind)


def _same(a: Value, b: Value) -> Column:
    """Whether two values are equal, member by member and element by element if their types are not the same."""
    if _is(a.kind, T.MapType) or _is(b.kind, T.MapType):
        raise Unsupported("comparing maps needs the text lane")
    if a.kind == b.kind or _number(a.kind) and _number(b.kind):
        return a.column.eqNullSafe(b.column)
    alike = F.lit(False)
    if _is(a.kind, T.ArrayType) and _is(b.kind, T.ArrayType):
        pairs = F.zip_with(a.column, b.column, lambda x, y: _same(Value(x, a.kind.elementType), Value(y, b.kind.elementType)))
        alike = (F.size(a.column) == F.size(b.column)) & F.forall(pairs, lambda x: x)
    elif _is(a.kind, T.StructType) and _is(b.kind, T.StructType) and {*a.kind.names} == {*b.kind.names}:
        alike = reduce(lambda x, y: x & y, (_same(_member(a, n), _member(b, n)) for n in a.kind.names))
    there = a.column.isNotNull() & b.column.isNotNull()
    return F.when(there, alike).otherwise(a.column.isNull() & b.column.isNull())


def _compared(op: str, a: Value, b: Value) -> Value:
    numbers = _number(a.kind) and _number(b.kind)
    if op in ("==", "!="):
        if _is(a.kind, T.NullType) or _is(b.kind, T.NullType) or not (numbers or type(a.kind) is type(b.kind)):
            same = _whole(a).column.isNull() & _whole(b).column.isNull()
        else:
            same = _same(_whole(a), _whole(b))
        return Value(same if op == "==" else ~same, T.BooleanType())
    if not numbers:
        return Value(F.lit(None).cast("boolean"), T.BooleanType())
    x, y = a.column, b.column
    return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], T.BooleanType())


def _either(node: Node, at: Value) -> Value:
    a, b = (_whole(build(p, at)) for p in node.parts)
    if type(a.kind) is type(b.kind) and a.kind == b.kind:
        true, false = (b, a) if node.kind == "and" else (a, b)
        return Value(F.when(truth(*a), true.column).otherwise(false.column), a.kind)
    both = truth(*a) & truth(*b) if node.kind == "and" else truth(*a) | truth(*b)
    return Value(both, T.BooleanType())


def build(node: Node, at: Value) -> Value:
    """The value of a node over a value."""
    kind, parts = node.kind, node.parts
    below = lambda n: build(n, at)
    if kind == "field":
        return _member(at, node.value)
    if kind == "literal":
        return _literal(node.value)
    if kind == "current":
        return at
    if kind in ("sub", "pipe"):
        return build(parts[1], below(parts[0]))
    if kind == "index":
        if not _is(at.kind, T.ArrayType):
            return _null()
        return Value(F.try_element_at(at.column, F.lit(node.value + 1 if node.value >= 0 else node.value)), at.kind.elementType)
    if kind == "slice":
        return _slice(at, *node.value)
    if kind == "flatten":
        values = below(parts[0])
        if _is(values.kind, T.ArrayType) and _is(values.kind.elementType, T.ArrayType):
            return Value(F.flatten(F.filter(values.column, lambda x: x.isNotNull())), values.kind.elementType)
        return values if _is(values.kind, T.ArrayType) else _null()
    if kind == "project":
        return _mapped(below(parts[0]), parts[1])
    if kind == "values":
        return _mapped(_objects_values(below(parts[0])), parts[1])
    if kind == "chosen":
        values = below(parts[0])
        if not _is(values.kind, T.ArrayType):
            return _null()
        some = F.filter(values.column, lambda x: truth(*_whole(build(parts[1], Value(x, values.kind.elementType)))))
        return _mapped(Value(some, values.kind), parts[2])
    if kind in ("list", "hash"):
        if _is(at.kind, T.NullType):
            return _null()
        each = [_whole(below(p)) for p in parts]
        out = _array(each) if kind == "list" else _struct(dict(zip(node.value, each, strict=True)))
        return out if at.column is None else Value(F.when(at.column.isNotNull(), out.column), out.kind)
    if kind == "compare":
        return _compared(node.value, below(parts[0]), below(parts[1]))
    if kind in ("and", "or"):
        return _either(node, at)
    if kind == "not":
        return Value(~truth(*_whole(below(parts[0]))), T.BooleanType())
    if kind == "call":
        return _call(node.value, parts, at)
    raise Unsupported(f"{kind} needs the text lane")


# --- functions -------------------------------------------------------------------------------------------------------

_LONG, _TEXT, _FLAG = T.LongType(), T.StringType(), T.BooleanType()


def _total(values: Value) -> Column:
    zero = F.lit(0).cast("double" if _is(values.kind.elementType, T.FloatType, T.DoubleType) else "decimal(38,18)" if _is(values.kind.elementType, T.DecimalType) else "long")
    return F.aggregate(values.column, zero, lambda a, x: (a + x).cast("decimal(38,18)") if _is(values.kind.elementType, T.DecimalType) else a + x)


def _sum_kind(kind: T.DataType) -> T.DataType:
    return T.DecimalType(38, 18) if _is(kind, T.DecimalType) else T.DoubleType() if _is(kind, T.FractionalType) else _LONG


def _by(values: Value, key: Node) -> Value:
    return _mapped(values, key.parts[0], keep_null=True)


def _best_by(values: Value, key: Node, best: Callable[[Column], Column]) -> Value:
    keys = _by(values, key).column
    return Value(F.try_element_at(values.column, F.array_position(keys, best(keys)).cast("int")), values.kind.elementType)


def _sorted_by(values: Value, key: Node) -> Value:
    """By key, then place, so that equal keys stay in their order."""
    places = F.array_sort(F.transform(_by(values, key).column, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return Value(F.transform(places, lambda p: F.get(values.column, p["i"])), values.kind)


def _length(x: Value) -> Value:
    if _is(x.kind, T.StringType):
        return Value(F.char_length(x.column), _LONG)
    if _is(x.kind, T.StructType):
        return Value(F.when(x.column.isNotNull(), F.lit(len(x.kind))), _LONG)
    return Value(F.when(x.column.isNotNull(), F.size(x.column)), _LONG)


def _keys(x: Value) -> Value:
    names = F.map_keys(x.column) if _is(x.kind, T.MapType) else F.when(x.column.isNotNull(), F.array(*map(F.lit, x.kind.names)))
    return Value(names, T.ArrayType(_TEXT))


def _merged(*objects: Value) -> Value:
    out = _struct({n: _member(x, n) for x in objects for n in x.kind.names})
    there = reduce(lambda a, b: a & b, (x.column.isNotNull() for x in objects))
    return Value(F.when(there, out.column), out.kind)


def _as_number(x: Value) -> Value:
    if _number(x.kind):
        return x
    kind = T.DecimalType(38, 18)
    return Value(x.column.try_cast(kind) if _is(x.kind, T.StringType) else F.lit(None).cast(kind), kind)


def _as_text(x: Value) -> Value:
    if _is(x.kind, T.NullType):
        return Value(F.lit("null"), _TEXT)
    nested = _is(x.kind, T.StructType, T.ArrayType, T.MapType)
    text = F.to_json(x.column, {"ignoreNullFields": "false"}) if nested else x.column.cast("string")
    return Value(F.coalesce(text, F.lit("null")), _TEXT)


_TYPES = ((T.BooleanType, "boolean"), (T.NumericType, "number"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"))


def _type(x: Value) -> Value:
    name = next((name for kind, name in _TYPES if _is(x.kind, kind)), "string")
    return Value(F.lit("null") if _is(x.kind, T.NullType) else F.when(x.column.isNull(), "null").otherwise(name), _TEXT)


_NUMBER, _STRING, _LIST, _OBJECT = _number, lambda k: _is(k, T.StringType), lambda k: _is(k, T.ArrayType), lambda k: _is(k, T.StructType, T.MapType)
_NUMBERS = lambda k: _is(k, T.ArrayType) and _number(k.elementType)
_ORDERED = lambda k: _is(k, T.ArrayType) and (_number(k.elementType) or _is(k.elementType, T.StringType))
_ANY = lambda k: True
_whole_number = lambda how: lambda x: x if _is(x.kind, T.IntegralType) else Value(how(x.column), _LONG)
_of_text = lambda how: lambda x, y: Value(how(x.column, y.column), _FLAG)

#: Each function by the types that it takes, and what it gives. A function may be there for several types.
CALLS: tuple[tuple[str, tuple, Callable[..., Value]], ...] = (
    ("abs", (_NUMBER,), lambda x: Value(F.abs(x.column), x.kind)),
    ("avg", (_NUMBERS,), lambda x: Value(F.when(F.size(x.column) > 0, _total(x) / F.size(x.column)), T.DoubleType())),
    ("ceil", (_NUMBER,), _whole_number(F.ceil)),
    ("contains", (_STRING, _STRING), _of_text(F.contains)),
    ("contains", (_LIST, _ANY), lambda x, y: Value(F.exists(x.column, lambda e: _compared("==", Value(e, x.kind.elementType), y).column), _FLAG)),
    ("ends_with", (_STRING, _STRING), _of_text(F.endswith)),
    ("floor", (_NUMBER,), _whole_number(F.floor)),
    ("join", (_STRING, _LIST), lambda glue, x: Value(F.aggregate(x.column, F.lit(None).cast("string"), lambda a, e: F.when(a.isNull(), e).otherwise(F.concat(a, glue.column, e)), lambda a: F.coalesce(a, F.lit(""))), _TEXT)),
    ("keys", (_OBJECT,), _keys),
    ("length", (lambda k: _STRING(k) or _LIST(k) or _OBJECT(k),), _length),
    ("max", (_ORDERED,), lambda x: Value(F.array_max(x.column), x.kind.elementType)),
    ("merge", (_OBJECT, ...), _merged),
    ("min", (_ORDERED,), lambda x: Value(F.array_min(x.column), x.kind.elementType)),
    ("reverse", (lambda k: _STRING(k) or _LIST(k),), lambda x: Value(F.reverse(x.column), x.kind)),
    ("sort", (_ORDERED,), lambda x: Value(F.array_sort(x.column), x.kind)),
    ("starts_with", (_STRING, _STRING), _of_text(F.startswith)),
    ("sum", (_NUMBERS,), lambda x: Value(_total(x), _sum_kind(x.kind.elementType))),
    ("to_array", (_LIST,), lambda x: x),
    ("to_array", (_ANY,), lambda x: _array([x])),
    ("to_number", (_ANY,), _as_number),
    ("to_string", (_STRING,), lambda x: Value(F.coalesce(x.column, F.lit("null")), _TEXT)),
    ("to_string", (_ANY,), _as_text),
    ("type", (_ANY,), _type),
    ("values", (_OBJECT,), _objects_values),
)


def _call(name: str, parts: Sequence[Node], at: Value) -> Value:
    if name in ("map", "sort_by", "max_by", "min_by"):
        key, values = parts if name == "map" else parts[::-1]
        found = _whole(build(values, at))
        if key.kind != "reference" or not _LIST(found.kind):
            raise Unsupported(f"{name}() takes an array and an expression")
        if name == "map":
            return _mapped(found, key.parts[0], keep_null=True)
        return _sorted_by(found, key) if name == "sort_by" else _best_by(found, key, F.array_max if name == "max_by" else F.array_min)
    got = [_whole(build(p, at)) for p in parts]
    if name == "not_null":
        kind = _common([x.kind for x in got])
        return _null() if _is(kind, T.NullType) else Value(F.coalesce(*(x.column.cast(kind) for x in got)), kind)
    for known, takes, gives in CALLS:
        wanted = [takes[0]] * len(got) if takes[-1] is ... else takes
        if known == name and len(wanted) == len(got) and all(test(x.kind) for test, x in zip(wanted, got, strict=True)):
            return gives(*got)
    raise Unsupported(f"{name}() does not take {', '.join(x.kind.simpleString() for x in got)} here")


def where(expression: str, schema: T.StructType) -> Column:
    return truth(*_whole(build(parse(expression), Value(None, schema))))
