"""Reconciliation of DataFrames with typed columns, all in Catalyst.

A record is a row, its identity the values of its key columns, its content the other columns that are not ignored.
Rows have no lines of their own: `order` names the column that stands for them, and first and last need it; rows of one
identity and place are told apart by their content. Doubles compare as Spark compares them: NaN equals NaN, and -0.0
equals 0.0; numbers of different types compare by value, and values of other different types are never equal.

Under `duplicates="pairs"` every row of an identity meets every row of the other side that has it, as in SQL's full join.
A null in a single key, and under `duplicates="error"` an identity of several rows, are errors. They are looked for in one
aggregate over the keys when a comparison is first asked for; faults() gives them as rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import canonical, columns, pointer
from spindle.model import SIDES, ConfigurationError, DuplicateKeyError, DuplicatePolicy, InputError, MissingKeyPolicy, options
from spindle.operators import profile, reconcile

_KINDS = {T.BooleanType: "booleans", T.StringType: "strings", T.StructType: "objects", T.MapType: "objects", T.ArrayType: "arrays"}


def col(name: str) -> Column:
    """A column by its very name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def json_text(column: Column) -> Column:
    """A value's JSON, whatever its type."""
    whole = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return whole.substr(F.lit(6), F.length(whole) - 6)


def identity_of(keys: Sequence[Column]) -> Column:
    """Canonical array text of key values, as bytes: what identities are ordered by."""
    return F.concat(F.lit("["), F.concat_ws(",", *map(json_text, keys)), F.lit("]")).cast("binary")


def identity(keys: Sequence[str]) -> Column:
    return identity_of([col(k) for k in keys])


def drop_pointer(df: DataFrame, text: str) -> DataFrame:
    """df without what a pointer names; absent fields are no matter."""
    first, *rest = pointer.parse(text)
    if first not in df.columns:
        return df
    return df.withColumn(first, _without(col(first), df.schema[first].dataType, rest)) if rest else df.drop(first)


def _without(value: Column, kind: T.DataType, path: Sequence[str]) -> Column:
    name, *rest = path
    if isinstance(kind, T.ArrayType):
        raise ConfigurationError("ignore paths may not traverse arrays")
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if not rest:
            return F.map_filter(value, lambda k, v: k != name)
        return F.transform_values(value, lambda k, v: F.when(k == name, _without(v, kind.valueType, rest)).otherwise(v))
    if not isinstance(kind, T.StructType) or name not in kind.names:
        return value
    if rest:
        kept = [value.getField(f.name) if f.name != name else _without(value.getField(f.name), f.dataType, rest) for f in kind]
        return F.when(value.isNotNull(), F.struct(*(c.alias(f.name) for c, f in zip(kept, kind, strict=True))))
    kept = [value.getField(n).alias(n) for n in kind.names if n != name]
    # An object that loses its only member is an empty one, which no struct can be.
    return F.when(value.isNotNull(), F.struct(*kept) if kept else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def comparable(value: Column, kind: T.DataType) -> Column:
    """The value with every map as its entries in order, which can be compared and ordered."""
    if not _has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*(comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind)))


def alike(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """Whether two values are equal; types that differ make values differ, but for numbers."""
    if a_kind == b_kind or all(isinstance(k, T.NumericType) for k in (a_kind, b_kind)):
        return comparable(a, a_kind).eqNullSafe(comparable(b, b_kind))
    neither = a.isNull() & b.isNull()
    if isinstance(a_kind, T.StructType) and isinstance(b_kind, T.StructType):
        if {*a_kind.names} != {*b_kind.names}:
            return neither
        members = (alike(a.getField(n), a_kind[n].dataType, b.getField(n), b_kind[n].dataType) for n in a_kind.names)
        return neither | (a.isNotNull() & b.isNotNull() & reduce(lambda x, y: x & y, members))
    if type(a_kind) is type(b_kind) and isinstance(a_kind, T.ArrayType | T.MapType):
        return json_text(a).eqNullSafe(json_text(b))
    if isinstance(a_kind, T.NullType) or isinstance(b_kind, T.NullType) or type(a_kind) is not type(b_kind):
        return neither
    return a.eqNullSafe(b)


class Frames:
    """Two DataFrames to reconcile, with the options of diff()."""

    def __init__(
        self, old: DataFrame, new: DataFrame, key: str | Sequence[str], ignore: Sequence[str] = (), where: str | Column | None = None, duplicates: str = "error",
        schema_ignore: Sequence[str] = (), order: str | None = None, missing_key: str = "error",
    ):
        self.options = options(key, ignore, where if isinstance(where, str) else None, duplicates, missing_key, True, schema_ignore)
        if self.options.duplicates in (DuplicatePolicy.FIRST, DuplicatePolicy.LAST) and order is None:
            raise ConfigurationError("first and last need an order column")
        self.order = order
        pick = lambda df: df if where is None else df.where(columns.where(where, df.schema) if isinstance(where, str) else where)
        self.sides = [pick(old), pick(new)]
        self.keys = list(self.options.key)
        for name, side in zip(SIDES, self.sides, strict=True):
            for k in self.keys:
                if k not in side.columns and (self.options.missing_key is MissingKeyPolicy.ERROR or len(self.keys) == 1):
                    raise InputError(f"missing identity field {k!r}", name)

    # --- sides ---

    @cached_property
    def contents(self) -> list[DataFrame]:
        """Both sides without what is ignored, but with their keys."""
        return [reduce(drop_pointer, self.options.ignore, df) for df in self.sides]

    def fields(self, side: int) -> list[T.StructField]:
        """Content columns, in the order of their names."""
        return sorted((f for f in self.contents[side].schema if f.name not in self.keys), key=lambda f: f.name)

    @property
    def ks(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.keys))]

    def shaped(self, side: int) -> DataFrame:
        """(k0, k1..., line, body): keys by place, the order column even if it is ignored as content, and the content as a struct."""
        source, kept = self.sides[side], self.contents[side]
        keys = [(col(k) if k in source.columns else F.lit(None)).alias(n) for k, n in zip(self.keys, self.ks, strict=True)]
        line = (col(self.order).cast("long") if self.order else F.lit(None).cast("long")).alias("line")
        body = F.struct(*(col(f.name).alias(f.name) for f in self.fields(side))) if self.fields(side) else F.struct(F.lit(0).alias(""))
        if self.order and self.order not in kept.columns:  # what is ignored is taken from the content alone
            return reduce(drop_pointer, (p for p in self.options.ignore if len(pointer.parse(p)) > 1), source).select(*keys, line, body.alias("body"))
        return kept.select(*keys, line, body.alias("body"))

    def ordered_body(self, side: int) -> Column:
        """The content as something that has an order."""
        return comparable(F.col("body"), T.StructType(self.fields(side)))

    def unique(self, side: int) -> DataFrame:
        """One row of each identity, or under "pairs" all of them."""
        df = self.shaped(side)
        if self.options.duplicates in (DuplicatePolicy.ERROR, DuplicatePolicy.PAIRS):
            return df
        pick = F.max_by if self.options.duplicates is DuplicatePolicy.LAST else F.min_by
        return df.groupBy(*self.ks).agg(pick("body", F.struct(F.col("line"), self.ordered_body(side).alias("body"))).alias("body"))

    # --- faults ---

    def faults(self) -> DataFrame:
        """(side, fault, identity, n, first, again) of null single keys, and of identities of several rows if these are errors: n rows, at the two first places."""
        rows = reduce(DataFrame.unionByName, (self.shaped(side).select(F.lit(side).alias("side"), *self.ks, "line") for side in (0, 1)))
        bad = rows.groupBy("side", *self.ks).agg(F.count("*").alias("n"), F.min("line").alias("first") if self.order else F.lit(None).cast("long").alias("first"))
        null = F.col("k0").isNull() if len(self.keys) == 1 else F.lit(False)
        bad = bad.where(null | (F.col("n") > 1) if self.options.duplicates is DuplicatePolicy.ERROR else null)
        again = F.col("first")
        if self.order:
            apart = ["side", *self.ks]
            marked = bad.select(*(F.col(c).alias(f"_{c}") for c in apart), "first")
            later = rows.join(marked, (F.col("side") == F.col("_side")) & self.same_key("", "_")).where("line > first").groupBy(*apart).agg(F.min("line").alias("again"))
            bad = bad.join(later.select(*(F.col(c).alias(f"_{c}") for c in apart), "again"), (F.col("side") == F.col("_side")) & self.same_key("", "_"), "left")
            again = F.coalesce("again", "first")
        return bad.select("side", F.when(null, "null key").otherwise("duplicate key").alias("fault"), identity_of([F.col(k) for k in self.ks]).cast("string").alias("identity"), "n", "first", F.when(F.col("n") > 1, again).alias("again"))

    @cached_property
    def _sound(self) -> bool:
        """True, or the first fault as an error: of OLD before NEW, of null keys before repeated ones."""
        if len(self.keys) > 1 and self.options.duplicates is not DuplicatePolicy.ERROR:
            return True
        worst = self.faults().agg(F.min(F.struct("side", F.col("fault") == "duplicate key", F.coalesce("again", F.lit(0)), "identity", "fault", "first", "again")).alias("f")).first()["f"]
        if worst is None:
            return True
        side = SIDES[worst["side"]]
        if worst["fault"] == "null key":
            raise InputError(f"identity field {self.keys[0]!r} must be a non-null scalar", side)
        lines = (worst["first"], worst["again"]) if self.order else None
        raise DuplicateKeyError(tuple(canonical.decode(worst["identity"].encode())), worst["identity"], side, lines)

    # --- comparison ---

    def same_key(self, one: str, other: str) -> Column:
        """A single key is never null, and compares quicker for it."""
        equal = (lambda a, b: a == b) if len(self.ks) == 1 else (lambda a, b: a.eqNullSafe(b))
        return reduce(lambda a, b: a & b, (equal(F.col(f"{one}{k}"), F.col(f"{other}{k}")) for k in self.ks))

    def paired(self) -> DataFrame:
        """k0, k1..., operation, and both sides' content as structs `old` and `new`."""
        assert self._sound
        part = lambda n, name: self.unique(n).select(*(F.col(k).alias(f"{name}_{k}") for k in self.ks), F.col("body").alias(name), F.lit(True).alias(f"in_{name}"))
        joined = part(0, "old").join(part(1, "new"), self.same_key("old_", "new_"), "full_outer")
        before, after = ({f.name: f.dataType for f in self.fields(n)} for n in (0, 1))
        o, n = F.col("old"), F.col("new")
        each = (alike(o.getField(c), before[c], n.getField(c), after[c]) for c in before if c in after)
        same = reduce(lambda a, b: a & b, each, F.lit(True)) if before.keys() == after.keys() else F.lit(False)
        operation = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(same, "equal").otherwise("modified")
        keys = (F.when(F.col("in_old"), F.col(f"old_{k}")).otherwise(F.col(f"new_{k}")).alias(k) for k in self.ks)
        return joined.select(*keys, operation.alias("operation"), "old", "new")

    def named(self, df: DataFrame, *rest: str, ordered: bool = False) -> DataFrame:
        """df with its keys by name and the rest; in the order of identities, if asked."""
        if ordered:
            df = df.orderBy(identity_of([F.col(k) for k in self.ks]), *(c for c in rest if c == "path"))
        return df.select(*(F.col(k).alias(name) for k, name in zip(self.ks, self.keys, strict=True)), *rest)

    def changes(self, only: str | None = None, ordered: bool = False) -> DataFrame:
        """Keys and operation of each identity that differs, or under "pairs" of each pair."""
        if only in ("added", "deleted"):  # an anti-join needs no content
            assert self._sound
            one, other = (1, 0) if only == "added" else (0, 1)
            here, there = self.shaped(one).select(*self.ks), self.shaped(other).select(*(F.col(k).alias(f"_{k}") for k in self.ks))
            here = here if self.options.duplicates is DuplicatePolicy.PAIRS else here.distinct()
            return self.named(here.join(there, self.same_key("", "_"), "left_anti").withColumn("operation", F.lit(only)), "operation", ordered=ordered)
        found = self.paired().where("operation <> 'equal'")
        return self.named(found.where(F.col("operation") == only) if only else found, "operation", ordered=ordered)

    def summary(self) -> DataFrame:
        return reconcile.totals(self.paired())

    # --- duplicates ---

    def duplicate_counts(self) -> DataFrame:
        """(side, n): rows beyond the first of each identity."""
        each = (self.shaped(n).groupBy(*self.ks).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("n")).where("n > 0").select(F.lit(n).alias("side"), "n") for n in (0, 1))
        return reduce(DataFrame.unionByName, each)

    def duplicates(self) -> DataFrame:
        """(side, identity, selected_line, discarded_line, content_equal) of each row that was not selected.

        Only rows of identities that have several are looked at, where they are once these have met: content is neither hashed nor written out.
        Under "pairs" all are selected.
        """
        found = reduce(DataFrame.unionByName, (self._discarded(side) for side in (0, 1)))
        return found.limit(0) if self.options.duplicates is DuplicatePolicy.PAIRS else found

    def _discarded(self, side: int) -> DataFrame:
        rows = self.shaped(side)
        several = rows.groupBy(*self.ks).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in self.ks))
        rows = rows.join(several, self.same_key("", "_"), "left_semi").select(*self.ks, F.struct(F.col("line"), self.ordered_body(side).alias("body")).alias("r"))
        pick = F.max if self.options.duplicates is DuplicatePolicy.LAST else F.min
        best = rows.groupBy(*self.ks).agg(pick("r").alias("best")).select(*(F.col(k).alias(f"_{k}") for k in self.ks), "best")
        judged = rows.join(best, self.same_key("", "_")).select(*self.ks, "r", "best")
        others = judged.where(~F.col("r").eqNullSafe(F.col("best"))).select(*self.ks, F.col("best.line").alias("selected_line"), F.col("r.line").alias("discarded_line"), F.col("r.body").eqNullSafe(F.col("best.body")).alias("content_equal"))
        # Of rows that are the selected one all over, all but one are discarded.
        twins = judged.where(F.col("r").eqNullSafe(F.col("best"))).groupBy(*self.ks, F.col("best.line").alias("selected_line")).agg(F.count("*").cast("int").alias("n")).where("n > 1")
        twins = twins.select(*self.ks, "selected_line", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("nth")).select(*self.ks, "selected_line", F.col("selected_line").alias("discarded_line"), F.lit(True).alias("content_equal"))
        return others.unionByName(twins).select(F.lit(side).alias("side"), identity_of([F.col(k) for k in self.ks]).alias("identity"), "selected_line", "discarded_line", "content_equal")

    def records(self) -> DataFrame:
        """Both sides as records of the text lane's shape, with `order` as line: their content is its JSON's length and digest."""
        both = []
        for n in (0, 1):
            text = F.to_json("body", {"ignoreNullFields": "false"}) if self.fields(n) else F.lit("{}")
            both.append(self.shaped(n).select(F.lit(n).alias("side"), identity_of([F.col(k) for k in self.ks]).alias("identity"), "line", F.octet_length(text).cast("long").alias("length"), F.unhex(F.sha2(text, 256)).alias("digest")))
        return both[0].unionByName(both[1])

    # --- schema ---

    def profiles(self) -> DataFrame:
        fields, objects = [], []
        for side, df in enumerate(self.sides):
            f, o = _counts(reduce(drop_pointer, self.options.schema_ignore, df), side)
            fields.append(f)
            objects.append(o)
        return profile.profiles(fields[0].unionByName(fields[1]), objects[0].unionByName(objects[1]))

    def schema_changes(self) -> DataFrame:
        return profile.changes(self.profiles())

    # --- fields ---

    def field_changes(self, ordered: bool = False) -> DataFrame:
        """Keys, op, path, old and value of each part that differs in a modified record, the values as JSON.

        Objects on both sides are compared by member, however deep; whatever else differs is replaced as a whole.
        """
        shape = [T.StructType(self.fields(n)) for n in (0, 1)]
        each = list(_parts("", F.col("old"), shape[0], F.col("new"), shape[1], F.lit(True)))
        found = self.paired().where("operation = 'modified'")
        found = found.select(*self.ks, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("p")) if each else found.select(*self.ks, F.lit(None).cast("struct<op:string,path:string,old:string,value:string>").alias("p")).limit(0)
        return self.named(found.select(*self.ks, "p.*"), "op", "path", "old", "value", ordered=ordered)

    def field_summary(self) -> DataFrame:
        count = lambda op, name: F.count_if(F.col("op") == op).alias(name)
        return self.field_changes().groupBy("path").agg(count("add", "added"), count("remove", "removed"), count("replace", "replaced"))


def _parts(path: str, old: Column | None, old_kind: T.DataType | None, new: Column | None, new_kind: T.DataType | None, there: Column) -> Iterator[Column]:
    """A struct (op, path, old, value) for each place where old and new may differ, null where they do not; in the order of names."""
    text = lambda x: F.lit(None).cast("string") if x is None else json_text(x)
    part = lambda op, test: F.when(there & test, F.struct(F.lit(op).alias("op"), F.lit(path).alias("path"), text(old).alias("old"), text(new).alias("value")))
    if old is None or new is None:
        yield part("add" if old is None else "remove", F.lit(True))
    elif isinstance(old_kind, T.StructType) and isinstance(new_kind, T.StructType):
        if path:
            yield part("replace", old.isNull() != new.isNull())
        both = there & old.isNotNull() & new.isNotNull()
        for name in sorted({*old_kind.names, *new_kind.names}, key=str.encode):
            sides = [(v.getField(name), k[name].dataType) if name in k.names else (None, None) for v, k in ((old, old_kind), (new, new_kind))]
            yield from _parts(pointer.child(path, name), *sides[0], *sides[1], both)
    else:
        yield part("replace", ~alike(old, old_kind, new, new_kind))


def _counts(df: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Partial counts of every column and nested member, in one aggregate over df."""
    fields: list[tuple[str, str, Column, Column, T.DataType]] = []
    objects: list[tuple[str, Column]] = [("", F.lit(True))]
    todo = [("", F.lit(True), f, col(f.name)) for f in df.schema.fields]
    while todo:
        parent, present, f, column = todo.pop()
        path = pointer.child(parent, f.name)
        fields.append((path, parent, present, column, f.dataType))
        if isinstance(f.dataType, T.StructType):
            objects.append((path, column.isNotNull()))
            todo += [(path, column.isNotNull(), g, column.getField(g.name)) for g in f.dataType.fields]
    cells = []
    for path, parent, present, column, kind in fields:
        there = present & column.isNotNull()
        if isinstance(kind, T.NumericType):
            whole = there & F.coalesce(column == F.floor(column), F.lit(False)) if isinstance(kind, T.FractionalType) else there
            by = {"integers": whole, "numbers": there & ~whole}
        else:
            by = {_KINDS.get(type(kind), "strings"): there}
        count = lambda x: F.count_if(x)
        values = {"present": count(present), "nulls": count(present & column.isNull())} | {k: count(v) for k, v in by.items()}
        cells.append(F.struct(F.lit(path).alias("path"), F.lit(parent).alias("parent"), *(values.get(c, F.lit(0).cast("long")).alias(c) for c in profile.COUNTS)))
    found = df.agg(F.array(*cells).alias("f"), F.array(*(F.struct(F.lit(p).alias("path"), F.count_if(x).alias("n")) for p, x in objects)).alias("o"))
    return found.select(F.lit(side).alias("side"), F.inline("f")).where("present > 0"), found.select(F.lit(side).alias("side"), F.inline("o")).where("n > 0")
