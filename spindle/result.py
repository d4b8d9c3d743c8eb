"""A comparison session: reads both sources once on entering, then answers from what it has indexed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import canonical
from spindle.functions.patch import patch
from spindle.model import (
    SIDES, Change, ChangeOperation, DiffConfig, Duplicate, DuplicateKeyError, DuplicatePolicy, FieldChange, FieldOperation, FieldSummary, InputError, ResourceError, SchemaChange,
    SchemaChangeOperation, SchemaFieldProfile, SchemaSummary, SourceLocation, Summary, options,
)
from spindle.operators import index, profile, reconcile
from spindle.sources import text
from spindle.sources.workspace import Workspace

#: Signs that Spark could not read a source, such as a broken archive.
UNREADABLE = ("READ_FAILED", "FAILED_READ_FILE", "EOFException", "ZipException", "IOException")
PATCH = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "path", "old", "value")]))


def diff(
    old: Any, new: Any, *, key: str | Sequence[str], ignore: Sequence[str] = (), where: str | None = None, duplicates: str | DuplicatePolicy = DuplicatePolicy.ERROR,
    missing_key: Any = "error", schema_diff: bool = False, schema_ignore: Sequence[str] = (), format: str = "jsonl", field_diff: bool = False, spark: SparkSession | None = None,
) -> DiffResult:
    """A comparison of two sources of JSON records by identity. Opens nothing until it is entered."""
    return DiffResult(old, new, options(key, ignore, where, duplicates, missing_key, schema_diff, schema_ignore, format, field_diff), spark)


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("spindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def patched(bodies: DataFrame) -> DataFrame:
    """(identity, old_line, new_line, patch) from the same with old_body and new_body."""

    @F.pandas_udf(PATCH)
    def patches(old: pd.Series, new: pd.Series) -> pd.Series:
        rows = []
        for a, b in zip(old, new, strict=True):
            rows.append([dict(zip(("op", "path", "old", "value"), x, strict=True)) for x in patch(canonical.decode(bytes(a)), canonical.decode(bytes(b)))])
        return pd.Series(rows)

    return bodies.select(*reconcile.PAIR, patches("old_body", "new_body").alias("patch"))


class DiffResult:
    def __init__(self, old: Any, new: Any, config: DiffConfig, spark: SparkSession | None = None):
        self._sources, self.config, self._spark = (old, new), config, spark
        self._state, self._summary, self._fields, self._chosen = "new", None, None, None

    # --- life ---

    def __enter__(self) -> DiffResult:
        if self._state != "new":
            raise RuntimeError("the diff result cannot be entered more than once")
        self._state = "open"
        self._spark = self._spark or session()
        self._workspace = Workspace(self._spark)
        try:
            self._build()
        except BaseException:
            self.close()
            raise
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if self._state == "open":
            self._state = "closed"
            self._workspace.close()

    def _build(self) -> None:
        old = text.prepare(self._sources[0], 0, self._workspace)
        try:
            new, failure = text.prepare(self._sources[1], 1, self._workspace), None
        except InputError as error:  # OLD's faults are told first
            new, failure = None, error
        with ThreadPoolExecutor(2) as pool:  # both sides' jobs run at once
            running = [pool.submit(self._index, side, path) for side, path in enumerate((old, new)) if path is not None]
            sides = []
            for one in running:
                try:
                    found, fault = one.result()
                    if fault is not None:
                        raise fault
                except InputError:
                    self._fail_on_duplicates(sides)  # of OLD, before what is wrong with NEW
                    raise
                sides.append(found)
        if failure is not None:
            self._fail_on_duplicates(sides)
            raise failure
        self.index_df = sides[0].unionByName(sides[1])
        policy = self.config.duplicates
        several = policy in (DuplicatePolicy.ERROR, DuplicatePolicy.PAIRS)
        self.records_df = self.index_df.where("kind = 'record'").select("side", "identity", "line", *(reconcile.CONTENT if several else reconcile.SELECTED))
        self.selected_df = self._workspace.store("pairs", reconcile.paired(self.records_df) if several else reconcile.selected(self.records_df, policy))
        pairs = self.selected_df.select("identity", "operation", "old_line", "new_line")
        self.pairs_df, self.each_df = pairs, pairs.where("operation IS NULL")  # each_df: the pairs of identities that have several
        count = lambda df: df.agg(*(F.count_if(F.col("operation") == name).alias(name) for name in ("equal", "added", "deleted", "modified")), F.count_if(F.col("operation").isNull()).alias("several")).first()
        single = counts = count(pairs)
        repeated = counts["several"] > 0
        if repeated:
            self._fail_on_duplicates(sides)
            self.each_df = self._workspace.store("each", reconcile.every_pair(self.records_df, self.each_df.select("identity"), counts["several"]))
            self.pairs_df = pairs.where("operation IS NOT NULL").unionByName(self.each_df)
            counts = count(self.pairs_df)
        if self.config.field_diff:  # fingerprints have met; of bodies, only those of modified records are fetched
            rows = self.index_df.where("kind = 'record'").select("side", "identity", "line", "body")
            found = reconcile.bodies(rows, pairs.where("operation = 'modified'"), single["modified"])
            if repeated:
                found = found.unionByName(reconcile.bodies_of_each(rows, self.each_df.where("operation = 'modified'"), counts["modified"] - single["modified"]))
            self.patches_df = self._workspace.store("patches", patched(found))
        extra = (0, 0) if several else reconcile.duplicate_counts(self.selected_df).first()
        schema = None
        if self.config.schema_diff:
            self.schema_df = self._workspace.store("schema", profile.changes(profile.from_index(self.index_df)))
            schema = SchemaSummary(**profile.summary(self.schema_df).first().asDict())
        self._summary = Summary(counts["equal"], counts["added"], counts["deleted"], counts["modified"], *extra, schema)

    def _index(self, side: int, path: str) -> tuple[DataFrame, InputError | None]:
        """A side's index, and the first fault of its records, which is told in its turn."""
        rows = text.lines(self._spark, path) if self.config.format == "jsonl" else text.array_elements(self._spark, path)
        try:
            found, errors = index.numbered(self._workspace.store(f"index-{side}", index.run(rows, side, self.config, self.config.format == "json")))
        except Exception as error:
            if any(sign in str(error) for sign in UNREADABLE):
                raise InputError("invalid input (OSError)", SIDES[side]) from error
            raise ResourceError("could not build the temporary index") from error
        if not errors:
            return found, None
        first = found.where("kind = 'error'").agg(F.min(F.struct(F.coalesce("line", F.lit(2**62)).alias("at"), "line", "message")).alias("e")).first()["e"]
        return found, InputError(first["message"], SIDES[side], first["line"])

    def _fail_on_duplicates(self, sides: list[DataFrame]) -> None:
        """Raises the first repetition of an identity, of the first side that has one, if that is an error."""
        if self.config.duplicates is not DuplicatePolicy.ERROR:
            return
        for side, found in enumerate(sides):
            again = reconcile.repeated(found.where("kind = 'record'").select("side", "identity", "line"))
            r = again.agg(F.min(F.struct("again", "first", "identity")).alias("r")).first()["r"]
            if r is not None:
                raw = bytes(r["identity"])
                raise DuplicateKeyError(self._key(raw), raw.decode(), SIDES[side], (r["first"], r["again"]))

    # --- answers ---

    def _need_open(self) -> None:
        if self._state == "closed":
            raise RuntimeError("the diff result is closed")
        if self._state == "new":
            raise RuntimeError("diff() must be used as a context manager")

    @property
    def summary(self) -> Summary:
        if self._summary is None:
            raise RuntimeError("diff() must be used as a context manager")
        return self._summary

    equal = property(lambda self: self.summary.equal)
    added = property(lambda self: self.summary.added)
    deleted = property(lambda self: self.summary.deleted)
    modified = property(lambda self: self.summary.modified)
    old_duplicates = property(lambda self: self.summary.old_duplicates)
    new_duplicates = property(lambda self: self.summary.new_duplicates)
    schema_summary = property(lambda self: self.summary.schema)
    different = property(lambda self: self.summary.different)
    has_duplicates = property(lambda self: self.summary.has_duplicates)
    has_schema_changes = property(lambda self: self.summary.has_schema_changes)
    has_issues = property(lambda self: self.summary.has_issues)

    @staticmethod
    def _key(identity: bytes) -> tuple:
        return tuple(canonical.decode(bytes(identity)))

    def changes_df(self, operation: ChangeOperation | str | None = None) -> DataFrame:
        """Changed identities in the order of their canonical bytes, with their patches if there are any."""
        self._need_open()
        found = self.pairs_df.where("operation <> 'equal'")
        if self.config.field_diff:  # each modified pair has its patch, so nothing has to be joined
            modified = self.patches_df.select(*reconcile.PAIR, F.lit("modified").alias("operation"), "patch")
            found = found.where("operation <> 'modified'").select(*reconcile.PAIR, "operation", F.lit(None).cast(PATCH).alias("patch")).unionByName(modified)
        if operation is not None:
            found = found.where(F.col("operation") == ChangeOperation(operation).value)
        return found.orderBy(*reconcile.PAIR)

    def changes(self, operation: ChangeOperation | str | None = None) -> Iterator[Change]:
        location = lambda side, line: None if line is None else SourceLocation(SIDES[side], line)
        for r in self.changes_df(operation).toLocalIterator():
            self._need_open()
            fields = None
            if self.config.field_diff and r["patch"] is not None:
                value = lambda x: None if x is None else canonical.decode(x.encode())
                fields = tuple(FieldChange(FieldOperation(p["op"]), p["path"], value(p["old"]), value(p["value"])) for p in r["patch"])
            yield Change(ChangeOperation(r["operation"]), self._key(r["identity"]), location(0, r["old_line"]), location(1, r["new_line"]), fields)

    def field_summary_df(self) -> DataFrame:
        self._need_open()
        if not self.config.field_diff:
            raise RuntimeError("field diff was not enabled")
        each = self.patches_df.select(F.explode("patch").alias("p"))
        count = lambda op, name: F.count_if(F.col("p.op") == op).alias(name)
        return each.groupBy(F.col("p.path").alias("path")).agg(count("add", "added"), count("remove", "removed"), count("replace", "replaced")).orderBy("path")

    def field_summary(self) -> Iterator[FieldSummary]:
        self._need_open()
        if self._fields is None:
            self._fields = self._workspace.store("fields", self.field_summary_df()).orderBy("path")
        for r in self._fields.toLocalIterator():
            yield FieldSummary(*r)

    def schema_changes_df(self, operation: SchemaChangeOperation | str | None = None) -> DataFrame:
        self._need_open()
        if not self.config.schema_diff:
            raise RuntimeError("schema diff was not enabled")
        found = self.schema_df
        if operation is not None:
            found = found.where(F.col("operation") == SchemaChangeOperation(operation).value)
        return found.orderBy("path", "nth")

    def schema_changes(self, operation: SchemaChangeOperation | str | None = None) -> Iterator[SchemaChange]:
        one = lambda path, x: None if x is None else SchemaFieldProfile(path, *(x[c] for c in ("parent_objects", *profile.COUNTS)))
        for r in self.schema_changes_df(operation).toLocalIterator():
            self._need_open()
            yield SchemaChange(SchemaChangeOperation(r["operation"]), r["path"], one(r["path"], r["old"]), one(r["path"], r["new"]))

    def duplicates_df(self) -> DataFrame:
        self._need_open()
        if self.config.duplicates not in (DuplicatePolicy.FIRST, DuplicatePolicy.LAST):  # all are selected
            return self._spark.createDataFrame([], "side int, identity binary, selected_line long, discarded_line long, content_equal boolean")
        if self._chosen is None:
            self._chosen = self._workspace.store("chosen", reconcile.chosen(self.selected_df))
        return reconcile.discarded(self.records_df, self._chosen).orderBy("side", "identity", "discarded_line")

    def duplicates(self) -> Iterator[Duplicate]:
        for r in self.duplicates_df().toLocalIterator():
            self._need_open()
            name = SIDES[r["side"]]
            yield Duplicate(self._key(r["identity"]), name, SourceLocation(name, r["selected_line"]), SourceLocation(name, r["discarded_line"]), r["content_equal"])
