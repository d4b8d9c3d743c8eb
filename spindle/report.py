"""Reports of a result: lines of JSON for machines, and a summary for people."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import canonical
from spindle.functions.canonical import encode
from spindle.model import SIDES, SchemaFieldProfile
from spindle.operators.reconcile import PAIR
from spindle.result import DiffResult


def _profile(p: SchemaFieldProfile) -> dict:
    return {"parent_objects": p.parent_objects, "present": p.present, "missing": p.missing, "nulls": p.nulls, "types": p.type_counts}


def meta(result: DiffResult) -> dict:
    o = result.config
    out: dict[str, Any] = {"type": "meta", "key": list(o.key), "ignore": list(o.ignore), "where": o.where, "duplicates": o.duplicates.value, "missing_key": o.missing_key.value}
    if o.schema_diff:
        out |= {"schema_diff": True, "schema_ignore": list(o.schema_ignore)}
    if o.field_diff:
        out["field_diff"] = True
    return out


def total(result: DiffResult) -> dict:
    s = result.summary
    out: dict[str, Any] = {"type": "summary"} | {name: getattr(s, name) for name in ("equal", "added", "deleted", "modified", "old_duplicates", "new_duplicates")}
    if s.schema is not None:
        out["schema"] = vars(s.schema)
    return out


@F.pandas_udf(T.StringType())
def _quoted(names: pd.Series) -> pd.Series:
    return names.map(canonical.quoted)


def _object(*members: tuple[str, Column | str | None], optional: tuple[str, ...] = ()) -> Column:
    """JSON text of an object from the JSON texts of its members, given in the order of their names; of those that are optional, only what is not null."""
    parts = []
    for name, text in members:
        member = F.concat(F.lit(f'"{name}":'), F.lit(text) if isinstance(text, str) else text.cast("string"))
        parts.append(member if name in optional else F.coalesce(member, F.lit(f'"{name}":null')))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _changes(result: DiffResult) -> DataFrame:
    """Identities and values are canonical JSON already, so events are put together where the rows are."""
    found = result.changes_df()
    key, operation = F.col("identity").cast("string"), F.concat(F.lit('"'), F.col("operation"), F.lit('"'))
    patch = F.lit(None).cast("string")
    if result.config.field_diff:
        each = result.patches_df.select(*PAIR, F.posexplode("patch").alias("nth", "p")).select(*PAIR, "nth", "p", _quoted("p.path").alias("path"))
        item = _object(("old", F.col("p.old")), ("op", F.concat(F.lit('"'), F.col("p.op"), F.lit('"'))), ("path", F.col("path")), ("value", F.col("p.value")), optional=("old", "value"))
        texts = each.groupBy(*PAIR).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", item.alias("t")))), lambda x: x["t"]), ",").alias("items"))
        found = found.drop("patch").join(texts, [*PAIR], "left")
        # A patch can be empty only where there is none: a modified record differs somewhere.
        patch = F.when(F.col("operation") == "modified", F.concat(F.lit("["), F.coalesce("items", F.lit("")), F.lit("]")))
    event = _object(("key", key), ("new_line", F.col("new_line")), ("old_line", F.col("old_line")), ("op", operation), ("patch", patch), ("type", '"change"'), optional=("new_line", "old_line", "patch"))
    return found.orderBy(*PAIR).select(event.alias("line"))


def _duplicates(result: DiffResult) -> DataFrame:
    source = F.when(F.col("side") == 0, f'"{SIDES[0]}"').otherwise(f'"{SIDES[1]}"')
    event = _object(
        ("content_equal", F.col("content_equal")), ("discarded_line", F.col("discarded_line")), ("key", F.col("identity").cast("string")), ("selected_line", F.col("selected_line")), ("source", source), ("type", '"duplicate"'),
    )
    return result.duplicates_df().select(event.alias("line"))


def _fields(result: DiffResult) -> DataFrame:
    found = result.field_summary_df().withColumn("quoted", _quoted("path"))
    event = _object(("added", F.col("added")), ("path", F.col("quoted")), ("removed", F.col("removed")), ("replaced", F.col("replaced")), ("type", '"field_summary"'))
    return found.orderBy("path").select(event.alias("line"))


def sections(result: DiffResult) -> Iterator[DataFrame | list[str]]:
    """The report in order: meta, schema changes, duplicates, changes, field summaries, summary. What grows with the records is a DataFrame of lines."""
    yield [encode(meta(result))]
    if result.config.schema_diff:
        lines = []
        for c in result.schema_changes():
            sides = {name: _profile(p) for name, p in (("old", c.old), ("new", c.new)) if p is not None}
            lines.append(encode({"type": "schema_change", "op": c.operation.value, "path": c.path} | sides))
        yield lines
    if result.summary.has_duplicates:
        yield _duplicates(result)
    if result.summary.different:
        yield _changes(result)
    if result.config.field_diff and result.summary.modified:
        yield _fields(result)
    yield [encode(total(result))]


def lines_df(result: DiffResult, spark) -> DataFrame:
    """All lines of the report as one DataFrame, in no order."""
    out = None
    for part in sections(result):
        df = part if isinstance(part, DataFrame) else spark.createDataFrame([(x,) for x in part], "line string")
        out = df if out is None else out.unionByName(df)
    return out


def write_details(result: DiffResult, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        for part in sections(result):
            for line in (r["line"] for r in part.toLocalIterator(prefetchPartitions=True)) if isinstance(part, DataFrame) else part:
                out.write(line + "\n")


#: Fixed wording of the summary, by the name of the number.
LINES = (("  equal:     ", "equal"), ("  added:     ", "added"), ("  deleted:   ", "deleted"), ("  modified:  ", "modified"), ("  OLD duplicates:  ", "old_duplicates"), ("  NEW duplicates:  ", "new_duplicates"))
SCHEMA_LINES = (
    ("  fields added:          ", "fields_added"), ("  fields removed:        ", "fields_removed"), ("  type changes:          ", "types_changed"),
    ("  nullability changes:   ", "nullability_changed"), ("  requiredness changes:  ", "requiredness_changed"),
)


def summary_text(result: DiffResult) -> str:
    s = result.summary
    lines = ["Records:", *(f"{label}{getattr(s, name):,}" for label, name in LINES)]
    if s.schema is not None:
        lines += ["", "Observed schema:", *(f"{label}{getattr(s.schema, name):,}" for label, name in SCHEMA_LINES)]
    return "\n".join(lines) + "\n"
