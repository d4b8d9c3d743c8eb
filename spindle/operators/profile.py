"""Observed schemas: counts of each path's values, and what differs between two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.model import TYPES

COUNTS = ("present", "nulls", "booleans", "integers", "numbers", "strings", "objects", "arrays")


def profiles(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """(side, path, parent_objects, counts...) from partial counts: fields (side, path, parent, COUNTS...) and objects (side, path, n)."""
    total = fields.groupBy("side", "path", "parent").agg(*(F.sum(c).alias(c) for c in COUNTS))
    parents = objects.groupBy("side", F.col("path").alias("parent")).agg(F.sum("n").alias("parent_objects"))
    return total.join(parents, ["side", "parent"]).select("side", "path", "parent_objects", *COUNTS)


def from_index(index: DataFrame) -> DataFrame:
    """Profiles from the index rows of the text lane."""
    fields = index.where("kind = 'field'").select("side", "path", "parent", *(F.col("counts")[k].alias(c) for k, c in enumerate(COUNTS)))
    return profiles(fields, index.where("kind = 'object'").select("side", "path", F.col("counts")[0].alias("n")))


def type_set():
    """Names of the types that occur, in their order."""
    present = F.array(*(F.when(F.col(c) > 0, F.lit(name)) for c, name in zip(COUNTS[2:], TYPES, strict=True)))
    return F.filter(present, lambda x: x.isNotNull())


#: Changes of one path, in the order in which they are told.
OPERATIONS = ("field_removed", "field_added", "types_changed", "nullability_changed", "requiredness_changed")


def changes(profile: DataFrame) -> DataFrame:
    """(path, nth, operation, old, new): old and new are structs of a side's counts, null where the side lacks the path."""
    shaped = profile.withColumn("types", type_set())
    side = lambda n, name: shaped.where(F.col("side") == n).select("path", F.struct("parent_objects", *COUNTS, "types").alias(name))
    both = side(0, "old").join(side(1, "new"), "path", "full_outer")
    o, n = F.col("old"), F.col("new")
    here = o.isNotNull() & n.isNotNull()
    tests = (
        n.isNull(), o.isNull(), here & (o["types"] != n["types"]), here & ((o["nulls"] > 0) != (n["nulls"] > 0)),
        here & ((o["parent_objects"] == o["present"]) != (n["parent_objects"] == n["present"])),
    )
    found = F.filter(F.array(*(F.when(t, F.struct(F.lit(k).alias("nth"), F.lit(name).alias("operation"))) for k, (t, name) in enumerate(zip(tests, OPERATIONS, strict=True)))), lambda x: x.isNotNull())
    return both.select("path", "old", "new", F.explode(found).alias("c")).select("path", "c.nth", "c.operation", "old", "new")


def summary(found: DataFrame) -> DataFrame:
    """Changes by operation, in one row."""
    names = {"fields_added": "field_added", "fields_removed": "field_removed"} | {x: x for x in OPERATIONS[2:]}
    return found.agg(*(F.count_if(F.col("operation") == op).alias(name) for name, op in names.items()))
