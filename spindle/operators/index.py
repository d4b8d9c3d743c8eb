"""One pass over a side's JSON records: filter, identity, content, fingerprint and profile, as rows.

Rows are of four kinds: a record, an error of a line, counts of a path (of its object occurrences, or of a
member's values), and the number of lines of a block of a file. Errors are data: the pass never fails, and the first one is
told once all is read. A line is known by its block and its place there; once all blocks are counted, numbered() gives its
number, so a source is read once, and its text never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import DecimalException

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import canonical, jmespath, pointer
from spindle.model import TYPES, DiffConfig, DuplicatePolicy, MissingKeyPolicy

SCHEMA = (
    "kind string, side int, block long, place long, identity binary, length long, d0 long, d1 long, d2 long, d3 long, content binary, body binary, message string, "
    "path string, parent string, counts array<long>"
)
_ARROW = pa.schema([
    ("kind", pa.string()), ("side", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("identity", pa.binary()), ("length", pa.int64()), *((f"d{k}", pa.int64()) for k in range(4)),
    ("content", pa.binary()), ("body", pa.binary()), ("message", pa.string()), ("path", pa.string()), ("parent", pa.string()), ("counts", pa.list_(pa.int64())),
])
#: Faults of a record's text.
_UNREADABLE = (ValueError, DecimalException, RecursionError)
#: Places in counts: present, nulls, then the types in order.
_AT = {name: k for k, name in enumerate(TYPES, 2)}
WIDTH = 2 + len(TYPES)


#: Content of up to so many bytes is kept as it is where one of several records is selected: what is alike from record to record packs well, and digests do not.
SHORT = 96


class Fault(Exception):
    pass


class Pass:
    """What is done with each record, in this order: object, filter, identity, ignored parts, content, profile."""

    def __init__(self, options: DiffConfig):
        self.options = options
        self.where = options.where_expression
        self.ignored, self.unprofiled = pointer.trie(options.ignore), pointer.trie(options.schema_ignore)

    def identity(self, record: dict) -> list:
        out = []
        for name in self.options.key:
            if name not in record and self.options.missing_key is MissingKeyPolicy.ERROR:
                raise Fault(f"missing identity field {name!r}")
            value = record.get(name)
            if value is None and len(self.options.key) == 1:
                raise Fault(f"identity field {name!r} must be a non-null scalar")
            out.append(value)
        return out

    def record(self, raw: bytes, profile: dict, objects: dict) -> tuple[bytes, bytes] | None:
        """(identity, content), or None for a record that the filter leaves out."""
        try:
            value = canonical.decode(raw)
        except _UNREADABLE as error:
            raise Fault(f"invalid input ({type(error).__name__})") from None
        if not isinstance(value, dict):
            raise Fault("each record must be a JSON object")
        if self.where is not None:
            try:
                if not jmespath.truth(jmespath.search(self.where, value)):
                    return None
            except (TypeError, ValueError, DecimalException) as error:
                raise Fault(str(error)) from None
        key = self.identity(value)
        try:
            content = canonical.canonical(pointer.without(value, self.ignored))
            identity = canonical.canonical(key)
        except pointer.CrossesArray as error:
            raise Fault(str(error)) from None
        except _UNREADABLE as error:
            raise Fault(f"invalid input ({type(error).__name__})") from None
        if self.options.schema_diff:
            self.profile(value, profile, objects)
        return identity, content

    def profile(self, record: dict, fields: dict, objects: dict) -> None:
        """Adds what the record holds: objects by path, members by (path, parent). Arrays are not entered."""
        todo = [("", record, self.unprofiled)]
        seen = []
        while todo:
            path, value, ignored = todo.pop()
            seen.append((path, None, 0))
            for name, x in value.items():
                below = ignored.get(name, {})
                if below is None:
                    continue
                where = pointer.child(path, name)
                kind = canonical.kind_of(x)
                seen.append((where, path, _AT.get(kind, 1)))
                if kind == "object":
                    todo.append((where, x, below))
                elif kind == "array" and below:
                    raise Fault("schema ignore paths may not traverse arrays")
        for where, parent, at in seen:
            if parent is None:
                objects[where] = objects.get(where, 0) + 1
            else:
                counts = fields.setdefault((where, parent), [0] * WIDTH)
                counts[0] += 1
                counts[at] += 1


#: Blocks of files that are told to all tasks at once, at most; beyond that, index rows are shuffled to them.
BROADCAST_BLOCKS = 2_000_000


def run(rows: DataFrame, side: int, options: DiffConfig, array_errors: bool = False) -> DataFrame:
    """Index rows of one side's (block, file, start, m, raw): the lines of a block come one after the other, and m counts them."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Pass(options)
        numbers = options.duplicates not in (DuplicatePolicy.FIRST, DuplicatePolicy.LAST)
        blocks: dict[int, list] = {}  # file, start, m of the first line, number of lines
        for batch in batches:
            out: list[dict] = []
            fields, objects = {}, {}
            held: dict[str, list] = {name: [] for name in ("block", "place", "identity", "length", "digest", "body")}
            for block, file, start, m, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = m  # of an array
                if block is not None:
                    seen = blocks.setdefault(block, [file, start, m, 0])
                    seen[3] += 1
                    place = m - seen[2] + 1
                row = {"kind": "error", "side": side, "block": block, "place": place}
                if array_errors and not m:
                    out.append(row | {"place": None, "message": f"invalid input ({raw.decode()})"})
                    continue
                try:
                    found = one.record(raw, fields, objects)
                except Fault as fault:
                    out.append(row | {"message": str(fault)})
                    continue
                if found is not None:
                    identity, content = found
                    length, digest = canonical.fingerprint(content) if numbers or len(content) > SHORT else (len(content), content)
                    for name, x in zip(held, (block, place, identity, length, digest, content if options.field_diff else None), strict=True):
                        held[name].append(x)
            out += [{"kind": "field", "side": side, "path": p, "parent": q, "counts": n} for (p, q), n in fields.items()]
            out += [{"kind": "object", "side": side, "path": p, "counts": [n]} for p, n in objects.items()]
            if n := len(held["place"]):
                fixed = {"kind": "record", "side": side}
                if numbers:
                    digests = np.frombuffer(b"".join(held.pop("digest")), dtype=">i8").astype(np.int64).reshape(-1, 4)
                    held |= {f"d{k}": digests[:, k] for k in range(4)}  # numbers, so that an aggregate over them can be a hash table
                else:
                    held["content"] = held.pop("digest")
                yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) if f.name in held else pa.repeat(pa.scalar(fixed.get(f.name), f.type), n) for f in _ARROW], schema=_ARROW)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        counted = [{"kind": "block", "side": side, "block": b, "place": n, "path": file, "counts": [start]} for b, (file, start, _, n) in blocks.items()]
        if counted:
            yield pa.RecordBatch.from_pylist(counted, schema=_ARROW)

    return rows.select("block", "file", "start", "m", "raw").mapInArrow(index, SCHEMA)


def numbered(index: DataFrame) -> tuple[DataFrame, int]:
    """(index rows with `line` instead of block and place, how many of them are errors): lines are counted through all files in the order of their names."""
    blocks = index.where("kind = 'block'").select("block", "path", F.col("counts")[0].alias("start"), F.col("place").alias("n"))
    # One row for each block of each file: a sum over all of them in one task is small.
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n, different, errors = index.agg(F.count_if(F.col("kind") == "block"), F.count_distinct(F.when(F.col("kind") == "block", F.col("block"))), F.count_if(F.col("kind") == "error")).first()
    if n != different:
        raise ValueError("two blocks have one number")
    told = F.broadcast(offsets) if n <= BROADCAST_BLOCKS else offsets
    rest = [c for c in index.columns if c not in ("block", "place")]
    return index.where("kind <> 'block'").join(told, "block", "left").select((F.col("place") + F.coalesce("before", F.lit(0))).alias("line"), *rest), errors
