"""Reconciliation of two sides of records (side, identity, line, length, d0 to d3, ...), as aggregates and joins.

A record's content is known by its length and its digest, which is four numbers; where one of several records of an identity is
selected, by its length and its bytes, which are a digest only if it is long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.model import DuplicatePolicy


#: What tells contents apart.
CONTENT = ("length", "d0", "d1", "d2", "d3")
#: The same where first or last are selected.
SELECTED = ("length", "content")


#: Bits of a sieve, at most, which are 32 MB; of more identities than a sixteenth of them, it lets more rows pass.
SIEVE_BITS = 1 << 28
#: Bits of a word of a sieve, words of a row of it, and the logarithms of both.
_WORD, _WORDS, _LOG_WORD, _LOG_WORDS = 64, 512, 6, 9


def sieved(rows: DataFrame, identities: DataFrame, n: int) -> DataFrame:
    """Of rows, those that may have one of n identities: all that do, and few others, to be joined next.

    A bit of each identity's hash is told to all tasks, so the join shuffles no row that it would only drop, however many rows and identities there are.
    """
    bits = 1 << min(max(16 * n, _WORD * _WORDS).bit_length(), SIEVE_BITS.bit_length() - 1)
    bit = F.xxhash64("identity").bitwiseAND(F.lit(bits - 1))
    at = lambda x: x.bitwiseAND(F.lit(_WORD - 1)).cast("int")
    marks = identities.select(F.shiftright(bit, _LOG_WORD).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at(bit)).alias("bits"))
    empty = rows.sparkSession.range(bits // _WORD).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))  # so that no row lacks a word
    words = marks.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    told = words.groupBy(F.shiftright("word", _LOG_WORDS).alias("sieve")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")).select("sieve", F.col("words.bits").alias("words"))
    word = F.col("words")[F.shiftright(bit, _LOG_WORD).bitwiseAND(F.lit(_WORDS - 1)).cast("int")]
    kept = F.call_function("shiftright", word, at(bit)).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(told), (F.shiftright(bit, _LOG_WORD + _LOG_WORDS) == F.col("sieve")) & kept, "left_semi")


def repeated(records: DataFrame) -> DataFrame:
    """(side, identity, first, again): the two first lines of each identity on more than one line."""
    first = records.groupBy("side", "identity").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
    both = records.join(first, ["side", "identity"]).where("line > first")
    return both.groupBy("side", "identity").agg(F.min("first").alias("first"), F.min("line").alias("again"))


def selected(records: DataFrame, policy: DuplicatePolicy) -> DataFrame:
    """(identity, operation, old_line, new_line, old_n, new_n, old, new) of each identity, by its first or last line of each side.

    Minima in one aggregate, not windows: no identity's records are gathered, and both sides meet in the same shuffle. `old` and `new` are (line, length, content)
    of what was selected of several records.
    """
    pick = F.max if policy is DuplicatePolicy.LAST else F.min
    of = lambda n: (pick(F.when(F.col("side") == n, F.struct("line", *SELECTED))), F.count_if(F.col("side") == n))
    (old, old_n), (new, new_n) = of(0), of(1)
    found = records.groupBy("identity").agg(old.alias("old"), new.alias("new"), old_n.alias("old_n"), new_n.alias("new_n"))
    same = reduce(lambda a, b: a & b, (F.col(f"old.{c}") == F.col(f"new.{c}") for c in SELECTED))
    operation = F.when(F.col("old_n") == 0, "added").when(F.col("new_n") == 0, "deleted").when(same, "equal").otherwise("modified")
    several = (F.when(F.col(f"{x}_n") > 1, F.col(x)).alias(x) for x in ("old", "new"))
    return found.select("identity", operation.alias("operation"), F.col("old.line").alias("old_line"), F.col("new.line").alias("new_line"), "old_n", "new_n", *several)


def chosen(selected: DataFrame) -> DataFrame:
    """(side, identity, c) of each identity of several records: the line and the content of the selected one."""
    of = lambda n, name: selected.where(F.col(f"{name}_n") > 1).select(F.lit(n).alias("side"), "identity", F.col(name).alias("c"))
    return of(0, "old").unionByName(of(1, "new"))


def discarded(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """(side, identity, selected_line, discarded_line, content_equal) of each record that was not selected.

    If what was chosen is a written table, Spark can split the join where one identity has many records, and broadcast it where few repeat.
    """
    joined = records.join(chosen, ["side", "identity"]).where(F.col("line") != F.col("c.line"))
    same = F.struct(*SELECTED) == F.struct(*(F.col(f"c.{x}") for x in SELECTED))
    return joined.select("side", "identity", F.col("c.line").alias("selected_line"), F.col("line").alias("discarded_line"), same.alias("content_equal"))


def paired(records: DataFrame) -> DataFrame:
    """(identity, operation, old_line, new_line, old_n, new_n) of each identity: both sides meet in one hash aggregate.

    The bits in which the contents of a pair differ tell whether they do. Where a side has an identity more than once, it has no operation, and n says so.
    """
    old = F.col("side") == 0
    found = records.groupBy("identity").agg(
        F.min(F.when(old, F.col("line"))).alias("old_line"), F.min(F.when(~old, F.col("line"))).alias("new_line"), F.count_if(old).alias("old_n"), F.count_if(~old).alias("new_n"),
        *(F.bit_xor(c).alias(c) for c in CONTENT),
    )
    same = reduce(lambda a, b: a & b, (F.col(c) == 0 for c in CONTENT))
    several = (F.col("old_n") > 1) | (F.col("new_n") > 1)
    operation = F.when(several, F.lit(None).cast("string")).when(F.col("old_n") == 0, "added").when(F.col("new_n") == 0, "deleted").when(same, "equal").otherwise("modified")
    return found.select("identity", operation.alias("operation"), "old_line", "new_line", "old_n", "new_n")


def every_pair(records: DataFrame, identities: DataFrame, n: int) -> DataFrame:
    """(identity, operation, old_line, new_line) of each pair of records of these n identities, as in SQL's full join."""
    rows = sieved(records, identities, n).join(identities, "identity", "left_semi")
    side = lambda n, name: rows.where(F.col("side") == n).select("identity", F.col("line").alias(f"{name}_line"), F.struct(*CONTENT).alias(name))
    found = side(0, "old").join(side(1, "new"), "identity", "full_outer")
    operation = F.when(F.col("old_line").isNull(), "added").when(F.col("new_line").isNull(), "deleted").when(F.col("old") == F.col("new"), "equal").otherwise("modified")
    return found.select("identity", operation.alias("operation"), "old_line", "new_line")


#: What a pair is known by.
PAIR = ("identity", "old_line", "new_line")


def bodies_of_each(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """As bodies(), where an identity has several pairs: each asks for its two lines, so that it meets no others of its identity."""
    asked = pairs.select(*PAIR, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("old_line").alias("line")), F.struct(F.lit(1).alias("side"), F.col("new_line").alias("line")))).alias("w")).select(*PAIR, "w.*")
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("body")))
    return sieved(rows, pairs, n).join(asked, ["identity", "side", "line"]).groupBy(*PAIR).agg(of(0).alias("old_body"), of(1).alias("new_body"))


def bodies(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(identity, old_line, new_line, old_body, new_body) of n pairs, from rows (side, identity, line, body): one join, and a sum where it put the rows."""
    wanted = pairs.select("identity", "old_line", "new_line")
    found = sieved(rows, wanted, n).join(wanted, "identity").where(F.col("line") == F.when(F.col("side") == 0, F.col("old_line")).otherwise(F.col("new_line")))
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("body")))
    return found.groupBy(*PAIR).agg(of(0).alias("old_body"), of(1).alias("new_body"))


def totals(pairs: DataFrame) -> DataFrame:
    """(equal, added, deleted, modified) in one row."""
    return pairs.agg(*(F.count_if(F.col("operation") == name).alias(name) for name in ("equal", "added", "deleted", "modified")))


def duplicate_counts(selected: DataFrame) -> DataFrame:
    """(old, new): records beyond the first of each identity, of each side."""
    return selected.agg(*(F.coalesce(F.sum(F.greatest(F.col(f"{x}_n") - 1, F.lit(0))), F.lit(0)).alias(x) for x in ("old", "new")))
