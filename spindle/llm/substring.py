"""Exact substring dedup over windows of words.

A word goes if a window of `length` words covers it whose words also occur in an earlier place: in a document of
smaller id, or earlier in the same document. Windows are judged on the input.

Method: seed and extend. Every window has one winnowed anchor, the least hash of its runs of SEED words (the
last of equals), so equal windows have equal anchors at equal places, and an anchor occurs about once in
eight words. Anchors that occur once are dropped by a join on their counts. Each remaining seed is extended
both ways to the whole stretch of windows that it anchors. Stretches are joined on the hash of their words:
all but the first of equal ones repeat in full. A first stretch whose seed also anchors different stretches
may still share some windows with them, so its windows are compared one by one, by 128 bits of hash.
Windows that repeat are merged into maximal repeats, whose words go.

No group is gathered: the first of equals is a minimum, taken by partial aggregates and joined back. What is
shuffled is 32 bytes for an anchor and the texts, in steps that are written to the shared folder.

Defined results: a null text has no words; a null id sorts before all ids; documents of one id count as at one
place, so they do not repeat each other; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, _powers, as_bytes, discard, mix, signed, small, stored, table

LENGTH, SEED = 20, 5
_FIRST = -(1 << 63)


def _sliding_last_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of h[i : i + width], the last of equals, for each i that has so many."""
    at = np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] <= h[left], right, left)
        have += step
    return at


def stretches(words: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: (seed hash, stretch hash, text, first window, number of windows)."""
    n = len(words) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    grams, _ = words.grams(seed)
    anchor = _sliding_last_least(grams[: len(words) - seed + 1], length - seed + 1)[:n]
    inside = np.flatnonzero(words.doc[:n] == words.doc[length - 1 :])
    if not len(inside):
        return words.hash[:0], words.hash[:0], inside, inside, inside
    a = anchor[inside]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    start = inside[new]
    count = np.diff(np.append(new, len(inside)))
    at = a[new]
    return grams[at], range_hash(words.hash, start, start + count + length - 1, at - start), words.doc[start], start, count


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """64 bits of the values h[start:end], in order, and salt."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h) * up[: len(h)], out=total[1:])
    return mix(mix((total[end] - total[start]) * down[start]) + (end - start).astype(np.uint64) * np.uint64(64) + np.asarray(salt).astype(np.uint64))


def packed(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) * 64 + count


def place(id_col: str) -> Column:
    """What documents are ordered by."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))


def repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(place, th, spans array<struct<start,end>>): the words that go from each document that has any, in stretches that may overlap."""
    if length - seed + 1 > 63:
        raise ValueError("a stretch holds at most 63 windows")
    texts = docs.where(F.col(text_col).isNotNull()).select(place(id_col).alias("place"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            w = Words(as_bytes(batch.column(2)))
            s, e, doc, start, count = stretches(w, length, seed)
            # Of equal stretches in one text, the later ones repeat whatever others hold.
            order = np.lexsort((start, e, s, doc))
            again = np.zeros(len(s), dtype=bool)
            a, b = order[1:], order[:-1]
            again[a] = (doc[a] == doc[b]) & (s[a] == s[b]) & (e[a] == e[b])
            where = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(s)), pa.array(signed(e)), pa.array(where[0][doc]), pa.array(where[1][doc]), pa.array(packed(start - w.first[doc], count)), pa.array(again)],
                names=["s", "e", "place", "th", "at", "again"],
            )

    anchors = stored(texts.mapInArrow(seeds, "s long, e long, place long, th long, at long, again boolean"))
    # Sums are stored before they are joined, so that Spark can split the rows of a hot seed, stretch or window.
    often = stored(anchors.where("not again").groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s"))
    seeds_again = stored(anchors.where("not again").join(often, "s").select("s", "e", "place", "th", "at"))
    groups = stored(seeds_again.groupBy("s", "e").agg(F.min("place").alias("least")))
    judged = stored(seeds_again.join(groups, ["s", "e"]))
    discard(often, seeds_again, groups)
    window_end = lambda at: F.shiftrightunsigned(at, 6) + at.bitwiseAND(63) + (length - 1)
    as_span = lambda df: df.select("place", "th", F.shiftrightunsigned("at", 6).alias("start"), window_end(F.col("at")).alias("end"))
    spans = as_span(anchors.where("again")).unionAll(as_span(judged.where("place > least")))

    # First stretches whose seed also has other stretches: window by window.
    firsts = judged.where("place = least")
    several = stored(judged.groupBy("s").agg(F.min("e").alias("a"), F.max("e").alias("b")).where("a < b").select("s"))
    asked = firsts.join(several, "s").select("place", "th", "at").distinct()
    asked = asked.groupBy("place", "th").agg(F.collect_list("at").alias("at"))  # of one document
    asked = asked.join(texts, ["place", "th"]).select("place", "th", "text", "at")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            w = Words(as_bytes(batch.column(2)))
            at = batch.column(3)
            which = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(at.offsets)))
            flat = np.asarray(at.flatten())
            first, count = flat >> 6, flat & 63
            which = np.repeat(which, count)
            start = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            k = start + w.first[which]
            a, b = range_hash(w.hash, k, k + length, 1), range_hash(mix(w.hash + np.uint64(1)), k, k + length, 2)
            order = np.lexsort((start, b, a, which))
            again = np.zeros(len(a), dtype=bool)
            p, q = order[1:], order[:-1]
            again[p] = (which[p] == which[q]) & (a[p] == a[q]) & (b[p] == b[q])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(a)), pa.array(signed(b)), batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(start), pa.array(again)],
                names=["a", "b", "place", "th", "start", "again"],
            )

    single = stored(asked.mapInArrow(windows, "a long, b long, place long, th long, start long, again boolean"))
    least = stored(single.groupBy("a", "b").agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1").select("a", "b", "least"))
    later = single.join(least, ["a", "b"]).where("again or place > least").select("place", "th", "start", (F.col("start") + length).alias("end"))
    spans = spans.unionAll(later)
    found = stored(spans.groupBy("place", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))
    discard(anchors, judged, several, single, least)
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def dedup(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(id_col, n_words, removed: maximal stretches of words that went, kept: the other words joined by one space)."""
    found = repeats(docs, id_col, text_col, length)
    rows = docs.select(F.col(id_col), place(id_col).alias("_place"), F.xxhash64(text_col).alias("_th"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    joined = rows.join(found, (F.col("_place") == F.col("place")) & (F.col("_th") == F.col("th")), "left").select(id_col, "_text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            total, gone, kept = [], [], []
            for raw, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = raw.split()
                merged: list[list[int]] = []
                for s in spans or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                at, rest = 0, []
                for a, b in merged:
                    rest += words[at:a]
                    at = b
                total.append(len(words))
                gone.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b" ".join(rest + words[at:] if merged else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[id_col, "n_words", "removed", "kept"],
            )

    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("removed", SPANS), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(cut, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"), "doc_id", "text")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH doc AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w0 FROM documents),
d AS (SELECT doc_id, list_filter(w0, lambda x: x <> '') AS w FROM doc),
place AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS words FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS k FROM place) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lists.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
