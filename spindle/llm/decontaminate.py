"""Benchmark decontamination.

Method: a prefix-filtered set join. Benchmark items are cut into item-sized windows: `window` words in a row, or the
whole item if it has fewer. Windows and documents have shingles of `shingle` words (or of a window's own
length, if that is less). Shingles of the benchmark are ordered by rarity, as counted over all documents.
A window that occurs must show all its shingles, so the necessary prefix of its ordered shingles is the
rarest one; documents are joined on these alone. Where one is found, its place in the window says where
the window would have to start (positional bound) and end (length bound), and the words there are compared
with the window's, exactly.

Only DataFrame functions are used. Defined results: a null or empty text has no words and is clean; an item without
words has no window; equal items are all named; repeated documents each give a row, as do null ids; an
empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW, SHINGLE = 13, 4
#: A benchmark of more different shingles or windows than this is joined by shuffling instead of broadcasting.
BROADCAST_ROWS = 500_000
#: What separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def shingles_of(hashes: Column, k: int) -> Column:
    """Hashes of k words in a row, by place, from an attribute that holds the words' hashes."""
    n = F.size(hashes) - k
    if k == 1:
        return F.transform(hashes, lambda h: F.xxhash64(h))
    return F.transform(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*(hashes[i + j] for j in range(k))))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows: words, k, at, h for each place of a shingle; owners: words, item): k is the shingle's size, item the id of an item that has the window."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))).alias("words"))
    owners = cut.distinct()
    different = cut.select("words", F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct()
    parts = None
    for k in range(1, shingle + 1):
        part = different.where(F.col("k") == k).select("words", "k", hashes_of(F.col("words")).alias("hashes"))
        part = part.select("words", "k", F.posexplode(shingles_of(F.col("hashes"), k)).alias("at", "h"))
        parts = part if parts is None else parts.unionAll(part)
    return parts, owners


def hits(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all: id, th, n_words of each document; found: id, th, start, end, words of each occurrence of a window; named: id, th, item of each item that occurs)."""
    windows, owners = windows_of(items, item_id, item_text, window, shingle)
    windows, owners = stored(windows), stored(owners)
    wanted = stored(windows.select("k", "h").distinct())
    few = windows.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    sizes = sorted(r[0] for r in wanted.select("k").distinct().collect())  # at most `shingle` numbers

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words_of(F.col(text_col)).alias("words"))
    tokens = rows.select("id", "th", "words", F.size("words").alias("n_words"), hashes_of(F.col("words")).alias("hashes"))
    # One null for the document itself, then its shingles of each size. The outer explode keeps Spark from adding a filter
    # on the size of the array, for which it would work out the array a second time, and its hashes for each place.
    all_of = F.concat(F.array(F.lit(None).cast("long")), *(shingles_of(F.col("hashes"), k) for k in sizes))
    each = tokens.select("id", "th", "n_words", *(["words"] if few else []), all_of.alias("all"))
    each = each.select("id", "th", "n_words", *(["words"] if few else []), F.posexplode_outer("all").alias("nth", "h"))
    k_of, pos, before = F.lit(0), F.lit(-1), F.lit(1)
    for k in sizes:
        k_of, pos = F.when(F.col("nth") >= before, k).otherwise(k_of), F.when(F.col("nth") >= before, F.col("nth") - before).otherwise(pos)
        before = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    wanted = wanted.select(F.col("k").alias("k2"), F.col("h").alias("h2"))
    joined = each.join(small(wanted), F.col("h") == F.col("h2"), "left")
    joined = joined.where((F.col("nth") == 0) | F.col("h2").isNotNull()).withColumn("k", k_of).withColumn("pos", pos).where((F.col("k") == 0) | (F.col("k") == F.col("k2")))
    if not few:  # exploded rows must not carry their text through a shuffle: the few that hit fetch it
        again = rows.select(F.col("id").alias("i2"), F.col("th").alias("t2"), "words").dropDuplicates(["i2", "t2"])
        joined = joined.join(again, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2")), "left")
    around = F.when(F.col("nth") > 0, F.slice("words", F.greatest(F.col("pos") - window + 2, F.lit(1)), F.lit(2 * window)))
    seen = stored(joined.select("id", "th", "n_words", "k", "pos", "h", around.alias("around")))

    counts = seen.where("k > 0").groupBy("k", "h").agg(F.count("*").alias("n"))
    rare = windows.join(small(counts), ["k", "h"], "left").groupBy("words", "k")
    rare = rare.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("m")).where("m.n > 0")
    prefix = rare.select("k", F.col("m.h").alias("h"), F.col("m.at").alias("at"), "words")
    start = F.col("pos") - F.col("at")
    offset = start - F.greatest(F.col("pos") - window + 1, F.lit(0))
    length = F.size("words")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    checked = seen.where("k > 0").join(small(prefix), ["k", "h"]).where(fits)
    checked = checked.where(F.slice("around", F.greatest(offset, F.lit(0)) + 1, length) == F.col("words"))
    found = stored(checked.select("id", "th", start.alias("start"), (start + length).alias("end"), "words").distinct())
    # One window may be in very many items: these meet each document and window once, and by broadcast only if they are few themselves.
    beside = F.broadcast if owners.count() <= BROADCAST_ROWS else (lambda df: df)
    named = found.select("id", "th", "words").distinct().join(beside(owners), "words").select("id", "th", "item")
    return seen.where("k = 0").select("id", "th", "n_words"), found, named


def covered(intervals: Column) -> Column:
    """How many places the sorted intervals (start, end) cover."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(x["end"], a["upto"]).alias("upto"))
    return F.aggregate(intervals, first, step, lambda a: a["n"])


def contamination(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, shingle: int = SHINGLE, least_share: int = 20) -> DataFrame:
    """Of each document: id, th (hash of its text), n_words, n_hit, items (sorted ids), contaminated (a least_share-th of its words or more is hit)."""
    everything, found, named = hits(docs, id_col, text_col, items, item_id, item_text, window, shingle)
    parts = found.select("id", "th", F.struct("start", "end").alias("span")).unionByName(named.distinct(), allowMissingColumns=True)
    one = parts.groupBy("id", "th").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    one = one.select(F.col("id").alias("i2"), F.col("th").alias("t2"), covered(F.col("spans")).cast("long").alias("hit"), "items")
    both = everything.join(one, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2")), "left")
    n_hit, n_words = F.coalesce("hit", F.lit(0)).cast("long"), F.col("n_words").cast("long")
    return both.select(
        "id", "th", n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * least_share >= n_words)).alias("contaminated"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contamination(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return done.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP8_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS words FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, place.k, item_id FROM place JOIN win ON place.k = win.k AND place.words = win.words),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""
