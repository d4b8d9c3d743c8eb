"""Near-duplicate documents by weighted MinHash.

Method: BagMinHash. A document is the multiset of its runs of five words. Each shingle's weight axis is
divided into intervals (0, 1], (1, 2], (2, 4], (4, 8] and so on; each interval carries a Poisson process of its
width as rate, whose points come in rising order and fall on a random register and a random place of the
interval. A document takes the points below its weight; a register keeps its least point. Registers of two
documents agree with the probability of their weighted Jaccard similarity. Points are only drawn until
they pass the document's largest register, which for most shingles is after the first.

Registers are banded; documents that share a band are candidates, and the similarity of candidates is taken
exactly, from their texts. Documents with equal multisets form one class, whose least document stands
for it. In each band's bucket all are compared with one leader, never all with all. Those that then are not
connected with the leader may still be linked with others of the bucket; but one less similarity is a metric,
so only with those whose similarity to the leader is as great, give or take 0.2, and sketches of how each
differs from the leader bound how alike two can be. This judging is quadratic in the members of a bucket that are apart from
its leader, so it is dealt out by pairs of blocks. Pairs that pass both bounds are compared one by one, so no
link between candidates is lost. Classes are the components of the links.

Words are as everywhere here, A-Z lower-cased. Defined results: a text of one to four words is one shingle; a null
text or one without words is alone; null ids sort after all ids, so a class that has an id is named by one, and a class of null
ids alone has a null name; a document is an id with a text, so texts of one id, or of null ids, are judged each on its
own, and one of each class is kept; repeated rows, of one id and text, each give a row, all alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, components, discard, mix, small, stored, table
from .substring import range_hash

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8, 24 bands of 4 registers miss one pair in 300,000.
BANDS, ROWS = 24, 4
#: Rows on either side of a block of pairs that are judged in one task; and how many buckets may be told to be larger by broadcast.
BLOCK, BROADCAST_ROWS = 1024, 500_000
_HASH = np.uint64((1 << 44) - 1)
_LAST = (1 << 63) - 1


def place(id_col: str) -> Column:
    """What documents are ordered by."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def shingles(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each different shingle of each text, in that order. Shingles are 44-bit hashes."""
    w = Words(texts, lower=True)
    h, inside = w.grams(k)
    doc, h = w.doc[inside], h[inside]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.concatenate([h, range_hash(w.hash, w.first[short], w.first[short + 1], 3)])
        doc = np.concatenate([doc, short])
    key = (doc.astype(np.uint64) << np.uint64(44)) | (h & _HASH)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return (key[new] >> np.uint64(44)).astype(np.int64), key[new] & _HASH, np.diff(np.append(new, len(key)))


def bagminhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers of each document, docs x m; inf throughout for one without shingles."""
    sig = np.full(docs * m, np.inf)
    # Intervals of the weight axis that each shingle reaches into: 0 is (0, 1], i is (2^(i-1), 2^i].
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    own = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 1, 2.0 ** (level - 1), 1.0)
    share = np.minimum((count[own] - low) / rate, 1.0)
    seed = mix(shingle[own] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    doc, x, t = doc[own], np.zeros(len(own)), 0
    while len(doc):
        t += 1
        r = mix(seed + np.uint64(t * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        r = mix(r)
        at = doc * m + (r % np.uint64(m)).astype(np.int64)
        ok = (r >> np.uint64(40)).astype(np.float64) * 2.0**-24 < share
        np.minimum.at(sig, at[ok], x[ok])
        going = x < sig.reshape(docs, m).max(1)[doc]
        doc, x, seed, rate, share = doc[going], x[going], seed[going], rate[going], share[going]
    return sig.reshape(docs, m)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number for each band."""
    raw = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3), raw.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + raw[:, :, k])
    return h


def counts_of(a: list[bytes], b: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(pair, shingle, count in a[pair], count in b[pair]) of each different shingle of each pair."""
    n = len(a)
    doc, h, count = shingles([*a, *b], k)
    pair, side = doc % n, doc >= n
    order = np.lexsort((h, pair))
    pair, h, side, count = pair[order], h[order], side[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (h[1:] != h[:-1])])) if len(pair) else np.zeros(0, dtype=np.int64)
    if not len(new):
        return pair, h, count, count
    return pair[new], h[new], np.add.reduceat(np.where(side, 0, count), new), np.add.reduceat(np.where(side, count, 0), new)


def similarities(a: list[bytes], b: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle multisets of a[i] and b[i]."""
    pair, _, x, y = counts_of(a, b, k)
    return np.bincount(pair, np.minimum(x, y), minlength=len(a)) / np.maximum(np.bincount(pair, np.maximum(x, y), minlength=len(a)), 1)


#: 64-bit words of a sketch of a difference.
BITS = 16


def differences(a: list[bytes], b: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, sketches): a sketch has a set bit for each shingle that b[i] holds more often than a[i], then a clear one for each that it holds less often."""
    pair, h, x, y = counts_of(a, b, k)
    s = np.bincount(pair, np.minimum(x, y), minlength=len(a)) / np.maximum(np.bincount(pair, np.maximum(x, y), minlength=len(a)), 1)
    bits = np.zeros((len(a), 2 * BITS), dtype=np.uint64)
    for at, which in ((0, y > x), (BITS, y < x)):
        slot = h[which] % np.uint64(64 * BITS)
        np.bitwise_or.at(bits, (pair[which], at + (slot // np.uint64(64)).astype(np.int64)), np.uint64(1) << (slot % np.uint64(64)))
    bits[:, BITS:] = ~bits[:, BITS:]
    return s, bits


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(place, th, a, b, n, bands) of each document with words: th is of its text, a and b are 128 bits of its multiset, n is its size."""
    texts = docs.where(F.col(text_col).isNotNull()).select(place(id_col).alias("place"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            doc, h, count = shingles(as_bytes(batch.column(2)))
            n = batch.num_rows
            has = np.bincount(doc, minlength=n) > 0
            keys = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(h * np.uint64(2) + np.uint64(salt)) + count.astype(np.uint64)))])
                first = np.searchsorted(doc, np.arange(n + 1))
                keys.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64)[has])
            found = bands_of(bagminhash(doc, h, count, n, bands * rows), bands, rows).view(np.int64)[has]
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(has)), batch.column(1).filter(pa.array(has)), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.bincount(doc, count, minlength=n).astype(np.int64)[has]), pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))], names=["place", "th", "a", "b", "n", "bands"]
            )

    return texts.mapInArrow(run, "place long, th long, a long, b long, n long, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the similarity s of their texts (place, text), and a sketch d of how b differs from a."""
    one = pairs.join(texts.select(F.col("place").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("place").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            s, bits = differences(as_bytes(batch.column(2)), as_bytes(batch.column(3)))
            d = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * 2 * BITS), pa.array(bits.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), d], names=["a", "b", "s", "d"])

    return stored(both.mapInArrow(run, "a long, b long, s double, d array<long>"))


def may_link(similarity: float, some: tuple[int, ...] = ()):
    """Whether p and q can be that similar, by their sizes and sketches against one leader, or by some words of these.

    It errs on one side only: what is false cannot be linked. A bit that only one has is a shingle that it holds more often, so
    the bits bound how much of each is not in the other. Some words are unrolled, so they are quick to compile; for all of
    them that would make a method too large for the JVM to compile, so these are a loop.
    """
    beyond = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    pd, qd = F.col("pd"), F.col("qd")
    if some:
        only = lambda x, y: sum((beyond(x[i], y[i]) for i in some), F.lit(0))
    else:
        only = lambda x, y: F.aggregate(F.zip_with(x, y, beyond), F.lit(0), lambda n, k: n + k)
    p_most, q_most = F.col("pn") - only(pd, qd), F.col("qn") - only(qd, pd)
    return F.least(p_most, q_most) * (1 + similarity) >= (F.col("pn") + F.col("qn")) * similarity - 1e-6


def classes(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(place, th, copy_of, class, class_th, rows) of each document with words: the least place with an equal multiset, the least document of its class, and its rows."""
    sketch = stored(sketches(docs, id_col, text_col, bands, rows))
    # Multisets get numbers, which hold from when they are written; from here to the classes, they are the places.
    first = sketch.groupBy("a", "b").agg(F.min(F.struct("place", "th")).alias("head"))
    first = stored(first.withColumn("node", F.monotonically_increasing_id()))
    every = sketch.join(first, ["a", "b"])
    member = stored(every.groupBy("place", "th").agg(F.min(F.struct("node", "head")).alias("of"), F.count("*").alias("rows")))
    one = every.where((F.col("place") == F.col("head.place")) & (F.col("th") == F.col("head.th"))).dropDuplicates(["node"])
    one = stored(one.select("node", "place", "th", "n", "bands"))
    heads = one.select(F.col("node").alias("place"), F.col("n").alias("size"), F.posexplode("bands").alias("nth", "key"))
    # What rows of a hot key are joined with is stored first: a join of tables can be split by Spark, one of an aggregate that is dealt by that key cannot.
    shared = stored(heads.groupBy("key").agg(F.min("place").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"))
    buckets = stored(heads.join(shared, "key"))
    wanted = buckets.select(F.col("place").alias("node")).distinct().join(one.select("node", "place", "th"), "node")
    texts = docs.where(F.col(text_col).isNotNull()).select(place(id_col).alias("place"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).join(wanted, ["place", "th"])
    texts = stored(texts.dropDuplicates(["place", "th"]).select(F.col("node").alias("place"), "text"))

    pairs = buckets.where("place > leader").select(F.col("leader").alias("a"), F.col("place").alias("b")).distinct()
    done = compared(pairs, texts)
    linked = lambda df: components(df.where(F.col("s") >= similarity).select("a", "b"))
    label = linked(done)

    of = lambda name: label.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    scored = buckets.join(done.select(F.col("a").alias("leader"), F.col("b").alias("place"), "s", "d"), ["leader", "place"], "left")
    scored = scored.join(of("place"), "place", "left").join(of("leader"), "leader", "left")
    component = F.coalesce("place_c", "place")
    scored = stored(scored.select("key", "nth", "place", component.alias("c"), F.coalesce("s", F.lit(1.0)).alias("s"), "size", F.coalesce("d", F.array(*[F.lit(0).cast("long")] * BITS, *[F.lit(-1).cast("long")] * BITS)).alias("d"), (component != F.coalesce("leader_c", "leader")).alias("apart")))
    # Pairs of which one is apart from the leader, by slots of similarity to the leader: a link spans two at most.
    width = 1 - similarity + 1e-9
    slot = F.floor(F.col("s") / width)
    apart = stored(scored.where("apart").select("key").distinct())
    open_ = scored.join(apart, "key", "left_semi")
    open_ = stored(open_.join(one.select(F.col("node").alias("place"), "bands"), "place"))
    short = {"place": "", "c": "c", "s": "s", "size": "n", "d": "d", "bands": "b", "apart": "x"}
    named = lambda df, side: df.select("key", "nth", "slot", *(F.col(c).alias(side + n) for c, n in short.items()))
    x = named(open_.where("apart").withColumn("slot", slot), "p")
    y = named(open_.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))), "q").drop("nth")
    # Where there are many of either, blocks of one meet blocks of the other, each pair of blocks on its own.
    asked = open_.select("key", "apart", F.explode(F.array(F.struct((slot - 1).alias("slot"), F.lit(False).alias("own")), F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")))).alias("e"))
    sizes = asked.groupBy("key", "e.slot").agg(F.count_if(F.col("apart") & F.col("e.own")).alias("p"), F.count("*").alias("q")).where((F.col("q") > BLOCK) & (F.col("p") > 0))
    sizes = stored(sizes.select("key", "slot", F.ceil(F.col("p") / BLOCK).cast("int").alias("pm"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qm")))
    beside = F.broadcast if sizes.count() <= BROADCAST_ROWS else (lambda df: df)
    of_block = lambda side, n: F.pmod(F.xxhash64(side), F.coalesce(n, F.lit(1))).cast("int").alias(f"{side}k")
    every_block = lambda side, n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)).alias(f"{side}k")
    x = x.join(beside(sizes), ["key", "slot"], "left").select("*", of_block("p", F.col("pm")), every_block("q", "qm")).drop("pm", "qm")
    y = y.join(beside(sizes), ["key", "slot"], "left").select("*", of_block("q", F.col("qm")), every_block("p", "pm")).drop("pm", "qm")
    near = (F.col("pc") != F.col("qc")) & (F.abs(F.col("ps") - F.col("qs")) <= width) & (~F.col("qx") | (F.col("p") < F.col("q"))) & may_link(similarity, (0, 1, BITS, BITS + 1))
    # A pair is judged in the first of the buckets that it shares.
    near &= ~F.arrays_overlap(F.slice("pb", F.lit(1), F.col("nth")), F.slice("qb", F.lit(1), F.col("nth")))
    near &= may_link(similarity)
    cross = x.join(y, ["key", "slot", "pk", "qk"]).where(near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    more = compared(cross.join(done, ["a", "b"], "left_anti"), texts)
    if not more.where(F.col("s") >= similarity).isEmpty():
        label = linked(done.unionAll(more))
    grouped = label.join(one.select("node", "place", "th"), "node")
    least = stored(grouped.groupBy("component").agg(F.min(F.struct("place", "th")).alias("least")))
    of_node = stored(grouped.select("node", "component").join(least, "component").select("node", "least"))
    group = member.select("place", "th", "of.*", "rows").join(of_node, "node", "left").withColumn("least", F.coalesce("least", "head"))
    found = stored(group.select("place", "th", F.col("head.place").alias("copy_of"), F.col("least.place").alias("class"), F.col("least.th").alias("class_th"), "rows"))
    discard(sketch, first, member, one, shared, buckets, texts, done, scored, apart, open_, sizes, more, least, of_node)
    return found


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, copy_of, class_id, kept) of each row: kept is true of one document, an id with a text, in each class."""
    found = classes(docs, id_col, text_col, similarity)
    rows = docs.select(F.col(id_col), place(id_col).alias("place"), F.xxhash64(text_col).alias("th"))
    joined = rows.join(found, ["place", "th"], "left")
    own = F.col(id_col).cast("long")
    least = lambda c: F.when(F.col(c).isNull() | (F.col(c) == F.col("place")), own).otherwise(F.col(c))
    return joined.select(id_col, least("copy_of").alias("copy_of"), least("class").alias("class_id"), (F.col("class").isNull() | ((F.col("class") == F.col("place")) & (F.col("class_th") == F.col("th")))).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
