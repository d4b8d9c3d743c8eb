"""Scoring texts with a log-bilinear language model.

Method: a log-bilinear neural model over symbols, trained in numpy with noise-contrastive estimation. The
most frequent words are symbols of their own, as many as the root of the number of different words, within SYMBOLS; each other word falls in one of TAILS classes by its
last letters and its length; the end of a text is a symbol, which also stands before its first word. The
predicted vector of a place is the sum of its two preceding symbols' vectors, each weighted by position; a
symbol's score is its product with that vector, plus a bias. Training needs no normaliser; scoring has the
exact one, as products of the matrices of vectors give the scores of all symbols for all pairs of
preceding symbols. Within a class, a word has the add-one estimate from its count, with one place for
words never seen, so the probabilities of all words sum to one.

Counts are of all training texts, and training goes once over all of their tokens. Texts are dealt by a hash of their id and
text to shards of about SHARD_TOKENS tokens, and within a shard to rounds: in a round, every shard trains on its texts in the
order of their hashes, from the average of the round before; the models, with the state of their step sizes, are averaged
by tokens. There are ROUNDS of them, and one more each time the number of shards doubles. So nothing hangs on how the rows lie in files. Counts of frequent words
are broadcast, HEAD of them at most; those of other words are joined by a 64-bit hash of the word.

Defined results: a null text is the empty text, whose one token is its end; ids may repeat, and null ids are not
held out; extra columns are ignored; if there is nothing to learn from, all words are unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, discard, mix, signed, small, stored, table
from .langid import held_out

#: Bounds of the number of words that are symbols: the exact normaliser is a table of all pairs of symbols, 57 MB in all at the upper one.
SYMBOLS = (640, 2048)
#: Classes of the other words, and words whose counts are broadcast.
TAILS, HEAD = 127, 65_536
#: Tokens of a shard, rounds of one shard, and tokens that are shuffled before they are learned from.
SHARD_TOKENS, ROUNDS, MIXED = 4_000_000, 4, 65_536
#: Dimensions, noise samples for each batch of places, places in a batch, learning rate.
DIM, NOISE, BATCH, RATE = 24, 48, 8192, 0.15
_END_HASH = int(mix(np.array([0x5DEECE66D], dtype=np.uint64)).view(np.int64)[0])


def tail_class(words: Words) -> np.ndarray:
    """The class of each word, from its last two bytes, as letters of either case and of no case, and its length."""
    raw = np.frombuffer(words.data, dtype=np.uint8)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    last = low[words.end - 1]
    before = np.where(words.end - words.start > 1, low[np.maximum(words.end - 2, 0)], 0)
    long = (words.end - words.start > 6).astype(np.uint64)
    return (mix(last * np.uint64(512) + before * np.uint64(2) + long) % np.uint64(TAILS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Hashes of frequent words, in order, with their counts and symbols; totals of the training texts and of each class."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # -1: by class
    n: int
    v: int
    end: int
    class_n: np.ndarray
    class_v: np.ndarray
    size: int  # symbols that are words

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among hashes, whether it is there)."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == h) if len(self.hashes) else np.zeros(len(h), dtype=bool)

    @property
    def total(self) -> int:
        """Symbols in all: words, classes, end."""
        return self.size + TAILS + 1


def symbols_of(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, place among the frequent words, whether it is there) of each word."""
    at, known = vocabulary.find(signed(words.hash))
    own = vocabulary.symbols[at] if len(vocabulary.symbols) else np.full(len(at), -1)
    own = np.where(known, own, -1)
    return np.where(own >= 0, own, vocabulary.size + tail_class(words)), at, known


def sequences(words: Words, symbol: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, symbol, text) of every token, the ends of the texts among them."""
    texts = len(words.first) - 1
    at = np.arange(len(words)) + words.doc
    ends = words.first[1:] + np.arange(texts)
    s = np.full(len(words) + texts + 2, end, dtype=np.int64)
    s[at + 2] = symbol
    one, two = s[1:-1].copy(), s[:-2].copy()
    first = words.first[:-1] + np.arange(texts)
    one[first] = end
    two[first] = end
    doc = np.empty(len(words) + texts, dtype=np.int64)
    doc[at], doc[ends] = words.doc, np.arange(texts)
    second = first + 1
    two[second[second < len(two)]] = end
    return one, two, s[2:], doc


def contexts(target: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(one before, two before) of each token of whole texts in a row."""
    one = np.concatenate([[end], target[:-1]])
    two = np.concatenate([[end, end], target[:-2]])[: len(target)]
    return one, np.where(one == end, end, two)


@dataclass
class Model:
    """Vectors of preceding symbols and of predicted ones, weights of the two positions, biases; then sums of squared gradients of each."""

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    bias: np.ndarray
    r_sums: np.ndarray
    q_sums: np.ndarray
    c_sums: np.ndarray
    bias_sums: np.ndarray

    @classmethod
    def new(cls, counts: np.ndarray) -> Model:
        rng = np.random.default_rng(17)
        draw = lambda: (rng.standard_normal((len(counts), DIM)) * 0.1).astype(np.float32)
        p = (counts + 1) / (counts + 1).sum()
        least = lambda *shape: np.full(shape, 1e-2, np.float32)
        c = np.array([[1.0], [0.5]], dtype=np.float32) * np.ones((1, DIM), np.float32)
        return cls(draw(), draw(), c, np.log(p).astype(np.float32), least(len(p)), least(len(p)), least(2, DIM), least(len(p)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.q, self.c, self.bias, self.r_sums, self.q_sums, self.c_sums, self.bias_sums

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in self.parts():
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*parts)

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, log_noise: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation; a batch shares its noise. AdaGrad over rows."""
        cumulative = np.cumsum(np.exp(log_noise))
        for i in range(0, len(target), BATCH):
            a, b, w = one[i : i + BATCH], two[i : i + BATCH], target[i : i + BATCH]
            n = len(w)
            ra, rb = self.r[a], self.r[b]
            h = ra * self.c[0] + rb * self.c[1]
            qw = self.q[w]
            noise = np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]).clip(0, len(self.q) - 1)
            qn = self.q[noise]
            # The odds that a word came from the model and not from NOISE draws of the noise.
            real = np.einsum("ij,ij->i", h, qw) + self.bias[w] - (log_noise[w] + np.log(NOISE))
            fake = h @ qn.T + self.bias[noise] - (log_noise[noise] + np.log(NOISE)).astype(np.float32)
            g = (1 / (1 + np.exp(np.clip(real, -30, 30)))).astype(np.float32)  # pulls real words up
            f = (-1 / (1 + np.exp(np.clip(-fake, -30, 30)))).astype(np.float32)  # pushes noise down
            dh = g[:, None] * qw + f @ qn
            self._add(self.q, self.q_sums, w, g[:, None] * h, n)
            self._add(self.q, self.q_sums, noise, f.T @ h, n)
            self._add_bias( np.concatenate([w, noise]), np.concatenate([g, f.sum(0)]), n)
            self._add(self.r, self.r_sums, np.concatenate([a, b]), np.concatenate([dh * self.c[0], dh * self.c[1]]), n)
            dc = np.stack([(dh * ra).sum(0), (dh * rb).sum(0)]) / n
            self.c_sums += dc * dc
            self.c += 0.1 * RATE * dc / np.sqrt(self.c_sums)

    def _add(self, x: np.ndarray, sums: np.ndarray, at: np.ndarray, grad: np.ndarray, n: int) -> None:
        order = at.argsort(kind="stable")
        rows = at[order]
        new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total = np.add.reduceat(grad[order], new, axis=0) / n * 64
        rows = rows[new]
        sums[rows] += (total * total).mean(1)
        x[rows] += RATE * total / np.sqrt(sums[rows])[:, None]

    def _add_bias(self, at: np.ndarray, grad: np.ndarray, n: int) -> None:
        total = (np.bincount(at, grad, minlength=len(self.bias)) / n * 64).astype(np.float32)
        self.bias_sums += total * total
        self.bias += 0.2 * RATE * total / np.sqrt(self.bias_sums)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by the symbol before, scores by the one before that, log normaliser of each pair): a score is the sum of the first two, and of the bias."""
        by_one = (self.r * self.c[0]) @ self.q.T + self.bias
        by_two = (self.r * self.c[1]) @ self.q.T
        top_two = by_two.max(1)
        e = np.exp(by_two - top_two[:, None])
        top_one = by_one.max(1)
        norm = np.exp(by_one - top_one[:, None]) @ e.T  # one x two: a product of matrices sums over all symbols
        return by_one.astype(np.float32), by_two.astype(np.float32), (np.log(norm) + top_one[:, None] + top_two).astype(np.float32)


def count_words(docs: DataFrame, train: Column, text_col: str) -> DataFrame:
    """(h, n, tail) of each word of the training texts, and of the end with tail -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n, k = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = h.argsort()
            h, n, k = h[order], n[order], k[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(np.add.reduceat(n, new)), pa.array(k[new])], names=["h", "n", "tail"])

        for batch in small(batches, 0):
            w = Words(as_bytes(batch.column(0)), lower=True)
            h, at, n = np.unique(signed(w.hash), return_index=True, return_counts=True)
            held.append((np.append(h, _END_HASH), np.append(n, batch.num_rows), np.append(tail_class(w)[at], -1)))
            size += len(h)
            if size > 2_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    texts = docs.where(train).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = texts.mapInArrow(run, "h long, n long, tail long")
    return stored(parts.groupBy("h").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    words = counts.where("tail >= 0")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("tail") < 0, F.col("n"))), F.lit(0))).first()
    size = int(np.clip(np.sqrt(totals[1]), *SYMBOLS))
    top = words.orderBy(F.desc("n"), "h").limit(head).toArrow()
    h, n, tail = (top[c].to_numpy() for c in ("h", "n", "tail"))
    symbol = np.where(np.arange(len(h)) < size, np.arange(len(h)), -1)
    class_n, class_v = np.zeros(TAILS, dtype=np.int64), np.zeros(TAILS, dtype=np.int64)
    for r in words.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # as many rows as classes
        class_n[r["tail"]], class_v[r["tail"]] = r["n"], r["v"]
    own = symbol >= 0
    np.subtract.at(class_n, tail[own], n[own])
    np.subtract.at(class_v, tail[own], 1)
    order = h.argsort()
    return Vocabulary(h[order], n[order], symbol[order], totals[0], totals[1], totals[2], class_n, class_v, int(own.sum()))


def symbol_counts(vocab: Vocabulary) -> np.ndarray:
    out = np.zeros(vocab.total)
    out[vocab.symbols[vocab.symbols >= 0]] = vocab.counts[vocab.symbols >= 0]
    out[vocab.size : vocab.size + TAILS] = vocab.class_n
    out[-1] = vocab.end
    return out


def learn(docs: DataFrame, train: Column, id_col: str, text_col: str, vocab: Vocabulary) -> Model:
    """Trained on all tokens of the training texts, in rounds over shards."""
    counts = symbol_counts(vocab)
    model, noise = Model.new(counts), np.log((counts + 1) / (counts + 1).sum()).astype(np.float32)
    shards = max(1, -(-vocab.n // SHARD_TOKENS))
    rounds = ROUNDS + (shards - 1).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def symbolise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in small(batches, 1):
            w = Words(as_bytes(batch.column(1)), lower=True)
            target = sequences(w, symbols_of(w, v)[0], v.total - 1)[2].astype(np.uint16)
            offsets = 2 * np.concatenate([[0], np.cumsum(np.diff(w.first) + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(target)])], names=["h", "s"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.where(train).select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text"))
    dealt = texts.mapInArrow(symbolise, "h long, s binary").withColumn("unit", F.pmod("h", F.lit(shards * rounds)).cast("int"))
    dealt = stored(dealt.sortWithinPartitions("unit"))  # so each round reads its own pages
    for k in range(rounds):
        model = averaged(dealt.where(F.col("unit").between(k * shards, (k + 1) * shards - 1)), shards, model, noise)
    discard(dealt)
    return model


def averaged(part: DataFrame, shards: int, start: Model, noise: np.ndarray) -> Model:
    """The average, by tokens, of the models that the units of part (unit, h, s) train from start."""
    spark = part.sparkSession
    shared = spark.sparkContext.broadcast((start, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, log_noise = shared.value
        end, now, model, rng, held, size, tokens = len(log_noise) - 1, None, None, None, [], 0, 0

        def flush() -> None:
            nonlocal size, tokens
            if size:
                target = np.concatenate(held).astype(np.int64)
                one, two = contexts(target, end)
                order = np.random.default_rng(size).permutation(size)
                model.train(one[order], two[order], target[order], log_noise, rng)
                tokens += size
                size = 0
                held.clear()

        def result() -> pa.RecordBatch:
            flush()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([tokens], pa.int64()), pa.array([(model.flat().astype(np.float64) * tokens).tobytes()])], names=["unit", "tokens", "sums"])

        for batch in batches:
            for unit, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if unit != now:
                    if now is not None:
                        yield result()
                    now, model, rng, tokens = unit, begun.like(begun.flat()), np.random.default_rng([23, unit]), 0
                held.append(np.frombuffer(raw, dtype=np.uint16))
                size += len(held[-1])
                if size >= MIXED:  # at the end of a text, so it hangs on the order of the texts alone
                    flush()
        if now is not None:
            yield result()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total, least = 0, None, None
        for batch in batches:
            for unit, t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                total = x.copy() if total is None else total + x
                tokens, least = tokens + t, unit if least is None else min(least, unit)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()])], names=["unit", "tokens", "sums"])

    schema = "unit int, tokens long, sums binary"
    trained = part.repartition(shards, "unit").sortWithinPartitions("unit", "h").select("unit", "s").mapInArrow(run, schema)
    n = shards
    while n == shards or n > 16:  # sums of sums, until few are left for the driver
        n = -(-n // 16)
        trained = trained.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(add, schema)
        if n == 1:
            break
    trained = stored(trained)  # and the round's shuffle files go
    tokens, total = 0, None
    got = trained.toArrow().sort_by("unit")
    for t, raw in zip(got["tokens"].to_pylist(), got["sums"].to_pylist(), strict=True):
        x = np.frombuffer(raw, dtype=np.float64)
        tokens, total = tokens + t, x if total is None else total + x
    discard(trained)
    return start.like(total / tokens) if tokens else start


def score(docs: DataFrame, id_col: str, text_col: str, parts: int = 7) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; one of `parts` texts is held out."""
    spark, train = docs.sparkSession, ~held_out(id_col, parts)
    counts = count_words(docs, train, text_col)
    vocab = vocabulary(counts)
    model = learn(docs, train, id_col, text_col, vocab)
    shared = spark.sparkContext.broadcast((vocab, model.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (by_one, by_two, norm) = shared.value
        ten = np.log(10.0)
        base_of = np.log10((v.counts + 1) / (v.n + v.v + 1)) if len(v.counts) else np.zeros(1)
        end_base = np.log10((v.end + 1) / (v.n + v.v + 1))
        for batch in small(batches, 2):
            texts = batch.num_rows
            w = Words(as_bytes(batch.column(2)), lower=True)
            symbol, at, known = symbols_of(w, v)
            one, two, target, doc = sequences(w, symbol, v.total - 1)
            p = (by_one[one, target] + by_two[two, target] - norm[one, two]).astype(np.float64) / ten
            total = np.bincount(doc, p, minlength=texts)
            base = np.bincount(w.doc[known], base_of[at[known]], minlength=texts) + end_base
            n_known = np.bincount(w.doc[known], minlength=texts) + (1 if v.end else 0)
            # Frequent words of a class: their share of it.
            within = known & (symbol >= v.size)
            k = symbol[within] - v.size
            total += np.bincount(w.doc[within], np.log10((v.counts[at[within]] + 1) / (v.class_n[k] + v.class_v[k] + 1)), minlength=texts)
            # Other words: their counts are joined.
            rare = ~known
            key = np.stack([w.doc[rare], signed(w.hash)[rare], symbol[rare] - v.size])
            order = np.lexsort((key[1], key[0]))
            key = key[:, order]
            new = np.flatnonzero(np.concatenate([[True], (key[0, 1:] != key[0, :-1]) | (key[1, 1:] != key[1, :-1])])) if key.shape[1] else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(new, key.shape[1]))
            n_rare = np.bincount(key[0, new], minlength=texts)
            offsets = np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(key[1, new]), pa.array(times.astype(np.int32)), pa.array(key[2, new].astype(np.int32))], names=["h", "t", "k"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(w.first) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), rest)],
                names=["id", "row", "n_tokens", "n_known", "base", "score", "rest"],
            )

    # Rows get numbers, which hold from when they are written.
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    local = stored(rows.mapInArrow(run, f"id {kind}, row long, n_tokens long, n_known long, base double, score double, rest array<struct<h:long,t:int,k:int>>"))
    classes = spark.createDataFrame([(i, float(a + b + 1)) for i, (a, b) in enumerate(zip(vocab.class_n.tolist(), vocab.class_v.tolist(), strict=True))], "k int, of double")
    rare = local.select("row", F.inline("rest"))
    seen = rare.join(counts.where("tail >= 0").select("h", "n"), "h", "left").join(F.broadcast(classes), "k")
    n = F.coalesce("n", F.lit(0))
    added = seen.groupBy("row").agg(
        F.sum(F.col("t") * F.log10((n + 1) / F.lit(float(vocab.n + vocab.v + 1)))).alias("base2"), F.sum(F.col("t") * F.log10((n + 1) / F.col("of"))).alias("score2"),
        F.sum(F.when(n > 0, F.col("t")).otherwise(0)).alias("known2"),
    )
    both = local.drop("rest").join(added, "row", "left")
    zero = F.lit(0.0)
    return both.select(
        F.col("id").alias(id_col), held_out("id", parts).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("score") + F.coalesce("score2", zero)).alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), "doc_id", "text")
