import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from spindle.llm import lm
from spindle.llm.common import Words

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(rows, got):
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for i, x in rows for t in [tokens(x)]), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == want


def test_counts_and_base(spark, docs, awkward):
    rows = [*docs, *awkward]
    got = lm.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int"), "doc_id", "text").collect()
    check(rows, got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize("rows", [[], [(2, "only one text, and it is held out" if held(2) else "x")], [(None, None)]])
def test_little_to_learn_from(spark, rows):
    check(rows, lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())


def test_the_model_is_normalised():
    rng = np.random.default_rng(0)
    model = lm.Model.new(rng.integers(1, 50, 40).astype(float))
    model.r *= 5
    one, two, norm = model.tables()
    for a, b in ((0, 1), (7, 7), (39, 2)):
        assert abs(np.exp(one[a] + two[b] - norm[a, b]).sum() - 1) < 1e-4
        h = model.r[a] * model.c[0] + model.r[b] * model.c[1]
        assert np.allclose(one[a] + two[b], model.q @ h + model.bias, atol=1e-4)


def test_training_learns_what_follows_what():
    rng = np.random.default_rng(1)
    two = rng.integers(0, 10, 60_000)
    one = rng.integers(0, 10, 60_000)
    target = (one + 3) % 10
    model = lm.Model.new(np.bincount(target, minlength=10).astype(float))
    for _ in range(4):
        model.train(one, two, target, np.log(np.full(10, 0.1)).astype(np.float32), np.random.default_rng(2))
    by_one, by_two, norm = model.tables()
    assert np.exp(by_one[one, target] + by_two[two, target] - norm[one, two]).mean() > 0.5


def test_sequences():
    w = Words([b"a b c", b"", b"d"])
    one, two, target, doc = lm.sequences(w, np.array([1, 2, 3, 4]), 9)
    assert list(zip(doc.tolist(), two.tolist(), one.tolist(), target.tolist(), strict=True)) == [(0, 9, 9, 1), (0, 9, 1, 2), (0, 1, 2, 3), (0, 2, 3, 9), (1, 9, 9, 9), (2, 9, 9, 4), (2, 9, 4, 9)]
    stream = np.concatenate([[1, 2, 3, 9], [9], [4, 9]])
    assert [x.tolist() for x in lm.contexts(stream, 9)] == [one.tolist(), two.tolist()]


def test_layout_does_not_matter(spark, docs, monkeypatch):
    """Whatever the partitions, scores are alike, and several shards keep most of the gain of one."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = lambda n: {r["doc_id"]: (r["base_score"], r["score"]) for r in lm.score(df.repartition(n, "doc_id"), "doc_id", "text").collect()}
    gain = lambda got: sum(s - b for b, s in got.values())
    first, other = one(1), one(8)
    assert all(abs(first[i][1] - other[i][1]) < 1e-3 for i in first)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 25_000)
    first_of_many, other_of_many = one(2), one(5)
    assert all(abs(first_of_many[i][1] - other_of_many[i][1]) < 1e-3 for i in first_of_many)
    assert gain(first_of_many) > 0.5 * gain(first) > 0


def test_sums_of_sums(spark, docs, monkeypatch):
    """More shards than the driver adds up by itself."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1000)
    df = spark.createDataFrame(docs[:120], "doc_id long, text string")
    got = lm.score(df, "doc_id", "text").collect()
    assert len(got) == 120 and all(np.isfinite(r["score"]) for r in got)


def test_scores_against_a_plain_evaluation(spark, docs):
    """The trained model, one token after the other."""
    from pyspark.sql import functions as F

    from spindle.llm.langid import held_out

    rows = docs[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = ~held_out("doc_id", 7)
    counts = lm.count_words(df, train, "text")
    vocab = lm.vocabulary(counts, head=300)
    model = lm.learn(df, train, "doc_id", "text", vocab)
    n_of = {r["h"]: r["n"] for r in counts.where(F.col("tail") >= 0).collect()}

    def plain(text):
        w = Words([(text or "").encode()], lower=True)
        hashes, classes = w.hash.view(np.int64).tolist(), lm.tail_class(w).tolist()
        own = dict(zip(vocab.hashes.tolist(), vocab.symbols.tolist(), strict=True))
        end, total = vocab.total - 1, 0.0
        one = two = end
        for h, k in [*zip(hashes, classes, strict=True), (None, None)]:
            symbol = end if h is None else own.get(h, -1) if own.get(h, -1) >= 0 else vocab.size + k
            logits = (model.q @ (model.r[one] * model.c[0] + model.r[two] * model.c[1]) + model.bias).astype(float)
            total += (logits[symbol] - np.logaddexp.reduce(logits)) / np.log(10)
            if vocab.size <= symbol < end:
                total += log10((n_of.get(h, 0) + 1) / (vocab.class_n[k] + vocab.class_v[k] + 1))
            one, two = symbol, one
        return total

    real = lm.vocabulary
    try:
        lm.vocabulary = lambda counts: real(counts, head=300)
        got = {r["doc_id"]: r["score"] for r in lm.score(df, "doc_id", "text").collect()}
    finally:
        lm.vocabulary = real
    for i, text in rows:
        assert abs(got[i] - plain(text)) < 1e-3 * max(1, abs(got[i]))
