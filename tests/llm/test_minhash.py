import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spindle.llm import minhash
from spindle.llm.common import components


def bag(text, k=5):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(rows, least=0.8):
    bags = [(i, bag(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    changed = True
    links = [(i, j) for n, (i, a) in enumerate(bags) for j, b in bags[:n] if a and b and similarity(a, b) >= least]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def test_classes_of_documents(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, "doc_id", "text").collect()}
    assert got == brute(docs)


def test_chains_and_hot_groups(spark):
    """A large group of near copies of one text, with some that are linked to others only, and some to none."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 12, 40])):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, "doc_id", "text").collect()}
    want = brute(rows)
    # Candidates at the very threshold may be missed with a small probability; here none is.
    assert got == want


def test_similarity_is_exact_and_estimated_without_bias():
    a = "a b c d e f g h i j " * 3 + "k l m n o"
    texts = [(a, a.replace("k l", "x y")), ("one two", "one two"), ("", "a"), (" ".join(map(str, range(300))), " ".join(map(str, range(30, 330))))]
    exact = minhash.similarities([x.encode() for x, _ in texts], [y.encode() for _, y in texts])
    assert np.allclose(exact, [similarity(bag(x), bag(y)) for x, y in texts])
    for x, y in (texts[0], texts[3]):
        doc, h, count = minhash.shingles([x.encode(), y.encode()])
        sig = minhash.bagminhash(doc, h, count, 2, 4096)
        assert abs((sig[0] == sig[1]).mean() - similarity(bag(x), bag(y))) < 0.04


def test_weights_count():
    doc, h = np.array([0, 1, 2]), np.array([5, 5, 5], dtype=np.uint64)
    sig = minhash.bagminhash(doc, h, np.array([3, 6, 48]), 3, 8192)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.03 and abs((sig[1] == sig[2]).mean() - 0.125) < 0.03


def test_awkward_rows(spark, awkward):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in awkward], "doc_id long, text string, `class` int, place int")
    got = minhash.near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == len(awkward)
    assert all(r["class_id"] == r["doc_id"] and r["kept"] for r in got)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 200)] + [(5, 5), (3, 2), (2, 9), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 201), 100), 2: 2, 3: 2, 9: 2}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_ids(spark):
    """Each text of an id, and of the null ids, is judged on its own, and one row of a class stays in the pipeline."""
    import corpus_pipeline

    text = lambda k, edit="": " ".join(f"w{k}_{i}" for i in range(80)) + edit
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(2) + " z"), (4, text(1)), (5, text(3) + " y"), (6, text(4)), (6, text(5)), (7, text(4) + " x"), (8, text(5)), (9, text(6)), (9, text(2)), (10, text(7)), (10, text(7))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda t: t.split("_")[0]
    done = minhash.classes(df, "doc_id", "text").join(df.select(F.xxhash64("text").alias("th"), "text").distinct(), "th").collect()
    groups = {}
    for r in done:
        groups.setdefault((r["class"], r["class_th"]), set()).add(key(r["text"]))
    assert len(groups) == 7 and all(len(g) == 1 for g in groups.values())
    got = minhash.near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 8  # the repeated row is kept with its like
    assert {r["class_id"] for r in got} | {r["copy_of"] for r in got} <= {r["doc_id"] for r in got}
    stay = [(r["doc_id"], key(r["text"])) for r in corpus_pipeline.near(spark, df, "").collect()]
    assert sorted(stay, key=str) == sorted([(4, "w1"), (9, "w2"), (5, "w3"), (6, "w4"), (6, "w5"), (9, "w6"), (10, "w7")], key=str)


def test_classes_of_null_ids(spark):
    """A class that has an id is named by it; one of null ids alone has no name, and keeps one document."""
    text = lambda k, edit="": " ".join(f"w{k}_{i}" for i in range(80)) + edit
    df = spark.createDataFrame([(None, text(1)), (8, text(1, " x")), (None, text(2)), (None, text(2, " y")), (None, None), (3, "")], "doc_id long, text string")
    got = minhash.near_duplicates(df, "doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["copy_of"], r["class_id"], r["kept"]) for r in got), key=repr) == sorted(
        [(None, None, 8, False), (8, 8, 8, True), (None, None, None, True), (None, None, None, False), (None, None, None, True), (3, 3, 3, True)], key=repr
    )


def test_blocks_do_not_matter(spark, monkeypatch):
    """Hot buckets whose members are apart from their leader, cut into blocks, with and without broadcasts."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(6):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows += [(3 * i + k, " ".join([*words[:-1], f"y{k}"])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    for limit in (minhash.BROADCAST_ROWS, 0):
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", limit)
        assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, "doc_id", "text").collect()} == want
