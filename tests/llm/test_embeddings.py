import numpy as np

from spindle.llm import embeddings


def brute(rows, least=0.9):
    good = [(i, np.asarray(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(np.asarray(v, dtype=float)).all() and any(v)]
    x = [(u := v / np.abs(v).max()) / np.linalg.norm(u) for _, v in good]
    g = np.array([[len(a) == len(b) and a @ b >= least for b in x] for a in x]).reshape(len(x), len(x))
    np.fill_diagonal(g, False)
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in zip(*np.nonzero(g), strict=True):
            low = min(label[good[a][0]], label[good[b][0]])
            label[good[a][0]] = label[good[b][0]] = low
    n = dict.fromkeys(label, 0)
    for (i, _), k in zip(good, g.sum(1), strict=True):
        n[i] = max(n[i], int(k))
    return {i: (n[i], label[i], i == label[i]) for i, _ in rows}


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, links int")
    got = embeddings.near_duplicates(df, "vec_id", "embedding", **kw).collect()
    assert len(got) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}


def clusters(seed, n=600, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((40, dim))
    return [(i, (centre[rng.integers(40)] + 0.3 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_recall_and_precision(spark, monkeypatch):
    """Overlapping clusters, and blocks so small that lists are cut."""
    monkeypatch.setattr(embeddings, "MEMBERS", 16)
    monkeypatch.setattr(embeddings, "QUERIES", 24)
    rows = clusters(1)
    got, want = found(spark, rows), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.99 * sum(x[0] for x in want.values())


def test_all_lists_probed_is_exact(spark):
    rows = clusters(2, 300)
    assert found(spark, rows, probes=1000, lists=12) == brute(rows)


def test_awkward_vectors(spark):
    v = [float(k) for k in range(1, 9)]
    rows = [(1, v), (2, [2 * x for x in v]), (3, v), (4, None), (5, []), (6, [0.0] * 8), (7, [1.0, None, *v[2:]]), (8, [float("nan"), *v[1:]]), (9, [float("inf"), *v[1:]]), (10, [1e300 * x for x in v]), (11, [-x for x in v]), (12, v[:3]), (13, v[::-1])]
    want = brute(rows)
    assert found(spark, rows) == want and want[1][0] == 3 and want[10][1] == 1
    assert found(spark, [(4, None), (5, [])]) == {4: (0, 4, True), 5: (0, 5, True)}
    assert found(spark, []) == {}
    twice = found(spark, [(1, v), (2, v)]) | found(spark, [(3, [0.0] * 8)])
    assert twice == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}


def test_no_link_is_missed_within_a_list():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[200:] = x[:200] + 0.2 * rng.standard_normal((200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.fit(x, 4, subspaces=4, codes=16)
    a, b = embeddings.linked(index, 0, x, x, 0.9)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(i.tolist() for i in np.nonzero(np.einsum("ij,kj->ik", x, x) >= 0.9)), strict=True))


def test_null_and_repeated_ids(spark):
    """Rows of null ids are vectors like others; every class keeps one row, and no id is invented."""
    v, w, x = [1.0] * 8, [1.0, -1.0] * 4, [1.0, 1.0, -1.0, -1.0] * 2
    rows = [(None, v), (5, v), (7, v), (None, w), (None, w), (None, None), (9, x), (9, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in embeddings.near_duplicates(df, "vec_id", "embedding").collect()]
    assert sorted(got, key=repr) == sorted(
        [(None, 3, 5, False), (5, 3, 5, True), (7, 3, 5, False), (None, 1, None, True), (None, 1, None, False), (None, 0, None, True), (9, 0, 5, False), (9, 3, 5, False)], key=repr
    )


def test_lengths_of_their_own(spark, monkeypatch):
    """Vectors of several lengths, of which the sample may lack some."""
    rows = [*clusters(3, 200), *((1000 + i, v) for i, v in clusters(4, 60, 5)), *((2000 + i, v) for i, v in clusters(5, 40, 3))]
    assert found(spark, rows, probes=1000) == brute(rows)
    keep = embeddings.sampled
    monkeypatch.setattr(embeddings, "sampled", lambda df: {n: x for n, x in keep(df).items() if n != 5})
    assert found(spark, rows, probes=1000) == brute(rows)


def test_more_lists_than_clusters(spark, monkeypatch):
    """Lists that outgrow the clusters of the sample cover all vectors, and lose next to nothing."""
    monkeypatch.setattr(embeddings, "FIRST", 6)
    rows = clusters(6, 500, 16)
    index = embeddings.fit(embeddings.unit(np.array([v for _, v in rows]))[1], 60, np.sqrt(0.2))
    assert len(index.coarse) > 30
    got, want = found(spark, rows, lists=60), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.98 * sum(x[0] for x in want.values())
