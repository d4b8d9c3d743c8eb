import numpy as np
from pyspark.sql import functions as F

from spindle.llm import langid
from tests.conftest import SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.documents_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n > 0.9


def test_presence_is_the_kernel():
    texts = [b"Hello there", b"hello THERE!", b"", b"a", b"ab"]
    x = langid.presence(texts)

    def sets(t):
        t = "".join(c if c.isalpha() else " " for c in t.decode().lower())
        return [{t[i : i + n] for i in range(len(t) - n + 1)} for n in (1, 2, 3)]

    k = x @ x.T
    a, b = sets(texts[0]), sets(texts[1])
    want = sum(w * len(p & q) / np.sqrt(len(p) * len(q)) for w, p, q in zip(langid.BLEND, a, b, strict=True))
    assert abs(k[0, 1] - want) < 0.02  # slots may coincide
    assert k[2, 2] == 0 and abs(k[0, 0] - 1) < 1e-5
    assert abs(k[3, 3] - langid.BLEND[0]) < 1e-6  # one letter has no longer n-grams


def test_awkward_rows(spark, awkward):
    train = [(100 + i, t, lang, "s") for i, (t, lang) in enumerate([("the quick brown fox and the dog", "en"), ("le renard et le chien de la maison", "fr")] * 40)]
    rows = [(i, t, None, None) for i, t in awkward] + train + [(300, "123 ...", "en", "s"), (301, "no label", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.documents_languages(df).collect()
    assert len(got) == len(rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 300}
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    assert {r["lang_pred"] for r in got if 100 <= (r["doc_id"] or 0) < 180 and r["doc_id"] % 2 == 0} == {"en"}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.documents_languages(df).collect()] == [(1, False, "und", 0.0)]
    assert langid.documents_languages(df.limit(0)).count() == 0


def test_against_a_plain_version(docs, spark):
    """Kernels of sets, the landmarks' inverse root and ridge regression, written out one by one."""
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang").collect() if r["text"] and r["lang"]][:120]
    texts, langs = [r["text"].encode() for r in rows], [r["lang"] for r in rows]
    names = sorted(set(langs))

    def sets(t):
        t = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in t]
        return [set(t), {(a * 977 + b * 131) % 2**32 % 2048 for a, b in zip(t, t[1:])}, {(a * 40_503 + b * 2_654 + c * 31) % 2**32 % 4096 for a, b, c in zip(t, t[1:], t[2:])}]

    def kernel(a, b):
        return sum(w * len(x & y) / max(len(x) * len(y), 1) ** 0.5 for w, x, y in zip(langid.BLEND, a, b, strict=True))

    chosen = [i for name in names for i in [k for k, x in enumerate(langs) if x == name][:6]]
    each = [sets(t) for t in texts]
    k = np.array([[kernel(each[i], each[j]) for j in chosen] for i in range(len(texts))])
    values, vectors = np.linalg.eigh(k[chosen])
    phi = np.concatenate([k @ vectors / np.sqrt(np.maximum(values, 1e-6)), np.ones((len(k), 1))], axis=1)
    y = np.array([[1.0 if x == name else -1.0 for name in names] for x in langs])
    w = np.array([len(langs) / len(names) / langs.count(x) for x in langs])[:, None]
    plain = phi @ np.linalg.solve(phi.T @ (w * phi) + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ (w * y))

    model = langid.fit(langid.packed(texts), langs, landmarks=6)
    assert model.languages == names and np.allclose(model.scores(texts), plain, atol=0.02)
    got = langid.predict(spark.createDataFrame([(i, t.decode(), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string"), "text", model).collect()
    e = np.exp(4 * (plain - plain.max(1, keepdims=True)))
    sure = np.sort(plain, axis=1)[:, -1] - np.sort(plain, axis=1)[:, -2] > 0.05
    assert sure.mean() > 0.9
    for r in got:
        if sure[r["doc_id"]]:
            assert r["lang_pred"] == names[plain[r["doc_id"]].argmax()]
        assert abs(r["score"] - e[r["doc_id"]].max() / e[r["doc_id"]].sum()) < 0.03


def test_what_is_gathered_of_a_text_does_not_grow_with_it(spark):
    assert {len(x) for x in langid.packed([b"", b"a", b"long " * 100_000])} == {sum(langid.SLOTS) // 8}
    rows = [(i % 3, "the same text of a third of all rows", "en") for i in range(300)] + [(i, f"texte numéro {i} de la maison", "fr") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", F.lit(True), sample=50)
    assert model.languages == ["en", "fr"] and len(model.landmarks) == 1 + langid.LANDMARKS
