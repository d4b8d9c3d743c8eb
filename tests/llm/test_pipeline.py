import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spindle.llm import secrets
from tests.conftest import SMALL
from tests.llm import test_bpe, test_decontaminate, test_minhash


@pytest.fixture(scope="module")
def stages(spark):
    """The result of each stage."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    from spindle.llm.common import stored

    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = stored(stage(spark, docs, SMALL))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_against_a_plain_version(spark, stages):
    rows = texts(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted(texts(stages["language"])) == sorted(rows)
    label = test_minhash.brute(rows)
    rows = [(i, t) for i, t in rows if label[i] == i]
    assert sorted(texts(stages["near"])) == sorted(rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {i for i, _, n_hit, *_ in test_decontaminate.brute(rows, items) if n_hit}
    rows = [(i, t) for i, t in rows if i not in bad]
    assert sorted(texts(stages["benchmark"])) == sorted(rows)
    cut = dict(texts(stages["secrets"]))
    assert set(cut) == {i for i, _ in rows}
    for i, t in rows:
        if not secrets.base_spans(t.encode()) and not secrets.candidates(t.encode(), []):
            assert cut[i] == t
        assert not secrets.base_spans(cut[i].encode())
    assert stages["secrets"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    sha = {r["doc_id"]: r["decoded_sha256"] for r in stages["tokens"].collect()}
    assert sha == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in cut.items()}
    for name in ("language", "near", "benchmark", "secrets"):
        assert set(stages[name].columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_run(spark, stages):
    assert test_bpe.rows_of(corpus_pipeline.run(spark, SMALL)) == test_bpe.rows_of(stages["tokens"])


def test_awkward_rows(spark, awkward):
    clashing = ["place", "id", "_id", "th", "_Th", "language", "_language", "certainty", "spans", "_spans", "class", "n_hit", "words"]
    extra = list(range(len(clashing)))
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), *extra) for i, t in awkward], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in clashing))
    learned = spark.createDataFrame([(900 + i, f"some english words number {i} and {i * i} in a row", "en", "s", 30, *extra) for i in range(30)], docs.schema)
    docs = docs.unionAll(learned)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *clashing]
    assert {tuple(r[c] for c in clashing) for r in docs.collect()} == {tuple(extra)}
    got = {r["doc_id"] for r in docs.collect()}
    assert {None, 4, 5, 6, 7, 8, 9, 10} <= got and not got & {1, 2, 3}
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_a_passage_in_a_long_document(spark):
    """Any window of the benchmark in a document is enough, whatever its share; and without labels no document is rejected for its language."""
    passage = next(t for t in (r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()) if len((t or "").split()) >= 20)
    rows = [(1, "filler words go here " * 400 + passage + " and go on" * 300), (2, "filler words go here " * 400), (3, "12 34")]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, SMALL).collect()] in ([2, 3], [3, 2])
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SMALL).collect()} == {1, 2}
