import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spindle.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wanted(plain, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    return sorted(((i, len(x), sha(",".join(map(str, x)).encode()), sha(t)) for i, x, t in ids), key=repr)


def test_against_the_library(spark, docs, awkward, plain):
    df = spark.createDataFrame([*docs, *awkward], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    assert rows_of(bpe.documents_digests(df)) == wanted(plain, [*docs, *awkward])


@pytest.mark.parametrize("overlap", [8, 40])
def test_stitched_chunks(spark, plain, overlap):
    """Small chunks, of texts that resynchronise in the overlap and of texts that do not."""
    texts = ["it's  a\n\n test'll 12 345  " * 30, "y" * 700, " " * 300 + "z", "'re" * 200, "中文字 " * 99, "a b" * 50 + "q" * 150 + " c" * 50, "naïve 中文 12345 don't\n" * 400]
    rows = list(enumerate(texts))
    encoded = bpe.encode(spark.createDataFrame(rows, "n long, t string"), "n", "t", bpe.read_ranks(PATH), public_tokenizers.PATTERN, chunk=64, overlap=overlap)
    assert {r["n"]: r["ids"] for r in encoded.collect()} == {i: plain.encode_ordinary(t) for i, t in rows}


def test_decoding(spark):
    df = spark.createDataFrame([(1, [0, 5, 300]), (2, []), (3, None)], "k int, tokens array<int>")
    ranks = bpe.read_ranks(PATH)
    by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
    found = {r["k"]: bytes(r["decoded"]) for r in bpe.decode(df, "tokens", ranks, public_tokenizers.PATTERN).collect()}
    assert found == {1: by_id[0] + by_id[5] + by_id[300], 2: b"", 3: b""}


def test_empty(spark):
    assert bpe.documents_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
