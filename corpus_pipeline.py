"""A corpus pipeline over `documents`: each stage works on all rows that the one before it kept.

language  texts without any letter are rejected
near      of each group of near duplicates, one row stays, of the least id
benchmark documents in which a window of a benchmark item occurs are rejected
secrets   every span found is replaced by a mark, and n_chars follows
tokens    the texts' token ids, with digests of them and of the decoded bytes

All stages but the last return the columns of documents. Rows with a null or empty text are rejected by the
first stage; nulls in other columns pass; of repeated rows one stays; empty tables give empty results;
extra columns stay through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import bpe, decontaminate, langid, minhash, secrets
from spindle.llm.common import bounded_batches, discard, fresh, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the classifier tells; it learns from those not held out."""
    bounded_batches(spark)
    model = langid.learn(docs, "text", "lang", ~langid.held_out("doc_id", 4))
    if model is None:  # nothing to learn from, so no document is rejected for it
        return docs.where(langid.readable(docs["text"]))
    told, sure = fresh(docs.columns, "language", "certainty")
    return langid.predict(docs, "text", model, told, sure).where(F.col(told) != "und").drop(told, sure)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates; a document is an id with a text."""
    bounded_batches(spark)
    found = minhash.classes(docs, "doc_id", "text")
    key = fresh(docs.columns, "place", "th")
    named = lambda df: df.select(F.col("place").alias(key[0]), F.col("th").alias(key[1]))
    first = (F.col("class") == F.col("place")) & (F.col("class_th") == F.col("th"))
    rows = docs.withColumns({key[0]: minhash.place("doc_id"), key[1]: F.xxhash64("text")})
    left = rows.join(named(found.where(~first)), key, "left_anti")
    repeated = named(found.where(first & (F.col("rows") > 1)))
    once = left.join(repeated, key, "left_anti").unionByName(left.join(repeated, key, "left_semi").dropDuplicates(key))
    return once.drop(*key)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs, however long they are."""
    done = decontaminate.contamination(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    i, th = fresh(docs.columns, "id", "th")
    bad = done.where("n_hit > 0").select(F.col("id").alias(i), F.col("th").alias(th)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[i]) & (F.xxhash64(docs["text"]) == bad[th]), "left_anti")


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut out."""
    bounded_batches(spark)
    (spans,) = fresh(docs.columns, "spans")
    found = secrets.scan(docs, "text", secrets.learn(docs, "text"), spans)
    cut = secrets.redact(found, "text", spans)
    n_chars = F.when(F.size(spans) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).drop(spans)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    bounded_batches(spark)
    return bpe.documents_digests(docs)


STAGES = [("language", language), ("near", near), ("benchmark", benchmark), ("secrets", secret), ("tokens", tokens)]

#: Similarity, trained models and BPE are not expressible in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            discard(before)
    return docs
