"""Language identification.

Method: string-kernel classification. The kernel of two texts is a blend, over n = 1, 2, 3, of their
n-gram presence kernels |A & B| / sqrt(|A| |B|), with A and B the sets of n-grams that occur. A Nyström map
takes a text to its kernels with landmark texts times the inverse root of the landmarks' own kernel
matrix; one-versus-rest kernel ridge regression in that space gives a score for each language. Texts are
scored by batched matrix products.

n-grams are of bytes, after A-Z are lower-cased, digits and ASCII punctuation read as blanks; an n-gram
is known by a slot of a table, as sets need not tell all n-grams apart. Whole texts are read.

Defined results: `und` with score 0 for a null text and for one without any letter; ties go to the
language that sorts first; if no labelled text can be learned from, all is `und`; equal texts are learned from once. Neither language,
source nor id is an input of a prediction. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, small, table

#: Texts learned from, of each language at most: a bound on the sample that the classifier is fitted on.
SAMPLE = 400
#: Of these, landmarks of each language.
LANDMARKS = 24
#: Slots for 1-grams, 2-grams and 3-grams, and the weights of their kernels.
SLOTS, BLEND = (256, 2048, 4096), (0.2, 0.3, 0.5)
RIDGE = 1e-2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_LETTER = regex.compile(r"\p{L}")


def grams(texts: list[bytes]) -> np.ndarray:
    """float32 rows of 1 for each slot that a text's n-grams fall into, else 0."""
    out = np.zeros((len(texts), sum(SLOTS)), dtype=np.float32)
    if not texts:
        return out
    raw = _FOLD[np.frombuffer(b"".join(texts) + b"  ", dtype=np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=0))
    n = len(row)
    a, b, c = raw[:n].astype(np.uint32), raw[1 : n + 1].astype(np.uint32), raw[2 : n + 2].astype(np.uint32)
    ends = np.repeat(ends, np.diff(ends, prepend=0))
    flat, at = out.reshape(-1), row * sum(SLOTS)
    left = ends - np.arange(n)
    offset = 0
    for k, (gram, slots) in enumerate(zip((a, (a * 977 + b * 131) % SLOTS[1], (a * 40_503 + b * 2_654 + c * 31) % SLOTS[2]), SLOTS, strict=True)):
        where = at + gram + offset
        flat[where if not k else where[left > k]] = 1
        offset += slots
    return out


def blended(out: np.ndarray) -> np.ndarray:
    """The rows of grams(), in place, with each 1 as weight / sqrt(size of the set), so that row products are kernels."""
    offset = 0
    for slots, weight in zip(SLOTS, BLEND, strict=True):
        part = out[:, offset : offset + slots]
        part *= np.sqrt(weight / np.maximum(part.sum(1, keepdims=True), 1))
        offset += slots
    return out


def presence(texts: list[bytes]) -> np.ndarray:
    return blended(grams(texts))


def packed(texts: list[bytes]) -> list[bytes]:
    """The rows of grams() as bits: what a text weighs in a sample, however long it is."""
    return [row.tobytes() for row in np.packbits(grams(texts).astype(bool), axis=1)]


def unpacked(rows: list[bytes]) -> np.ndarray:
    bits = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    return blended(np.unpackbits(bits, axis=1, count=sum(SLOTS)).astype(np.float32))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text and language, from -1 or less to 1 or more."""
        k = presence(texts) @ self.landmarks.T
        return np.concatenate([k, np.ones((len(k), 1), dtype=np.float32)], axis=1) @ self.weights


def fit(rows: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """From packed rows and their languages."""
    names = sorted(set(languages))
    if not names:
        return None
    which = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(which == k)[:landmarks] for k in range(len(names))])
    z = unpacked([rows[i] for i in chosen])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = np.concatenate([unpacked(rows[i : i + 256]) @ z.T for i in range(0, len(rows), 256)]).astype(np.float64) @ root
    phi = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
    y = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.bincount(which, minlength=len(names))
    w = (len(which) / len(names) / share)[which][:, None]
    solved = np.linalg.solve(phi.T @ (w * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (w * y))
    return Model(names, z, np.concatenate([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def readable(text: Column) -> Column:
    """Whether there is a letter."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, text_col: str, lang_col: str, train: Column, sample: int = SAMPLE) -> Model | None:
    """Fitted on up to `sample` different labelled texts of each language, chosen by their hashes.

    Both passes are jobs over all tasks at once; executors turn the texts into bits, so the driver gets as many bytes
    of a long text as of a short one. What is broadcast and gathered grows with the number of languages alone.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & readable(F.col(text_col)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col), F.lit("langid")).alias("h"), F.col(text_col).alias("text"))
    # The smallest hash in each slot: a partial aggregate keeps a bounded number of them in each task.
    picked = rows.groupBy("lang", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2, 1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed(as_bytes(batch.column(2))), pa.binary())], names=["lang", "h", "bits"])

    found = rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").mapInArrow(run, "lang string, h long, bits binary")
    got = found.groupBy("lang", "h").agg(F.min("bits").alias("bits")).toArrow().to_pylist()  # repeated texts once
    got.sort(key=lambda r: (r["lang"], r["h"]))
    return fit([r["bits"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, text_col: str, model: Model | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score, which take the place of columns that have these names."""
    docs = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches, at, 1 << 18):
            texts = as_bytes(batch.column(at))
            ok = np.array([t is not None and m is not None and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], dtype=bool)
            names, values = ["und"] * len(texts), np.zeros(len(texts))
            where = np.flatnonzero(ok)
            for k in range(0, len(where), 256):
                part = where[k : k + 256]
                f = m.scores([texts[i] for i in part]).astype(np.float64)
                e = np.exp(4 * (f - f.max(1, keepdims=True)))
                best = f.argmax(1)
                values[part] = (e / e.sum(1, keepdims=True))[np.arange(len(part)), best]
                for i, b in zip(part.tolist(), best.tolist(), strict=True):
                    names[i] = m.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(values)], names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str, parts: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 2, F.lit(False))


def documents_languages(docs: DataFrame) -> DataFrame:
    model = learn(docs, "text", "lang", ~held_out("doc_id", 4))
    rows = docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), "text")
    return predict(rows, "text", model).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_languages(table(spark, sf_dir, "documents"))
