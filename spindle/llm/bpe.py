"""Byte-level BPE encoding and decoding.

Method: overlapping chunk encoding. Long texts are cut into chunks that overlap; every chunk is
pre-tokenised on its own, in parallel; neighbours are stitched at the first pre-token boundary that both
see in their overlap (from a common boundary on, the pattern sees the same characters, so both go on
alike); then the stretches between stitches are encoded in parallel. Neighbours without a common boundary, as within
one endless word, are encoded as one stretch. Decoding joins raw token bytes.

Defined results: a null text is read as the empty text, which has no tokens; bytes that are not UTF-8 read
as U+FFFD; repeated rows each give a row; equal long texts are encoded once; extra columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import as_text, give_back, small, spread, stored, table

#: Characters of a chunk before the overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 512
#: Pre-tokens whose ids a worker remembers. Bounds memory only: others are encoded again.
REMEMBERED = 100_000
#: The longest contraction that the pattern matches: nearer to the end of a chunk than this, a match may differ from the text's.
MARGIN = 3


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec(dict):
    """Ids of pre-tokens, as bytes of 32-bit numbers, in a mapping that fills itself."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.ranks, self.of_piece = table, None
        tokens = [b""] * (max(table.values(), default=-1) + 1)
        for token, k in table.items():
            tokens[k] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if self.of_piece is None:  # a worker that only decodes never needs it
            import tiktoken

            # To this pattern a pre-token is one match, whatever is in it.
            self.of_piece = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        ids = array("i", self.of_piece(piece)).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The joined bytes of each row's tokens; a null row has none."""
        flat, offsets = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        raw = self.bytes[np.repeat(self.starts[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[offsets].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    key = (hash(ranks), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def lists(values: list[bytes]) -> pa.ListArray:
    """Rows of 32-bit numbers from their bytes."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(values), dtype=np.int32)))


def sure_cuts(pattern, text: str, last: bool) -> list[int]:
    """Ends of the matches that hold whatever follows the text; all of them if nothing follows."""
    found = [m.span() for m in pattern.finditer(text)]
    n = len(text)
    return [b for a, b in found if last or b < n and a + MARGIN <= n]


def encode(docs: DataFrame, id_col: str, text_col: str, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>) for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # its size is the vocabulary's
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.char_length("text") > chunk + overlap
    id_field = T.StructField("id", rows.schema["id"].dataType)
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                ids = lists([c.encode(t) for t in as_text(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])
        give_back()

    short = rows.where(~long).mapInArrow(run, T.StructType([id_field, ids_field]))

    # Long texts, each different one once.
    keyed = rows.where(long).withColumn("sha", F.sha2("text", 256))
    texts = keyed.select("sha", "text").dropDuplicates(["sha"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All chunks of each text, in time linear in its length: a built-in substring counts characters from the text's start each time."""
        for batch in small(batches, 1):
            for sha, text in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), strict=True):
                n = len(text)
                for k in range(0, n, 64 * chunk):
                    at = range(k, min(n, k + 64 * chunk), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([sha] * len(at)), pa.array(at, pa.int32()), pa.array([text[i : i + chunk + overlap] for i in at]), pa.array([i + chunk + overlap >= n for i in at]), pa.array([i + chunk >= n for i in at])],
                        names=["sha", "start", "part", "last", "final"],
                    )

    cut = texts.mapInArrow(slices, "sha string, start int, part string, last boolean, final boolean")
    cut = spread(cut, "sha", "start")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            head, tail = [], []
            for start, part, last in zip(batch.column(1).to_pylist(), as_text(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                cuts = [0, *sure_cuts(c.pattern, part, last)]
                head.append(array("i", [start + x for x in cuts if x <= overlap]).tobytes())
                tail.append(array("i", [start + x for x in cuts if chunk <= x]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(head), lists(tail)], schema=pa.schema([*batch.schema, ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    edges = T.ArrayType(T.IntegerType(), False)
    tried = stored(cut.mapInArrow(pretokenise, T.StructType([*cut.schema.fields, T.StructField("head", edges), T.StructField("tail", edges)])))
    # Where each chunk's own stretch begins and ends: numbers alone, so no task holds a text.
    order = Window.partitionBy("sha").orderBy("start")
    stops = tried.select("sha", "start", "final", "tail", F.lead("head").over(order).alias("next"))
    stops = stops.select("sha", "start", "final", F.when(~F.col("final"), F.array_min(F.array_intersect("tail", "next"))).alias("stop"))
    # Chunks without a common boundary in their overlap, as in one endless word, go into one piece with the next.
    joins = stops.select(
        "sha", "start", F.lag("stop").over(order).alias("begin"), "stop",
        F.coalesce(F.sum(F.col("stop").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("piece"),
    )
    cuts = tried.select("sha", "start", "part", "final").join(joins, ["sha", "start"])
    since = F.coalesce("begin", "start")
    upto = F.coalesce("stop", F.when(F.col("final"), F.col("start") + F.char_length("part")).otherwise(F.col("start") + chunk))
    cuts = cuts.select("sha", "piece", F.struct(since.alias("at"), F.col("part").substr(since - F.col("start") + 1, upto - since).alias("part")).alias("cut"))
    pieces = cuts.groupBy("sha", "piece").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    pieces = pieces.select("sha", F.col("cuts")[0]["at"].alias("at"), F.array_join(F.transform("cuts", lambda x: x["part"]), "").alias("part"))

    def run_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists([c.encode(t) for t in as_text(batch.column(2))])], names=["sha", "at", "ids"])

    done = pieces.mapInArrow(run_pieces, T.StructType([T.StructField("sha", T.StringType()), T.StructField("at", T.IntegerType()), ids_field]))
    joined = done.groupBy("sha").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    long_rows = keyed.select("id", "sha").join(joined, "sha").select("id", "ids")
    return short.unionAll(long_rows).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str, ranks: bytes, pattern: str) -> DataFrame:
    """encoded with a column `decoded`: the bytes of its tokens, joined."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                yield pa.RecordBatch.from_arrays([*part.columns, c.decode(part.column(at))], names=[*part.schema.names, "decoded"])
        give_back()

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """The columns of the query, from ids and decoded bytes."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def documents_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = encode(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN)
    return digests(decode(encoded, "ids", ranks, public_tokenizers.PATTERN))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_digests(table(spark, sf_dir, "documents"))
