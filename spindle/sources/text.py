"""Sources of JSON text: paths, URLs, streams, compressed or not, as rows (line, raw).

Spark reads what it can split or decompress itself. What only the driver can open (HTTP, xz, streams) is staged to
the workspace first. Files are read in parallel, by blocks; lines get their numbers later, from counts of the blocks.
"""

from __future__ import annotations

import lzma
import os
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit
from urllib.request import url2pathname, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import canonical
from spindle.model import SIDES, InputError
from spindle.sources.workspace import Workspace

CHUNK = 1 << 20
#: Seconds that a server may keep silent.
TIMEOUT = 60
READ_ERRORS = (OSError, EOFError, ValueError, RuntimeError, lzma.LZMAError)


def _chunks(stream: Any, side: int) -> Iterator[bytes]:
    while True:
        try:
            chunk = stream.read(CHUNK)
        except READ_ERRORS as error:
            raise InputError(f"invalid input ({type(error).__name__})", SIDES[side]) from error
        if not chunk:
            return
        yield chunk.encode("utf-8") if isinstance(chunk, str) else chunk


def _suffix(name: str) -> str:
    return os.path.splitext(urlsplit(name).path if "://" in name else name)[1].lower()


def local_path(source: Any) -> str | None:
    """The local file that a path or file URL names."""
    name = os.fspath(source) if isinstance(source, str | os.PathLike) else None
    if name is None or isinstance(name, bytes):
        return None
    parts = urlsplit(name)
    if parts.scheme == "file" and parts.netloc in ("", "localhost"):
        return url2pathname(parts.path)
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", name) else name


def prepare(source: Any, side: int, workspace: Workspace) -> str:
    """A path that Spark can read, with the characters of patterns escaped."""
    try:
        if hasattr(source, "read"):
            return workspace.stage(f"{SIDES[side]}.jsonl", _chunks(source, side))
        name = os.fspath(source)
        path = local_path(name)
        if path is not None:
            if _suffix(path) == ".xz":
                with lzma.open(path) as stream:
                    return workspace.stage(f"{SIDES[side]}.jsonl", _chunks(stream, side))
            if not os.path.isdir(path):  # a folder is all of its files
                with open(path, "rb"):
                    pass
            return "file://" + re.sub(r"([*?\[\]{}\\])", r"\\\1", os.path.abspath(path))
        if urlsplit(name).scheme in ("http", "https"):
            with urlopen(name, timeout=TIMEOUT) as stream:  # noqa: S310
                if _suffix(name) == ".xz":
                    return workspace.stage(f"{SIDES[side]}.jsonl", _chunks(lzma.LZMAFile(stream), side))
                return workspace.stage(f"{SIDES[side]}.jsonl{_suffix(name) if _suffix(name) in ('.gz', '.bz2', '.zst') else ''}", _chunks(stream, side))
        return name  # a store that Spark has a file system for
    except READ_ERRORS as error:
        if isinstance(error, InputError):
            raise
        raise InputError(f"invalid input ({type(error).__name__})", SIDES[side]) from error


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, file, start, m, raw) of each physical line: what block of what file it is in, and m that rises by one within the block."""
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select(F.xxhash64(file, start).alias("block"), file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("m"), F.col("value").cast("binary").alias("raw"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(null block, file and start, m, raw) of each element of a file's top-level array, m its place from 1; m 0 holds the name of an error that ended the reading."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, k = [], 0
                try:
                    for k, (_, text) in enumerate(canonical.elements(bytes(content).decode("utf-8")), 1):
                        rows.append((k, text.encode("utf-8")))
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=["m", "raw"])
                            rows = []
                except (ValueError, ArithmeticError, RecursionError) as error:
                    rows.append((0, type(error).__name__.encode()))
                yield pd.DataFrame(rows, columns=["m", "raw"])

    suffix = _suffix(path)
    if suffix in (".gz", ".bz2", ".zst"):  # one record that holds the whole decompressed text
        whole = spark.read.option("wholetext", True).text(path).select(F.col("value").cast("binary").alias("content"))
    else:
        whole = spark.read.format("binaryFile").load(path).select("content")
    # An element's place is its own number: the array is one block, of which m counts from 1 and not from its first row.
    found = whole.mapInPandas(split, "m long, raw binary").repartition(spark.sparkContext.defaultParallelism)
    return found.select(F.lit(None).cast("long").alias("block"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("start"), "m", "raw")
