"""What the text operators share: tables, shared scratch space, Arrow batches, word hashes, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word everywhere here: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = b" \t\n\v\f\r"

_LOCAL: dict[str, str] = {}


#: Rows of a batch that Python workers get at once, at most: rows of these tables may be long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    That folder is ``spark.checkpoint.dir``. Only a local session may leave it unset: it then gets a
    temporary folder that goes when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="spindle-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], True)
        base = "file://" + _LOCAL["dir"]
    return f"{base.rstrip('/')}/spindle-{uuid.uuid4().hex}"


#: Tables that were written and not discarded yet: path, and the JVM's view of the file system that it is on.
_WRITTEN: dict[str, tuple] = {}
_LOCK = threading.Lock()
#: Sessions that are writing just now: how many tables, and the setting that they had before.
_WRITING: dict[int, list] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """Lets shuffle files go as soon as a write ends; the session's own setting is back when its last write has ended."""
    with _LOCK:
        held = _WRITING.setdefault(id(spark), [0, spark.conf.get(_CLEAN, "false")])
        held[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_CLEAN, held[1])
                del _WRITING[id(spark)]


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation.

    Its shuffle files go as soon as it is written, so a chain of stored steps needs the disk of its
    largest step and not of their sum. The table itself goes when it is discarded, or when Python ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    _WRITTEN[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    with _cleaning(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._spindle_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables, on whatever file system: nothing will read them any more. Others are left alone."""
    for df in tables:
        path = getattr(df, "_spindle_path", None)
        if path in _WRITTEN:
            _delete(path)


def _delete(path: str) -> None:
    jvm, conf = _WRITTEN.pop(path)
    with contextlib.suppress(Exception):  # what cannot be deleted now only costs space
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        _delete(path)


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column's; Spark's names have no case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame, *columns) -> DataFrame:
    """df dealt out evenly by a hash of columns over the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8, without assuming that it is valid."""
    return column.cast(pa.binary()).to_pylist()


def as_text(column: pa.Array) -> list[str | None]:
    """Values of a string column; bytes that are not UTF-8 read as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [b if b is None else b.decode("utf-8", "replace") for b in as_bytes(column)]


def small(batches: Iterator[pa.RecordBatch], column: int | str, limit: int = 3 << 18) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column holds about limit bytes in each, one row at least. Freed memory goes back when they end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a worker for later tasks, and what it holds counts until then."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


# --- hashes of words, many at a time ---------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(WORD_BREAKS)] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // 65_536) * 65_536
        _POWERS[:] = [np.multiply.accumulate(np.full(size, b, dtype=np.uint64)) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts, as arrays over all of them.

    hash: 64 bits a word; doc: index of its text; start, end: bytes in data; first: index of each text's
    first word, with the total at the end. A null text has no words.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.data = b"\n".join([t or b"" for t in texts]) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        gap = _BREAK[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[: len(raw)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.hash)

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether those k words lie within one text)."""
        n = len(self)
        if n < k:
            return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        h = np.full(n - k + 1, (seed * 2 + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + self.hash[j : n - k + 1 + j]
            h ^= h >> np.uint64(29)
        out = np.zeros(n, dtype=np.uint64)
        out[: n - k + 1] = mix(h)
        inside = np.zeros(n, dtype=bool)
        inside[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return out, inside


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges (a, b): component is the smallest node that its links reach.

    Alternates large stars and small stars: each node's larger, then smaller, neighbours are linked to
    its smallest neighbour, until nothing changes. Each round is sums by key and joins, written to the
    shared folder, the sums before they are joined, so that Spark can split the rows of a hot node; no neighbourhood is ever gathered. Null ends and loops are dropped. It ends after a
    number of rounds of the order of the logarithm of the longest path; more than `rounds` is an error.
    """
    links = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    links = stored(links)
    last = None
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = stored(large.distinct())
        down = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small_ = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u > v")
            .distinct()
        )
        before, links = links, stored(small_)
        discard(before, low, large, down)
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = links.groupBy("u").agg(F.min("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.select(F.col("u").alias("node"), "component").unionAll(roots)
