"""Near-duplicate embeddings.

Method: product quantisation. Unit vectors are put on coarse inverted lists (nearest centroid), and their residuals are
coded by the nearest of 256 sub-centroids in each subspace. Every vector is a query: it probes the lists
of its nearest centroids, where its residual's squared distances to all sub-centroids are tabulated and the
codes' distances looked up and added (asymmetric distances). Each vector keeps the error of its own code, so
a vector may be passed over only if even that error cannot bring it within the wanted distance: within the
probed lists no link is missed. Candidates are reranked by their exact cosine in double precision.

The number of lists grows with the root of the number of vectors. Up to FIRST of them are clusters of the sample; beyond
that each cluster is cut by the same centroids of residuals, so that lists outgrow the sample. Vectors of different
lengths never meet: each length of the sample has centroids of its own, and a length that the sample lacks has one list
without any, within which all are compared.

Equal vectors are compared once and counted as often as they occur. A list is cut into blocks of members
and blocks of queries, so no task gets a whole list, however full; a task sends on counts, and a spanning
forest of the links that it found, never the pairs. Vectors are shuffled as they came, in single precision if
that is what they have, and made unit vectors in double precision where they are compared. Centroids and sub-centroids
are fitted on a bounded sample; all vectors are indexed and all are queries.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component has no links; rows of one id
count as different vectors with links of their own, and meet in one component; rows of a null id have links like others, but no id
to name a component, so the component of such rows alone is null, and one of them is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, mix, spread, stored, table

COSINE = 0.9
#: Vectors that centroids and sub-centroids are fitted on, at most.
SAMPLE = 16_384
#: Bounds of the number of coarse lists, which is 4 times the root of the number of vectors between them: enough for four billion.
LISTS = (16, 1 << 18)
#: Of these, clusters of the sample; more come from cutting each of them.
FIRST = 4096
PROBES, SUBSPACES, CODES = 16, 8, 256
#: Rows of a block of members, and of a block of queries.
MEMBERS, QUERIES = 1024, 2048


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest centres of each row, the nearest first."""
    out = []
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        if k == 1:
            out.append(d.argmin(1)[:, None])
        else:
            best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(best, np.take_along_axis(d, best, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def kmeans(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Centres of at most k clusters; the start is an even choice of the rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(turns):
        at = nearest(x, centres)[:, 0]
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centroids and, for each subspace, sub-centroids of residuals."""

    coarse: np.ndarray
    sub: list[np.ndarray]

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(s.shape[1] for s in self.sub)])

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code in each subspace, error of the code)."""
        code = np.zeros((len(residuals), len(self.sub)), dtype=np.uint8)
        error = np.zeros(len(residuals))
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            code[:, k] = nearest(residuals[:, a:b], self.sub[k])[:, 0]
            error += ((residuals[:, a:b] - self.sub[k][code[:, k]]) ** 2).sum(1)
        return code, np.sqrt(error)

    def tables(self, residuals: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each row to the sub-centroids of each subspace."""
        parts = [residuals[:, a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        return [(p * p).sum(1)[:, None] - 2 * p @ s.T + (s * s).sum(1) for p, s in zip(parts, self.sub, strict=True)]


def spaced(centres: np.ndarray, least: float) -> np.ndarray:
    """The centres without those that are nearer than least to one before them, so a dense group has few lists, and its queries probe them all."""
    kept = np.zeros((0, centres.shape[1]))
    for c in centres:
        if not len(kept) or ((kept - c) ** 2).sum(1).min() >= least * least:
            kept = np.concatenate([kept, c[None]])
    return kept


def fit(x: np.ndarray, lists: int, least: float = 0.0, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
    coarse = spaced(kmeans(x, min(lists, FIRST)), least)
    rest = x - coarse[nearest(x, coarse)[:, 0]]
    if lists > FIRST:
        cuts = spaced(kmeans(rest, -(-lists // len(coarse))), least)
        coarse = (coarse[:, None] + cuts[None]).reshape(-1, x.shape[1])
        rest = x - coarse[nearest(x, coarse)[:, 0]]
    parts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
    return Index(coarse, [kmeans(rest[:, p], codes, 5) for p in parts])


def unfitted(length: int) -> Index:
    """One list around the origin, and one code, whose error lets nothing pass over."""
    parts = np.array_split(np.arange(length), min(SUBSPACES, length))
    return Index(np.zeros((1, length)), [np.zeros((1, len(p))) for p in parts])


class Book:
    """An index for each length, whose lists are numbered on from those of the lengths before; others have the list -length."""

    def __init__(self, indexes: dict[int, Index]):
        self.indexes, self.first, at = indexes, {}, 0
        for length, index in indexes.items():
            self.first[length] = at
            at += len(index.coarse)

    def near(self, u: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the lists nearest to each unit vector."""
        length = u.shape[1]
        if length not in self.indexes:
            return np.full((len(u), 1), -length, dtype=np.int32)
        coarse = self.indexes[length].coarse
        return (nearest(u, coarse, min(probes, len(coarse))) + self.first[length]).astype(np.int32)

    def of(self, number: int, length: int) -> tuple[Index, int]:
        """(index, place of its centroid) of a list."""
        return (unfitted(length), 0) if number < 0 else (self.indexes[length], number - self.first[length])


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are finite and not zero, these as unit vectors in double precision)."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(1) if x.shape[1] else np.zeros(len(x))
        ok = np.isfinite(x).all(1) & (scale > 0)
        x = x[ok] / scale[ok, None]
    return ok, x / np.sqrt((x * x).sum(1, keepdims=True))


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of the rows that are vectors of one length, their unit vectors), for each length that occurs."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(sizes[sizes > 0]):
        which = np.flatnonzero(sizes == length)
        flat = pc.cast(column.take(pa.array(which)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        ok, u = unit(flat.reshape(len(which), length))
        if ok.any():
            yield which[ok], u


def linked(index: Index, centre: int, q: np.ndarray, m: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of every pair with that cosine or more, of queries and members of the list of centre."""
    code, error = index.codes(m - index.coarse[centre])
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + error + 1e-6
    out_q, out_m = [], []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        distance = np.zeros((len(part), len(m)))
        for k, t in enumerate(index.tables(part - index.coarse[centre])):
            distance += t[:, code[:, k]]
        a, b = np.nonzero(distance <= reach * reach)
        ok = np.einsum("ij,ij->i", part[a], m[b]) >= cosine
        out_q.append(a[ok] + i)
        out_m.append(b[ok])
    return np.concatenate(out_q), np.concatenate(out_m)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def sampled(rows: DataFrame) -> dict[int, np.ndarray]:
    """Different unit vectors of the sample by length, in an order of their own."""
    slots = rows.where(F.size("v") > 0).select(F.xxhash64("v", "id").alias("h"), F.xxhash64("v", F.lit(1)).alias("g"))
    picked = slots.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("slot")).agg(F.min("g").alias("g")).select("g").distinct()
    some = rows.where(F.size("v") > 0).withColumn("g", F.xxhash64("v", F.lit(1))).join(F.broadcast(picked), "g", "left_semi")
    column = some.select("v").dropDuplicates(["v"]).toArrow()["v"].combine_chunks()
    return {u.shape[1]: np.unique(u, axis=0)[np.random.default_rng(3).permutation(len(np.unique(u, axis=0)))] for _, u in unit_rows(column)}


def links(vectors: DataFrame, id_col: str, vec_col: str, cosine: float = COSINE, probes: int = PROBES, lists: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: row, own, id, node; nodes: node, head, first, n, links; edges: a, b between nodes).

    rows has every row, with a number, its id as it came and as long, and the node of the class of equal vectors that it is
    in, null for a vector without links. Of a node there are the least id, the least row, the rows and how many others each of these is linked with.
    """
    spark = vectors.sparkSession
    element = getattr(vectors.schema[vec_col].dataType, "elementType", None)
    kind = "float" if isinstance(element, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"), F.monotonically_increasing_id().alias("row"))
    total, sample = rows.count(), sampled(rows)
    size = sum(map(len, sample.values()))
    wanted = lambda n: lists or int(np.clip(4 * np.sqrt(total * n / size), *LISTS))
    book = Book({length: fit(x, wanted(len(x)), np.sqrt(2 - 2 * cosine)) for length, x in sorted(sample.items())})
    shared = spark.sparkContext.broadcast(book)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            valid, keys, near = np.zeros(n, dtype=bool), np.zeros((2, n), dtype=np.int64), [None] * n
            for which, u in unit_rows(batch.column(2)):
                valid[which] = True
                raw = (u + 0.0).view(np.uint64)
                for salt in (0, 1):
                    h = np.full(len(u), salt + 1 + 2 * u.shape[1], dtype=np.uint64)
                    for j in range(raw.shape[1]):
                        h = mix(h * np.uint64(0x9FB21C651E98DF25) + raw[:, j])
                    keys[salt, which] = h.view(np.int64)
                for i, x in zip(which.tolist(), shared.value.near(u, probes), strict=True):
                    near[i] = x
            # A vector without links needs its place no more.
            v = pc.if_else(pa.array(valid), batch.column(2), pa.nulls(n, batch.column(2).type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), v, *(pa.array(k, mask=~valid) for k in keys), pa.array(near, pa.list_(pa.int32()))],
                names=["own", "id", "row", "v", "key_a", "key_b", "near"],
            )

    own = vectors.schema[id_col].dataType.simpleString()
    placed = stored(spread(rows, "row").mapInArrow(place_rows, f"own {own}, id long, row long, v array<{kind}>, key_a long, key_b long, near array<int>"))
    groups = placed.where("key_a is not null").groupBy("key_a", "key_b").agg(F.min("id").alias("head"), F.min("row").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()))  # numbers hold from when they are written
    numbered = stored(placed.select("row", "own", "id", "key_a", "key_b").join(groups.select("key_a", "key_b", "node"), ["key_a", "key_b"], "left").drop("key_a", "key_b"))
    heads = stored(placed.select(F.col("row").alias("first"), "v", "near").join(groups.select("node", "first", "n"), "first").drop("first"))

    # How many blocks each list needs, for its members and for the queries that probe it: as many numbers as lists.
    sizes = heads.select(F.posexplode("near").alias("nth", "list")).groupBy("list").agg(F.count("*").alias("q"), F.count_if(F.col("nth") == 0).alias("m")).where("m > 0").collect()
    blocks = spark.createDataFrame([(r["list"], -(-r["m"] // MEMBERS), -(-r["q"] // QUERIES)) for r in sizes], "list int, mb int, qb int")
    each = heads.select("node", "n", "v", "near", F.explode("near").alias("list")).join(F.broadcast(blocks), "list")
    block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = each.withColumn("q", block("qb", 1)).withColumn("m", all_of("mb")).withColumn("member", F.lit(False))
    members = each.where(F.col("list") == F.col("near")[0]).withColumn("m", block("mb", 2)).withColumn("q", all_of("qb")).withColumn("member", F.lit(True))
    columns = ["list", "m", "q", "member", "node", "n", "v", "near"]
    tasks = queries.select(columns).unionByName(members.select(columns))

    def compare(group: pa.Table) -> pa.Table:
        t = group.combine_chunks()
        is_member = t["member"].to_numpy().astype(bool)
        node, n = t["node"].to_numpy(), t["n"].to_numpy()
        qi, mi = np.flatnonzero(~is_member), np.flatnonzero(is_member)
        if not len(qi) or not len(mi):
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        u = unit(t["v"].combine_chunks().flatten().to_numpy().reshape(len(node), -1))[1]
        near = t["near"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        a, b = linked(*shared.value.of(t["list"][0].as_py(), u.shape[1]), u[qi], u[mi], cosine)
        a, b = qi[a], mi[b]
        apart = node[a] != node[b]
        a, b = a[apart], b[apart]
        # A pair that the other one's query finds too, in this list or another, is counted there for the other.
        alone = ~(near[b] == near[a][:, :1]).any(1)
        count = np.bincount(a, n[b], minlength=len(node)) + np.bincount(b[alone], n[a[alone]], minlength=len(node))
        _, slot = np.unique(node, return_inverse=True)
        least = np.zeros(slot.max() + 1, dtype=np.int64)
        least[slot] = node
        root = local_roots(slot[a], slot[b], len(least))
        edge = np.flatnonzero(root != np.arange(len(root)))
        has = np.flatnonzero(count > 0)
        return pa.table({
            "node": np.concatenate([node[has], least[edge]]), "other": np.concatenate([node[has], least[root[edge]]]),
            "links": np.concatenate([count[has].astype(np.int64), np.zeros(len(edge), dtype=np.int64)]),
        })

    found = stored(tasks.groupBy("list", "m", "q").applyInArrow(compare, "node long, other long, links long"))
    discard(placed, heads)
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = groups.select("node", "head", "first", "n").join(counts, "node", "left")
    nodes = nodes.select("node", "head", "first", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return numbered, nodes, found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, id_col: str, vec_col: str, cosine: float = COSINE, probes: int = PROBES, lists: int | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row."""
    rows, nodes, edges = links(vectors, id_col, vec_col, cosine, probes, lists)
    # Nodes that hold rows of one id meet in one component.
    several = rows.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    same = rows.join(several, "id").where("node > a").select("a", F.col("node").alias("b"))
    label = components(edges.unionAll(same))
    labelled = stored(nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # Stored before it is joined, so that Spark can split the rows of a hot component.
    whole = stored(labelled.groupBy("component").agg(F.min("head").alias("least"), F.min("first").alias("first")))
    told = labelled.select("node", "links", "component").join(whole, "component").drop("component")
    joined = rows.join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    kept = F.coalesce(F.col("id") == component, component.isNull() & F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    return joined.select(F.col("own").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
