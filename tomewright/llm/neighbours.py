"""Approximate nearest neighbours over balanced posting lists (operator 4).

A bounded sample of vectors (SAMPLE_PER_LIST for each list, SAMPLE_MOST at most, those of the least
hashes of vec_id) is split by balanced k-means, level by level, into clusters of equal size; their
centroids and a graph of near centroids are all that is broadcast (MOST_LISTS centroids at most).
Every vector of the table is put into the posting list of its nearest centroid, and boundary
vectors into those of other centroids nearly as near, unless a list already chosen is nearer to
that centroid than both the vector and the chosen list's own neighbours in the graph are.
Centroids are searched by a beam over the graph. Of the lists that it finds a query reads those that are at
most a ratio as far as its nearest one, so a query amid a cluster reads few and one between clusters more. Ratio and beam are fitted at the
table's own size: PROBES vectors are compared with all others; the beam is the least that holds TARGET of their true
neighbours, and the ratio the least within which WITHIN of those lie. A query's nearest list is read first; from the others only vectors come
that are no farther than the k-th found there. Vectors are compared in double
precision. Lists above LIST_LIMIT rows are dealt into blocks, so equal or crowded vectors don't
gather in one task. A query that finds too few reads all lists.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; a vec_id counts once (repeated rows and other vectors of a vec_id
give way to its least vector); ties go to the smaller vec_id; other columns are ignored; an empty
table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.session import materialize

LIST_ROWS, MOST_LISTS, LIST_LIMIT = 256, 8192, 2048
SAMPLE_PER_LIST, SAMPLE_MOST = 64, 1 << 17
NEIGHBOURS, BEAM, REPLICAS = 16, 48, 4
#: A vector is replicated to lists whose centroid is within this ratio of the nearest.
REPLICA_RATIO = 1.15
#: Vectors compared with all others to find how many lists to read, and the share of their neighbours to be found.
PROBES, TARGET, WITHIN = 256, 0.995, 0.997
#: Queries nearer to a centroid than this part of the lists' mean spacing count as so far away.
LEAST = 0.1
FANOUT, ROUNDS = 8, 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def split(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """A label of k for each point: Lloyd's rounds with a price on crowded clusters."""
    centroids = points[rng.choice(len(points), k, replace=False)]
    labels = np.zeros(len(points), np.int64)
    share = len(points) / k
    crowd = np.zeros(k)
    for _ in range(ROUNDS):
        d = distances(points, centroids)
        labels = np.argmin(d + d.mean() * 0.25 * crowd, axis=1)
        sizes = np.bincount(labels, minlength=k)
        crowd = crowd + 0.5 * (sizes / share - 1)
        centroids = np.stack([points[labels == j].mean(0) if sizes[j] else points[rng.integers(len(points))] for j in range(k)])
    return labels


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """About ``lists`` centroids of clusters of about equal size."""
    rng, out, todo = np.random.default_rng(seed), [], [(points, lists)]
    while todo:
        some, k = todo.pop()
        if k <= 1 or len(some) < 2 * k or (some == some[0]).all():
            out.append(some.mean(0))
            continue
        ways = min(FANOUT, k)
        labels = split(some, ways, rng)
        sizes = np.bincount(labels, minlength=ways)
        if sizes.max() == len(some):
            out.append(some.mean(0))
            continue
        for j in np.flatnonzero(sizes):
            todo.append((some[labels == j], max(1, round(k * sizes[j] / len(some)))))
    return np.unique(np.stack(out), axis=0).astype(np.float32)


@dataclass(frozen=True)
class ListIndex:
    centroids: np.ndarray
    graph: np.ndarray  #: neighbours of each centroid: the nearest, and some far ones
    entries: np.ndarray  #: where a search begins
    spacing: np.ndarray  #: mean distance of each centroid to its near ones in the graph

    @classmethod
    def of(cls, centroids: np.ndarray, seed: int = 3) -> ListIndex:
        n, rng = len(centroids), np.random.default_rng(seed)
        near = min(NEIGHBOURS, n)
        graph, spacing = np.empty((n, near + 4), np.int32), np.zeros(n, np.float32)
        for at in range(0, n, 1024):
            d = distances(centroids[at : at + 1024], centroids)
            graph[at : at + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
            # its distance to itself is among them
            spacing[at : at + 1024] = np.take_along_axis(d, graph[at : at + 1024, :near], 1).sum(1) / max(1, near - 1)
        graph[:, near:] = rng.integers(0, n, (n, 4))
        return cls(centroids, graph, rng.choice(n, min(n, 16), replace=False).astype(np.int32), spacing)

    def search(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids that the graph leads to, nearest first, and their distances."""
        n, beam = len(vectors), min(beam, len(self.centroids))
        own = (vectors * vectors).sum(1)
        squares = (self.centroids * self.centroids).sum(1)

        def far(ids: np.ndarray) -> np.ndarray:
            dots = np.einsum("nd,nkd->nk", vectors, self.centroids[ids])
            return np.maximum(own[:, None] + squares[ids] - 2 * dots, 0)

        ids = np.tile(self.entries, (n, 1))
        dist, done = far(ids), np.zeros(ids.shape, bool)
        for _ in range(4 * beam):
            open_ = np.where(done, np.inf, dist)
            pick = np.argmin(open_, axis=1)
            row = np.arange(n)
            if not np.isfinite(open_[row, pick]).any():
                break
            done[row, pick] = True
            more = self.graph[ids[row, pick]]
            ids, dist = np.concatenate([ids, more], axis=1), np.concatenate([dist, far(more)], axis=1)
            done = np.concatenate([done, np.zeros(more.shape, bool)], axis=1)
            # a centroid once: what was looked at comes before what wasn't
            order = np.lexsort((~done, ids), axis=1)
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
            dist[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    def compared(self, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest of all centroids, nearest first, and their distances."""
        ids, dist = [], []
        for at in range(0, len(vectors), 512):
            d = distances(vectors[at : at + 512], self.centroids)
            ids.append(np.argsort(d, axis=1, kind="stable")[:, :most].astype(np.int32))
            dist.append(np.take_along_axis(d, ids[-1], 1))
        return np.concatenate(ids), np.concatenate(dist)

    def postings(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: each vector's nearest list, and the others that it is replicated to."""
        ids, dist = self.search(vectors, min(16, len(self.centroids)))
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = np.isfinite(dist[:, j]) & (dist[:, j] <= REPLICA_RATIO * dist[:, 0]) & (chosen.sum(1) < REPLICAS)
            for i in range(j):
                apart = np.sqrt(((self.centroids[ids[:, i]] - self.centroids[ids[:, j]]) ** 2).sum(1))
                # centroids of unstructured vectors are all nearer to each other than to any vector
                ok &= ~(chosen[:, i] & (apart < np.minimum(dist[:, j], self.spacing[ids[:, i]])))
            chosen[:, j] = ok
        row, col = np.nonzero(chosen)
        return row, ids[row, col]

    def base(self, dist: np.ndarray) -> np.ndarray:
        """What the ratio is of: each query's distance to its nearest centroid, if that isn't next to nothing."""
        return np.maximum(dist[:, :1], LEAST * float(self.spacing.mean()))

    def lists(self, vectors: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs that queries read, nearest first: of the ``most`` nearest lists that the graph leads to, those at
        most ``ratio`` as far as the nearest."""
        ids, dist = self.search(vectors, max(BEAM, most + most // 4))  # wider than what is read, so that the last are found too
        ids, dist = ids[:, :most], dist[:, :most]
        row, col = np.nonzero(np.isfinite(dist) & (dist <= ratio * self.base(dist)))
        return row, ids[row, col]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"))
    most = sizes.orderBy(F.col("c").desc(), F.col("d").desc()).first()
    rows = rows.where(F.size("v") == (most.d if most else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def build(vectors: DataFrame, list_rows: int = LIST_ROWS) -> ListIndex | None:
    """Fit centroids and their graph on the bounded sample of (vec_id, v)."""
    n = vectors.count()
    if not n:
        return None
    lists = min(MOST_LISTS, max(1, -(-n // list_rows)))
    size = min(SAMPLE_MOST, SAMPLE_PER_LIST * lists)
    sample = vectors.select("vec_id", F.col("v").cast("array<float>").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toPandas()
    return ListIndex.of(balanced_centroids(np.stack(sample.v.to_numpy()).astype(np.float32), lists))


def _listed(rows: DataFrame, index: ListIndex, how: str, *more: float, ranked: bool = False) -> DataFrame:
    """(list, vec_id, v): each vector once for each list that it is in, or reads; ``ranked`` adds ``nth``, from 0 for its first."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                flat = part.column(1).flatten().to_numpy()
                row, lists = getattr(own, how)(flat.reshape(part.num_rows, -1).astype(np.float32), *more)
                take, nth = pa.array(row), (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
                arrays = [pa.array(lists.astype(np.int32)), part.column(0).take(take), part.column(1).take(take), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(arrays[: 3 + ranked], names=["list", "vec_id", "v", "nth"][: 3 + ranked])

    return rows.select("vec_id", "v").mapInArrow(run, "list int, vec_id long, v array<double>" + ", nth int" * ranked)


def nearest(queries: np.ndarray, names: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest of ``points`` of each query but itself; the smaller id within ties."""
    out, squares = [], (points * points).sum(1)
    step = max(1, (1 << 21) // max(1, len(points)))
    for at in range(0, len(queries), step):
        q, own = queries[at : at + step], (queries[at : at + step] ** 2).sum(1)
        # products tell which rows can be among the k nearest; their distances are then taken one by one
        d = own[:, None] + squares[None, :] - 2 * (q @ points.T)
        d[names[at : at + step, None] == ids[None, :]] = np.inf
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * (own + squares.max())
        row, col = np.nonzero((d <= (last + slack)[:, None]) & np.isfinite(d))
        exact = np.sqrt(((points[col] - q[row]) ** 2).sum(1))
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((row[nth < k] + at, col[nth < k], exact[nth < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _nearest(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        names, ids = queries.vec_id.to_numpy(), rows.vec_id.to_numpy()
        row, col, score = nearest(np.stack(queries.v.to_numpy()), names, np.stack(rows.v.to_numpy()), ids, k)
        kept = score <= queries.bound.to_numpy()[row]
        row, col, score = row[kept], col[kept], score[kept]
        return pd.DataFrame({"query_id": names[row], "vec_id": ids[col], "score": score})

    return run


def fit_ratio(vectors: DataFrame, queries: DataFrame, index: ListIndex, k: int, probes: int = PROBES, target: float = TARGET) -> tuple[float, int]:
    """(ratio, most): the least number of nearest lists that hold ``target`` of the k true neighbours of a sample of the
    queries, and the least ratio of distances within which WITHIN of those lie."""
    spark = vectors.sparkSession
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).toPandas()
    if not len(some):
        return 1.0, 1
    names, points = some.vec_id.to_numpy(), np.stack(some.v.to_numpy())
    order, dist = index.compared(points.astype(np.float32), len(index.centroids))
    reach, rank = np.empty(order.shape), np.empty(order.shape, np.int32)
    np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.int32)[None, :], 1)
    np.put_along_axis(reach, order, dist / index.base(dist), 1)  # of each probe, how far each list is, as a ratio
    shared = spark.sparkContext.broadcast((index, names, points, reach, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, points, reach, rank = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, v = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                row, col, score = nearest(points, names, v, ids, k)
                # the nearest list that holds a copy of the neighbour
                which, lists = own.postings(v.astype(np.float32))
                starts = np.searchsorted(which, np.arange(len(ids) + 1))
                n = np.diff(starts)[col]
                flat = np.repeat(starts[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first = lambda of: np.minimum.reduceat(of[np.repeat(row, n), lists[flat]], np.cumsum(n) - n) if len(n) else np.empty(0, of.dtype)  # noqa: B023, E731
                arrays = [names[row], ids[col], score, first(reach), first(rank)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["query_id", "vec_id", "score", "at", "nth_list"])

    found = vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double, at double, nth_list int")
    true = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("nth") <= k)
    told = true.select("at", "nth_list").collect()  # k rows for each probe
    if not told:
        return 1.0, 1
    at = lambda found, share: np.sort(found)[min(len(found) - 1, int(np.ceil(share * len(found))))]
    ratios, ranks = (np.array([r[c] for r in told]) for c in ("at", "nth_list"))
    most = int(at(ranks, target)) + 1
    return max(1.0, float(at(ratios[ranks < most], WITHIN)) * (1 + 1e-6)), most


def search(rows: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each row that ``queries`` (a condition on
    ``vec_id``) picks, by Euclidean distance."""
    vectors = materialize(usable(rows, id_col, vector_col), "vectors")
    index = build(vectors, list_rows)
    if index is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    posted = materialize(_listed(vectors, index, "postings"), "postings")
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / LIST_LIMIT).cast("int").alias("blocks"))
    # one row a list, at most MOST_LISTS of them
    sizes = F.broadcast(materialize(sizes, "lists"))
    posted = posted.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = vectors.where(queries)
    ratio, most = fit_ratio(vectors, asked, index, k)
    reads = materialize(_listed(asked, index, "lists", ratio, most, ranked=True), "reads")
    near = materialize(_compare(reads.where("nth = 0").withColumn("bound", F.lit(float("inf"))), posted, sizes, k), "near")
    # the k-th found in the nearest list bounds what the others can add
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    bounds = near.distinct().withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    others = reads.where("nth > 0").drop("nth").join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = materialize(near.unionByName(_compare(others, posted, sizes, k)), "found")
    n = vectors.count()
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("c")).where(F.col("c") >= min(k, n - 1))
    short = asked.join(enough, asked.vec_id == enough.query_id, "left_anti")
    if n > 1 and short.limit(1).count():
        everywhere = short.select(F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))).alias("list"), "vec_id", "v")
        found = found.unionByName(_compare(everywhere.withColumn("bound", F.lit(float("inf"))), posted, sizes, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _compare(asked: DataFrame, posted: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The k nearest of each block that a query reads, those within its ``bound``."""
    spread = asked.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = spread.select("list", "block", "vec_id", "v", "bound").groupBy("list", "block")
    right = posted.select("list", "block", "vec_id", "v").groupBy("list", "block")
    return left.cogroup(right).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
