"""Approximate nearest neighbours with balanced posting lists.

Centroids come from cutting a bounded sample in halves of equal size again and again, so lists are about equally long. Every row is
filed under its nearest centroid and, near a boundary, under others whose distance is hardly larger. A query finds its nearest
centroids by a best-first search in a graph of centroids, which every worker holds, and reads the lists whose centroid is not much
farther than the nearest one. Lists are spread over the cluster by number; where many rows share one, or many queries read
it, rows and queries are cut into parts that meet one by one.

Vectors of each length have an index of their own. There are at most LISTS centroids for one length whatever the table's size, so centroids and
graph stay small; lists grow beyond that, and a query reads the same share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .topk import finite, matrix

#: The bound of the sample that centroids are fitted on, in rows.
SAMPLE_ROWS = 20_000
LIST_ROWS, LISTS = 256, 4096
#: Rows and queries of a list that one task compares.
PART_ROWS, PART_QUERIES = 4096, 4096
COPIES, COPY_RATIO = 4, 1.15
#: A query reads lists up to this ratio of the nearest one's distance, PROBES times the root of the number of lists at most.
PROBE_RATIO, PROBES = 1.6, 5
NEIGHBOURS, BEAM, STEP = 24, 32, 6


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def halves(x: np.ndarray, rows: np.ndarray, depth: int, r: np.random.Generator) -> list[np.ndarray]:
    """Rows cut into 2**depth groups of equal size: by two means, dealt out half and half."""
    if depth == 0 or len(rows) < 2:
        return [rows]
    own = x[rows]
    a, b = own[r.choice(len(rows), 2, replace=False)]
    for _ in range(6):
        nearer = np.argsort(((own - a) ** 2).sum(axis=1) - ((own - b) ** 2).sum(axis=1), kind="stable")
        left, right = nearer[: len(rows) // 2], nearer[len(rows) // 2 :]
        a, b = own[left].mean(axis=0), own[right].mean(axis=0)
    return halves(x, rows[left], depth - 1, r) + halves(x, rows[right], depth - 1, r)


class Graph:
    """Centroids and, for each, the numbers of its nearest others."""

    def __init__(self, centroids: np.ndarray, near: np.ndarray | None = None):
        self.centroids = centroids.astype(np.float64)
        n = len(centroids)
        many = min(NEIGHBOURS, n - 1)
        self.near = np.zeros((n, max(1, many)), np.int64) if near is None else near
        for i in range(n if near is None else 0):
            d = ((self.centroids - self.centroids[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            if many:
                self.near[i] = np.argpartition(d, many - 1)[:many]
            if many and i + 1 < n:
                self.near[i, -1] = i + 1  # so that every centroid can be reached
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of the `many` nearest centroids found for each row of x, nearest first."""
        c, n = self.centroids, len(self.centroids)
        many = min(n, many)
        beam = min(n, max(BEAM, many))
        step = min(STEP, beam)
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), bool)
        number = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        seen[rows, number] = True
        dist = ((x[:, None] - c[number]) ** 2).sum(axis=2)
        done = np.zeros(dist.shape, bool)
        while True:
            order = np.argsort(dist, axis=1)[:, :beam]
            number, dist, done = number[rows, order], dist[rows, order], done[rows, order]
            left = ~done & np.isfinite(dist)
            if not left.any():
                break
            # the nearest few that weren't looked at
            first = np.argsort(~left, axis=1, kind="stable")[:, :step]
            use = left[rows, first]
            done[rows, first] = True
            more = self.near[number[rows, first]]
            more = np.sort(np.where(use[:, :, None], more, n).reshape(len(x), -1), axis=1)
            new = np.hstack([np.ones((len(x), 1), bool), more[:, 1:] != more[:, :-1]]) & (more < n)
            more = np.minimum(more, n - 1)
            new &= ~seen[rows, more]
            d = np.full(more.shape, np.inf)
            at, j = np.nonzero(new)
            seen[at, more[at, j]] = True
            d[at, j] = ((x[at] - c[more[at, j]]) ** 2).sum(axis=1)
            number, dist, done = np.hstack([number, more]), np.hstack([dist, d]), np.hstack([done, ~new])
        return number[:, :many], np.sqrt(dist[:, :many])


def build(vectors: DataFrame, sizes: dict[int, int]) -> dict[int, Graph]:
    """For each vector length, centroids of its rows in a bounded sample, about one for LIST_ROWS rows. sizes: rows of each length.

    A length of which the sample has hardly any rows gets one centroid, and so one list, which its queries read whole.
    """
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow().column("embedding").combine_chunks()
    lengths = some.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for size, n in sizes.items():
        x = unit(matrix(some.take(pa.array(np.flatnonzero(lengths == size))))) if (lengths == size).any() else np.zeros((1, size))
        depth = int(np.clip(np.round(np.log2(max(1.0, n / LIST_ROWS))), 0, min(np.log2(LISTS), np.log2(max(1, len(x) // 4)))))
        out[size] = Graph(np.array([x[g].mean(axis=0) for g in halves(x, np.arange(len(x)), depth, np.random.default_rng(11)) if len(g)]))
    return out


def by_size(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one vector length, at most `most` together."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for at in range(0, len(rows), most):
            yield int(size), batch.take(pa.array(rows[at : at + most]))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k nearest found of all other rows.

    Score: cosine in double precision of the original vectors, between vectors of one length. Vectors that are null, zero, empty, or hold a
    null or non-finite component take no part. A query reads lists until they hold more than k rows, so it has k neighbours
    if there are as many of its length. Ties go to the smaller vec_id (a null one last). Rows with the query's own vec_id are no candidates of
    it. Equal rows are candidates each, and one query; different vectors of one id are one query too, and a candidate's score is the
    largest found for any of them. An empty table gives an empty result. Other columns are not used.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(finite())
    v = v.filter(F.exists("embedding", lambda x: x != 0))
    out = "query_id long, rank int, vec_id long, score double"
    sizes = {r["size"]: r["n"] for r in v.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if not sizes:
        return spark.createDataFrame([], out)
    # plain values, as executors know no class of this package
    shared = spark.sparkContext.broadcast({size: (g.centroids, g.near) for size, g in build(v, sizes).items()})

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = {size: Graph(*parts) for size, parts in shared.value.items()}
        for batch in batches:
            for size, part in by_size(batch, "embedding", 2048):
                number, dist = graphs[size].search(unit(matrix(part.column("embedding"))), COPIES)
                row, place = np.nonzero(dist <= COPY_RATIO * dist[:, :1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(number[row, place].astype(np.int32)), pa.array(place == 0), *(part.column(c).take(pa.array(row)) for c in ("row", "vec_id", "embedding"))], names=["size", "list", "own", "row", "vec_id", "embedding"])

    filed = v.withColumn("row", F.monotonically_increasing_id()).mapInArrow(file, "size int, list int, own boolean, row long, vec_id long, embedding array<double>")
    filed = common.written(filed, "lists")
    lists = common.written(filed.groupBy("size", "list").agg(F.count_if("own").alias("own"), F.count(F.lit(1)).alias("n")), "sizes")
    own = {size: np.zeros(len(g[0]), np.int64) for size, g in shared.value.items()}
    for r in lists.collect():  # a row for each centroid
        own[r["size"]][r["list"]] = r["own"]
    held = spark.sparkContext.broadcast(own)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = {size: Graph(*parts) for size, parts in shared.value.items()}
        for batch in batches:
            for size, part in by_size(batch, "query", 1024):
                x, rows = unit(matrix(part.column("query"))), held.value[size]
                number, dist = graphs[size].search(x, max(8, int(np.ceil(PROBES * np.sqrt(len(rows))))))
                take = dist <= PROBE_RATIO * dist[:, :1]
                enough = np.cumsum(rows[number], axis=1)
                take |= np.hstack([np.zeros((len(x), 1), np.int64), enough[:, :-1]]) <= k
                row, place = np.nonzero(take)
                chosen = number[row, place]
                for i in np.flatnonzero(enough[:, -1] <= k):  # hardly any rows near it: all lists
                    rest = np.setdiff1d(np.arange(len(rows)), number[i])
                    row, chosen = np.append(row, np.full(len(rest), i)), np.append(chosen, rest)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(chosen.astype(np.int32)), part.column("query_row").take(pa.array(row))], names=["size", "list", "query_row"])

    queries = v.filter(F.col("vec_id") % every == 0).distinct().select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    queries = common.written(queries, "queries")
    asked = common.written(queries.mapInArrow(probe, "size int, list int, query_row long"), "asked")
    parts = lists.join(asked.groupBy("size", "list").agg(F.count(F.lit(1)).alias("asked")), ["size", "list"])
    parts = parts.select("size", "list", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"), F.ceil(F.col("asked") / PART_QUERIES).cast("int").alias("q_parts"))
    # every part of a list's rows meets every part of its queries
    part = lambda key, many: F.pmod(F.xxhash64(key), F.col(many)).cast("int")
    every_part = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    asked = asked.join(parts, ["size", "list"]).withColumn("q_part", part("query_row", "q_parts")).withColumn("part", every_part("parts")).join(queries, "query_row").select("size", "list", "part", "q_part", "query_id", "query")
    rows = filed.join(parts, ["size", "list"]).withColumn("part", part("row", "parts")).withColumn("q_part", every_part("q_parts")).select("size", "list", "part", "q_part", "row", "vec_id", "embedding")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = [("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kind})
        x = matrix(left.column("embedding").combine_chunks())
        ids = np.array([np.iinfo(np.int64).max if i is None else i for i in left.column("vec_id").to_pylist()], np.int64)
        length = np.sqrt((x * x).sum(axis=1))
        got: list[tuple] = []
        for at in range(0, right.num_rows, 512):
            part = right.slice(at, 512)
            q = matrix(part.column("query").combine_chunks())
            rough = unit(q) @ (x / length[:, None]).T
            for j, i in enumerate(part.column("query_id").to_pylist()):
                near = rough[j]
                near[ids == i] = -np.inf
                if len(near) > k:
                    cut = np.partition(near, len(near) - k)[len(near) - k] - 1e-9
                    some = np.flatnonzero(near >= cut)
                else:
                    some = np.arange(len(near))
                some = some[near[some] > -np.inf]
                # one row at a time, so that equal vectors have equal scores
                s = (x[some] * q[j]).sum(axis=1) / (length[some] * np.sqrt((q[j] * q[j]).sum()))
                top = np.lexsort((ids[some], -s))[:k]
                got.append((np.full(len(top), i), some[top], s[top]))
        place = np.concatenate([g[1] for g in got])
        left = left.select(["row", "vec_id"]).take(pa.array(place))
        return pa.table([pa.array(np.concatenate([g[0] for g in got]), pa.int64()), left.column("row"), left.column("vec_id"), pa.array(np.concatenate([g[2] for g in got]), pa.float64())], names=[n for n, _ in kind])

    keys = ["size", "list", "part", "q_part"]
    hits = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, "query_id long, row long, vec_id long, score double")
    hits = hits.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))  # a row filed in several lists
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
