"""Exact top-k by inner product of integer vectors: pivot tables eliminate candidates before their product is computed.

Distances of every candidate to some pivots are computed once. A query's distance to a candidate is at least the largest difference of
their distances to a pivot, and 2 q.x = |q|^2 + |x|^2 - |q - x|^2, so the table bounds every product from above.

Vectors are put in order by their nearest pivot and their distance to it, and lie in blocks of BLOCK along that order, so a block
covers short ranges of distances. A query is first compared with the block it lies in itself, whose k-th best product is a bound from below. Blocks of
queries then meet those blocks of candidates alone whose ranges allow a product that reaches it. Within a block a query takes the
candidates in order of their bounds and stops when the next one is below the k-th best product: what is left can't enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, Q_BLOCK = 1024, 256
PIVOTS = 24
PIVOT_SAMPLE = 2048
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last
STEP = 128  # candidates evaluated at first; each further step takes twice as many


def finite(vector: str = "embedding"):
    """True for vectors with components, all of them finite."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as float64, which holds it exactly."""
    return np.floor(256.0 * x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of a's rows with b's rows, exact: by float64 where sums stay below 2**53, else by integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return np.array([[int(sum(int(x) * int(y) for x, y in zip(r, s, strict=True))) for s in b] for r in a], object).clip(-(2**63), 2**63 - 1).astype(np.int64)


def pivots(vectors: DataFrame, number: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each vector length, pivots far from each other, from a bounded sample (by hash of vec_id)."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("embedding").toArrow().column("embedding").to_pylist()
    out = {}
    for size in {len(v) for v in some}:
        x = whole(np.array([v for v in some if len(v) == size], np.float64))
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(number, len(x)):
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
            if far.max() == 0:
                break
            chosen.append(int(far.argmax()))
        out[size] = x[chosen]
    return out


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot."""
    return np.stack([np.linalg.norm(x - q, axis=1) for q in p], axis=1) if len(p) else np.zeros((len(x), 0))


def in_order(vectors: DataFrame, own_pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, embedding) by vector length, nearest pivot and distance to it; equal ones by a hash, so that copies don't make one partition."""
    shared = vectors.sparkSession.sparkContext.broadcast(own_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in of_size(batch, BLOCK):
                table = distances(whole(matrix(part.column("embedding"))), shared.value.get(size, np.zeros((0, size))))
                near = table.argmin(axis=1) if table.shape[1] else np.zeros(len(table), np.int64)
                far = table[np.arange(len(table)), near] if table.shape[1] else np.zeros(len(table))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(np.full(len(near), size, np.int32)), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "embedding", "size", "near", "far"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(run, f"{common.fields(vectors, ['vec_id', 'embedding'])}, size int, near int, far double")
    keys = ["size", "near", "far", F.xxhash64("vec_id")]
    return rows.repartitionByRange(max(1, vectors.count() // (8 * BLOCK)), *keys).sortWithinPartitions(*keys).select("vec_id", "embedding")


def of_size(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one vector length, at most `most` together, in their order."""
    lengths = np.array(batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for at in range(0, len(rows), most):
            yield int(size), batch.take(pa.array(rows[at : at + most]))


RANGES = "lo array<double>, hi array<double>, norm double"


def ranges(x: np.ndarray, table: np.ndarray) -> list[pa.Array]:
    """RANGES of a block: smallest and largest distance to each pivot, and the largest squared length."""
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.float64()))
    return [one(table.min(axis=0)), one(table.max(axis=0)), pa.array([float((x * x).sum(axis=1).max())])]


def packed(vectors: DataFrame, own_pivots: dict[int, np.ndarray], at_most: int = BLOCK) -> DataFrame:
    """(size, ids, vectors, table, RANGES): blocks of up to at_most vectors of one length, with their distances to the pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast(own_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in of_size(batch, at_most):
                x = whole(matrix(part.column("embedding")))
                table = distances(x, shared.value.get(size, np.zeros((0, size))))
                ids = part.column("vec_id")
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())), common.binary([x.tobytes()]), common.binary([table.tobytes()]), *ranges(x, table)], names=["size", "ids", "vectors", "table", "lo", "hi", "norm"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"size int, ids array<long>, vectors binary, table binary, {RANGES}")


def at_home(blocks: DataFrame, k: int, every: int) -> DataFrame:
    """(query_id, size, vector, table, place, kth): the queries, with the k-th best product of their own block, null if it has fewer others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = [j for j, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                if not mine:
                    continue
                ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
                x, t = np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["table"]).reshape(len(ids), -1)
                found = [best(x[j], t[j], ids[j], x, t, ids, k)[1] for j in mine]
                kth = pa.array([int(f[k - 1]) if len(f) >= k else None for f in found], pa.int64())
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array([row["size"]] * n, pa.int32()), common.binary([x[j].tobytes() for j in mine]), common.binary([t[j].tobytes() for j in mine]), pa.array([row["block"]] * n, pa.int64()), kth], names=["query_id", "size", "vector", "table", "place", "kth"])

    found = blocks.select("block", "size", "ids", "vectors", "table").mapInArrow(run, "query_id long, size int, vector binary, table binary, place long, kth long")
    # equal rows are one query
    return found.groupBy("query_id", "size", "vector").agg(F.first("table").alias("table"), F.min("place").alias("place"), F.max("kth").alias("kth"))


def asking(queries: DataFrame, many: int) -> DataFrame:
    """(size, q_ids, q_vectors, q_table, q_kth, q_least, RANGES as q_lo, q_hi, q_norm): queries in blocks along the order of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), Q_BLOCK):
                    part = batch.take(pa.array(rows[at : at + Q_BLOCK]))
                    x, t = (np.frombuffer(b"".join(part.column(c).to_pylist())).reshape(part.num_rows, -1) for c in ("vector", "table"))
                    kth = part.column("kth").to_pylist()
                    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), one(part.column("query_id")), common.binary([x.tobytes()]), common.binary([t.tobytes()]), one(part.column("kth")), pa.array([None if None in kth else min(kth)], pa.int64()), *ranges(x, t)], names=["size", "q_ids", "q_vectors", "q_table", "q_kth", "q_least", "q_lo", "q_hi", "q_norm"])

    rows = queries.repartitionByRange(many, "size", "place", "query_id").sortWithinPartitions("size", "place", "query_id")
    return rows.select("query_id", "size", "vector", "table", "kth").mapInArrow(run, "size int, q_ids array<long>, q_vectors binary, q_table binary, q_kth array<long>, q_least long, q_lo array<double>, q_hi array<double>, q_norm double")


def meetings(asked: DataFrame, blocks: DataFrame, number: int) -> DataFrame:
    """(q_block, block): the blocks of queries and of candidates between which some product may reach a query's bound. number: of candidates' blocks."""
    bucket = F.pmod(F.xxhash64("block"), F.lit(number)).cast("int")
    own = asked.select("q_block", "size", "q_least", "q_lo", "q_hi", "q_norm", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("bucket"))
    both = own.join(blocks.select("block", "size", "lo", "hi", "norm", bucket.alias("bucket")), ["size", "bucket"])
    apart = lambda x, y: F.coalesce(F.array_max(F.zip_with(x, y, lambda a, b: a - b)), F.lit(0.0))
    gap = F.greatest(F.lit(0.0), apart("lo", "q_hi"), apart("q_lo", "hi"))
    norms = F.col("norm") + F.col("q_norm")
    bound = (norms - gap * gap) / 2 + 1e-9 * norms + 1e-6
    return both.filter(F.col("q_least").isNull() | (bound >= F.col("q_least"))).select("q_block", "block")


def best(q: np.ndarray, q_table: np.ndarray, q_id: int, x: np.ndarray, x_table: np.ndarray, x_ids: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(places, products) of the k best candidates of one block, or of all that may tie with the k-th; those below `least` may be left out."""
    norms = (x * x).sum(axis=1) + (q * q).sum()
    gap = np.abs(x_table - q_table).max(axis=1, initial=0.0)
    bound = (norms - gap * gap) / 2
    bound += 1e-9 * norms + 1e-6  # more than rounding can take away
    bound[x_ids == q_id] = -np.inf
    order = np.argsort(-bound)
    places, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, STEP
    while at < len(order):
        some = order[at : at + step]
        at, step = at + step, 2 * step
        some = some[bound[some] > -np.inf]
        if not len(some) or bound[some[0]] < least or (len(found) >= k and bound[some[0]] < found[k - 1]):
            break
        places, found = np.append(places, some), np.append(found, products(q[None], x[some])[0])
        top = np.lexsort((x_ids[places], -found))[:k]
        places, found = places[top], found[top]
    return places, found


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k best of all other rows.

    Score: inner product of floor(256 * component). Vectors that are null, empty, or hold a null or non-finite component take no
    part; products are of vectors of one length. Ties go to the smaller vec_id (a null one last). Rows with the query's own
    vec_id are no candidates of it; equal rows are candidates each, and one query. An empty table gives an empty result. Other
    columns are not used.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(finite())
    p = pivots(v)
    rows = common.written(packed(in_order(v, p), p, BLOCK).withColumn("block", F.monotonically_increasing_id()), "vectors")
    number = max(1, rows.count())
    queries = common.written(at_home(rows, k, every), "queries")
    asked = common.written(asking(queries, max(1, queries.count() // (8 * Q_BLOCK))).withColumn("q_block", F.monotonically_increasing_id()), "asked")
    pairs = meetings(asked, rows, number)
    met = pairs.join(asked.select("q_block", "q_ids", "q_vectors", "q_table", "q_kth"), "q_block").join(rows.select("block", "size", "ids", "vectors", "table"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                x_ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
                x, q = (np.frombuffer(row[n]).reshape(-1, row["size"]) for n in ("vectors", "q_vectors"))
                xt, qt = (np.frombuffer(row[n]).reshape(len(m), -1) for n, m in (("table", x), ("q_table", q)))
                out = [(i, *best(q[j], qt[j], i, x, xt, x_ids, k, -np.inf if least is None else least)) for j, (i, least) in enumerate(zip(row["q_ids"], row["q_kth"], strict=True))]
                ids = [row["ids"][p] for _, places, _ in out for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, places, _ in out for _ in places], pa.int64()), pa.array(ids, pa.int64()), pa.array(np.concatenate([f for *_, f in out]) if out else [], pa.int64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same result for DuckDB, by computing every product.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""
