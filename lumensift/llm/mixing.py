"""Mixing sources to target weights: systematic sampling in DataFrame functions only.

Every document of a source has the same expected number of copies, the source's target over its size.
Documents stand in a fixed order within their source; a document's copies are the whole numbers that the
running sum of expected copies, moved by one offset of the source, crosses at this document.

The running sum needs a document's place in its source. A source may hold a third of all rows, so no task
sees a whole source: it is split into cells (a class of similar sizes and a hash bucket), the few thousand
cells of a source are counted and summed, and rows are numbered within their cell alone. As similar sizes
stand together, the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 64
CLASSES_PER_DOUBLING = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target. One row per source in and out.

    The total is shared by weight; a source stops at cap * its size, and what it leaves is shared again by weight
    among the others until none is above. Sorted by cap * size / weight, the stopped sources are a first part of the
    list: with running sums over it, the level of the first list place that isn't stopped is the level of all.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("_limit", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_limit", F.lit(cap) * F.col("source_size") / F.col("_w"))
    t = t.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_w").over(everything))
    left = F.col("_total") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_w = F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / open_w)
    t = t.withColumn("_stopped", F.col("_limit") <= F.col("_level"))
    t = t.withColumn("_final", F.min(F.when(~F.col("_stopped"), F.struct(F.col("_limit"), F.col("_level")))).over(everything)["_level"])
    target = F.when(F.col("_stopped") | F.col("_final").isNull(), F.lit(cap) * F.col("source_size")).otherwise(F.col("_w") * F.col("_final"))
    return t.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).cast("double").alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """docs (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and mix_copies (0 to ceil(cap)).

    Null and empty texts have size 0; they take part with their source's rate, at no words. A source of size 0 has
    rate 0. A null source is a source of its own, last in order. Equal rows are told apart only by their place, so which
    of them is repeated makes no difference. An empty table gives an empty result. Extra columns stay; those whose
    names start with mix_ are left out.
    """
    return placed(docs.withColumn("mix_size", word_count(F.col("text"))), seed, weights, cap)


def placed(docs: DataFrame, seed: str, weights: tuple[int, ...], cap: float) -> DataFrame:
    """mix() of rows (doc_id, source, ...) that have their mix_size already."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.withColumn("mix_key", key)
    d = d.withColumn("mix_class", F.floor(F.lit(float(CLASSES_PER_DOUBLING)) * F.log2(F.col("mix_size") + F.lit(1.0))).cast("int"))
    d = d.withColumn("mix_bucket", F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") % BUCKETS)
    cells = d.groupBy(F.col("source").alias("mix_source"), "mix_class", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_n"), F.sum("mix_size").alias("mix_words"))
    sizes = cells.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_words").alias("source_size"))
    targets = source_targets(sizes, weights, cap).select(F.col("source").alias("mix_t_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    order = Window.partitionBy("mix_source").orderBy("mix_class", "mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("mix_before", F.coalesce(F.sum("mix_n").over(order), F.lit(0)))
    # a 20-bit offset, kept off whole numbers by half a step
    offset = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("mix_source"), F.lit("\u0000")))), 1, 5), 16, 10).cast("double") + 0.5) / 1048576.0
    cells = cells.join(targets, F.col("mix_source").eqNullSafe(F.col("mix_t_source"))).select(
        F.col("mix_source"), F.col("mix_class").alias("mix_c"), F.col("mix_bucket").alias("mix_b"), "mix_before", "mix_source_size", "mix_target", offset.alias("mix_offset"),
        F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0).alias("mix_rate"),
    )
    within = Window.partitionBy("source", "mix_class", "mix_bucket").orderBy("mix_size", "mix_key")
    d = d.withColumn("mix_place", F.row_number().over(within).cast("long"))
    d = d.join(cells, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_class") == F.col("mix_c")) & (F.col("mix_bucket") == F.col("mix_b")))
    place = F.col("mix_before") + F.col("mix_place")
    reached = lambda x: F.floor(x * F.col("mix_rate") + F.col("mix_offset"))
    d = d.withColumn("mix_copies", (reached(place) - reached(place - 1)).cast("long"))
    return d.select(*[F.col(c) for c in docs.columns if not c.startswith("mix_")], "mix_size", "mix_source_size", "mix_target", "mix_copies")


def emit(mixed_docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, in its own columns."""
    copies = mixed_docs.filter(F.col("mix_copies") > 0)
    return copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*[c for c in mixed_docs.columns if not c.startswith("mix_")])


def sampled(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """docs as often as the mix takes each row, in their own columns, whatever these are called."""
    own = {c: common.fresh(docs.columns, f"own_{c}".lower()) for c in docs.columns if c.lower().startswith("mix_")}
    rows = emit(mix(docs.withColumnsRenamed(own), seed, weights, cap))
    return rows.withColumnsRenamed({new: c for c, new in own.items()}).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    # texts are read once: sizes are all that cells, targets and places need
    sizes = common.written(docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_size")), "sizes")
    m = placed(sizes, "mix", (1, 2, 3), 3.0)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


#: The same mix for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
c AS (
  SELECT *, CAST(floor(4.0 * log2(size + 1.0)) AS INTEGER) AS cls, CAST('0x' || substr(k, 1, 8) AS BIGINT) % 64 AS b FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size / w AS lim, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM w),
v AS (SELECT *, CAST(total - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
     / (weights - coalesce(sum(w) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM l),
f AS (SELECT *, (SELECT min_by(lev, (lim, lev)) FROM v WHERE lim > lev) AS fin FROM v),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN lim <= lev OR fin IS NULL THEN 3.0::DOUBLE * source_size ELSE w * fin END AS target,
     (CAST('0x' || substr(md5('mix|' || coalesce(source, chr(0))), 1, 5) AS BIGINT)::DOUBLE + 0.5) / 1048576.0::DOUBLE AS u FROM f),
r AS (SELECT c.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
     row_number() OVER (PARTITION BY c.source ORDER BY cls, b, size, k) AS p FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(p * rate + u) - floor((p - 1) * rate + u) AS BIGINT) * size AS taken FROM r
"""
