"""The chunk table: changes as functions from table to table, listings, statistics, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def active() -> Column:
    return ~F.coalesce(F.col("deleted"), F.lit(False))


def upsert(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace rows of the same key. An anti-join that shuffles both by key, or broadcasts a small batch's keys."""
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_official(store: DataFrame, new: DataFrame, files: DataFrame, keep_on_empty: bool = False) -> DataFrame:
    """New official chunks instead of all official chunks of `files` (filename), also of files that gave no chunk, unless keep_on_empty."""
    gone = new.select("filename").distinct() if keep_on_empty else files.select("filename").distinct()
    gone = gone.withColumn("_scope", F.lit("official"))
    kept = store.join(gone, (store["filename"] == gone["filename"]) & (store["scope"] == gone["_scope"]), "left_anti")
    return upsert(kept, new)


def append(store: DataFrame, chunks: Column, filename: Column, embeddings: Column, pages: Column, rows: DataFrame, **extra: Column) -> DataFrame:
    """Rows of parallel arrays with random ids. Arrays of different lengths raise; page 0 where none is given; extra columns win."""
    same = (F.size(chunks) == F.size(embeddings)) & (pages.isNull() | (F.size(chunks) == F.size(pages)))
    checked = F.when(same, chunks).otherwise(F.raise_error("chunks, embeddings and pages differ in length").cast("array<string>"))
    new = rows.select("*", F.posexplode(checked).alias("chunk_index", "text"))
    made = {"chunk_id": F.uuid(), "filename": filename, "page": F.coalesce(F.get(pages, F.col("chunk_index")), F.lit(0)), "embedding": F.get(embeddings, F.col("chunk_index")), "deleted": F.lit(False)} | extra
    return store.unionByName(new.select("chunk_index", "text", *[c.alias(n) for n, c in made.items()]), allowMissingColumns=True)


def set_deleted(store: DataFrame, filename: str, deleted: bool) -> DataFrame:
    return store.withColumn("deleted", F.when(F.col("filename") == filename, F.lit(deleted)).otherwise(F.col("deleted")))


def hard_delete(store: DataFrame, filename: str, scope: str | None = None) -> DataFrame:
    gone = F.col("filename") == filename
    if scope:
        gone = gone & (F.col("scope") == scope)
    return store.filter(~F.coalesce(gone, F.lit(False)))


def affected(store: DataFrame, filename: str) -> DataFrame:
    return store.filter(F.col("filename") == filename).agg(F.count(F.lit(1)).alias("affected"))


def files(store: DataFrame, only_active: bool = False) -> DataFrame:
    """Distinct file names, `unknown` for a missing one, sorted. Reads one or two columns."""
    rows = store.filter(active()) if only_active else store
    return rows.select(F.coalesce("filename", F.lit("unknown")).alias("filename")).distinct().orderBy("filename")


def first_files(store: DataFrame, n: int = 4) -> DataFrame:
    """The first n active files by name."""
    return files(store, only_active=True).limit(n)


def all_files(store: DataFrame, folder: DataFrame) -> DataFrame:
    return files(store).unionByName(folder.select("filename")).distinct().orderBy("filename")


def statistics(store: DataFrame) -> DataFrame:
    """total, deleted, active, files."""
    return store.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("deleted", F.lit(False))).alias("deleted"), F.countDistinct(F.coalesce("filename", F.lit("unknown"))).alias("files")).withColumn("active", F.col("total") - F.col("deleted"))


def collisions(chunks: DataFrame) -> DataFrame:
    """Chunk ids that stand for more than one file name."""
    return chunks.groupBy("chunk_id").agg(F.countDistinct("filename").alias("names")).filter("names > 1")


def save(store: DataFrame, root: str) -> str:
    """A new snapshot below root, partitioned by scope; what was read is never overwritten. Returns its path."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    store.write.partitionBy("scope").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
