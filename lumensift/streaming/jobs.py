"""Streams: live figures, files as they arrive, questions as they are asked, guests' message counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumensift import storage
from lumensift.functions import text as T
from lumensift.operators import analytics, answering, chunking, store
from lumensift.operators.snapshots import Snapshots
from lumensift.sources import files as sources

#: Log rows later than this after the newest one are left out, so that the state of old days can go.
HORIZON = "8 days"


def live_days(logs: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """(day, queries, unanswered, answered_ms, with_ms) of a stream of logs; equal to the batch series where nothing is later than the horizon. In
    update mode a day's row comes out when it changes, and its state goes once the watermark has passed it."""
    day = F.window("created_at", "1 day")
    out = logs.withWatermark("created_at", horizon).groupBy(day.alias("w")).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(~analytics.answered()).alias("unanswered"), F.sum("response_time_ms").alias("answered_ms"), F.count("response_time_ms").alias("with_ms")
    )
    return out.select(F.to_date("w.start").alias("day"), "queries", "unanswered", "answered_ms", "with_ms")


def keep(live: DataFrame, table: Snapshots, name: str) -> DataStreamWriter:
    """A writer of a stream of changed rows (update mode) into a table by its key: a row takes the place of the one of the same key. The stream
    needs no state for keys that won't change any more, as the table has them."""

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.count()  # every partition, also of a batch that is left out, so that its state is stored
            table.commit(name, number, batch, lambda old: store.upsert(old, batch, table.key) if old.columns else batch)
        finally:
            batch.unpersist()

    return live.writeStream.queryName(name).outputMode("update").foreachBatch(save)


def live_figures(logs: DataFrame, table: Snapshots, name: str = "actors") -> DataStreamWriter:
    """A writer that keeps who has asked, with their numbers (actor, queries, answered, ms, with_ms), without any state in the stream: a batch is
    added up by actor and added to the table. `figures` makes the page's figures of it. Rows of nobody are kept under the empty name."""

    def save(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(F.coalesce(analytics.actor(), F.lit("")).alias("actor")).agg(
            F.count(F.lit(1)).alias("queries"), F.count_if(analytics.answered()).alias("answered"), F.coalesce(F.sum("response_time_ms"), F.lit(0.0)).alias("ms"), F.count("response_time_ms").alias("with_ms")
        ).persist()
        add = lambda old: (old.unionByName(new) if old.columns else new).groupBy("actor").agg(*[F.sum(c).alias(c) for c in ("queries", "answered", "ms", "with_ms")])
        try:
            table.commit(name, number, new, add)
        finally:
            new.unpersist()

    return logs.writeStream.queryName(name).foreachBatch(save)


def figures(actors: DataFrame) -> DataFrame:
    """The figures of analytics.figures from the table that live_figures keeps."""
    mean = F.when(F.sum("with_ms") > 0, T.rounded(F.sum("ms") / F.sum("with_ms"))).otherwise(0).cast("long")
    total = F.coalesce(F.sum("queries"), F.lit(0))
    done = F.coalesce(F.sum("answered"), F.lit(0))
    return actors.agg(total.alias("total"), done.alias("answered"), (total - done).alias("unanswered"), F.count_if(F.col("actor") != "").alias("active_users"), mean.alias("mean_response_ms"))


def live_categories(logs: DataFrame) -> DataFrame:
    """(category, n) of a stream of logs; one state row for each category."""
    return logs.groupBy(T.category(F.col("question"), saved=F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def guest_counts(messages: DataFrame, limit: int = 5) -> DataFrame:
    """(session_id, asked, at_limit) of a stream of messages."""
    n = F.count_if(F.col("role") == "user")
    return messages.groupBy("session_id").agg(n.alias("asked"), (n >= limit).alias("at_limit"))


def ingest_batch(files: DataFrame, old: DataFrame) -> DataFrame:
    """The chunk table after one batch of files (path, content, ...): each replaces its old official version, also where it gives no chunk. Files that
    can't be read change nothing. Ids don't depend on the run."""
    f = sources.last_of_name(sources.typed(files))
    pages = sources.pages_text(f).filter("error is null or error = 'no text'").withColumn("scope", F.lit("official"))
    # written down, as three steps begin with it, and the filter alone would clean every text anew in each
    pages = storage.written(pages, "pages")
    new = chunking.chunks(pages.drop("error"))
    return store.replace_official(old, new.select(*[c for c in new.columns if c in old.columns]), pages) if old.columns else new


def ingest(files: DataFrame, table: Snapshots, name: str = "files") -> DataStreamWriter:
    """A writer that keeps a chunk table up to date with a stream of files. A batch is committed together with its number under the
    stream's name, so one that comes again after a failure is left out; only the buckets of its files are written anew."""

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            table.commit(name, number, sources.typed(batch).select("filename"), lambda old: ingest_batch(batch, old))
        finally:
            batch.unpersist()

    return files.writeStream.queryName(name).foreachBatch(save)


def answer(questions: DataFrame, chunks: Callable[[], DataFrame], path: str, k: int | None = None, use_fuzzy: bool = True) -> DataStreamWriter:
    """A writer of routed rows (answering.routed) for a stream of questions, into a folder for each batch below path; `answered` reads them all.

    chunks gives the table once for each batch, as `Snapshots.load` does, so a batch sees one snapshot. A batch that comes again
    writes its own folder anew.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            answering.routed(batch, chunks(), k, use_fuzzy).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return questions.writeStream.foreachBatch(save)


def answered(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `answer` has written, with their batch."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def last_table(stream: DataFrame, path: str) -> DataFrame:
    """The whole result of a stream of aggregates once nothing is left to read: every batch writes its snapshot below path, the
    last one stands. A batch that comes again writes the same snapshot."""
    done: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table-{number}")
        done.append(number)

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/table-{max(done)}") if done else spark.createDataFrame([], stream.schema)
