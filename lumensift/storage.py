"""Where tables come from and intermediate ones go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A table of texts up to so many bytes of files may be dealt out when it is read.
DEALT_BYTES = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, without a slash at its end: spark.checkpoint.dir of the session.

    Where it is unset, one process that is driver and executor alike, as in tests, gets a folder of its own; a cluster gets an error,
    as each executor would write to its own disk.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        place = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts. If its files give fewer partitions than there are cores, as a single small file does, its rows are dealt
    out, so that the work on them isn't one task's; a table of more than DEALT_BYTES, whatever the number of cores, is read as it lies."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > DEALT_BYTES:
        return df
    return df.repartition(cores)
