"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of one orderable type -> (id, component), the smallest id reachable, for every id with a link.

    Each round ties the larger neighbours of every id to its smallest neighbour, then all smaller ones; the rounds needed grow
    with the logarithm of the largest component. Links go through the shared folder after each round, never to the driver.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.written(e, "links")
    number = e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        old_number, number = number, new.count()
        same = number == old_number and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
