"""Chat logs to figures: answered rates, active users, series, categories, newest rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumensift.functions import lexicons
from lumensift.functions import text as T

from .conversations import no_answer

LOG = "id long, user_id string, user_email string, question string, answer string, conversation_id string, category string, is_answered boolean, response_time_ms double, created_at timestamp"


def complete(logs: DataFrame) -> DataFrame:
    """Logs with all columns of LOG, missing ones null; others stay."""
    missing = [c.split() for c in LOG.split(", ") if c.split()[0] not in logs.columns]
    return logs.withColumns({name: F.lit(None).cast(kind) for name, kind in missing}) if missing else logs


def has_answer() -> Column:
    return F.trim(F.coalesce("answer", F.lit(""))) != ""


def answered(not_found: str | None = None) -> Column:
    """As saved, else whether there is an answer. With not_found, an answer that says so is none, whatever is saved."""
    saved = F.coalesce("is_answered", has_answer())
    return saved if not_found is None else saved & ~F.coalesce(no_answer(F.col("answer"), not_found), F.lit(False))


def not_unanswered() -> Column:
    return F.coalesce("is_answered", F.lit(True))


def actor() -> Column:
    return F.coalesce(F.nullif("user_id", F.lit("")), F.nullif("user_email", F.lit("")))


def newest(logs: DataFrame, n: int | None) -> DataFrame:
    """The n newest rows, a top-k without a full sort; all rows for None."""
    return logs if n is None else logs.orderBy(F.desc_nulls_last("created_at"), "id").limit(n)


def figures(logs: DataFrame, not_found: str | None = None) -> DataFrame:
    """total, answered, unanswered, active_users, mean_response_ms (half up, 0 without numbers); not_found as in `answered`."""
    a = answered(not_found)
    mean = F.coalesce(T.rounded(F.avg("response_time_ms")), F.lit(0)).cast("long")
    return logs.agg(F.count(F.lit(1)).alias("total"), F.count_if(a).alias("answered"), F.count_if(~a).alias("unanswered"), F.countDistinct(actor()).alias("active_users"), mean.alias("mean_response_ms"))


def dashboard(logs: DataFrame, documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """documents, queries, unanswered (without an answer), active_users (all profiles if there is none), registered_users."""
    log = logs.agg(F.count(F.lit(1)).alias("queries"), F.count_if(~has_answer()).alias("unanswered"), F.countDistinct(actor()).alias("a"))
    one = log.join(documents.agg(F.countDistinct("filename").alias("documents"))).join(profiles.agg(F.count(F.lit(1)).alias("registered_users")))
    return one.select("documents", "queries", "unanswered", F.when(F.col("a") == 0, F.col("registered_users")).otherwise(F.col("a")).alias("active_users"), "registered_users")


def daily(logs: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """(day, queries, unanswered): UTC days up to now, with zeros; rows without a time, or outside, are left out."""
    last = now.date()
    first = last - dt.timedelta(days=days - 1)
    inside = logs.filter((F.col("created_at") >= F.lit(str(first)).cast("timestamp")) & (F.col("created_at") < F.lit(str(last + dt.timedelta(days=1))).cast("timestamp")))
    counts = inside.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("queries"), F.count_if(~answered()).alias("unanswered"))
    calendar = logs.sparkSession.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("unanswered", F.lit(0)).alias("unanswered"))


def week(series: DataFrame) -> DataFrame:
    """total, and its mean over the days of the series to one decimal."""
    return series.agg(F.sum("queries").alias("total"), F.round(F.sum("queries") / F.count(F.lit(1)), 1).alias("per_day"))


def categories(logs: DataFrame, rules: list[tuple[str, str]] = lexicons.CATEGORIES, use_saved: bool = True) -> DataFrame:
    """(category, n), most frequent first; ties in order of first appearance among the newest rows first."""
    c = T.category(F.col("question"), rules, F.col("category") if use_saved else None)
    order = F.struct(F.coalesce(-F.unix_micros("created_at"), F.lit(2**62)), "id")
    return logs.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")


def shares(counts: DataFrame) -> DataFrame:
    """(category, n) with percent to one decimal and degrees of a circle. One row for each category."""
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("_t") * 100, 1).alias("percent"), (F.col("n") / F.col("_t") * 360).alias("degrees"))


def topics(logs: DataFrame, n: int = 6) -> DataFrame:
    """(topic, n): the n categories that are asked about most, a saved category before a recognised one; ties as in `categories`."""
    return categories(logs).withColumnRenamed("category", "topic").limit(n)


def unanswered(logs: DataFrame, n: int = 8) -> DataFrame:
    return newest(logs.filter(~answered()), n)


def cleared(logs: DataFrame) -> DataFrame:
    """What is left after clearing: rows without an id."""
    return logs.filter("id is null")


def day_label(day: Column) -> Column:
    return F.date_format(day, "MMM d")
