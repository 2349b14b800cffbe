"""Profiles, invitations and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.functions import text as T


def keyed(profiles: DataFrame) -> DataFrame:
    """Profiles with one id, of the column id or, failing that, uuid."""
    have = [F.col(c).cast("string") for c in ("id", "uuid") if c in profiles.columns]
    return profiles.withColumn("id", F.coalesce(*have)).drop("uuid")


def is_admin(role: Column) -> Column:
    return F.coalesce(role.isin("admin", "super_admin"), F.lit(False))


def removable(role: Column, who: Column, me: Column) -> Column:
    return (F.coalesce(role, F.lit("")) != "super_admin") & ~who.eqNullSafe(me)


def resolve_invites(requests: DataFrame, profiles: DataFrame, invites: DataFrame) -> DataFrame:
    """requests (email, role) with action: rejected, already_super_admin, already_admin, promote, duplicate_pending or invite.

    Only admins are invited; the role is trimmed and lower-cased, and none or an empty one means admin."""
    r = requests.withColumn("email", T.email(F.coalesce("email", F.lit(""))))
    asked = F.lower(T.strip(F.coalesce(F.nullif("role", F.lit("")), F.lit("admin"))))
    p = profiles.select(T.email(F.col("email")).alias("email"), F.col("role").alias("_role")).groupBy("email").agg(F.max("_role").alias("_role"))
    i = invites.filter("status = 'pending'").select(T.email(F.col("email")).alias("email"), F.lit(True).alias("_pending")).distinct()
    action = (
        F.when((F.col("email") == "") | (asked != "admin"), "rejected").when(F.col("_role") == "super_admin", "already_super_admin")
        .when(F.col("_role") == "admin", "already_admin").when(F.col("_role").isNotNull(), "promote").when(F.col("_pending"), "duplicate_pending").otherwise("invite")
    )
    return r.join(p, "email", "left").join(i, "email", "left").withColumn("action", action).drop("_role", "_pending")


def activity(resolved: DataFrame, by: Column, at: Column) -> DataFrame:
    """Log rows of what resolve_invites did."""
    done = resolved.filter(F.col("action").isin("promote", "invite"))
    return done.select(F.concat_ws("_", F.col("action"), F.lit("admin")).alias("action"), F.col("email").alias("target_email"), by.alias("performed_by"), at.alias("created_at"))


def known(emails: DataFrame, profiles: DataFrame) -> DataFrame:
    """Those emails that have a profile."""
    return emails.join(profiles.select(T.email(F.col("email")).alias("email")), "email", "left_semi")


def display_name(profile_name: Column, metadata_name: Column, email: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(profile_name), blank(metadata_name), blank(T.local_part(email)), F.lit("Guest"))


def roles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """requests (user_id) with role and allowed: the profile's role by either id column; no profile, no admin: not allowed."""
    p = keyed(profiles).select(F.col("id").alias("user_id"), "role")
    return requests.join(p, "user_id", "left").withColumn("allowed", is_admin(F.col("role")))


def roster(profiles: DataFrame) -> DataFrame:
    return profiles.filter(is_admin(F.col("role"))).orderBy(F.desc("created_at"), "id")


def pending(invites: DataFrame) -> DataFrame:
    return invites.filter("status = 'pending'").orderBy(F.desc("created_at"), "id")


def first_profiles(profiles: DataFrame, n: int = 6) -> DataFrame:
    """The n profiles of the smallest ids."""
    return profiles.orderBy("id").limit(n)


def recent_activity(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), "id").limit(n)


def upsert_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """New rows by id; columns that the new rows lack, or have null, keep their old value."""
    n = new.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != "id"])
    both = profiles.join(n, "id", "full")
    return both.select("id", *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in profiles.columns if c != "id"])


def changed(rows: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """rows with `column` set for the ids of changes (id, column)."""
    c = changes.select("id", F.col(column).alias("_new"))
    return rows.join(c, "id", "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)
