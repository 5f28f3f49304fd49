"""Notification fan-out and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def high_severity_events(rolled: DataFrame) -> DataFrame:
    """One reviewer event per record whose highest severity is high or critical."""
    return rolled.where(F.col("highest_severity").isin("high", "critical")).select(
        F.format_string("%s severity discrepancy on %s", F.upper("highest_severity"), "record_id").alias("title"),
        F.format_string("Khasra %s (%s) failed %d business rule(s). Reviewer action required.",
                        "khasra_no", "village", "discrepancy_count").alias("message"),
        F.lit("reviewer").alias("role"), F.lit(None).cast("long").alias("user_id"), F.lit("high").alias("level"),
        F.concat(F.lit("#/review/"), F.col("id").cast("string")).alias("link"))


def fan_out(events: DataFrame, users: DataFrame) -> DataFrame:
    """One notification per target user: the named user, else every user of the named role."""
    named = events.where("user_id is not null").join(
        users.select(F.col("id").alias("target")), F.col("user_id") == F.col("target"))
    by_role = events.where("user_id is null").join(
        users.select(F.col("id").alias("target"), F.col("role").alias("_role")), F.col("role") == F.col("_role"))
    cols = [F.col("target").alias("user_id"), F.col("title"),
            F.col("message"), "level", "link", F.lit("unread").alias("status")]
    return named.select(*cols).unionByName(by_role.select(*cols))


def fan_out_counts(events: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, unread) of `fan_out`, from event counts per target: no row per event and user is made."""
    ids = users.select(F.col("id").alias("target"), F.col("role").alias("_role"))
    own = events.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n"))
    shared = events.where("user_id is null").groupBy("role").agg(F.count("*").alias("n"))
    parts = own.join(ids, F.col("user_id") == F.col("target")).select("target", "n").unionByName(
        shared.join(ids, F.col("role") == F.col("_role")).select("target", "n"))
    return parts.groupBy(F.col("target").alias("user_id")).agg(F.sum("n").alias("unread"))


def mark_read(notifications: DataFrame, reads: DataFrame, is_admin: Column | None = None) -> DataFrame:
    """Apply (id, user_id) read marks; only the owner (or an admin) may mark a notification."""
    marks = reads.select("id", F.col("user_id").alias("_reader"), (F.lit(False) if is_admin is None else is_admin).alias("_admin")).distinct()
    ok = (F.col("_reader") == F.col("user_id")) | F.col("_admin")
    flagged = notifications.join(marks, "id", "left").groupBy(*notifications.columns).agg(
        F.max(F.coalesce(ok, F.lit(False))).alias("_read"))
    return flagged.withColumn("status", F.when(F.col("_read"), "read").otherwise(F.col("status"))).drop("_read")
