"""Retention, deletion, personal-data requests, audit log, call failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS = 90  # fixed value
AUDIT_MONTHS = 12  # fixed value
DELETION_SLA_HOURS = 24  # fixed value
FAILURE_SHARE = 0.10  # fixed value


def retain(df: DataFrame, as_of: Column, days: int = RETENTION_DAYS, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def deletion_sla(df: DataFrame, by: str = "source", hours: int = DELETION_SLA_HOURS) -> DataFrame:
    """Purge delay of deleted items (deleted_at, purged_at); an item not purged yet counts as open."""
    delay = (F.unix_micros("purged_at") - F.unix_micros("deleted_at")) / F.lit(3_600_000_000.0)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("deletions"),
        F.count_if(delay <= hours).alias("within_sla"),
        F.count_if(delay > hours).alias("late"),
        F.count_if(F.col("purged_at").isNull()).alias("open"),
        F.max(delay).alias("max_hours"),
    )


def forget(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return df.join(users.select(key), key, "left_anti")


def export_user(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return df.join(users.select(key), key, "left_semi")


def audit_usage(log: DataFrame, as_of: Column, months: int = AUDIT_MONTHS) -> DataFrame:
    """Queries per user and day within the log's retention."""
    kept = log.where(F.col("ts") >= F.add_months(as_of, -months))
    return kept.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("queries"))


def failure_rate(
    calls: DataFrame, window: str = "1 hour", slide: str | None = None, threshold: float = FAILURE_SHARE
) -> DataFrame:
    """Share of failed calls per window; above the threshold the mode is batch. Works on streams too."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = calls.groupBy(span.alias("window")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("failed")).alias("failures")
    )
    share = F.col("failures") / F.col("calls")
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "calls",
        "failures",
        share.alias("failure_rate"),
        F.when(share > threshold, "batch").otherwise("streaming").alias("mode"),
    )
