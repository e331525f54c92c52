"""Message and channel operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.running import running_total

CHANNEL_TYPES = ("public_channel", "private_channel")  # fixed values
LOOKBACK_DAYS = 30
SAMPLE_SIZE = 500


def filter_channels(
    channels: DataFrame, types: Sequence[str] = CHANNEL_TYPES, limit: int | None = None
) -> DataFrame:
    """Channels that are not archived and of the given types: all of them, or the first ``limit`` by id."""
    live = channels.where(~F.col("is_archived") & F.col("type").isin(*types))
    return live if limit is None else live.orderBy("channel_id").limit(limit)


def public_only(df: DataFrame, kind: str = "type") -> DataFrame:
    return df.where(F.col(kind) == "public_channel")


def first_per_group(df: DataFrame, group: str, order: Sequence[Column], n: Column | int, keep_rank: str | None = None) -> DataFrame:
    """First n rows per group; Spark trims each task's rows to n per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    picked = df.withColumn("__rank", rank).where(F.col("__rank") <= n)
    return picked.withColumnRenamed("__rank", keep_rank) if keep_rank else picked.drop("__rank")


def recent_messages(
    messages: DataFrame,
    as_of: Column,
    days_back: int = LOOKBACK_DAYS,
    limit: int | None = None,
    tie: Sequence[str] = ("message_id",),
) -> DataFrame:
    """Messages of the last days; with a ``limit`` the newest per channel. A message without a time is in no such span."""
    fresh = messages.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days_back)))
    return fresh if limit is None else first_per_group(fresh, "channel_id", [F.desc("ts"), *map(F.col, tie)], limit)


def quota_sample(
    messages: DataFrame,
    channels: DataFrame,
    key: str = "channel_id",
    n: int = SAMPLE_SIZE,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """At most n rows: n // channels (at least 1) per channel, channels taken in id order.

    Channels are counted by Spark, not collected; the quota is a scalar subquery.
    A channel with too few rows is not made up for by others.
    """
    order = order or [F.desc("ts"), F.col("message_id")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # no quota exceeds n, so trimming to n first lets Spark cut each task's rows before the shuffle
    trimmed = messages.withColumn("__rank", rank).where(F.col("__rank") <= n)
    count = F.greatest(F.countDistinct(key), F.lit(1))
    quota = channels.agg(F.greatest(F.floor(F.lit(n) / count), F.lit(1)).alias("quota"))
    return trimmed.where(F.col("__rank") <= quota.scalar()).orderBy(key, "__rank").limit(n).drop("__rank")


def threads(messages: DataFrame, order: Sequence[str] = ("ts", "message_id")) -> DataFrame:
    """Every message of a thread with the size of the thread and its place in it, in time order.

    Replies stay rows, and the place comes from a running count that splits long threads, so a thread
    of any size is fine.
    """
    keys = ["channel_id", "thread_ts"]
    inside = messages.where(F.col("thread_ts").isNotNull())
    numbered = running_total(inside, F.lit(1).cast("bigint"), order, keys, "__place")
    sizes = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("thread_size"))
    same = [F.col(name).eqNullSafe(F.col(f"__of_{name}")) for name in keys]
    sizes = sizes.select("thread_size", *[F.col(name).alias(f"__of_{name}") for name in keys])
    placed = numbered.join(sizes, same).withColumn("reply_index", F.col("__place") - 1)
    return placed.drop("__place", *[f"__of_{name}" for name in keys])


def with_users(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Add user columns, null for unknown users. Spark chooses the join side by the measured size."""
    return messages.join(users, "user_id", "left")
