"""The result cache as a table: key_hash, key, value (JSON text), created_at, expires_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.index import latest_by

DEFAULT_TTL_SECONDS = 7 * 24 * 3600  # fixed value


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def expired(now: Column) -> Column:
    """An entry is valid up to and including its expiry; an unreadable (null) expiry counts as expired."""
    return F.coalesce(now > F.col("expires_at"), F.lit(True))


def cache_entries(rows: DataFrame, default_ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Entries from rows of key, value, created_at and ttl_seconds (null means the default, 0 at once)."""
    ttl = F.coalesce(F.col("ttl_seconds"), F.lit(default_ttl)).cast("bigint")
    expires = F.timestamp_micros(F.unix_micros("created_at") + ttl * 1_000_000)
    return rows.select(
        key_hash(F.col("key")).alias("key_hash"), "key", "value", "created_at", expires.alias("expires_at")
    )


def cache_put(cache: DataFrame, rows: DataFrame, default_ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Overwrite by key; of several writes the last one (then the greater value) stays."""
    written = latest_by(cache_entries(rows, default_ttl), ["key_hash"], ["created_at", "value"])
    return cache.join(written.select("key_hash"), "key_hash", "left_anti").unionByName(written)


def cache_get(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Look-up of each key: hit with its value, miss, or expired."""
    asked = keys.select("key", key_hash(F.col("key")).alias("key_hash"))
    found = cache.select("key_hash", "value", "expires_at", F.lit(1).alias("__there"))
    joined = asked.join(found, "key_hash", "left")
    state = F.when(F.col("__there").isNull(), "miss").when(expired(now), "expired").otherwise("hit")
    return joined.select("key", state.alias("state"), F.when(state == "hit", F.col("value")).alias("value"))


def cache_delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select(key_hash(F.col("key")).alias("key_hash")), "key_hash", "left_anti")


def cache_purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(~expired(now))


def purge_count(cache: DataFrame, now: Column) -> DataFrame:
    return cache.agg(F.count_if(expired(now)).alias("purged"))


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    bytes_ = F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("bigint")
    return cache.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(~expired(now)).alias("valid_entries"),
        F.count_if(expired(now)).alias("expired_entries"),
        bytes_.alias("total_size_bytes"),
    ).withColumn("total_size_mb", F.round(F.col("total_size_bytes") / (1024 * 1024), 2))
