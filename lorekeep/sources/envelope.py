"""Ingest events: base64 of JSON {source, content, metadata{id, author, timestamp, url, ...}}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVELOPE = "source string, content string, metadata map<string,string>, broken string"


def decode_events(df: DataFrame, data: str = "data") -> DataFrame:
    """Add source, content, source_id, author, timestamp, url, metadata, and the ``reason`` of a bad event.

    Works on batches and streams. ``reason`` is null for good events.
    """
    text = F.try_to_binary(F.col(data), F.lit("base64")).cast("string")
    decoded = df.withColumn("__text", text)
    parsed = F.from_json(
        F.when(F.is_valid_utf8("__text"), F.col("__text")),
        ENVELOPE,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"},
    )
    named = lambda key: F.try_element_at(F.col("__event.metadata"), F.lit(key))
    # a row each: a filter on the reason is not pushed below, where it would decode and parse every event several times more
    event = decoded.withColumn("__event", F.explode(F.array(parsed)))
    reason = (
        F.when(F.col("__text").isNull(), "bad base64")
        .when(~F.is_valid_utf8("__text"), "bad utf-8")
        .when(F.col("__event").isNull() | F.col("__event.broken").isNotNull(), "bad json")
        .when(F.col("__event.source").isNull(), "missing source")
        .when(named("id").isNull(), "missing id")
    )
    return event.select(
        *[name for name in df.columns if name != data],
        F.col("__event.source").alias("source"),
        F.col("__event.content").alias("content"),
        named("id").alias("source_id"),
        named("author").alias("author"),
        named("timestamp").alias("timestamp"),
        named("url").alias("url"),
        F.coalesce("__event.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        reason.alias("reason"),
        F.col(data).alias("raw"),
    )


def good_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).drop("reason", "raw")


def dead_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNotNull()).select("raw", "reason")
