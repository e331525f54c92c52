"""Queries over the cache, retention, deletion, personal data and the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import cache as ca
from lorekeep.operators import governance as gv
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import query

_NOW = "2024-01-31 00:00:00"
_TOP = f"TIMESTAMP '{_NOW}'"


def _cache(spark, sf_dir):
    """The cache after all writes, put on an empty one."""
    empty = ca.cache_entries(b.cache_rows(spark, sf_dir).where(F.lit(False)))
    return ca.cache_put(empty, b.cache_rows(spark, sf_dir))


_ENTRY = "key_hash, key, value"


@query(
    "cache_put",
    f"""WITH {b.CACHE_ROWS_SQL} SELECT {_ENTRY}, {b.sql_stamp('created_at')} AS created_at,
  {b.sql_stamp('expires_at')} AS expires_at FROM cache""",
)
def cache_put(spark, sf_dir):
    """The first half of the writes fills the cache, the second half is put over it."""
    rows = b.cache_rows(spark, sf_dir)
    split = b.at("2024-01-16 00:00:00")
    first = ca.cache_put(ca.cache_entries(rows.where(F.lit(False))), rows.where(F.col("created_at") < split))
    cache = ca.cache_put(first, rows.where(F.col("created_at") >= split))
    return cache.select(
        "key_hash", "key", "value", b.stamp("created_at").alias("created_at"), b.stamp("expires_at").alias("expires_at")
    )


@query(
    "cache_get",
    f"""WITH {b.CACHE_ROWS_SQL}, asked AS (
  SELECT key FROM cache UNION ALL SELECT DISTINCT 'missing:' || CAST(user_id AS VARCHAR) FROM events)
SELECT a.key, CASE WHEN c.key IS NULL THEN 'miss' WHEN {_TOP} > c.expires_at THEN 'expired' ELSE 'hit' END AS state,
  CASE WHEN {_TOP} <= c.expires_at THEN value END AS value FROM asked a LEFT JOIN cache c ON a.key = c.key""",
)
def cache_get(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    unknown = b.events(spark, sf_dir).select(F.concat(F.lit("missing:"), F.col("user_id").cast("string")).alias("key"))
    return ca.cache_get(cache, cache.select("key").unionByName(unknown.distinct()), b.at(_NOW))


@query(
    "cache_delete",
    f"WITH {b.CACHE_ROWS_SQL} SELECT {_ENTRY} FROM cache WHERE NOT starts_with(key, 'error:')",
)
def cache_delete(spark, sf_dir):
    errors = b.cache_rows(spark, sf_dir).where(F.col("key").startswith("error:")).select("key").distinct()
    return ca.cache_delete(_cache(spark, sf_dir), errors).select("key_hash", "key", "value")


@query(
    "cache_purge",
    f"WITH {b.CACHE_ROWS_SQL} SELECT {_ENTRY} FROM cache WHERE {_TOP} <= expires_at",
)
def cache_purge(spark, sf_dir):
    return ca.cache_purge(_cache(spark, sf_dir), b.at(_NOW)).select("key_hash", "key", "value")


@query(
    "cache_stats",
    f"""WITH {b.CACHE_ROWS_SQL} SELECT count(*) AS total_entries, count(*) FILTER (WHERE {_TOP} <= expires_at) AS valid_entries,
  count(*) FILTER (WHERE {_TOP} > expires_at) AS expired_entries, CAST(sum(strlen(value)) AS BIGINT) AS total_size_bytes,
  round(sum(strlen(value)) / 1048576.0, 2) AS total_size_mb FROM cache""",
)
def cache_stats(spark, sf_dir):
    return ca.cache_stats(_cache(spark, sf_dir), b.at(_NOW))


@query(
    "retention_purge",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-04-10 12:00:00' - INTERVAL 90 DAY",
)
def retention_purge(spark, sf_dir):
    return gv.retain(b.events(spark, sf_dir), b.at("2024-04-10 12:00:00")).select("event_id", "user_id")


_DELETIONS_SQL = f"""{b.CORPUS}, {b.TOXIC_SQL}, deleted AS (
  SELECT source, ts + INTERVAL 1 DAY AS deleted_at,
    CASE WHEN lang <> 'es' THEN ts + INTERVAL 1 DAY + to_hours(CAST(doc_id % 30 AS INTEGER)) END AS purged_at
  FROM corpus WHERE doc_id IN (SELECT doc_id FROM toxic_docs))"""


@query(
    "deletion_sla",
    f"""WITH {_DELETIONS_SQL}, timed AS (SELECT *, epoch(purged_at - deleted_at) / 3600.0 AS h FROM deleted)
SELECT source, count(*) AS deletions, count(*) FILTER (WHERE h <= 24) AS within_sla, count(*) FILTER (WHERE h > 24) AS late,
  count(*) FILTER (WHERE purged_at IS NULL) AS open, round(max(h), 4) AS max_hours FROM timed GROUP BY source""",
)
def deletion_sla(spark, sf_dir):
    docs = b.corpus(spark, sf_dir).join(b.toxic_docs(spark, sf_dir), "doc_id", "left_semi")
    deleted_at = F.col("ts") + F.make_dt_interval(F.lit(1))
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") % 30).cast("int"))
    items = docs.select(
        "source",
        deleted_at.alias("deleted_at"),
        F.when(F.col("lang") != "es", deleted_at + hours).alias("purged_at"),
    )
    return gv.deletion_sla(items).withColumn("max_hours", F.round("max_hours", 4))


@query(
    "user_purge",
    f"WITH {b.LEAVERS_SQL} SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM leavers)",
)
def user_purge(spark, sf_dir):
    return gv.forget(b.events(spark, sf_dir), b.leavers(spark, sf_dir)).select("event_id", "user_id")


@query(
    "user_export",
    f"WITH {b.LEAVERS_SQL} SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM leavers)",
)
def user_export(spark, sf_dir):
    rows = gv.export_user(b.events(spark, sf_dir), b.leavers(spark, sf_dir))
    return rows.select("event_id", "user_id", "event_type")


@query(
    "audit_log",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS queries FROM events
WHERE ts >= TIMESTAMP '2025-01-10 00:00:00' - INTERVAL 12 MONTH GROUP BY ALL""",
)
def audit_log(spark, sf_dir):
    usage = gv.audit_usage(b.events(spark, sf_dir), b.at("2025-01-10 00:00:00"))
    return usage.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "queries")
