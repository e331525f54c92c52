"""Queries over sources and their listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import index as ix
from lorekeep.operators import messages as ms
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import query
from lorekeep.session import scratch_path
from lorekeep.sinks import write_files, write_samples
from lorekeep.sources import exports as ex
from lorekeep.sources.envelope import decode_events
from lorekeep.sources.files import read_files


def _message_export(spark, sf_dir):
    epoch = lambda ts: F.format_string("%d.%06d", F.unix_seconds(ts), F.pmod(F.unix_micros(ts), F.lit(1_000_000)))
    rows = b.messages(spark, sf_dir).select(
        "channel_id",
        F.lit(None).cast("string").alias("channel_name"),
        epoch("ts").alias("timestamp"),
        F.nullif("text", F.lit("")).alias("text"),
        epoch("thread_ts").alias("thread_ts"),
        F.when(F.col("user_id") != "system", F.col("user_id")).alias("user_id"),
    )
    return write_samples(rows, scratch_path(spark, "messages"))


def _page_export(spark, sf_dir):
    return write_samples(b.raw_pages_json(spark, sf_dir), scratch_path(spark, "pages"))


def _drive_export(spark, sf_dir):
    return write_samples(b.raw_drive(spark, sf_dir), scratch_path(spark, "drive"))


@query(
    "scan_messages",
    f"""WITH {b.MESSAGES_SQL}
SELECT channel_id, 'unknown' AS channel_name, {b.sql_stamp('ts')} AS ts, md5(text) AS text_md5,
  CAST(epoch(thread_ts) AS BIGINT) AS thread_s,
  CASE WHEN user_id = 'system' THEN 'unknown' ELSE user_id END AS user_id
FROM messages""",
)
def scan_messages(spark, sf_dir):
    rows = ex.read_messages(spark, _message_export(spark, sf_dir))
    return rows.select(
        "channel_id",
        "channel_name",
        b.stamp("ts").alias("ts"),
        F.md5("text").alias("text_md5"),
        F.unix_seconds(ex.epoch_timestamp(F.col("thread_ts"))).alias("thread_s"),
        "user_id",
    )


@query(
    "scan_pages",
    f"""WITH {b.RAW_PAGES_SQL}
SELECT page_id, title, md5(text_content) AS text_md5, block_count, database_id FROM raw_pages""",
)
def scan_pages(spark, sf_dir):
    rows = ex.read_pages(spark, _page_export(spark, sf_dir))
    return rows.select(
        "page_id",
        "title",
        F.md5("text_content").alias("text_md5"),
        F.col("block_count").cast("bigint").alias("block_count"),
        "database_id",
    )


@query(
    "scan_drive_docs",
    f"""WITH {b.RAW_DRIVE_SQL}
SELECT file_id, name, mime_type, size, substr(content, 1, 500) AS content_preview,
  CAST(length(content) AS BIGINT) AS content_length FROM raw_drive WHERE content <> ''""",
)
def scan_drive_docs(spark, sf_dir):
    rows = ex.read_drive(spark, _drive_export(spark, sf_dir))
    return rows.select(
        "file_id",
        "name",
        "mime_type",
        "size",
        "content_preview",
        F.col("content_length").cast("bigint").alias("content_length"),
    )


@query(
    "scan_sample_union",
    f"""WITH {b.MESSAGES_SQL}, {b.RAW_PAGES_SQL}, {b.RAW_DRIVE_SQL}
SELECT 'slack' AS source, channel_id AS item, md5(text) AS text_md5 FROM messages
UNION ALL SELECT 'notion', page_id, md5(text_content) FROM raw_pages
UNION ALL SELECT 'drive', file_id, md5(content) FROM raw_drive WHERE content <> ''""",
)
def scan_sample_union(spark, sf_dir):
    paths = {
        "slack": _message_export(spark, sf_dir),
        "notion": _page_export(spark, sf_dir),
        "drive": _drive_export(spark, sf_dir),
    }
    rows = ex.read_corpus(spark, paths)
    return rows.select(
        "source",
        F.coalesce("channel_id", "page_id", "file_id").alias("item"),
        F.md5(F.coalesce("text", "text_content", "content")).alias("text_md5"),
    )


@query(
    "scan_ingest_envelope",
    f"""WITH {b.CORPUS}, told AS (SELECT *, {b.REASON_SQL} AS reason FROM corpus)
SELECT CASE WHEN reason IN ('bad base64', 'bad json', 'missing source') THEN NULL ELSE source END AS source,
  CASE WHEN reason IN ('bad base64', 'bad json', 'missing id') THEN NULL ELSE source_id END AS source_id,
  CASE WHEN reason IN ('bad base64', 'bad json') THEN NULL ELSE md5(text) END AS content_md5,
  CASE WHEN reason IN ('bad base64', 'bad json') THEN NULL ELSE author END AS author,
  CASE WHEN reason IN ('bad base64', 'bad json') THEN NULL ELSE url END AS url,
  CASE WHEN reason IN ('bad base64', 'bad json') THEN NULL ELSE lang END AS lang,
  reason
FROM told""",
)
def scan_ingest_envelope(spark, sf_dir):
    rows = decode_events(b.envelopes(spark, sf_dir))
    fit = F.coalesce(F.col("reason"), F.lit("")) != "bad json"
    return rows.select(
        *[F.when(fit, F.col(name)).alias(name) for name in ("source", "source_id", "author", "url")],
        F.when(fit, F.md5("content")).alias("content_md5"),
        F.when(fit, F.try_element_at("metadata", F.lit("lang"))).alias("lang"),
        "reason",
    )


# A document goes out as one file with a line feed at its end: its kind by doc_id % 6, and with every tenth a byte that is no UTF-8 in front.
_FILE_KINDS = ("gdoc", "gsheet", "gslides", "pdf", "txt", "bin")


@query(
    "scan_files_by_mime",
    """SELECT CASE doc_id % 6 WHEN 0 THEN 'application/vnd.google-apps.document' WHEN 1 THEN 'application/vnd.google-apps.spreadsheet'
    WHEN 2 THEN 'application/vnd.google-apps.presentation' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'text/plain'
    ELSE 'application/octet-stream' END AS mime_type,
  CASE doc_id % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/pdf'
    WHEN 4 THEN 'text/plain' ELSE 'application/octet-stream' END AS format,
  count(*) AS files, CAST(sum(strlen(text) + CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS bytes,
  CAST(sum(length(text) + 1) AS BIGINT) AS chars, bit_xor(CAST('0x' || substr(md5(text || chr(10)), 1, 15) AS BIGINT)) AS texts
FROM documents GROUP BY ALL""",
)
def scan_files_by_mime(spark, sf_dir):
    """Every document as a file of its own, under each route: three exports, a type read as it is, plain text, and raw bytes."""
    folder = scratch_path(spark, "files")
    docs = b.table(spark, sf_dir, "documents", "doc_id").select(
        F.element_at(F.array(*map(F.lit, _FILE_KINDS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("kind"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("FF")), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8")).alias("body"),
    )
    write_files(docs, folder)
    files = read_files(spark, folder, pattern="*.txt", kind=F.regexp_extract("path", "kind=([^/]+)/", 1))
    return files.groupBy("mime_type", "format").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").cast("bigint").alias("bytes"),
        F.sum(F.length("content")).cast("bigint").alias("chars"),
        F.bit_xor(F.conv(F.substring(F.md5("content"), 1, 15), 16, 10).cast("bigint")).alias("texts"),
    )


@query(
    "channel_filter",
    f"""WITH {b.CHANNELS_SQL}
SELECT channel_id, channel_name, type FROM channels
WHERE NOT is_archived AND type IN ('public_channel', 'private_channel')""",
)
def channel_filter(spark, sf_dir):
    return ms.filter_channels(b.channels(spark, sf_dir)).select("channel_id", "channel_name", "type")


@query(
    "message_lookback",
    f"""WITH {b.MESSAGES_SQL}, fresh AS (
  SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, message_id) AS r
  FROM messages WHERE ts >= TIMESTAMP '{b.AS_OF}' - INTERVAL 18 DAY)
SELECT channel_id, message_id, {b.sql_stamp('ts')} AS ts, md5(text) AS text_md5 FROM fresh WHERE r <= 50""",
)
def message_lookback(spark, sf_dir):
    recent = ms.recent_messages(b.messages(spark, sf_dir), b.at(b.AS_OF), days_back=18, limit=50)
    return recent.select("channel_id", "message_id", b.stamp("ts").alias("ts"), F.md5("text").alias("text_md5"))


@query(
    "channel_quota_sample",
    f"""WITH {b.CHANNELS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, message_id) AS r FROM messages),
quota AS (SELECT greatest(200 // greatest(count(DISTINCT channel_id), 1), 1) AS q FROM channels)
SELECT channel_id, message_id, md5(text) AS text_md5 FROM ranked, quota WHERE r <= q
ORDER BY channel_id, r LIMIT 200""",
)
def channel_quota_sample(spark, sf_dir):
    sample = ms.quota_sample(b.messages(spark, sf_dir), b.channels(spark, sf_dir), n=200)
    return sample.select("channel_id", "message_id", F.md5("text").alias("text_md5"))


@query("page_title", f"WITH {b.RAW_PAGES_SQL} SELECT page_id, title FROM raw_pages")
def page_title(spark, sf_dir):
    return b.raw_pages(spark, sf_dir).select("page_id", ex.page_title(F.col("properties")).alias("title"))


@query(
    "page_block_text",
    f"WITH {b.RAW_PAGES_SQL} SELECT page_id, md5(text_content) AS text_md5, block_count FROM raw_pages",
)
def page_block_text(spark, sf_dir):
    return b.raw_pages(spark, sf_dir).select(
        "page_id",
        F.md5(ex.blocks_to_text(F.col("blocks"))).alias("text_md5"),
        F.size("blocks").cast("bigint").alias("block_count"),
    )


@query(
    "page_search",
    f"""WITH {b.RAW_PAGES_SQL} SELECT page_id, title FROM raw_pages
WHERE object = 'page' AND contains(lower(title), 'the')""",
)
def page_search(spark, sf_dir):
    found = ex.search_pages(b.raw_pages(spark, sf_dir), "The", n=None)
    return found.select("page_id", ex.page_title(F.col("properties")).alias("title"))


@query(
    "page_by_database",
    f"WITH {b.RAW_PAGES_SQL} SELECT page_id, title, database_id FROM raw_pages WHERE database_id = 'src7'",
)
def page_by_database(spark, sf_dir):
    found = ex.pages_in(b.raw_pages(spark, sf_dir), "src7", n=None)
    return found.select("page_id", ex.page_title(F.col("properties")).alias("title"), "database_id")


@query(
    "drive_list",
    f"""WITH {b.RAW_DRIVE_SQL} SELECT file_id, name, mime_type FROM raw_drive
WHERE folder = 'f3' AND mime_type IN ('application/pdf', 'text/plain')""",
)
def drive_list(spark, sf_dir):
    files = ex.list_files(b.raw_drive(spark, sf_dir), "f3", ["application/pdf", "text/plain"], n=None)
    return files.select("file_id", "name", "mime_type")


@query(
    "drive_search",
    f"""WITH {b.RAW_DRIVE_SQL} SELECT file_id, name FROM raw_drive
WHERE contains(name, 'token') OR contains(content, 'token')""",
)
def drive_search(spark, sf_dir):
    return ex.search_files(b.raw_drive(spark, sf_dir), "token", n=None).select("file_id", "name")


@query(
    "incremental_sync",
    f"""WITH {b.CORPUS}, synced AS (SELECT source, max(ts) AS last_seen FROM corpus
  WHERE ts < TIMESTAMP '2024-03-01 00:00:00' AND source <> 'drive' GROUP BY source)
SELECT doc_id, c.source, {b.sql_stamp('ts')} AS ts FROM corpus c LEFT JOIN synced s ON c.source = s.source
WHERE last_seen IS NULL OR ts > last_seen""",
)
def incremental_sync(spark, sf_dir):
    corpus = b.corpus(spark, sf_dir).select("doc_id", "source", "ts")
    earlier = corpus.where((F.col("ts") < b.at("2024-03-01 00:00:00")) & (F.col("source") != "drive"))
    no_marks = spark.createDataFrame([], "source string, last_seen timestamp")
    marks = ix.next_marks(earlier, no_marks, modified="ts")
    fresh = ix.since(corpus, marks, modified="ts")
    return fresh.select("doc_id", "source", b.stamp("ts").alias("ts"))
