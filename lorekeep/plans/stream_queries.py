"""Streaming queries, run to the end of their input, and sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep import sinks
from lorekeep.functions.identity import namespace_of
from lorekeep.functions.rules import EXTENDED
from lorekeep.functions.prices import token_cost
from lorekeep.operators import context as cx
from lorekeep.operators import index as ix
from lorekeep.operators import scanning as sc
from lorekeep.operators import search as sr
from lorekeep.operators.embedding import embed_hash
from lorekeep.operators import volume as vl
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import ORACLES, QUERIES, query
from lorekeep.session import scratch_path
from lorekeep.sources.envelope import decode_events
from lorekeep.store import write_rows
from lorekeep.streaming import events as ev
from lorekeep.streaming import ingest as ig


def _event_stream(spark, sf_dir):
    stream = ev.file_stream(spark, sf_dir, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _envelope_stream(spark, sf_dir):
    """The corpus as a stream of envelopes, written once as the topic and read as a stream."""
    topic = scratch_path(spark, "topic")
    write_rows(b.envelopes(spark, sf_dir), topic)
    return spark.readStream.schema("data string").parquet(topic)


def _ingested(spark, sf_dir):
    path = scratch_path(spark, "ingest")
    stream = _envelope_stream(spark, sf_dir)
    ig.start_ingest(stream, path, f"{path}/checkpoint", b.at("2024-02-01 00:00:00")).awaitTermination()
    return path


_SAID_SQL = f"{b.CORPUS}, told AS (SELECT *, {b.REASON_SQL} AS reason FROM corpus)"


@query(
    "stream_ingest",
    f"""WITH {_SAID_SQL}, clean AS (
  SELECT source, source_id, author, url, {b.sql_redact('text', EXTENDED)} AS body FROM told WHERE reason IS NULL),
{b.sql_chunks('clean', 'body', 'source, source_id, author, url')}
SELECT source || '/' AS namespace, source || '-' || source_id || '-' || CAST(chunk_index AS VARCHAR) AS id, author, url,
  CAST(token_count AS BIGINT) AS token_count, md5(content) AS content_md5 FROM chunks""",
)
def stream_ingest(spark, sf_dir):
    index = ig.current_index(spark, _ingested(spark, sf_dir))
    return index.select(
        "namespace", "id", "author", "url", F.col("token_count").cast("bigint").alias("token_count"), F.md5("content").alias("content_md5")
    )


@query(
    "search_stored_index",
    f"""WITH {_SAID_SQL}, clean AS (
  SELECT source, source_id, author, url, {b.sql_redact('text', EXTENDED)} AS body FROM told WHERE reason IS NULL),
{b.sql_chunks('clean', 'body', 'source, source_id, author, url')},
stored AS (SELECT source || '/' AS namespace, source || '-' || source_id || '-' || CAST(chunk_index AS VARCHAR) AS id, content FROM chunks),
{b.TEXT_QUERIES_SQL}, {b.sql_hash_terms('stored', 'id', 'content', 'vec')},
{b.sql_hash_terms('text_queries', 'query_id', 'text', 'ask')},
pairs AS (SELECT query_id, id, sum(a.value * v.value) AS dot FROM ask a JOIN vec v ON a.bucket = v.bucket GROUP BY ALL),
owners AS (SELECT DISTINCT id FROM vec), askers AS (SELECT DISTINCT query_id FROM ask),
scored AS (SELECT k.query_id, c.namespace, c.id, round(coalesce(dot, 0), 6) AS score
  FROM askers k CROSS JOIN owners o JOIN stored c ON c.id = o.id LEFT JOIN pairs p ON p.query_id = k.query_id AND p.id = o.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, namespace, id, score, rank FROM ranked WHERE rank <= 5""",
)
def search_stored_index(spark, sf_dir):
    """From events to the stored table, and from there to hits: no text is chunked or embedded for a question."""
    index = ig.current_index(spark, _ingested(spark, sf_dir))
    hits = sr.top_k(embed_hash(b.text_queries(spark, sf_dir), "text"), index)
    return hits.select("query_id", "namespace", "id", "score", "rank")


# The stored index as the corpus' chunk index: redacted, without the events that are dead.
_STORED_SQL = f"""{_SAID_SQL}, clean AS (
  SELECT source, source_id, author, url, ts, {b.sql_redact('text', EXTENDED)} AS body FROM told WHERE reason IS NULL),
{b.sql_chunks('clean', 'body', 'source, source_id, author, url, ts', name='doc_chunks')},
chunk_index AS (
  SELECT source || '/' AS namespace, source || '-' || source_id || '-' || CAST(chunk_index AS VARCHAR) AS id,
    source_id AS doc_id, chunk_index, author, url, ts, content, token_count
  FROM doc_chunks)"""


@query("answer_stored_index", ORACLES["answer_render"].replace(b.CHUNK_INDEX_SQL, _STORED_SQL))
def answer_stored_index(spark, sf_dir):
    """From events to the stored table, and from its vectors and metadata to whole answers."""
    index = ig.current_index(spark, _ingested(spark, sf_dir), model=ig.HASHED)
    asked = b.text_queries(spark, sf_dir)
    hits = sr.top_k_all(embed_hash(asked, "text"), index, carry=("content", "url", "timestamp"))
    summaries = cx.extractive_summary(asked, cx.answer_context(hits))
    return cx.answer_render(summaries, cx.citations(hits))


def _revised(spark, sf_dir):
    """Every tenth document once more, a day later and cut short."""
    docs = b.corpus(spark, sf_dir).where("doc_id % 10 = 3 AND author NOT IN ('src0', 'src1', 'src2', 'src3')")
    later = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(1)), "yyyy-MM-dd'T'HH:mm:ss")
    return docs.select(
        "source", "source_id", "author", later.alias("timestamp"), "url", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        F.concat(F.lit("revised "), F.substring("text", 1, 200)).alias("content"),
    )


@query(
    "stored_index_versions",
    f"""WITH {_SAID_SQL}, versions AS (
  SELECT source, source_id, CASE WHEN doc_id % 10 = 3 THEN 'revised ' || substr(text, 1, 200) ELSE text END AS said,
    ts + CASE WHEN doc_id % 10 = 3 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS seen FROM told WHERE reason IS NULL),
clean AS (SELECT source, source_id, seen, {b.sql_redact('said', EXTENDED)} AS body FROM versions),
{b.sql_chunks('clean', 'body', 'source, source_id, seen')}
SELECT source || '/' AS namespace, source || '-' || source_id || '-' || CAST(chunk_index AS VARCHAR) AS id,
  strftime(seen, '%Y-%m-%dT%H:%M:%S') AS timestamp, md5(content) AS content_md5, 'term-hash' AS model, 256 AS dimension FROM chunks""",
)
def stored_index_versions(spark, sf_dir):
    """Ingest, compact, ingest newer versions of some documents and the old ones again, and read base and later batches together."""
    path = _ingested(spark, sf_dir)
    ig.compact(spark, path)
    stamp, dead = b.at("2024-02-02 00:00:00"), spark.createDataFrame([], ig.DEAD)
    ig.write_events(spark, path, ig.newest_events(_revised(spark, sf_dir)), dead, "revised", 0, stamp)
    stale = _revised(spark, sf_dir).withColumns({"timestamp": F.lit("2020-01-01"), "content": F.lit("stale")})
    ig.write_events(spark, path, ig.newest_events(stale), dead, "revised", 1, stamp)
    index = ig.current_index(spark, path)
    return index.select("namespace", "id", "timestamp", F.md5("content").alias("content_md5"), "model", "dimension")


@query(
    "ingest_budget_gate",
    f"""WITH {_STORED_SQL}, costed AS (
  SELECT namespace, doc_id, min(ts) AS ts, sum(token_count) AS tokens FROM chunk_index GROUP BY namespace, doc_id),
nanos AS (SELECT *, CAST(round(tokens * (0.02::DOUBLE / 1000000.0) * 1e9) AS BIGINT) AS nano FROM costed),
running AS (SELECT namespace, doc_id, sum(nano) OVER (ORDER BY ts, namespace, rtrim(namespace, '/') || '-' || doc_id) / 1e9 AS spent FROM nanos),
cap AS (SELECT (CAST(sum(tokens) AS BIGINT) // 2) * 0.02::DOUBLE / 1000000.0 AS usd FROM costed)
SELECT namespace, rtrim(namespace, '/') || '-' || doc_id AS doc_id, spent <= usd AS indexed FROM running, cap""",
)
def ingest_budget_gate(spark, sf_dir):
    """Ingest with half the money that the corpus would cost: documents in the order of their events until it is spent."""
    path = scratch_path(spark, "ingest")
    good = decode_events(b.envelopes(spark, sf_dir)).where("reason IS NULL")
    tokens = ig.chunk_rows(good).agg(F.sum("token_count")).first()[0]
    stamp = b.at("2024-02-01 00:00:00")
    cap = (tokens // 2) * 0.02 / 1000000.0
    ig.start_ingest(_envelope_stream(spark, sf_dir), path, f"{path}/checkpoint", stamp, budget=cap).awaitTermination()
    done = ig.store(spark, path).documents().select("namespace", "doc_id", F.lit(True).alias("indexed"))
    left = ig.skipped_events(spark, path)
    named = left.select(namespace_of(F.col("source")).alias("namespace"), F.concat_ws("-", "source", "source_id").alias("doc_id"), F.lit(False).alias("indexed"))
    return done.unionByName(named)


@query(
    "stream_dead_letter",
    f"WITH {_SAID_SQL} SELECT reason, count(*) AS events FROM told WHERE reason IS NOT NULL GROUP BY reason",
)
def stream_dead_letter(spark, sf_dir):
    dead = ig.dead_letters(spark, _ingested(spark, sf_dir))
    return dead.groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


# Every third event comes again after 20 minutes, every seventh after 90, under an id of its own.
_REPEATED_SQL = """repeated AS (
  SELECT event_id, ts, user_id, event_type, value, props FROM events
  UNION ALL SELECT event_id + 1000000000, ts + INTERVAL 20 MINUTE, user_id, event_type, value, props FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id + 2000000000, ts + INTERVAL 90 MINUTE, user_id, event_type, value, props FROM events WHERE event_id % 7 = 0)"""


def _repeated(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    again = lambda every, number, minutes: events.where(F.col("event_id") % every == 0).withColumns(
        {"event_id": F.col("event_id") + number, "ts": F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))}
    )
    return events.select(*names).unionByName(again(3, 10**9, 20).select(*names)).unionByName(again(7, 2 * 10**9, 90).select(*names))


@query(
    "stream_dedup",
    f"""WITH {_REPEATED_SQL}, gaps AS (SELECT event_id, ts, user_id, event_type, value, props,
  lag(ts) OVER (PARTITION BY user_id, event_type, value, props ORDER BY ts, event_id) AS before FROM repeated)
SELECT event_id, user_id, event_type, value, props, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM gaps
WHERE (before IS NULL OR ts - before > INTERVAL 1 HOUR)
  AND date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) FROM repeated) - INTERVAL 2 HOUR""",
)
def stream_dedup(spark, sf_dir):
    """Events of one user, type, value and properties are repeats within an hour of each other; the first of each run is given out whole."""
    path = scratch_path(spark, "dedup")
    rows = _repeated(spark, sf_dir)
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    first = ev.first_of_repeats(stream, ["user_id", "event_type", "value", "props"], "event_id", delay="2 hours")
    out = ev.run_to_end(first, f"{path}/out", f"{path}/checkpoint")
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "stream_late_rows",
    """SELECT count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE NOT late) AS in_time FROM (
  SELECT ts < (SELECT date_trunc('day', max(ts)) FROM events) - INTERVAL 5 DAY AS late FROM events)""",
)
def stream_late_rows(spark, sf_dir):
    """The last day comes first, then the days before it, and all earlier events in a third batch, when the watermark has long passed them.

    Spark holds a batch against the watermark that the batch before it began with.
    """
    path = scratch_path(spark, "late")
    events = b.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.date_trunc("day", F.max("ts")).alias("day")).first()["day"]
    early = F.col("ts") < F.lit(last) - F.make_dt_interval(F.lit(5))
    group = F.when(early, 2).when(F.col("ts") < F.lit(last), 1).otherwise(0)
    counts = events.agg(*[F.count(F.when(group == number, 1)) for number in range(3)]).first()
    files = max(1, min(spark.sparkContext.defaultParallelism, min(counts) // 100_000))  # of each group, so a batch is a group
    for number in range(3):
        mine = events.where(group == number)
        (mine.coalesce(1) if files == 1 else mine.repartition(files)).write.parquet(f"{path}/in/group={number}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{path}/in")
    late = ev.LateRows()
    first = ev.first_of_repeats(stream, ["event_id"], "event_id", delay="1 hour")
    ev.run_to_end(first, f"{path}/out", f"{path}/checkpoint", late)
    counted = late.table(spark).agg(F.sum("dropped").alias("late"))
    return counted.select("late", (F.lit(events.where("ts IS NOT NULL").count()) - F.col("late")).alias("in_time"))


@query(
    "stream_dedup_hours",
    f"SELECT DISTINCT user_id, event_type, {b.sql_stamp('date_trunc(\'hour\', ts)')} AS bucket_start FROM events",
)
def stream_dedup_hours(spark, sf_dir):
    path = scratch_path(spark, "dedup")
    unique = ev.dedup_stream(_event_stream(spark, sf_dir), ["user_id", "event_type"])
    out = ev.run_to_end(unique, f"{path}/out", f"{path}/checkpoint")
    return out.withColumn("bucket_start", b.stamp("bucket_start"))


def _windows(spark, sf_dir, slide=None):
    path = scratch_path(spark, "windows")
    calls = _event_stream(spark, sf_dir).select("ts", (F.col("event_type") == "error").alias("failed"))
    closed = ev.run_to_end(ev.failure_stream(calls, slide=slide), f"{path}/out", f"{path}/checkpoint")
    return closed.select(
        b.stamp("window_start").alias("window_start"), "calls", "failures", F.round("failure_rate", 6).alias("failure_rate"), "mode"
    )


def _window_sql(spread):
    return f"""WITH {b.CALLS_SQL}, placed AS ({spread}),
counted AS (SELECT w, count(*) AS calls, count(*) FILTER (WHERE failed) AS failures FROM placed GROUP BY w)
SELECT {b.sql_stamp('w')} AS window_start, calls, failures, round(failures / calls, 6) AS failure_rate,
  CASE WHEN failures / calls > 0.1 THEN 'batch' ELSE 'streaming' END AS mode FROM counted
WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM calls) - INTERVAL 10 MINUTE"""


@query("stream_failure_rate", _window_sql("SELECT date_trunc('hour', ts) AS w, failed FROM calls"))
def stream_failure_rate(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(
    "stream_failure_sliding",
    _window_sql(
        "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * CAST(unnest(range(0, 4)) AS INTEGER)) AS w, failed FROM calls"
    ),
)
def stream_failure_sliding(spark, sf_dir):
    return _windows(spark, sf_dir, "15 minutes")


@query(
    "stream_ledger",
    f"""WITH {b.LEDGER_SQL} SELECT month, model, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost_usd
FROM ledger GROUP BY month, model""",
)
def stream_ledger(spark, sf_dir):
    path = scratch_path(spark, "ledger")
    models = F.array(*[F.lit(m) for m in b._MODELS])
    spent = _event_stream(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.element_at(models, (F.col("user_id") % 3 + 1).cast("int")).alias("model"),
        (F.get_json_object("props", "$.k").cast("bigint") * 100).alias("tokens"),
    )
    costed = spent.withColumn("cost_usd", token_cost(F.col("tokens"), F.col("model")))
    ev.start_ledger(costed, f"{path}/ledger", f"{path}/checkpoint").awaitTermination()
    return ev.ledger(spark, f"{path}/ledger").withColumn("cost_usd", F.round("cost_usd", 6))


# ---------------------------------------------------------------- sinks


@query("sink_samples", f"WITH {b.MESSAGES_SQL} SELECT channel_id, message_id, md5(text) AS text_md5 FROM messages")
def sink_samples(spark, sf_dir):
    rows = b.messages(spark, sf_dir)
    path = sinks.write_samples(rows.select("channel_id", "message_id", "text"), scratch_path(spark, "samples"))
    back = spark.read.schema("channel_id string, message_id string, text string").json(path)
    return back.select("channel_id", "message_id", F.md5("text").alias("text_md5"))


@query(
    "sink_reports",
    """SELECT 'scan' AS report, CAST(count(*) AS VARCHAR) AS rows_read FROM documents
UNION ALL SELECT 'volume', CAST(count(*) AS VARCHAR) FROM documents
UNION ALL SELECT 'decision', NULL FROM (SELECT 1)""",
)
def sink_reports(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id")
    gate = sc.pii_gate(docs)
    checked = vl.recommend(vl.budget_check(vl.project_cost(vl.project(vl.sample_stats(docs.select("text"))))))
    folder = scratch_path(spark, "reports")
    paths = [
        sinks.write_report(gate, f"{folder}/scan"),
        sinks.write_report(checked, f"{folder}/volume"),
        sinks.write_report(vl.go_no_go(gate, checked), f"{folder}/decision"),
    ]
    names = F.element_at(F.split(F.col("path"), "/"), -2)
    report = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = [F.get_json_object("value", path) for path in ("$.rows_scanned", "$.total_items")]
    return report.select(names.alias("report"), F.coalesce(*rows).alias("rows_read"))


@query("sink_critical_matches", ORACLES["critical_only"])
def sink_critical_matches(spark, sf_dir):
    """The critical matches beside the scan report: rows of files, as many as there are matches."""
    rows = QUERIES["critical_only"](spark, sf_dir)
    path = sinks.write_samples(rows, scratch_path(spark, "critical"))
    return spark.read.schema(rows.schema).json(path)


@query(
    "sink_index",
    f"""WITH {b.VECTORS_SQL} SELECT namespace, count(*) AS vector_count,
  CASE WHEN namespace = 'notion/' THEN 'second' ELSE 'first' END AS version FROM vectors GROUP BY namespace""",
)
def sink_index(spark, sf_dir):
    """Write the whole table, then replace one namespace; the others keep their files."""
    vectors = b.vectors(spark, sf_dir)
    path = sinks.write_index(vectors.withColumn("version", F.lit("first")), scratch_path(spark, "index"))
    again = vectors.where(F.col("namespace") == "notion/").withColumn("version", F.lit("second"))
    sinks.overwrite_namespaces(again, path)
    return ix.index_stats(spark.read.parquet(path)).where("namespace is not null").join(
        spark.read.parquet(path).select("namespace", "version").distinct(), "namespace"
    ).select("namespace", "vector_count", "version")


@query(
    "sink_buckets",
    f"""WITH {b.VECTORS_SQL} SELECT namespace, id, id = (SELECT min(id) FROM vectors) AS replaced FROM vectors""",
)
def sink_buckets(spark, sf_dir):
    """Write the whole table in buckets, then replace one document; every other folder keeps its files."""
    vectors = b.vectors(spark, sf_dir).withColumns({"doc_id": F.col("id"), "replaced": F.lit(False)})
    path = sinks.write_buckets(vectors, scratch_path(spark, "index"))
    one = vectors.where(F.col("id") == vectors.agg(F.min("id")).first()[0]).withColumn("replaced", F.lit(True))
    sinks.replace_documents(one, one.select("namespace", "doc_id"), path)
    return spark.read.parquet(path).select("namespace", "id", "replaced")
