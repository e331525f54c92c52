"""Ingest of event streams into the vector table (``lorekeep.store``).

A micro-batch is appended under the id of its stream, which the checkpoint keeps, and its batch id, and counts once its log entry is
written. So a repeated batch overwrites only itself, streams with checkpoints of their own do not overwrite each other, and the
work of a batch grows with the batch, not with the table. ``compact`` folds batches into the base, bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.functions.identity import namespace_of, preview, vector_id
from lorekeep.functions.rules import Rule
from lorekeep.operators.budget import budget_gate, with_cost
from lorekeep.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from lorekeep.operators.embedding import HASH_DIMS, embed_hash
from lorekeep.operators.index import latest_by
from lorekeep.operators.redaction import redact
from lorekeep.session import cut_lineage
from lorekeep.sinks import write_index
from lorekeep.sources.envelope import dead_events, decode_events, good_events
from lorekeep.store import Store, write_rows

CHUNKS = """namespace string, id string, doc_id string, chunk_index int, token_count int, author string, timestamp string,
url string, extra map<string,string>, content string, preview string, values array<double>, model string, dimension int,
indexed_at timestamp"""
DOCS = "namespace string, doc_id string, redactions int, seen_at timestamp, indexed_at timestamp"
DEAD = "raw string, reason string"
SKIPPED = """source string, source_id string, author string, timestamp string, url string, metadata map<string,string>,
content string, seen_at timestamp, cost_usd double"""
LEDGER = "month string, model string, tokens bigint, cost_usd double"
SCHEMAS = {"chunks": CHUNKS, "docs": DOCS, "dead": DEAD, "skipped": SKIPPED, "ledger": LEDGER}

DEAD_LETTER_ALERT = 100  # fixed value: more dead events than this raise the alert
MAX_RETRIES = 3


HASHED = "term-hash"  # name of the model behind ``embed_hash``
Embed = Callable[[DataFrame, str], DataFrame]


def chunk_rows(
    events: DataFrame, rules: str | tuple[Rule, ...] = "extended", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Good events to rows of the vector table without vectors: redact, chunk. No shuffle.

    Redaction comes before chunking, because a secret may straddle the edge of a chunk.
    """
    return clean_chunks(redact(events, "content", "__clean", rules=rules).withColumn("content", F.col("__clean")), size, overlap)


def clean_chunks(clean: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``chunk_rows`` of events whose content is redacted already."""
    kept = clean.withColumn("__id", F.col("source_id"))
    chunks = chunk_documents(kept, extra="metadata", key="__id", size=size, overlap=overlap)
    return chunks.select(
        namespace_of(F.col("source")).alias("namespace"),
        vector_id(F.col("source"), F.col("__id"), F.col("chunk_index")).alias("id"),
        F.concat_ws("-", "source", "__id").alias("doc_id"),
        "chunk_index",
        "token_count",
        "author",
        "timestamp",
        "url",
        "extra",
        "content",
        preview(F.col("content")).alias("preview"),
    )


def with_vectors(chunks: DataFrame, embed: Embed | None = None, model: str = HASHED, dims: int = HASH_DIMS) -> DataFrame:
    """Add values, model and dimension. ``embed`` (df, text column) adds ``values``, null for texts that the model refused."""
    made = embed(chunks, "content") if embed else embed_hash(chunks, "content", dims=dims)
    values = F.col("values").cast("array<double>")
    return made.withColumn("values", values).withColumns({"model": F.lit(model), "dimension": F.size("values")})


def index_rows(
    events: DataFrame,
    rules: str | tuple[Rule, ...] = "extended",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    dims: int = HASH_DIMS,
    embed: Embed | None = None,
    model: str = HASHED,
) -> DataFrame:
    """Good events to rows of the vector table: redact, chunk, embed. No shuffle."""
    return with_vectors(chunk_rows(events, rules, size, overlap), embed, model, dims)


def event_time(timestamp: Column) -> Column:
    """Seconds since 1970, or an ISO date or time, as a timestamp; null for anything else."""
    seconds = timestamp.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(timestamp.try_cast("timestamp"))


def newest_events(events: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Last event of each document within a batch, by time, then content; one without a time counts as of its arrival."""
    arrived = F.current_timestamp() if arrived is None else arrived
    timed = events.withColumn("seen_at", F.coalesce(event_time(F.col("timestamp")), arrived))
    return latest_by(timed, ["source", "source_id"], ["seen_at", "content"])


def split_dead(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return good_events(decoded), dead_events(decoded)


def dead_letter_depth(dead: DataFrame, alert_at: int = DEAD_LETTER_ALERT) -> DataFrame:
    """Events per reason, and whether all of them together are above the alert depth."""
    by_reason = dead.groupBy("reason").agg(F.count(F.lit(1)).alias("events"))
    return by_reason.rollup("reason").agg(F.sum("events").alias("events")).withColumn(
        "alert", F.col("events") > alert_at
    )


def retry_state(dead: DataFrame, retries: str = "retries", most: int = MAX_RETRIES) -> DataFrame:
    """Count one more attempt; rows at the limit are given up, the others may be replayed."""
    tried = F.coalesce(F.col(retries), F.lit(0)) + 1
    return dead.withColumn(retries, tried).withColumn("given_up", tried >= most)


def stream_id(batch: DataFrame) -> str:
    """Id of the stream a micro-batch belongs to; it stays the same as long as the checkpoint does."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, SCHEMAS)


def spent_in(spark: SparkSession, path: str, month: str) -> float:
    """What committed batches have cost in a month (yyyy-MM)."""
    rows = store(spark, path).every("ledger").where(F.col("month") == month)
    return rows.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]


def _gated(chunks: DataFrame, events: DataFrame, month: str, left: float, price: str) -> DataFrame:
    """Documents (namespace, doc_id, cost_usd, accepted), in the order of their events, as long as their running cost stays within ``left``.

    Only keys and token counts are numbered; a document is taken whole or not at all.
    """
    keys = ["namespace", "doc_id"]
    tokens = chunks.groupBy(*keys).agg(F.sum("token_count").alias("tokens"))
    costed = events.select(*keys, "seen_at").join(tokens, keys, "left").na.fill(0, ["tokens"])
    costed = with_cost(costed, price).withColumn("month", F.lit(month))
    return budget_gate(costed, ["seen_at", *keys], cap=left).select(*keys, "cost_usd", "accepted")


def write_events(
    spark: SparkSession,
    path: str,
    good: DataFrame,
    dead: DataFrame,
    run: str,
    batch_id: int,
    stamp: Column,
    rules: str | tuple[Rule, ...] = "extended",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    dims: int = HASH_DIMS,
    embed: Embed | None = None,
    model: str = HASHED,
    budget: float | None = None,
    price: str = "text-embedding-3-small",
) -> None:
    """One batch of good events (newest of each document) and dead ones, unless it is committed already.

    With a monthly ``budget`` the running gate takes documents in the order of their events until what the ledger has for the month
    of ``stamp`` and this batch would pass it; the others are not embedded and go to the part ``skipped``. Chunks that the model refuses
    are left out and reported among the dead as ``embedding failed``. Tokens and cost of what was embedded go to the ledger in the same commit.
    The texts are redacted once, with their counts, and lie under ``clean`` until the commit; every part is made from there.
    """
    table = store(spark, path)
    if table.committed(run, batch_id):
        return
    keys = ["namespace", "doc_id"]
    named = good.withColumns({"namespace": namespace_of(F.col("source")), "doc_id": F.concat_ws("-", "source", "source_id")})
    month = spark.range(1).select(F.date_format(stamp, "yyyy-MM")).first()[0]
    counted = redact(named, "content", "__clean", rules=rules, count_as="redactions")
    if budget is None:
        counted = counted.withColumn("content", F.col("__clean")).drop("__clean")
    else:  # what is skipped stays as it came
        counted = counted.withColumn("__clean", F.when(F.col("redactions") > 0, F.col("__clean")))
    cleaned = table.place("clean", run, batch_id)
    write_rows(counted, cleaned)
    named = spark.read.schema(counted.schema).parquet(cleaned)
    skipped = named.where(F.lit(False)).withColumn("cost_usd", F.lit(0.0))
    if budget is not None:
        left = budget - spent_in(spark, path, month)
        clean = lambda rows: rows.withColumn("content", F.coalesce("__clean", "content", F.lit(""))).drop("__clean")
        gate = _gated(clean_chunks(clean(named), size, overlap), named, month, left, price)
        gate = cut_lineage(gate)
        skipped = named.join(gate.where("NOT accepted").select(*keys, "cost_usd"), keys)
        named = clean(named).join(gate.where("accepted").select(*keys), keys, "left_semi")
    rows = with_vectors(clean_chunks(named, size, overlap), embed, model, dims).withColumn("indexed_at", stamp)
    place = table.place("made", run, batch_id)
    if embed:  # a model is called once for each text, though two parts are written from what it gives
        write_rows(rows, place)
        rows = spark.read.schema(rows.schema).parquet(place)
        failed = rows.where("values IS NULL").select(F.col("id").alias("raw"), F.lit("embedding failed").alias("reason"))
        dead = dead.select("raw", "reason").unionByName(failed)
    chunks = rows.where("values IS NOT NULL") if embed else rows
    typed = lambda part, frame: frame.select(*[F.col(f.name).cast(f.dataType) for f in table.batches(part, []).drop("run", "batch_id").schema])

    def spent() -> DataFrame:
        told = with_cost(table.written("chunks", run, batch_id).select("token_count"), price, "token_count")
        sums = told.agg(F.sum("token_count").alias("tokens"), F.sum("cost_usd").alias("cost_usd")).where("tokens IS NOT NULL")
        return typed("ledger", sums.withColumns({"month": F.lit(month), "model": F.lit(model)}))

    parts = {
        "chunks": chunks,
        "docs": named.select(*keys, "redactions", "seen_at").withColumn("indexed_at", stamp),
        "dead": dead,
        "skipped": skipped,
    }
    table.append(run, batch_id, {part: typed(part, frame) for part, frame in parts.items()} | {"ledger": spent})
    table.discard("clean", run, batch_id)


def write_batch(
    batch: DataFrame, batch_id: int, path: str, indexed_at: Column | None = None, run: str | None = None, **options
) -> None:
    """One micro-batch, decoded once, through ``write_events``.

    What is decoded lies under ``decoded`` until the commit, with the raw event where it is dead. It is not persisted: tasks that cached it ran
    out of heap, in memory or on disk alike.
    """
    spark, run = batch.sparkSession, run or stream_id(batch)
    table = store(spark, path)
    if table.committed(run, batch_id):
        return
    told = decode_events(batch)
    told = told.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))
    place = table.place("decoded", run, batch_id)
    write_rows(told, place)
    good, dead = split_dead(spark.read.schema(told.schema).parquet(place))
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    write_events(spark, path, newest_events(good, stamp), dead, run, batch_id, stamp, **options)
    table.discard("decoded", run, batch_id)


def take_up(spark: SparkSession, path: str, indexed_at: Column | None = None, **options) -> int:
    """Try skipped events again, the newest of each document that has no later version in the table; the number tried.

    Those within the budget of the month of ``indexed_at`` are embedded, the rest are skipped once more.
    """
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    table = store(spark, path)
    skipped = latest_by(table.every("skipped").drop("run", "batch_id", "cost_usd"), ["source", "source_id"], ["seen_at", "content"])
    done = table.documents().select("namespace", "doc_id", F.col("seen_at").alias("__at"))
    named = skipped.withColumns({"namespace": namespace_of(F.col("source")), "doc_id": F.concat_ws("-", "source", "source_id")})
    waiting = named.join(done, ["namespace", "doc_id"], "left").where("__at IS NULL OR __at < seen_at").drop("__at", "namespace", "doc_id")
    waiting = cut_lineage(waiting)
    if count := waiting.count():
        dead = spark.createDataFrame([], DEAD)
        write_events(spark, path, waiting, dead, "taken-up", len(table.log.names()), stamp, **options)
    return count


def replay_dead(spark: SparkSession, path: str, repair: Callable[[DataFrame], DataFrame], indexed_at: Column | None = None, **options) -> int:
    """Send dead events through ``repair`` (raw, reason -> data) and into the table again; what is still dead stays, up to MAX_RETRIES times."""
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    table = store(spark, path)
    tries = table.every("dead").groupBy("raw", "reason").agg(F.count(F.lit(1)).alias("retries"))
    again = retry_state(tries.withColumn("retries", F.col("retries") - 1)).where("NOT given_up AND reason <> 'embedding failed'")
    decoded = cut_lineage(decode_events(repair(again.select("raw", "reason")).select("data")))
    good, dead = split_dead(decoded)
    if count := decoded.count():
        write_events(spark, path, newest_events(good, stamp), dead, "replayed", len(table.log.names()), stamp, **options)
    return count


def start_ingest(
    stream: DataFrame, path: str, checkpoint: str, indexed_at: Column | None = None, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Start the ingest of a stream of ``data`` events; by default it ends when the input is used up."""
    write = lambda batch, batch_id: write_batch(batch, batch_id, path, indexed_at, **options)
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def current_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The newest version of every document; one that came back shorter or empty leaves no old chunks.

    Newest by the time of the event (of its arrival where it has none), then by arrival: the same rule as within a batch. Only the base and
    later batches are opened, and no chunk of the base is shuffled while later documents are few. ``model`` keeps the vectors of
    one model, where an index holds several.
    """
    rows = store(spark, path).current()
    return rows if model is None else rows.where(F.col("model") == model)


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return store(spark, path).every("dead")


def skipped_events(spark: SparkSession, path: str) -> DataFrame:
    return store(spark, path).every("skipped")


def compact(spark: SparkSession, path: str) -> int:
    """Fold the batches so far into the base; from then on a read opens the base and what came later. Gives the version covered."""
    return store(spark, path).compact()


def export_index(spark: SparkSession, path: str, target: str) -> str:
    return write_index(current_index(spark, path), target)
