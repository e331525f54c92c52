"""Stateful stream operators: duplicates, failure windows, the cost ledger."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators.governance import failure_rate
from lorekeep.streaming.ingest import stream_id


def file_stream(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """Stream over the Parquet files of a folder that match ``name``.

    A stream needs its schema up front; without one it is read from the files that are there.
    """
    schema = schema or spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def dedup_stream(
    stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour", bucket: str = "1 hour"
) -> DataFrame:
    """One row (keys, bucket_start) for each key and bucket of event time.

    What stays is a function of the events and not of how they were cut into batches, as long as none is later than
    ``delay``; which of the repeats stood for the others is therefore not given out. The state forgets a bucket once the
    watermark has passed it.
    """
    bucketed = stream.withWatermark(ts, delay).select(*keys, F.window(ts, bucket).alias("window"))
    return bucketed.dropDuplicates([*keys, "window"]).select(*keys, F.col("window.start").alias("bucket_start"))


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


_HELD = pa.schema([("key", pa.string()), ("at", pa.int64()), ("tie", pa.string()), ("row", pa.string())])
_LAST = pa.schema([("key", pa.string()), ("at", pa.int64())])


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    table = pa.ipc.open_stream(bytes(held)).read_all() if held else schema.empty_table()
    return table.to_pandas()


def first_of_repeats(
    stream: DataFrame, content: list[str], tie: str, ts: str = "ts", within: int = 3600, delay: str = "1 hour", buckets: int = 1024
) -> DataFrame:
    """The whole first event of each run of events with the same ``content`` columns; a run ends after ``within`` seconds without one.

    Events wait in the state until the watermark has passed them, and are then taken in order of
    time and ``tie`` (unique), so the result is a function of the events and not of batches, as long as none is later than
    ``delay``; runs go on across any edge of the clock. A state holds the contents of one of ``buckets`` (fixed for a checkpoint), so that a call
    of Python meets many contents at once. Event-time timers wake it when its next event is due, and it forgets a content when its run has
    ended. Events that the watermark has not passed when the stream ends are given out when it goes on; those without a time never are.
    """
    micros = within * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ends = state.get if state.exists else (None, None)
        came = [frame[["__key", "__at", "__tie", "__row"]].set_axis(_HELD.names, axis=1) for frame in frames]
        waiting = pd.concat([_unpacked(held, _HELD), *came], ignore_index=True).astype({"at": "int64"})
        last = _unpacked(ends, _LAST)
        now = state.getCurrentWatermarkMs()
        passed = waiting["at"] // 1000 < now
        due, waiting = waiting[passed].sort_values(["at", "tie", "row"]), waiting[~passed]
        line = pd.concat([last, due], ignore_index=True).astype({"at": "int64"}).sort_values("key", kind="stable")  # the last one of each content, then what is due
        gap = line.groupby("key")["at"].diff()
        out = line.loc[line["row"].notna() & ~(gap <= micros), "row"] if len(due) else ()
        last = line[["key", "at"]].drop_duplicates("key", keep="last")
        last = last[(last["at"] + micros) // 1000 + 1 >= now]
        if len(waiting) or len(last):
            state.update((_packed(waiting, _HELD), _packed(last, _LAST)))
            wakes = [*(waiting["at"] // 1000).nsmallest(1), *((last["at"] + micros) // 1000 + 1).nsmallest(1)]
            state.setTimeoutTimestamp(max(int(min(wakes)), now + 1))
        elif state.exists:
            state.remove()
        if len(out):
            yield pd.DataFrame({"__row": out.to_numpy()})

    keyed = stream.withWatermark(ts, delay).where(F.col(ts).isNotNull()).select(
        ts,
        F.sha2(F.to_json(F.struct(*content), _EXACT), 256).alias("__key"),
        F.unix_micros(ts).alias("__at"),
        F.col(tie).cast("string").alias("__tie"),
        F.to_json(F.struct(*stream.columns), _EXACT).alias("__row"),
    )
    placed = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    first = placed.groupBy("__bucket").applyInPandasWithState(
        run, "__row string", "held binary, ends binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return first.select(F.from_json("__row", stream.schema, _EXACT).alias("row")).select("row.*")


LATE = "query string, batch_id bigint, operator string, dropped bigint"


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators dropped because the watermark had passed them, batch by batch.

    An aggregation reports rows after its partial sums; operators on whole rows report events.
    """

    def __init__(self) -> None:
        self.rows: dict[tuple, tuple] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self.changed:
            for place, operator in enumerate(progress.stateOperators):
                row = (str(progress.id), progress.batchId, operator.operatorName, operator.numRowsDroppedByWatermark)
                self.rows[str(progress.runId), progress.batchId, place] = row

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all that the query reported has arrived here."""
        with self.changed:
            self.changed.wait_for(lambda: str(query.runId) in self.ended, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each query, batch and stateful operator."""
        with self.changed:
            return spark.createDataFrame(list(self.rows.values()), LATE)


def failure_stream(
    calls: DataFrame, delay: str = "10 minutes", window: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """The failed share per tumbling or sliding window; a window is given out once it is closed."""
    return failure_rate(calls.withWatermark("ts", delay), window, slide)


def run_to_end(result: DataFrame, path: str, checkpoint: str, late: LateRows | None = None) -> DataFrame:
    """Write all available input to Parquet in append mode and read it back; ``late`` counts what came too late."""
    if late is not None:
        result.sparkSession.streams.addListener(late)
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if late is not None:
        late.wait(query)
        result.sparkSession.streams.removeListener(late)
    return result.sparkSession.read.schema(result.schema).parquet(path)


LEDGER = "month string, model string, tokens bigint, cost_usd double, run string, batch_id bigint"


def ledger_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Tokens and cost per month and model of one batch of one stream; a repeated batch overwrites itself."""
    summed = batch.groupBy("month", "model").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")
    )
    typed = summed.select("month", "model", F.col("tokens").cast("bigint"), F.col("cost_usd").cast("double"))
    typed.write.mode("overwrite").parquet(f"{path}/run={stream_id(batch)}/batch_id={batch_id}")


def start_ledger(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the cost ledger of a stream of (month, model, tokens, cost_usd) across restarts."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    write = lambda batch, batch_id: ledger_batch(batch, batch_id, path)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Spending so far; a budget gate reads its month's sum from here."""
    return spark.read.schema(LEDGER).parquet(path).groupBy("month", "model").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")
    )
