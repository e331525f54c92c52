"""Sharding by histogram sort."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map, written

HALF = 1 << 63
LOW = (1 << 64) - 1
SPACE = 1 << 128


def _buckets(high: np.ndarray, low: np.ndarray, probe_high: np.ndarray, probe_low: np.ndarray) -> np.ndarray:
    """For each key (high, low) the number of probes at or below it; the probes are sorted."""
    first = np.searchsorted(probe_high, high, "left")
    found = np.searchsorted(probe_high, high, "right")
    for k in np.unique(first[first < found]):
        rows = np.flatnonzero((first == k) & (first < found))
        own = probe_low[k : found[rows[0]]]
        found[rows] = k + np.searchsorted(own, low[rows], "right")
    return found


def _key(high: int, low: int) -> int:
    return (high + HALF) << 64 | (low + HALF)


def _below(keys: DataFrame, probes: list[int]) -> dict[int, int]:
    """Exact bytes below each probe, and below and behind the first and last key between two probes.

    Counted inside the tasks; a task sends one row for each bucket that it has rows in.
    """
    high = np.array([(p >> 64) - HALF for p in probes], np.int64)
    low = np.array([(p & LOW) - HALF for p in probes], np.int64)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, d, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        at = _buckets(h, d, high, low)
        order = np.lexsort((d, h, at))
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
        last = np.concatenate([first[1:], [len(order)]]) - 1
        own = [at[order][first], np.add.reduceat(size[order], first)]
        own += [values[order][edge] for edge in (first, last) for values in (h, d)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in own], ["at", "bytes", "h0", "d0", "h1", "d1"])

    schema = "at long, bytes long, h0 long, d0 long, h1 long, d1 long"
    sums = (
        arrow_map(keys.select("__h", "__d", "size"), count, schema)
        .groupBy("at")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.min(F.struct("h0", "d0")).alias("first"),
            F.max(F.struct("h1", "d1")).alias("last"),
        )
    )
    by_bucket = {row["at"]: row for row in sums.collect()}
    below, out = 0, {}
    for i in range(len(probes) + 1):
        if row := by_bucket.get(i):
            out[_key(*row["first"])] = below
            below += row["bytes"]
            out[_key(*row["last"]) + 1] = below
        if i < len(probes):
            out[probes[i]] = below
    return out


def splitters(keys: DataFrame, total: int, parts: int, tolerance: float = 0.2, probes: int = 31) -> list[int]:
    """Sorted 128-bit keys that cut ``keys`` into ``parts`` of near equal bytes.

    Each pass counts the exact bytes below ``probes`` candidates inside the interval of every open splitter and draws the
    interval in to the keys that are there, until each splitter is within ``tolerance`` of a part's share or its interval
    holds a single key. parts x probes sums are the most that reaches the driver.
    """
    share = max(1, total // parts)
    wanted = [total * j // parts for j in range(1, parts)]
    known = {0: 0, SPACE: total}
    while True:
        edges = sorted(known)
        below = [known[e] for e in edges]
        best, ask = [], set()
        for target in wanted:
            i = bisect_left(below, target)
            low, high = edges[max(0, i - 1)], edges[i]
            near = min((low, high), key=lambda e: abs(known[e] - target))
            best.append(near)
            if abs(known[near] - target) > tolerance * share and high - low > 1:
                step = max(1, (high - low) // (probes + 1))
                ask.update(range(low + step, high, step))
        if not ask:
            return sorted(set(best) - {0, SPACE})
        known.update(_below(keys, sorted(ask)))


def shard(docs: DataFrame, shards: int = 16, part_rows: int = 200_000) -> DataFrame:
    """Cut all rows into ``shards`` runs of near equal bytes, in the order of (hash of text, hash of doc_id).

    Size is the UTF-8 bytes of the text plus 1. The order puts equal texts side by side, so a group of copies stays
    in one shard unless a border runs through it; a group larger than a shard is cut by its ids. A row goes to shard
    ``floor(shards x bytes before it / all bytes)``, so shard sizes differ by less than two rows' bytes.

    The rows are cut into many more parts than shards by :func:`splitters`, exchanged once by part and numbered
    inside each part; no task holds a whole shard. Ties: rows equal in text and doc_id are interchangeable and stay
    in one part. A null text counts as empty (size 1, checksum 0), null ids hash alike, an empty table gives no rows.
    Other columns do not matter. Returns doc_id, size, text_crc32, law, shard, slot (from 0 in each shard), grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("__h"),
            F.xxhash64("doc_id").alias("__d"),
        ),
        "shard-keys",
    )
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = splitters(keys, total, max(4 * shards, -(-rows // part_rows))) if rows else []
    high = np.array([(p >> 64) - HALF for p in cuts], np.int64)
    low = np.array([(p & LOW) - HALF for p in cuts], np.int64)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, d = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("__h", "__d"))
        part = pa.array(_buckets(h, d, high, low).astype(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns, part], [*batch.schema.names, "__part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    parted = arrow_map(keys, place, f"{fields}, __part long")
    # One row for each part: at most parts rows, summed on the driver's side of a small window.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy("__part")
        .agg(F.count("*").alias("__n"), F.sum("size").alias("__b"))
        .select(
            F.col("__part").alias("__of"),
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows_before"),
            F.coalesce(F.sum("__b").over(earlier), F.lit(0)).alias("__bytes_before"),
        )
    )
    inside = Window.partitionBy("__part").orderBy("__h", "__d")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = (
        parted.withColumn("__rank", F.row_number().over(inside) - 1)
        .withColumn("__running", running - F.col("size"))
        .join(offsets, F.col("__part") == F.col("__of"))
        .withColumn("__place", F.col("__rows_before") + F.col("__rank"))
        .withColumn("__at", F.col("__bytes_before") + F.col("__running"))
        .withColumn("shard", F.expr(f"CAST(__at * {shards} DIV {max(1, total)} AS INT)"))
    )
    starts = numbered.groupBy(F.col("shard").alias("__shard")).agg(F.min("__place").alias("__start"))
    return numbered.join(F.broadcast(starts), F.col("shard") == F.col("__shard")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__place") - F.col("__start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
