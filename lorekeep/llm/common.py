"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import scratch_path, ship_package

WORD_GAP = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, so very long texts do not add up in a Python worker; and let Spark remove the
    shuffle files of a job that has ended, since what later jobs need is written to the shared folder."""
    ship_package(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` on each Arrow batch; batches for which it returns None give no rows."""
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor reads them again instead of computing them again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, cut at ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null: 0, as for an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def arrow_groups(
    df: DataFrame, group: str, function: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 20_000
) -> DataFrame:
    """``function`` on tables of whole groups, sorted by the long column ``group``.

    Rows are dealt out by the column and sorted inside each partition; a table holds the groups of about ``rows`` rows, so many
    small groups are handled at once and a worker holds one table. The caller bounds the size of a group.
    """
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                table = pa.Table.from_batches(held)
                keys = table.column(group).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    if (out := function(table.slice(0, cut))) is not None:
                        yield out
                    rest = table.slice(cut).combine_chunks()
                    held, count = rest.to_batches(), rest.num_rows
        if held and (out := function(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition(group).sortWithinPartitions(group).mapInArrow(each, schema)


def checksum(df: DataFrame) -> tuple:
    """Number of rows and an order-free sum of their hashes."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, root), the root being the smallest node.

    Large-star and small-star steps in turn until the edges stay as they are. Every round writes at most one row per edge
    to the shared folder; only a count and a checksum reach the driver.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    own = written(own, label)
    before = checksum(own)
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.where("a <> b")
        lowest = lower.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (
            lower.join(lowest, F.col("a") == F.col("u"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        own = written(small, label)
        after = checksum(own)
        if after == before:
            return own.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                own.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
