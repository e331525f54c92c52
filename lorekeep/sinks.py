"""Writers: samples and reports as JSON, the vector table as Parquet by namespace."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.session import scratch_path


def write_samples(df: DataFrame, path: str) -> str:
    """JSON lines; the writer of one export per fresh path."""
    df.write.mode("errorifexists").json(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """A report is an aggregate of one or few rows, so it is one file."""
    report.coalesce(1).write.mode("errorifexists").json(path)
    return path


def write_files(rows: DataFrame, path: str) -> str:
    """Each row (kind, body) as a file of its own: the body's bytes and a line feed, in a folder ``kind=...``.

    Hadoop's local file system starts a process for each permission it sets, four for each file, so on it the tasks write by themselves. A task
    fills a hidden folder that gets its name at the end, so an attempt that failed leaves nothing. Other stores are left to Spark.
    """
    typed = rows.select("kind", F.col("body").cast("binary").alias("body"))
    if urlsplit(path).scheme not in ("", "file"):
        whole = typed.withColumn("body", F.col("body").cast("string"))
        whole.write.mode("errorifexists").partitionBy("kind").option("maxRecordsPerFile", 1).text(path)
        return path
    folder = unquote(urlsplit(path).path) if path.startswith("file:") else path
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, number = f"{folder}/_attempt-{uuid.uuid4().hex}", 0
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body")):
                place = f"{made}/kind=" + ("__HIVE_DEFAULT_PARTITION__" if kind is None else quote(kind, safe=""))
                os.makedirs(place, exist_ok=True)
                with open(f"{place}/part-{number:09d}.txt", "wb") as file:
                    if body.is_valid:
                        file.write(body.as_buffer())
                    file.write(b"\n")
                number += 1
        if number:
            try:
                os.rename(made, f"{folder}/task-{TaskContext.get().partitionId():06d}")
            except OSError:  # another attempt of the same task was done before
                if not os.path.isdir(f"{folder}/task-{TaskContext.get().partitionId():06d}"):
                    raise
        yield pa.RecordBatch.from_pydict({"files": pa.array([number], pa.int64())})

    typed.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
    return path


def write_index(index: DataFrame, path: str) -> str:
    """The whole table to a new path, one partition per namespace."""
    index.write.mode("errorifexists").partitionBy("namespace").parquet(path)
    return path


def overwrite_namespaces(rows: DataFrame, path: str) -> str:
    """Replace only the namespaces that occur in ``rows``; ``rows`` must not be read from ``path``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)
    return path


BUCKETS = 16


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def write_buckets(index: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """The whole table (namespace, doc_id, ...) to a new path: per namespace, ``buckets`` folders by a hash of the document."""
    placed = _bucketed(index, buckets)
    placed.repartition("namespace", "bucket").write.mode("errorifexists").partitionBy("namespace", "bucket").parquet(path)
    return path


def replace_documents(new: DataFrame, docs: DataFrame, path: str, buckets: int = BUCKETS) -> list[tuple[str, int]]:
    """Replace all rows of ``docs`` (namespace, doc_id) by their rows in ``new``; the folders of their buckets alone are read and rewritten.

    The merged buckets are written to the shared folder first, then over the old ones, so a failed run can be repeated. The touched
    (namespace, bucket) pairs are given back; there are at most as many as there are folders. A bucket that becomes empty keeps one file
    without rows.
    """
    spark = new.sparkSession
    touched = [tuple(r) for r in _bucketed(docs, buckets).select("namespace", "bucket").distinct().collect()]
    lies = lambda n, b: F.col("namespace").eqNullSafe(F.lit(n)) & (F.col("bucket") == b)
    inside = reduce(Column.__or__, [lies(*pair) for pair in touched], F.lit(False))
    stored = spark.read.parquet(path)
    names = stored.columns
    old = stored.where(inside).join(docs.select("namespace", "doc_id").distinct(), ["namespace", "doc_id"], "left_anti")
    fresh = new.join(docs.select("namespace", "doc_id").distinct(), ["namespace", "doc_id"], "left_semi")
    merged = old.select(*names).unionByName(_bucketed(fresh, buckets).select(*names))
    out = scratch_path(spark, "buckets")
    merged.write.partitionBy("namespace", "bucket").parquet(out)
    schema = T.StructType([f for f in stored.schema if f.name not in ("namespace", "bucket")])
    kept = spark.read.schema(stored.schema).parquet(out)
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for namespace, bucket in touched:
        own = kept.where(lies(namespace, bucket)).select(*schema.names)
        folder = f"{path}/{escaped('namespace', namespace)}/bucket={bucket}"
        own.coalesce(1).write.mode("overwrite").parquet(folder)
    return touched
