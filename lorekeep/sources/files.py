"""Text of drive files by MIME type."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator, Mapping
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Export format of editor documents; every other type is read as it is.
EXPORT_FORMATS = {
    "application/vnd.google-apps.document": "text/plain",
    "application/vnd.google-apps.spreadsheet": "text/csv",
    "application/vnd.google-apps.presentation": "text/plain",
}
EXTENSIONS = {
    "gdoc": "application/vnd.google-apps.document",
    "gsheet": "application/vnd.google-apps.spreadsheet",
    "gslides": "application/vnd.google-apps.presentation",
    "pdf": "application/pdf",
    "txt": "text/plain",
}
RAW_MIME = "application/octet-stream"


def _pick(value: Column, table: Mapping[str, str], default: Column) -> Column:
    for key, answer in table.items():
        default = F.when(value == key, F.lit(answer)).otherwise(default)
    return default


def export_format(mime: Column) -> Column:
    """The format a file is exported in, or its own type."""
    return _pick(mime, EXPORT_FORMATS, mime)


@F.arrow_udf(T.StringType())
def _drop_bad_bytes(content: pa.Array) -> pa.Array:
    return pa.array(
        [None if c is None else c.decode("utf-8", errors="ignore") for c in content.to_pylist()], pa.string()
    )


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes; invalid bytes are dropped. Only invalid contents travel to Python."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    return F.coalesce(F.when(valid, text), _drop_bad_bytes(F.when(~valid, content)))


FOLDERS = 10_000  # that the driver hands out; what lies deeper a task walks by itself
HELD_BYTES = 8 << 20  # of contents that a task gathers before it sends them on, and HELD_FILES of them
HELD_FILES = 1_000
_LISTED = "path string, modificationTime timestamp, length bigint"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _local(path: str) -> str | None:
    """The folder a path names on a local or mounted file system; None for files, globs and other stores."""
    folder = path if urlsplit(path).scheme == "" else urlsplit(path).path if path.startswith("file:") else None
    return os.path.abspath(folder) if folder and not glob.has_magic(folder) and "{" not in folder and os.path.isdir(folder) else None


def _top(folder: str) -> Iterator[tuple[str, bool]]:
    """Folders that together hold all of one, and whether what is below them is meant too: level by level, as long as there are few."""
    level = [folder]
    while True:
        below = []
        for place in level:
            with os.scandir(place) as entries:
                below += [e.path for e in entries if not _hidden(e.name) and e.is_dir()][: FOLDERS + 1]
            if len(below) > FOLDERS:
                break
        if not below or len(below) > FOLDERS:
            yield from ((place, True) for place in level)
            return
        yield from ((place, False) for place in level)
        level = below


def _listed(spark: SparkSession, folder: str, pattern: str | None) -> DataFrame:
    """The files of a local folder, listed by the tasks: the driver sees folders only."""
    named = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern(), re.DOTALL) if pattern else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])

        def found() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                open_ = [(row["place"], row["deep"]) for row in batch.to_pylist()]
                while open_:
                    place, deep = open_.pop()
                    with os.scandir(place) as entries:
                        for e in entries:
                            if _hidden(e.name):
                                continue
                            if e.is_dir():
                                open_ += [(e.path, True)] if deep else []
                            elif named is None or named.fullmatch(e.name):
                                stat = e.stat()
                                if stat.st_size:  # Spark's readers pass over empty files
                                    yield f"file:{e.path}", stat.st_mtime_ns // 1_000_000 * 1_000, stat.st_size

        held = []
        for row in found():
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    places = spark.createDataFrame(list(_top(folder)), "place string, deep boolean")
    return places.repartition(spark.sparkContext.defaultParallelism).mapInArrow(walk, _LISTED)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the bytes of the files, a few megabytes at a time."""
    for batch in batches:
        start, held, size = 0, [], 0
        for at, path in enumerate(batch.column("path").to_pylist()):
            with open(path.removeprefix("file:"), "rb") as file:
                held.append(file.read())
            size += len(held[-1])
            if size >= HELD_BYTES or len(held) == HELD_FILES or at + 1 == batch.num_rows:
                part = batch.slice(start, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                start, held, size = at + 1, [], 0


def _binary_files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """The columns of Spark's ``binaryFile`` source: path, modificationTime, length, content.

    That source lists every file in the driver, several hundred bytes for each, and starts processes for some on a local store. Of a folder on a
    local or mounted file system the tasks list and read the files; other stores are left to Spark.
    """
    if folder := _local(path):
        listed = _listed(spark, folder, pattern)
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return listed.repartition(parts).mapInArrow(_contents, f"{_LISTED}, content binary")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_files(
    spark: SparkSession,
    path: str,
    extensions: Mapping[str, str] = EXTENSIONS,
    pattern: str | None = None,
    kind: Column | None = None,
) -> DataFrame:
    """One row per file: path, mime_type, format, modified_time, size, content.

    ``kind`` says which of ``extensions`` a file has, by default the end of its path in lower case; any other kind is read as raw bytes.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = _pick(extension if kind is None else kind, extensions, F.lit(RAW_MIME))
    return _binary_files(spark, path, pattern).select(
        "path",
        mime.alias("mime_type"),
        export_format(mime).alias("format"),
        F.col("modificationTime").alias("modified_time"),
        F.col("length").alias("size"),
        decode_text(F.col("content")).alias("content"),
    )
