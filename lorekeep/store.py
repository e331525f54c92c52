"""A versioned table of documents and their chunks: a commit log over appended batches and a bucketed base.

    log/00000007.batch.json     which batch (run, batch_id) has been written
    log/00000008.base.json      up to which version the base covers the log, and in which folder each bucket of it lies
    chunks|docs|.../run=/batch_id=/   rows of a batch
    base/chunks|docs/v=/bucket=/      rows of a bucket, as of a compaction

A write counts from the moment its log entry is there, which is renamed into place when it is whole. What a crash leaves behind has no
entry: no reader sees it, and the repeated batch or the next compaction writes it anew. Readers open the base and later batches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # of a new table; kept in its base entries
SPREAD = 4  # parts that the rows of a bucket are dealt out to when it is written
ROW_GROUP = 16 << 20  # bytes that a writer gathers, and a reader of one column takes at once at most; texts and vectors are wide


def write_rows(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Over what lies there, in row groups that a task can hold several of."""
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy(*by).parquet(path)


class Log:
    """The entries of one table, through Hadoop's file system, so any store that Spark reaches will do.

    One driver at a time should write to a table: where renaming replaces an existing file, two could take the same version.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self.folder = f"{path}/log"
        self.fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = spark._jvm.org.apache.commons.io.IOUtils.toString

    def names(self) -> list[str]:
        folder = self._path(self.folder)
        if not self.fs.exists(folder):
            return []
        return sorted(name for status in self.fs.listStatus(folder) if (name := status.getPath().getName()).endswith(".json"))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self._read(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, kind: str, entry: Mapping) -> int:
        """Add an entry with the next free version; a version taken meanwhile is passed over."""
        names = self.names()
        version = int(names[-1].split(".")[0]) + 1 if names else 0
        draft = self._path(f"{self.folder}/.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        while True:
            target = self._path(f"{self.folder}/{version:08d}.{kind}.json")
            taken = any(name.startswith(f"{version:08d}.") for name in self.names())
            if not taken and self.fs.rename(draft, target):
                return version
            version += 1

    def folders(self, path: str) -> list[str]:
        """Names of the folders under a path."""
        place = self._path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(place) if s.isDirectory()] if self.fs.exists(place) else []


class Store:
    """A table under ``path``. ``schemas`` names its parts and their columns; ``docs`` and ``chunks`` make up the base."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schemas, self.log = spark, path, schemas, Log(spark, path)
        self.buckets = buckets

    def state(self) -> tuple[dict, list[dict]]:
        """The last base entry, and the entries of the batches it does not cover, in order."""
        names = self.log.names()
        bases = [name for name in names if ".base." in name]
        base = self.log.read(bases[-1]) if bases else {"covers": -1, "buckets": self.buckets, "chunks": {}, "docs": {}}
        later = [name for name in names if ".batch." in name and int(name.split(".")[0]) > base["covers"]]
        return base, [self.log.read(name) | {"version": int(name.split(".")[0])} for name in later]

    def place(self, part: str, run: str, batch_id: int) -> str:
        return f"{self.path}/{part}/run={run}/batch_id={batch_id}"

    def committed(self, run: str, batch_id: int) -> bool:
        """Whether the batch has been written; of batches that the base covers only the last of each run is remembered."""
        base, later = self.state()
        return batch_id <= base.get("runs", {}).get(run, -1) or any((e["run"], e["batch_id"]) == (run, batch_id) for e in later)

    def append(self, run: str, batch_id: int, parts: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> None:
        """Write the parts of a batch and commit it; a repeated batch overwrites itself and is committed once.

        A function is called for its rows when the parts before it are written.
        """
        for part, rows in parts.items():
            write_rows(rows() if callable(rows) else rows, self.place(part, run, batch_id))
        if not self.committed(run, batch_id):
            self.log.commit("batch", {"run": run, "batch_id": batch_id})

    def written(self, part: str, run: str, batch_id: int) -> DataFrame:
        """Rows of a part of a batch, committed or not."""
        return self.spark.read.schema(self.schemas[part]).parquet(self.place(part, run, batch_id))

    def discard(self, part: str, run: str, batch_id: int) -> None:
        """Delete what a batch wrote for its own use only."""
        self.log.fs.delete(self.log._path(self.place(part, run, batch_id)), True)

    def _read(self, part: str, paths: Sequence[str], root: str, more: str) -> DataFrame:
        schema = f"{self.schemas[part]}, {more}"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def batches(self, part: str, entries: Sequence[dict]) -> DataFrame:
        paths = [self.place(part, e["run"], e["batch_id"]) for e in entries]
        return self._read(part, paths, f"{self.path}/{part}", "run string, batch_id bigint")

    def every(self, part: str) -> DataFrame:
        """All rows of a part that is not compacted."""
        entries = [self.log.read(name) for name in self.log.names() if ".batch." in name]
        return self.batches(part, entries)

    def base(self, part: str, entry: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/base/{part}/v={v}/bucket={b}" for b, v in entry[part].items() if wanted is None or int(b) in wanted]
        return self._read(part, paths, f"{self.path}/base/{part}", "v int, bucket int")

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("namespace", "doc_id"), F.lit(buckets)).cast("int")

    def _newest(self, base: dict, later: Sequence[dict], buckets: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(documents of the base that still stand, documents of later batches that stand), by event time, then arrival.

        Base documents are compared by key and time alone; no chunk moves.
        """
        order = F.struct("seen_at", "indexed_at", "run", "batch_id")
        rest = [c for c in self.batches("docs", []).columns if c not in ("namespace", "doc_id")]
        fresh = self.batches("docs", later).groupBy("namespace", "doc_id").agg(F.max_by(F.struct(*rest), order).alias("__new"))
        fresh = fresh.select("namespace", "doc_id", "__new.*")
        old = self.base("docs", base, buckets)
        known = old.select(F.col("namespace").alias("__n"), F.col("doc_id").alias("__d"), F.struct("seen_at", "indexed_at").alias("__was"))
        same = F.col("namespace").eqNullSafe(F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__d"))
        met = fresh.join(known, same, "left")
        wins = met.where(F.col("__was").isNull() | (F.struct("seen_at", "indexed_at") >= F.col("__was"))).drop("__n", "__d", "__was")
        beaten = wins.select(F.col("namespace").alias("__n"), F.col("doc_id").alias("__d"))
        return old.join(beaten, same, "left_anti"), wins

    def _current(self, base: dict, later: Sequence[dict], buckets: Sequence[int] | None = None) -> DataFrame:
        """Chunks of the newest version of every document: those of the base but for beaten documents, which are few and can be broadcast,
        and those of later batches but for versions that do not stand, which are fewer than those that do: no chunk need be shuffled."""
        names = self.batches("chunks", []).drop("run", "batch_id").columns
        stand = self.base("chunks", base, buckets)
        if not later:
            return stand.select(*names)
        _, wins = self._newest(base, later, buckets)
        keys = ["namespace", "doc_id", "run", "batch_id"]
        renamed = wins.select(*[F.col(c).alias(f"__{c}") for c in keys])
        same = F.col("namespace").eqNullSafe(F.col("__namespace")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        kept = stand.join(renamed, same, "left_anti")
        version = (F.col("run") == F.col("__run")) & (F.col("batch_id") == F.col("__batch_id"))
        lost = self.batches("docs", later).select(*keys).join(renamed, same & version, "left_anti")
        lost = lost.select(*[F.col(c).alias(f"__{c}") for c in keys])
        fresh = self.batches("chunks", later).join(lost, same & version, "left_anti")
        return kept.select(*names).unionByName(fresh.select(*names))

    def current(self) -> DataFrame:
        return self._current(*self.state())

    def documents(self) -> DataFrame:
        """The newest version of every document, those without chunks included."""
        base, later = self.state()
        names = [c for c in self.batches("docs", []).columns if c not in ("run", "batch_id")]
        if not later:
            return self.base("docs", base).select(*names)
        stand, wins = self._newest(base, later)
        return stand.select(*names).unionByName(wins.select(*names))

    def compact(self) -> int:
        """Fold the later batches into the base: only buckets with documents of theirs are rewritten, the others keep their files."""
        base, later = self.state()
        if not later:
            return base["covers"]
        hashed = self.batches("docs", later).select(self.bucket(base["buckets"]).alias("b")).distinct()
        touched = sorted(r["b"] for r in hashed.collect())  # at most as many as there are buckets
        stand, wins = self._newest(base, later, touched)
        names = [c for c in self.batches("docs", []).columns if c not in ("run", "batch_id")]
        docs = stand.select(*names).unionByName(wins.select(*names))
        rows = self._current(base, later, touched)
        version = later[-1]["version"]
        attempt = version * 1000 + sum(f.startswith("v=") for f in self.log.folders(f"{self.path}/base/docs"))
        entry = {"covers": version, "buckets": base["buckets"], "runs": dict(base.get("runs", {}))}
        for part, frame in (("docs", docs), ("chunks", rows)):
            out = f"{self.path}/base/{part}/v={attempt}"
            placed = frame.withColumn("bucket", self.bucket(base["buckets"]))
            write_rows(placed.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))), out, ["bucket"])
            written = {name.split("=")[1] for name in self.log.folders(out)}
            entry[part] = {b: v for b, v in base[part].items() if int(b) not in touched} | {b: attempt for b in sorted(written, key=int)}
        for e in later:
            entry["runs"][e["run"]] = max(e["batch_id"], entry["runs"].get(e["run"], -1))
        self.log.commit("base", entry)
        return version

    def vacuum(self) -> list[str]:
        """Delete the chunk and document folders of batches that the base covers, and base folders that no bucket points to any more.

        For when no reader of an older state is at work. Entries and other parts (dead letters, ledger) stay.
        """
        base, later = self.state()
        live = {(e["run"], e["batch_id"]) for e in later}
        gone = []
        for name in self.log.names():
            if ".batch." in name and int(name.split(".")[0]) <= base["covers"]:
                e = self.log.read(name)
                if (e["run"], e["batch_id"]) not in live:
                    gone += [self.place(part, e["run"], e["batch_id"]) for part in ("chunks", "docs")]
        for part in ("chunks", "docs"):
            used = {f"v={v}" for v in base[part].values()}
            gone += [f"{self.path}/base/{part}/{f}" for f in self.log.folders(f"{self.path}/base/{part}") if f.startswith("v=") and f not in used]
        return [path for path in gone if self.log.fs.delete(self.log._path(path), True)]
