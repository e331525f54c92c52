"""The vector table: upsert, replace, delete, statistics, coverage, change detection, dedup.

Table columns: namespace, id, doc_id (source-id of the document), values, content and metadata, indexed_at.
Every operator returns the new table; it is written to a new path (see ``lorekeep.sinks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.identity import content_hash

KEYS = ("namespace", "id")


def latest_by(df: DataFrame, keys: Sequence[str], newest: Sequence[str | Column]) -> DataFrame:
    """Last row per key as a partial aggregate, so copies of a hot key are reduced before the shuffle."""
    rest = [name for name in df.columns if name not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("__row"))
    return best.select(*[F.col(n) if n in keys else F.col(f"__row.{n}").alias(n) for n in df.columns])


def upsert(index: DataFrame, new: DataFrame, indexed_at: Column, newest: Sequence[str] = ()) -> DataFrame:
    """Last write per (namespace, id) wins; the new rows are stamped.

    Only the new rows are grouped (``newest`` orders repeats among them, by default all columns, maps as JSON); the index is
    met by an anti join on its keys, so it is neither sorted nor shuffled when the new keys are few.
    """
    stamped = new.withColumn("indexed_at", indexed_at)
    maps = {f.name for f in stamped.schema if "map<" in f.dataType.simpleString()}
    rest = [F.to_json(name) if name in maps else F.col(name) for name in stamped.columns if name not in KEYS]
    last = latest_by(stamped, KEYS, list(newest) or rest)
    return delete(index, last).unionByName(last, allowMissingColumns=True)


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove ids; ``ids`` has namespace and id. Ids that are not there are ignored."""
    return index.join(ids.select(*KEYS), list(KEYS), "left_anti")


def replace_docs(index: DataFrame, new: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """New chunks of a document replace all its old ones, also when there are now fewer (or none).

    ``docs`` names the re-ingested documents (namespace, doc_id); by default those in ``new``.
    """
    keys = ["namespace", "doc_id"]
    touched = (new if docs is None else docs).select(*keys).distinct()
    return index.join(touched, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def sync_deletes(index: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep the vectors whose source document was deleted out of the index."""
    return index.join(sources.select(key), key, "left_anti")


def index_stats(index: DataFrame) -> DataFrame:
    """Vectors and dimension per namespace, and a row with a null namespace for the whole index.

    The dimension is that of the longest vector, ``least_dimension`` that of the shortest; they differ in a mixed index. Rows
    without a vector count as vectors but have no dimension.
    """
    size = F.when(F.col("values").isNotNull(), F.size("values"))
    counts = index.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("vector_count"), F.max(size).alias("dimension"), F.min(size).alias("least_dimension")
    )
    return counts.rollup("namespace").agg(
        F.sum("vector_count").alias("vector_count"),
        F.max("dimension").alias("dimension"),
        F.min("least_dimension").alias("least_dimension"),
    )


def coverage(source: DataFrame, index: DataFrame, key: str = "doc_id", by: str = "source") -> DataFrame:
    """Share of source items that are in the index."""
    there = index.select(key).distinct().withColumn("__there", F.lit(1.0))
    joined = source.select(key, by).join(there, key, "left")
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("__there").alias("indexed"),
        F.avg(F.coalesce("__there", F.lit(0.0))).alias("coverage"),
    )


def change_detect(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """new, changed, unchanged or deleted per document; only keys and hashes are shuffled."""
    before = old.select(key, content_hash(F.col(text)).alias("old_hash"), F.lit(1).alias("__old"))
    after = new.select(key, content_hash(F.col(text)).alias("new_hash"), F.lit(1).alias("__new"))
    status = (
        F.when(F.col("__old").isNull(), "new")
        .when(F.col("__new").isNull(), "deleted")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, key, "full_outer").select(key, status.alias("status"), "old_hash", "new_hash")


def first_copies(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Per content: its hash, the smallest ``keep`` that has it, and the number of copies.

    Copies are reduced to a partial minimum in each task, so a content that makes up a third of the
    rows sends one row per task to its group, and no text is shuffled.
    """
    return df.groupBy(content_hash(F.col(text)).alias("content_sha256")).agg(
        F.min(keep).alias(keep), F.count(F.lit(1)).alias("copies")
    )


def dedup(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """One row of each content (a null text is a content too): that with the smallest ``keep``, one without an id only if none has one.

    Ids may repeat, also under different contents: every content keeps a row. Among rows of one content and id the one
    with the smallest hash of all its columns stays, and of rows that are equal throughout, one. Contents, ids and hashes
    alone are grouped, with partial counts per task; their repeats meet the table in one join, so no text
    moves where they are few enough to broadcast. Only rows that are equal throughout are grouped as a whole.
    """
    maps = {f.name for f in df.schema if "map<" in f.dataType.simpleString()}
    row = F.xxhash64(*[F.to_json(name) if name in maps else F.col(name) for name in df.columns])
    hashed = df.withColumns({"__hash": content_hash(F.col(text)), "__order": F.struct(F.col(keep).isNull(), F.col(keep), row)})
    counted = hashed.groupBy("__hash", "__order").agg(F.count(F.lit(1)).alias("__same"))
    firsts = (
        counted.groupBy(F.col("__hash").alias("__content"))
        .agg(F.min("__order").alias("__first"), F.min_by("__same", "__order").alias("__equal"), F.sum("__same").alias("__copies"))
        .where("__copies > 1")
    )
    met = hashed.join(firsts, F.col("__hash").eqNullSafe(F.col("__content")), "left")
    lone = met.where(F.col("__copies").isNull() | ((F.col("__order") == F.col("__first")) & (F.col("__equal") == 1)))
    equal = firsts.where("__equal > 1").select("__content", "__first")
    again = hashed.join(equal, F.col("__hash").eqNullSafe(F.col("__content")) & (F.col("__order") == F.col("__first")))
    one = again.groupBy("__hash").agg(F.any_value(F.struct(*df.columns)).alias("__row"))
    return lone.select(*df.columns).unionByName(one.select("__row.*"))


def since(df: DataFrame, marks: DataFrame, key: str = "source", modified: str = "modified") -> DataFrame:
    """Rows changed after the last sync of their source; a source without a mark comes in whole.

    ``marks`` has one row per source (key, last_seen).
    """
    joined = df.join(marks.select(key, "last_seen"), key, "left")
    fresh = F.col("last_seen").isNull() | (F.col(modified) > F.col("last_seen"))
    return joined.where(fresh).drop("last_seen")


def next_marks(df: DataFrame, marks: DataFrame, key: str = "source", modified: str = "modified") -> DataFrame:
    """Marks to store once the rows of ``since`` have been processed."""
    seen = df.groupBy(key).agg(F.max(modified).alias("last_seen"))
    return seen.unionByName(marks.select(key, "last_seen")).groupBy(key).agg(F.max("last_seen").alias("last_seen"))
