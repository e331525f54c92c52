"""Approximate top-k over an inverted file: vectors are stored by the cell of their nearest centroid, a query reads a few cells.

The index lies under one path: ``vectors`` partitioned by cell, and ``cells`` (cell, centroid, number of vectors, and in the row of
NO_CELL the number of cells to probe for the wanted recall, measured when the index was built).
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators import search as sr

MAX_CENTROID_BYTES = 32 << 20  # of the centroids that every task holds
TRAINED_PER_CELL = 64  # vectors that k-means sees for each cell, at most
ROUNDS = 8
MEASURED = 200  # vectors whose neighbours the number of probes is measured on, at most
CELL_ROWS = 500_000  # larger cells are written as several files
NO_CELL = -1  # of vectors without a direction: null, zero or not finite


def _nearest_cells(matrix: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest cells of each row, nearest first."""
    scores = sr._unit(matrix) @ centroids.T
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if n == 1:
        return scores.argmax(1)[:, None]
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def _arrays(batch: pa.RecordBatch, name: str = "values") -> np.ndarray:
    return sr._matrix(batch.column(name))


def _has_direction() -> Column:
    """False for a vector that is null, zero, or holds something null or not finite: it has no nearest cell."""
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists("values", lambda x: x != 0), F.lit(False))


def learn_centroids(vectors: DataFrame, cells: int, rounds: int = ROUNDS, per_cell: int = TRAINED_PER_CELL) -> np.ndarray:
    """Spherical k-means in Spark: each round the tasks sum their unit vectors by nearest centroid, and one row a cell comes back.

    It learns from at most about ``per_cell`` vectors a cell, chosen by a hash of their id; the first centroids are the first of
    those. A cell that loses its vectors keeps its centroid.
    """
    context = vectors.sparkSession.sparkContext
    own = vectors.where(_has_direction()).select("id", "values")
    share = min(1.0, cells * per_cell / max(1, own.count()))
    taught = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    first = taught.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(cells).select("values").toArrow()
    centroids = sr._unit(np.concatenate([_arrays(b) for b in first.to_batches()])) if first.num_rows else np.zeros((0, 0))

    for _ in range(rounds if len(centroids) else 0):
        shared = context.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            total, count = np.zeros(held.shape), np.zeros(len(held), np.int64)
            for batch in batches:
                if batch.num_rows:
                    unit = sr._unit(_arrays(batch))
                    cell = _nearest_cells(unit, held)[:, 0]
                    np.add.at(total, cell, unit)
                    count += np.bincount(cell, minlength=len(held))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["cell", "total"])

        added = lambda left, right: F.zip_with(left, right, lambda a, b: a + b)
        parts = taught.select("values").mapInArrow(sums, "cell long, total array<double>")
        # One partial sum per task and cell; they are added up in array order, so the result does not depend on their arrival.
        summed = parts.groupBy("cell").agg(F.array_sort(F.collect_list("total")).alias("totals"))
        summed = summed.select("cell", F.aggregate(F.slice("totals", 2, F.size("totals")), F.element_at("totals", 1), added).alias("total"))
        found = summed.toArrow()
        shared.unpersist()
        moved = centroids.copy()
        if found.num_rows:
            moved[found.column("cell").to_numpy()] = sr._unit(np.array(found.column("total").to_pylist()))
        moved = np.where(np.isnan(moved), centroids, moved)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with ``cell``, that of the nearest centroid by cosine; NO_CELL without a direction. No shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest_cells(_arrays(batch), shared.value)[:, 0] if len(shared.value) else np.zeros(batch.num_rows, np.int64)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    lost = vectors.where(~_has_direction()).withColumn("cell", F.lit(NO_CELL))
    return vectors.where(_has_direction()).mapInArrow(run, f"{fields}, cell int").unionByName(lost)


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 5) -> str:
    """Write the index of ``vectors`` (namespace, id, values and columns to carry) under ``path``.

    By default there are as many cells as the square root of the number of vectors, as far as their centroids stay below
    MAX_CENTROID_BYTES. The number of cells to probe is the smallest that holds ``recall`` of the exact neighbours of at most
    MEASURED vectors. Rows are shuffled once, by cell, large cells split into files of about CELL_ROWS rows.
    """
    spark = vectors.sparkSession
    size = vectors.where(_has_direction()).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("dims")).first()
    most = max(1, MAX_CENTROID_BYTES // (8 * max(1, size["dims"] or 1)))
    centroids = learn_centroids(vectors, min(most, max(1, cells or math.isqrt(size["n"]))))
    placed = assign(vectors, centroids)
    files = max(1, math.ceil(size["n"] / max(1, len(centroids)) / CELL_ROWS))
    spread = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files)))
    spread.write.option("maxRecordsPerFile", CELL_ROWS).partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    sizes = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}  # a row for each cell
    probes = _measured_probes(stored, centroids, recall, k)
    rows = [(NO_CELL, None, sizes.get(NO_CELL, 0), probes, placed.schema.json())]
    rows += [(c, own.tolist(), sizes.get(c, 0), None, None) for c, own in enumerate(centroids)]
    cells = spark.createDataFrame(rows, "cell int, centroid array<double>, vectors long, probes int, fields string")
    cells.coalesce(1).write.parquet(f"{path}/cells")
    return path


def _measured_probes(vectors: DataFrame, centroids: np.ndarray, recall: float, k: int) -> int:
    """How many cells hold the wanted share of the exact neighbours of some stored vectors, themselves apart."""
    if not len(centroids):
        return 1
    spark, stored = vectors.sparkSession, vectors.where(F.col("cell") != NO_CELL)
    asked = stored.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(MEASURED).select(F.concat_ws("|", "namespace", "id").alias("query_id"), "values")
    asked = spark.createDataFrame(asked.toArrow())
    hits = sr.top_k(asked, stored, k + 1, carry=["cell"]).where("query_id <> concat_ws('|', namespace, id)").where(F.col("rank") <= k + 1)
    own = asked.toArrow()
    order = _nearest_cells(np.concatenate([_arrays(b) for b in own.to_batches()]), centroids, len(centroids))
    place = {q: {int(c): i for i, c in enumerate(row)} for q, row in zip(own.column("query_id").to_pylist(), order, strict=True)}
    needed = sorted(place[r["query_id"]][r["cell"]] + 1 for r in hits.select("query_id", "cell").collect())
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1


class Index:
    """What the driver knows of a written index: centroids, the sizes of the cells, and how to read them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.schema("cell int, centroid array<double>, vectors long, probes int, fields string").parquet(f"{path}/cells").toArrow()
        rows = sorted(rows.to_pylist(), key=lambda r: r["cell"])
        self.probes, self.fields = rows[0]["probes"], T.StructType.fromJson(json.loads(rows[0]["fields"]))
        self.centroids = np.array([r["centroid"] for r in rows[1:]]) if rows[1:] else np.zeros((0, 0))
        self.sizes = {r["cell"]: r["vectors"] for r in rows}

    def vectors(self, cells: Sequence[int] | None = None) -> DataFrame:
        """All vectors, or those of some cells: only their directories are listed and opened."""
        reader = self.spark.read.schema(self.fields).option("basePath", f"{self.path}/vectors")
        if cells is None:
            return reader.parquet(f"{self.path}/vectors")
        paths = [f"{self.path}/vectors/cell={c}" for c in cells if self.sizes.get(c)]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.fields)


def top_k(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    probes: int | None = None,
    carry: Sequence[str] = (),
    resident: int | None = None,
) -> DataFrame:
    """The k best of the vectors in the ``probes`` nearest cells of each query, by cosine: query_id, namespace, id, score, rank.

    Scores are exact. Cells are directories: only those that some query of a pass probes are read, and a row meets only the queries that probe its
    cell, which is the equi join of queries and index on the cell, made inside the task. By default as many cells are probed as the
    index found it needs. A query that finds fewer than k rows, or has no direction, is searched exactly. More queries than a task may
    hold are taken in blocks, each reading its own cells, so what a query finds does not depend on the others.
    """
    sr._checked("cosine", k)
    index = Index(spark, path)
    wanted = min(len(index.centroids), probes or index.probes)
    asked = sr._usable(queries, "query_id")
    bound = sr._bound(asked, resident)
    whole = sr._resident(asked, bound)
    if whole:
        # At most k rows for each of the resident queries come back, so the driver can tell which are short of k.
        ids = whole[0]
        hits = sr._ranked(_cell_hits(index, whole, wanted, k), k, "cosine", False).toArrow()
        met = Counter(hits.column("query_id").to_pylist())
        near = spark.createDataFrame(hits)
        short = [q for q in ids if met[q] < k]
        if short:
            few = asked.where(F.col("query_id").isin(short))
            exact = sr.top_k(few, index.vectors(), k, resident=resident)
            near = near.where(~F.col("query_id").isin(short)).unionByName(exact)
        return sr._carried(near, index.vectors(), carry, len(ids) * k) if carry else near
    out = sr.scratch_path(spark, "hits")
    spark.createDataFrame([], sr._HITS).write.parquet(f"{out}/block=-1")
    for number, load in enumerate(sr._blocks(asked, bound)):
        _cell_hits(index, load, wanted, k).write.parquet(f"{out}/block={number}")
    near = sr._ranked(spark.read.schema(f"{sr._HITS}, block int").parquet(out).drop("block"), k, "cosine", False)
    enough = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    exact = sr.top_k(asked.join(enough, "query_id", "left_anti"), index.vectors(), k, resident=resident)
    near = near.join(enough, "query_id", "left_semi").unionByName(exact)
    return sr._carried(near, index.vectors(), carry, None) if carry else near


def probed_cells(centroids: np.ndarray, queries: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """For each cell that some query probes, the places of those queries."""
    cells = _nearest_cells(queries, centroids, max(2, probes))[:, :probes]
    directed = np.flatnonzero(np.isfinite(queries).all(1) & (queries != 0).any(1))
    cells = cells[directed]
    order = np.argsort(cells, axis=None, kind="stable")
    names, starts = np.unique(cells.reshape(-1)[order], return_index=True)
    owners = directed[order // cells.shape[1]] if cells.size else directed
    return dict(zip(names.tolist(), np.split(owners, starts[1:]), strict=True)) if len(names) else {}


def _cell_hits(index: Index, load: tuple[list[str], np.ndarray], probes: int, k: int) -> DataFrame:
    ids, matrix = load
    probing = probed_cells(index.centroids, matrix, probes) if len(ids) and len(index.centroids) else {}
    shared = index.spark.sparkContext.broadcast((ids, matrix, probing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, places = shared.value
        best = sr._Best(len(query_ids), k, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            vectors = _arrays(batch)
            named = sr._named(*[np.asarray(batch.column(c).to_pylist(), dtype=object) for c in ("id", "namespace")])
            for cell in np.unique(cells).tolist():
                mine, columns = np.flatnonzero(cells == cell), places[cell]
                step = max(1, sr.BLOCK_SCORES // len(columns))
                for at in range(0, len(mine), step):
                    rows = mine[at : at + step]
                    best.add("", named[rows], sr.goodness(vectors[rows], queries[columns], "cosine"), columns)
        yield sr._rows_to_batch(best.rows(query_ids, "cosine"))

    # The list of cells has at most as many entries as there are centroids, whatever the number of rows.
    return index.vectors(sorted(probing)).select("cell", "namespace", "id", "values").mapInArrow(run, sr._HITS)
