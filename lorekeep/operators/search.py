"""Exact top-k vector search for a table of queries (approximate: ``lorekeep.operators.ivf``).

``queries`` has query_id and values; ``vectors`` has namespace, id, values. The index is never shuffled
or broadcast while the queries fit a checked bound: each task scores its index rows block by block and
gives back only its best k per query, so pairs are never materialised. More queries than the bound are
cut into blocks, and a task scores each slab of its rows against one block after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.identity import NAMESPACES
from lorekeep.operators.embedding import HASH_DIMS, embed_hash
from lorekeep.session import scratch_path

METRICS = ("cosine", "euclidean", "dotproduct")  # fixed values
RESIDENT_BYTES = 32 << 20  # of the queries that every task holds
PASS_BYTES = 128 << 20  # of the queries that meet the index in one pass, in blocks of RESIDENT_BYTES
HITS_TO_BROADCAST = 500_000
SLAB_ROWS = 16_384
BLOCK_SCORES = 2_000_000
RUN = 128  # rows of which the highest score stands for all
SCORE_PLACES = 6
_HITS = "query_id string, namespace string, id string, score double"
_ARROW_HITS = pa.schema(
    [("query_id", pa.string()), ("namespace", pa.string()), ("id", pa.string()), ("score", pa.float64())]
)


def _matrix(values: pa.Array) -> np.ndarray:
    """Two-dimensional doubles of an Arrow list column of equal lengths; a null element is nan.

    Vectors of different lengths raise: side by side they would take each other's elements.
    """
    if len(values) and pc.count_distinct(pc.list_value_length(values)).as_py() > 1:
        raise ValueError("the vectors of one search must have one dimension")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row becomes nan."""
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, np.nan, norms)


def _raw(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all vectors against all queries, not rounded, higher is better, nan where undefined; those of a query lie side by side.

    For the cosine both must be of length one.
    """
    if len(vectors) and len(queries) and vectors.shape[1] != queries.shape[1]:
        raise ValueError(f"queries have {queries.shape[1]} dimensions, vectors {vectors.shape[1]}")
    if metric != "euclidean":
        return (queries @ vectors.T).T
    scores = np.empty((len(queries), len(vectors)))
    for j, query in enumerate(queries):
        gap = vectors - query
        scores[j] = -np.sqrt((gap * gap).sum(axis=1))
    return scores.T


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), -np.inf, np.round(scores, SCORE_PLACES) + 0.0)


def goodness(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all vectors against all queries, higher is better, -inf where undefined."""
    if metric == "cosine":
        vectors, queries = _unit(vectors), _unit(queries)
    return _rounded(_raw(vectors, queries, metric))


def _contenders(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and rounded scores of all that may be among the best ``k`` of a query, and not below its ``floor``; by query.

    Scores have a row for each query. They are read once, for the highest of each run of RUN rows: the k-th highest of these is a bound
    that k rows reach, and only runs that reach it are looked into.
    """
    n = scores.shape[1]
    starts = np.arange(0, n, RUN)
    whole = n - n % RUN
    peaks = scores[:, :whole].reshape(len(scores), -1, RUN).max(axis=2)
    if whole < n:
        peaks = np.concatenate([peaks, scores[:, whole:].max(axis=1, keepdims=True)], axis=1)
    if np.isnan(peaks).any():
        return _contenders(np.where(np.isnan(scores), -np.inf, scores), floor, k)
    if n > k:
        bounds = peaks if len(starts) > k else scores
        at = bounds.shape[1] - k
        floor = np.maximum(floor, np.partition(bounds, at, axis=1)[:, at])
    known = np.isfinite(floor)
    floor = np.where(known, floor - 10.0**-SCORE_PLACES - 1e-9 * np.abs(np.where(known, floor, 0)), floor)  # what rounding may bring up to it
    asked, runs = np.nonzero(peaks >= floor[:, None])
    rows = starts[runs][:, None] + np.arange(min(RUN, n))
    found = scores[asked[:, None], np.minimum(rows, n - 1)]
    which, place = np.nonzero((found >= floor[asked][:, None]) & (rows < n))
    return asked[which], rows[which, place], _rounded(found[which, place])


class _Best:
    """Best k (score, id) per query of the rows seen so far in one task: of each namespace, or of all of them together,
    where an id carries its namespace."""

    def __init__(self, queries: int, k: int, by_namespace: bool = True):
        self.k = k
        self.by_namespace = by_namespace
        self.queries = queries
        self.kept: dict[str, list[list[tuple[float, str]]]] = {}

    def add(self, namespace: str, ids: np.ndarray, scores: np.ndarray, columns: np.ndarray | None = None) -> None:
        """``columns`` names the queries that were scored; by default all."""
        every = self.kept.setdefault(namespace, [[] for _ in range(self.queries)])
        kept = every if columns is None else [every[j] for j in columns]
        if not len(ids) or not kept:
            return
        floor = np.array([pairs[-1][0] if len(pairs) == self.k else -np.inf for pairs in kept])
        asked, rows, good = _contenders(np.ascontiguousarray(scores.T), floor, self.k)
        bounds = np.searchsorted(asked, np.arange(len(kept) + 1))
        for j in np.flatnonzero(np.diff(bounds)).tolist():
            mine = slice(bounds[j], bounds[j + 1])
            pairs = kept[j] + list(zip(good[mine].tolist(), ids[rows[mine]].tolist()))
            pairs.sort(key=lambda pair: (-pair[0], pair[1]))
            every[j if columns is None else columns[j]] = pairs[: self.k]

    def rows(self, query_ids: Sequence[str], metric: str) -> list[tuple]:
        sign = -1.0 if metric == "euclidean" else 1.0
        named = lambda namespace, row_id: (namespace, row_id) if self.by_namespace else row_id[::-1]
        return [
            (query_ids[j], *named(namespace, row_id), None if math.isinf(score) else sign * score + 0.0)
            for namespace, kept in self.kept.items()
            for j, pairs in enumerate(kept)
            for score, row_id in pairs
        ]


def _groups(batch: pa.RecordBatch, metric: str, by_namespace: bool) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Namespace, ids and vectors, ready to be scored, of a batch: one group, whose ids carry their namespace, or one for each namespace."""
    namespaces = np.asarray(batch.column("namespace").to_pylist(), dtype=object)
    ids = np.asarray(batch.column("id").to_pylist(), dtype=object)
    vectors = _matrix(batch.column("values"))
    vectors = _unit(vectors) if metric == "cosine" else vectors
    if not by_namespace:
        return [("", _named(ids, namespaces), vectors)]
    return [(name, ids[mine], vectors[mine]) for name in sorted(set(namespaces.tolist())) for mine in [namespaces == name]]


def _score_groups(best: _Best, groups: list[tuple[str, np.ndarray, np.ndarray]], queries: np.ndarray, metric: str) -> None:
    """Score in blocks, so the scores held at once do not grow with the number of queries."""
    step = max(1, BLOCK_SCORES // max(1, len(queries)))
    asked = _unit(queries) if metric == "cosine" else queries
    for namespace, ids, vectors in groups:
        for start in range(0, len(ids), step):
            block = slice(start, start + step)
            best.add(namespace, ids[block], _raw(vectors[block], asked, metric))


def _score_batch(best: _Best, batch: pa.RecordBatch, queries: np.ndarray, metric: str) -> None:
    _score_groups(best, _groups(batch, metric, best.by_namespace), queries, metric)


def _named(ids: np.ndarray, namespaces: np.ndarray) -> np.ndarray:
    """Ids that carry their namespace, for the best of all namespaces together."""
    both = np.empty(len(ids), object)
    both[:] = list(zip(ids.tolist(), namespaces.tolist(), strict=True))
    return both


def _rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    arrays = [pa.array(list(column), field.type) for column, field in zip(columns, _ARROW_HITS)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_HITS)


def _bound(queries: DataFrame, resident: int | None) -> int:
    """How many queries a task may hold: ``resident``, or what fits RESIDENT_BYTES at their longest dimension."""
    if resident is not None:
        return resident
    longest = queries.agg(F.max(F.size("values"))).first()[0]
    return max(1, RESIDENT_BYTES // (8 * max(1, longest or 1)))


def _blocks(queries: DataFrame, bound: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The queries in blocks of at most ``bound``, dealt out by a hash of their ids; the driver holds one at a time."""
    count = max(1, math.ceil(2 * queries.count() / bound))
    for block in range(count):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == block)
        loaded = _resident(mine, bound)
        for part in range(64 if loaded is None else 0):  # by another hash, where one block has too many
            own = _resident(mine.where(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(64)) == part), bound)
            if own is None:
                raise ValueError(f"more than {bound} queries of few ids: query_id must be unique")
            if own[0]:
                yield own
        if loaded is not None and loaded[0]:
            yield loaded


def _resident(queries: DataFrame, bound: int) -> tuple[list[str], np.ndarray] | None:
    """The queries as ids and a matrix, or None when there are more than ``bound``."""
    table = queries.limit(bound + 1).toArrow()
    if table.num_rows > bound:
        return None
    column = table.column("values").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return table.column("query_id").to_pylist(), _matrix(column)


def _local_hits(
    vectors: DataFrame, loads: Sequence[tuple[list[str], np.ndarray]], k: int, metric: str, by_namespace: bool = False
) -> DataFrame:
    """One pass over the index: each task meets its rows, slab by slab, with every block of queries, and keeps the best of each block."""
    context = vectors.sparkSession.sparkContext
    blocks = [context.broadcast(load) for load in loads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[int, _Best] = {}

        def meet(slab: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(slab).combine_chunks().to_batches() if slab else []
            groups = [group for batch in table for group in _groups(batch, metric, by_namespace)]
            for number, block in enumerate(blocks):
                query_ids, queries = block.value
                best = bests.setdefault(number, _Best(len(query_ids), k, by_namespace))
                if query_ids:
                    _score_groups(best, groups, queries, metric)

        slab, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                slab.append(batch)
                rows += batch.num_rows
            if rows >= SLAB_ROWS or len(blocks) == 1:
                meet(slab)
                slab, rows = [], 0
        meet(slab)
        for number, best in bests.items():
            yield _rows_to_batch(best.rows(blocks[number].value[0], metric))

    return vectors.select("namespace", "id", "values").mapInArrow(run, _HITS)


def _many_hits(queries: DataFrame, vectors: DataFrame, k: int, metric: str, by_namespace: bool, bound: int) -> DataFrame:
    """More queries than a task may hold at once: as many as PASS_BYTES hold, in blocks of ``bound``, in each pass over the index, which
    is never copied, and shuffled only where it has fewer splits than there are cores.

    Neither the driver nor a worker holds more than the queries of one pass. With more than one pass each writes its hits, of bounded number
    for each query, to the shared folder before the next is loaded.
    """
    spark, paths = vectors.sparkSession, []
    cores = spark.sparkContext.defaultParallelism
    if vectors.rdd.getNumPartitions() < cores:
        vectors = vectors.repartition(cores)
    longest = queries.agg(F.max(F.size("values"))).first()[0]
    most = max(bound, PASS_BYTES // (8 * max(1, longest or 1)))
    whole = _resident(queries, most)
    for ids, matrix in [whole] if whole else _blocks(queries, most):
        cuts = range(0, max(1, len(ids)), bound)
        hits = _local_hits(vectors, [(ids[at : at + bound], matrix[at : at + bound]) for at in cuts], k, metric, by_namespace)
        if whole:
            return hits
        paths.append(scratch_path(spark, "hits"))
        hits.write.parquet(paths[-1])
    return spark.read.schema(_HITS).parquet(*paths)


def _usable(frame: DataFrame, *names: str) -> DataFrame:
    return frame.where(F.col("values").isNotNull()).select(*names, "values")


def _ranked(hits: DataFrame, k: int, metric: str, per_namespace: bool) -> DataFrame:
    best = F.col("score").asc_nulls_last() if metric == "euclidean" else F.col("score").desc_nulls_last()
    groups = ["query_id", "namespace"] if per_namespace else ["query_id"]
    order = [best, "id"] if per_namespace else [best, "id", "namespace"]
    window = Window.partitionBy(*groups).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _checked(metric: str, k: int) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be at least 1")


def _carried(ranked: DataFrame, vectors: DataFrame, carry: Sequence[str], most: int | None) -> DataFrame:
    """Add index columns to hits. Only hits whose number has a proven bound are sent to the index."""
    if not carry:
        return ranked
    index = vectors.select("namespace", "id", *carry)
    small = most is not None and most <= HITS_TO_BROADCAST
    return index.join(F.broadcast(ranked) if small else ranked, ["namespace", "id"])


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    namespace: str | None = None,
    where: Column | None = None,
    per_namespace: bool = False,
    carry: Sequence[str] = (),
    resident: int | None = None,
    namespaces: int | None = None,
) -> DataFrame:
    """The k best vectors of each query: query_id, namespace, id, score, rank, carried columns.

    Scores are rounded to six places and ties broken by id. A source name is mapped to its namespace.
    A zero vector has null cosine and ranks last. ``where`` filters the index before scoring;
    ``namespaces`` is how many there can be, if known.
    """
    _checked(metric, k)
    index = vectors
    if namespace is not None:
        index = index.where(F.col("namespace") == NAMESPACES.get(namespace, namespace))
    if where is not None:
        index = index.where(where)
    asked = _usable(queries, "query_id")
    usable = _usable(index, "namespace", "id")
    loaded = _resident(asked, _bound(asked, resident))
    if loaded is not None:
        hits = _local_hits(usable, [loaded], k, metric, per_namespace)
    else:
        hits = _many_hits(asked, usable, k, metric, per_namespace, _bound(asked, resident))
    ranked = _ranked(hits, k, metric, per_namespace)
    groups = namespaces if per_namespace else 1
    most = len(loaded[0]) * k * groups if loaded is not None and groups else None
    return _carried(ranked, index, carry, most)


def top_k_all(queries: DataFrame, vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """k per known namespace; namespaces without hits give no rows, ``default`` is not searched."""
    known = vectors.where(F.col("namespace").isin(*NAMESPACES.values()))
    return top_k(queries, known, k, per_namespace=True, namespaces=len(NAMESPACES), **options)


def search_text(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    text: str = "text",
    content: str = "content",
    dims: int = HASH_DIMS,
    **options,
) -> DataFrame:
    """Text queries against chunks by cosine of their hashed terms.

    ``queries`` has query_id and text; ``chunks`` has namespace, id and content.
    """
    return top_k(embed_hash(queries, text, dims=dims), embed_hash(chunks, content, dims=dims), k, **options)


_COMPARISONS = {
    "$eq": lambda col, value: col == value,
    "$ne": lambda col, value: col != value,
    "$gt": lambda col, value: col > value,
    "$gte": lambda col, value: col >= value,
    "$lt": lambda col, value: col < value,
    "$lte": lambda col, value: col <= value,
    "$in": lambda col, value: col.isin(*value),
    "$nin": lambda col, value: ~col.isin(*value),
}


def metadata_where(filters: dict) -> Column:
    """Condition of a metadata filter: ``{"field": value}`` or ``{"field": {"$in": [...], "$gte": x}}``."""
    condition = F.lit(True)
    for name, wanted in filters.items():
        tests = wanted if isinstance(wanted, dict) else {"$eq": wanted}
        for operator, value in tests.items():
            if operator not in _COMPARISONS:
                raise ValueError(f"unknown filter operator {operator}")
            condition = condition & _COMPARISONS[operator](F.col(name), value)
    return condition


def rerank(hits: DataFrame, n: int = 5) -> DataFrame:
    """Rank the union of all namespaces by score and keep n per query."""
    return _ranked(hits.drop("rank"), n, "cosine", False)
