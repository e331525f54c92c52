"""Approximate nearest neighbours: a neighbour graph by NN-descent, answered by greedy graph search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_groups, arrow_map, written

# For vectors without much structure, the hard case: 51,282 random-like vectors of 64 dimensions.
DEGREE = 40
REVERSE = 24
TURNS = 8
GROUP = 500
ROUNDS = 4
BEAM = 160
EXPAND = 40


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def _filled(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, shorter ones filled up with zeros; by a power of two, exactly, below 1."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(1, keepdims=True))[1])


def _units(binary: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision from packed vectors, which keep the precision of the table (4 or 8 bytes a component)."""
    packed = binary.to_pylist()
    kind = np.float64 if packed and len(packed[0]) == 8 * width else np.float32
    out = np.frombuffer(b"".join(packed), kind).reshape(-1, width).astype(np.float64)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _first_groups(nodes: DataFrame, width: int, count: int, rounds: int = TURNS) -> DataFrame:
    """Nodes with groups of about GROUP nodes on the same side of random planes, several times over."""
    bits = max(0, int(np.ceil(np.log2(max(1, count) / GROUP))))
    planes = np.random.default_rng(5).standard_normal((rounds, width, bits))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = _units(batch.column(1), width)
        codes = [((units @ p > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(units), np.int64) for p in planes]
        both = [pa.array(np.tile(batch.column(0).to_numpy(), rounds)), pa.array(batch.column(1).to_pylist() * rounds, pa.binary())]
        turn = np.repeat(np.arange(rounds, dtype=np.int32), len(units))
        return pa.RecordBatch.from_arrays([*both, pa.array(turn), pa.array(np.concatenate(codes))], ["node", "unit", "turn", "code"])

    placed = arrow_map(nodes.select("node", "unit"), place, "node long, unit binary, turn int, code long")
    sizes = placed.groupBy(F.col("turn").alias("__t"), F.col("code").alias("__c")).agg(F.count("*").alias("__n"))
    split = F.pmod(F.xxhash64("node", "turn"), F.ceil(F.col("__n") / GROUP))
    return placed.join(sizes, (F.col("turn") == F.col("__t")) & (F.col("code") == F.col("__c"))).select(
        F.xxhash64("turn", "code", split).alias("__g"), "node", "unit", F.lit(-2.0).alias("worst"), F.lit(True).alias("fresh")
    )


def _local_join(width: int, most: int):
    """Inside each group: pairs with a fresh member that are closer than what one of the two has; at most ``most`` for each."""

    def run(table: pa.Table) -> pa.RecordBatch | None:
        group, node, worst = (table.column(c).to_numpy() for c in ("__g", "node", "worst"))
        fresh = table.column("fresh").to_numpy()
        units = _units(table.column("unit"), width)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
        left, right, near = [], [], []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            own = units[a:b]
            near_all = own @ own.T
            wanted = (near_all > worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (node[a:b, None] != node[None, a:b])
            near_all = np.where(wanted, near_all, -3)
            if b - a > most:
                best = np.argpartition(-near_all, most, axis=1)[:, :most]
            else:
                best = np.tile(np.arange(b - a), (b - a, 1))
            value = np.take_along_axis(near_all, best, 1)
            i, j = np.nonzero(value > -3)
            left.append(node[a + i])
            right.append(node[a + best[i, j]])
            near.append(value[i, j])
        if not left:
            return None
        columns = [pa.array(np.concatenate(x)) for x in (left, right, near)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(columns[0]), bool))], ["node", "other", "near", "fresh"])

    return run


def _nearest(degree: int):
    """Of each node the ``degree`` nearest of its edges; one that was there before stays as it was."""

    def run(table: pa.Table) -> pa.RecordBatch:
        node, other, near, fresh = (table.column(c).to_numpy() for c in ("node", "other", "near", "fresh"))
        order = np.lexsort((fresh, other, node))
        once = np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(other[order]) != 0)])
        kept = order[once]
        kept = kept[np.lexsort((other[kept], -near[kept], node[kept]))]
        starts = np.concatenate([[True], np.diff(node[kept]) != 0])
        place = np.arange(len(kept)) - np.maximum.accumulate(np.where(starts, np.arange(len(kept)), 0))
        kept = kept[place < degree]
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (node, other, near, fresh)], ["node", "other", "near", "fresh"])

    return run


EDGES = "node long, other long, near double, fresh boolean"


def build_graph(nodes: DataFrame, width: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """Edges (node, other, near, fresh) to about the ``degree`` nearest of each node, from nodes (node, unit).

    The first edges come from groups on the same side of random planes. Every round joins, at every node, its
    neighbours and the nearest REVERSE nodes it is a neighbour of, and keeps for each of them the closer ones found among them:
    the neighbours of neighbours. Edges join only while one of a pair is fresh. It ends when a round improves fewer than one
    edge in a hundred.
    """
    count = nodes.count()
    grouped = _first_groups(nodes, width, count)
    edges = arrow_groups(grouped, "__g", _local_join(width, degree), EDGES)
    edges = written(arrow_groups(edges, "node", _nearest(degree), EDGES), "ann-edges")
    vectors = nodes.select(F.col("node").alias("__node"), "unit")
    for _ in range(rounds):
        worst = edges.groupBy(F.col("node").alias("__of")).agg(
            F.when(F.count("*") >= degree, F.min("near")).otherwise(F.lit(-2.0)).alias("worst")
        )
        held = vectors.join(worst, F.col("__node") == F.col("__of"), "left").select("__node", "unit", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        back = Window.partitionBy("other").orderBy(F.desc("near"), "node")
        reverse = edges.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= REVERSE)
        members = edges.select(F.col("node").alias("__g"), F.col("other").alias("node"), "fresh").unionByName(
            reverse.select(F.col("other").alias("__g"), "node", "fresh")
        )
        members = members.groupBy("__g", "node").agg(F.max("fresh").alias("fresh"))
        local = members.join(held, F.col("node") == F.col("__node")).drop("__node")
        found = arrow_groups(local, "__g", _local_join(width, degree), EDGES)
        settled = edges.withColumn("fresh", F.lit(False))
        edges = written(arrow_groups(settled.unionByName(found), "node", _nearest(degree), EDGES), "ann-edges")
        if edges.where("fresh").count() < 0.01 * count * degree:
            break
    return edges


def _adjacency(edges: DataFrame) -> DataFrame:
    """One row per node: its DEGREE neighbours and the nearest REVERSE nodes it is a neighbour of."""
    back = Window.partitionBy("other").orderBy(F.desc("near"), "node")
    reverse = edges.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= REVERSE)
    ways = edges.select("node", "other").unionByName(reverse.select(F.col("other").alias("node"), F.col("node").alias("other")))
    return ways.groupBy(F.col("node").alias("__at")).agg(F.collect_set("other").alias("all"))


def _step(width: int):
    """Beams of queries and what the expanded nodes led to -> the BEAM nearest nodes of each query, with those still to expand."""

    def run(table: pa.Table) -> pa.RecordBatch:
        query, node, near = (table.column(c).to_numpy() for c in ("query", "node", "near"))
        done = table.column("done").to_numpy()
        new, old = np.flatnonzero(np.isnan(near)), np.flatnonzero(~np.isnan(near))
        asked, first = np.unique(query[old], return_index=True)
        packed = table.column("query_unit").take(pa.array(old[first])).combine_chunks()
        near = near.copy()
        own = _units(packed, width)
        for part in np.array_split(new, len(new) * width // 2_000_000 + 1):
            units = _units(table.column("unit").take(pa.array(part)), width)
            near[part] = (own[np.searchsorted(asked, query[part])] * units).sum(1)
        order = np.lexsort((~done, node, query))
        once = np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(node[order]) != 0)])
        kept = order[once]
        kept = kept[np.lexsort((node[kept], -near[kept], query[kept]))]
        starts = np.concatenate([[True], np.diff(query[kept]) != 0])
        place = np.arange(len(kept)) - np.maximum.accumulate(np.where(starts, np.arange(len(kept)), 0))
        kept = kept[place < BEAM]
        units = packed.take(pa.array(np.searchsorted(asked, query[kept])))
        columns = [pa.array(query[kept]), units, pa.array(node[kept]), pa.array(near[kept]), pa.array(done[kept])]
        return pa.RecordBatch.from_arrays(columns, ["query", "query_unit", "node", "near", "done"])

    return run


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, width: int, rounds: int = 12) -> DataFrame:
    """Greedy search for all queries (query, query_unit, node) together: (query, node, near), the BEAM nearest found for each.

    A query starts at its own node. Every round expands the EXPAND nearest nodes of each beam that were not yet expanded,
    by one join with the adjacency; it ends when no beam has one left among its nearest half, or after ``rounds``.
    """
    around = written(_adjacency(edges), "ann-adjacency")
    vectors = nodes.select(F.col("node").alias("__node"), "unit")
    state = "query long, query_unit binary, node long, near double, done boolean"
    beam = queries.select("query", "query_unit", "node", F.lit(1.0).alias("near"), F.lit(False).alias("done"))
    for _ in range(rounds):
        order = Window.partitionBy("query").orderBy("done", F.desc("near"), "node")
        ranked = beam.withColumn("__k", F.row_number().over(order))
        now = ~F.col("done") & (F.col("__k") <= EXPAND)
        reached = ranked.where(now).join(around, F.col("node") == F.col("__at")).select("query", F.explode("all").alias("node")).distinct()
        led = reached.join(vectors, F.col("node") == F.col("__node")).select(
            "query",
            F.lit(None).cast("binary").alias("query_unit"),
            "node",
            F.lit(float("nan")).alias("near"),
            F.lit(False).alias("done"),
            "unit",
        )
        stay = ranked.select("query", "query_unit", "node", "near", (F.col("done") | now).alias("done"), F.lit(None).cast("binary").alias("unit"))
        beam = written(arrow_groups(stay.unionByName(led), "query", _step(width), state), "ann-beam")
        half = beam.withColumn("__k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "node")))
        if half.where(f"__k <= {BEAM // 2} AND NOT done").isEmpty():
            break
    return beam.select("query", "node", "near")


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """For the rows of vectors (vec_id, embedding) where ``queries`` holds, their ``k`` nearest other rows by cosine.

    Rows whose vector is null, zero or has null or non-finite components take no part. Equal vectors are one node of the graph, with the k + 1
    smallest ids of its rows, all that an answer can need, so a hot vector is one node. Vectors of different lengths are
    compared as if filled up with zeros. Graph and search hold the vectors in the precision of the table and take cosines
    in double precision, so near copies keep their order; all BEAM nodes found are scored on the original vectors. Ties go to the smaller id; a query with fewer than k other rows gets them all.
    Returns query_id, rank (from 1), vec_id, score.
    """
    fine = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("__vector", F.col("embedding").cast("array<double>"))
    fine = fine.select("vec_id", "__vector", queries.alias("__asks"))
    grouped = fine.groupBy("__vector").agg(F.min("vec_id").alias("node"), F.max(F.size("__vector")).alias("width"))
    width = grouped.agg(F.max("width")).first()[0]
    if width is None:
        return fine.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)

    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def units(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = _filled(batch.column(1), width).astype(kind)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in packed], pa.binary()), batch.column(1)], ["node", "unit", "vector"])

    nodes = written(arrow_map(grouped.select("node", "__vector"), units, "node long, unit binary, vector array<double>"), "ann-nodes")
    member = grouped.select(F.col("__vector").alias("__same"), "node")
    least = Window.partitionBy("node").orderBy("vec_id")
    rows = fine.join(member, F.col("__vector") == F.col("__same")).select("vec_id", "node", "__asks")
    ids = rows.withColumn("__k", F.row_number().over(least)).where(F.col("__k") <= k + 1).select(F.col("node").alias("__of"), "vec_id")
    asks = rows.where("__asks").select(F.col("vec_id").alias("query"), "node").distinct()
    asked = written(asks.join(nodes.select(F.col("node").alias("__node"), F.col("unit").alias("query_unit")), F.col("node") == F.col("__node")).drop("__node"), "ann-queries")
    found = search(asked, nodes, build_graph(nodes, width), width)
    exact = nodes.select(F.col("node").alias("__node"), "vector")
    own = asked.select(F.col("query").alias("__query"), F.col("node").alias("__home")).join(exact, F.col("__home") == F.col("__node")).select("__query", F.col("vector").alias("__asked"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = (
        found.select("query", "node").join(exact, F.col("node") == F.col("__node"))
        .join(own, F.col("query") == F.col("__query"))
        .withColumn("score", dot("vector", "__asked") / (F.sqrt(dot("vector", "vector")) * F.sqrt(dot("__asked", "__asked"))))
        .join(ids, F.col("node") == F.col("__of"))
        .where("vec_id <> query")
    )
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
