"""Near duplicates: a MinHash LSH forest finds candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_groups, arrow_map, components, words, written

SHINGLE = 5
TREES, DEPTH = 24, 8
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
# Multipliers of the hash functions: odd numbers from a fixed generator.
_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
ROLL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts given by their word hashes: all in one array, and the number of each text.

    A text with fewer than five words has one shingle of all its words, one without words has none.
    """
    flat = flat.view(np.uint64)
    ends = np.cumsum(sizes)
    rolled = np.zeros(len(flat), np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            rolled[: len(flat) - k] += _mixed(flat[k:] + np.uint64(k)) * factor
            factor = factor * ROLL
    sets = []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        n = end - begin
        if n >= SHINGLE:
            own = np.unique(rolled[begin : end - SHINGLE + 1])
        elif n:
            own = np.frombuffer(blake2b(flat[begin:end].tobytes(), digest_size=8).digest(), np.uint64)
        else:
            own = flat[:0]
        sets.append(own)
    return np.concatenate(sets) if sets else flat[:0], np.array([len(s) for s in sets], np.int64)


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One byte of each of the TREES x DEPTH minima of every text; zeros for a text without shingles."""
    out = np.zeros((len(counts), TREES * DEPTH), np.uint8)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        with np.errstate(over="ignore"):
            mixed = _mixed(shingles)
            for k, (a, b) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
                least = np.minimum.reduceat(mixed * a + b, starts)
                out[some, k] = (_mixed(least) >> np.uint64(40)).astype(np.uint8)
    return out


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Start from whole branches of the tries and shorten the prefixes until a pair at the threshold meets in at least one
    tree with probability ``recall``."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError("the forest is too small for this recall")


def _word_hashes() -> Column:
    return F.transform(words(F.col("text")), lambda w: F.xxhash64(w))


def _lists(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _binary(array: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(-1, width)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    shingles, counts = shingle_sets(*_lists(batch.column(2)))
    ends = np.cumsum(counts)
    keys = [
        blake2b(shingles[b:e].tobytes(), digest_size=16).digest()
        for b, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)
    ]
    signs = [row.tobytes() for row in signatures(shingles, counts)]
    columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts), pa.array(signs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "key", "n", "sign"])


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Join the trees of the given pairs; the pairs that joined two."""
    used = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = i, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            used.append((i, j))
    return used


def _close(least_equal: int):
    """Texts beside the representative of their branch: the pairs whose signatures are close enough."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sign, other = (_binary(batch.column(c), TREES * DEPTH) for c in ("sign", "__sign"))
        at = pa.array(np.flatnonzero((sign == other).sum(1) >= least_equal))
        return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("node", "__rep")], ["a", "b"]) if len(at) else None

    return run


def _candidates(least_equal: int, last: int):
    """Within subtrees (__g) of texts with ``last`` bytes in common: a forest over the pairs whose signatures are close enough.

    A subtree is sorted by its branches and walked from prefixes one byte short of whole to those of ``last`` bytes, so a
    prefix holds neighbours. Pairs that are connected already, by other trees or by deeper prefixes, are not compared: a dense region is
    done with at a deep prefix, and a group gives fewer edges than rows.
    """

    def run(table: pa.Table) -> pa.RecordBatch | None:
        branch = _binary(table.column("branch"), DEPTH).copy().view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((branch, table.column("__g").to_numpy()))
        branch = branch[order]
        group, node, block, cross, comp = (table.column(c).to_numpy()[order] for c in ("__g", "node", "__b", "__cross", "comp"))
        sign = _binary(table.column("sign"), TREES * DEPTH)[order]
        _, first, own = np.unique(comp, return_index=True, return_inverse=True)
        parent, used = first[own], []
        for depth in range(DEPTH - 1, last - 1, -1):
            prefix = branch >> np.uint64(8 * (DEPTH - depth))
            opens = np.concatenate([[True], (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])])
            run_of = np.cumsum(opens)
            sizes = np.bincount(run_of)
            for k in range(1, int(sizes.max())):
                at = np.flatnonzero((run_of[k:] == run_of[:-k]) & (~cross[k:] | (block[k:] != block[:-k])))
                if not len(at):
                    continue
                root = _roots(parent)
                at = at[root[at] != root[at + k]]
                close = [a[(sign[a] == sign[a + k]).sum(1) >= least_equal] for a in np.array_split(at, len(at) // 50_000 + 1)]
                at = np.concatenate(close)
                used += _unite(parent, at, at + k)
        if not used:
            return None
        left, right = np.array(used).T
        return pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(node[right])], ["a", "b"])

    return run


def forest_candidates(nodes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """Components (node, root) of the candidates among nodes (node, sign), and the rows that walk on from whole branches.

    A trie holds one branch of DEPTH bytes of each text. The walk starts at whole branches: every text is held against the smallest
    node of its branch, in one row each, which already connects most of a group of near copies. Then prefixes are shortened byte by byte
    (``_candidates``), until a pair at the threshold has met in some tree with probability ``recall``, in those subtrees only whose texts
    do not yet form one component; dense regions stop there, only texts that are still apart walk on. The last depth sees every pair that is
    apart, so all components are those of comparing whole subtrees at the last depth.
    """
    total = TREES * DEPTH
    least_equal = int(total * threshold - 4 * (total * threshold * (1 - threshold)) ** 0.5)
    last = prefix_length(threshold, recall)
    tree = lambda t: F.substring("sign", t * DEPTH + 1, F.lit(DEPTH))
    every = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), tree)).alias("tree", "branch"))
    tries = every.withColumn("top", F.xxhash64("tree", F.substring("branch", 1, last)))
    shared = tries.groupBy(F.col("top").alias("__top")).agg(F.count("*").alias("size")).where("size > 1").select("__top")
    met = tries.join(shared, F.col("top") == F.col("__top")).select("node", "tree", "branch", "top")
    signs = nodes.select(F.col("node").alias("__node"), "sign")
    met = written(met.join(signs, F.col("node") == F.col("__node")).drop("__node"), "near-branches")

    whole = met.withColumn("__g", F.xxhash64("tree", "branch"))
    reps = whole.groupBy(F.col("__g").alias("__of")).agg(F.min(F.struct("node", "sign")).alias("rep"), F.count("*").alias("size")).where("size > 1")
    beside = whole.join(reps.select("__of", F.col("rep.node").alias("__rep"), F.col("rep.sign").alias("__sign")), F.col("__g") == F.col("__of"))
    beside = beside.where("node <> __rep").select("node", "__rep", "sign", "__sign")
    labels = components(arrow_map(beside, _close(least_equal), "a long, b long"), "near-beside")

    own = met.join(labels.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    own = own.select("node", "sign", F.coalesce("root", "node").alias("comp"), "branch", F.col("top").alias("__top"))
    apart = own.groupBy(F.col("__top").alias("__open")).agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("size"))
    apart = apart.where("least < most").select("__open", "size")
    live = written(own.join(apart, F.col("__top") == F.col("__open")).select("__top", "node", "comp", "branch", "sign", "size"), "near-open")
    count = live.count()
    if not count:
        return labels, 0
    blocked = _blocked(live, ["__top"], F.ceil(F.col("size") / BLOCK_ROWS)).select("__g", "node", "comp", "__b", "__cross", "branch", "sign")
    found = arrow_groups(blocked, "__g", _candidates(least_equal, last), "a long, b long")
    edges = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
    return components(edges, "near-candidates"), count


def _verified(threshold: float):
    """Within groups of candidates: exact similarities; for each text its linked documents and the smallest text it is linked
    to over links inside the group."""

    def run(table: pa.Table) -> pa.RecordBatch:
        group, node, copies, block, cross = (table.column(c).to_numpy() for c in ("__g", "node", "copies", "__b", "__cross"))
        shingles, counts = shingle_sets(*_lists(table.column("words")))
        ends = np.cumsum(counts)
        links, smallest = np.zeros(len(node), np.int64), node.copy()
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
        for first, last in zip(edges, edges[1:], strict=False):
            m, n, nodes = last - first, counts[first:last], node[first:last]
            own = shingles[ends[first] - counts[first] : ends[last - 1]]
            common = _intersections(own, np.repeat(np.arange(m), n), m)
            linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
            linked &= (common > 0) & (nodes[:, None] != nodes[None, :])
            if cross[first]:
                linked &= block[first:last, None] != block[None, first:last]
            once = np.zeros(m, bool)  # rows equal in id and text bring a node twice
            once[np.unique(nodes, return_index=True)[1]] = True
            links[first:last] = np.where(once, linked[:, once] @ copies[first:last][once], 0)
            parent = np.arange(m)
            _unite(parent, *np.nonzero(np.triu(linked)))
            root = _roots(parent)
            least = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(least, root, nodes)
            smallest[first:last] = least[root]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(smallest)], ["node", "links", "near"])

    return run


def _intersections(shingles: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """Sizes of all intersections of m sets, by products of their incidence matrix in slices of shared shingles."""
    _, at, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    number = np.cumsum(times > 1) - 1
    column, row = number[at[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((m, m), np.float64)
    width = max(64, 4_000_000 // m)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        slice_ = np.zeros((m, min(width, int(column[-1]) + 1 - begin)), np.float32)
        slice_[row[a:b], column[a:b] - begin] = 1
        out += slice_ @ slice_.T
    return out


def _blocked(rows: DataFrame, group: list[str], blocks: Column) -> DataFrame:
    """Split each group into ``blocks`` blocks and give every pair of blocks, and every block alone, a group of its own."""
    return (
        rows.withColumn("__n", blocks.cast("int"))
        .withColumn("__b", F.pmod(F.xxhash64("node"), F.col("__n")).cast("int"))
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("__cross", F.col("__o") != F.col("__b"))
        .withColumn("__g", F.xxhash64(*group, F.least("__b", "__o"), F.greatest("__b", "__o")))
        .drop("__n", "__o")
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, row, class_id, n_copies, n_links.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least ``threshold``; words are
    what stands between ASCII white space. A class is what links connect; ``class_id`` is its smallest doc_id. ``n_copies``
    counts the rows with the same shingle set (itself included), ``n_links`` all other rows it is linked to, copies among
    them. ``row`` is a hash of id and text.

    1. Every text becomes a signature of TREES branches of DEPTH one-byte minima; texts with equal sets become one node.
    2. In each trie the texts with a common prefix are compared by whole signature, from whole branches to shorter prefixes, dense
       regions first, until a pair at the threshold has met with probability ``recall`` (``forest_candidates``). A signature that agrees in
       four standard deviations less than expected at the threshold is still a candidate.
    3. Components of the candidates are verified exactly and completely: all pairs in a component are counted.
    Groups are cut into blocks of bounded rows and shingles, every pair of blocks being a task's unit, so a hot group is spread; the
    work on a group of different near copies is quadratic, its rows and results are not.

    Null texts count as empty; texts without words form one class. Null ids are rows like others, a class of nulls
    only has a null class_id. Other columns do not matter, an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    schema = f"doc_id {id_type}, row long, key binary, n long, sign binary"
    signed = written(arrow_map(rows.select("doc_id", "row", _word_hashes().alias("words")), _sign, schema), "near-signs")
    nodes = written(
        signed.groupBy("key")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min("row").alias("row"),
            F.max("n").alias("n"),
            F.max("sign").alias("sign"),
            F.count("*").alias("copies"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )

    members, _ = forest_candidates(nodes.where("n > 0").select("node", "sign"), threshold, recall)

    sized = members.join(nodes.select(F.col("node").alias("__node"), "key", "row", "n", "copies"), F.col("node") == F.col("__node")).drop("__node")
    sizes = sized.groupBy(F.col("root").alias("__root")).agg(F.count("*").alias("__rows"), F.sum("n").alias("__shingles"))
    blocks = F.ceil(F.greatest(F.col("__rows") / BLOCK_ROWS, F.col("__shingles") / BLOCK_SHINGLES))
    texts = rows.select(F.col("row").alias("__row"), "text")
    chosen = (
        sized.join(sizes, F.col("root") == F.col("__root"))
        .withColumn("__blocks", blocks)
        .join(texts, F.col("row") == F.col("__row"))
        .select("root", "node", "copies", "__blocks", _word_hashes().alias("words"))
    )
    groups = _blocked(chosen, ["root"], F.col("__blocks")).select("__g", "node", "copies", "__b", "__cross", "words")
    verified = written(
        arrow_groups(groups, "__g", _verified(threshold), "node long, links long, near long", rows=2_000), "near-verified"
    )
    split = members.join(sizes.where(blocks > 1), F.col("root") == F.col("__root"), "left_semi").select("node")
    across = verified.join(split, "node", "left_semi").select(F.col("node").alias("a"), F.col("near").alias("b"))
    joined = components(across, "near-classes").withColumnRenamed("node", "__near")
    each = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min("near").alias("near"))
    classes = (
        nodes.join(each, "node", "left")
        .withColumn("near", F.coalesce("near", "node"))
        .join(joined, F.col("node") == F.col("__near"), "left")
        .select("key", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "near").alias("class"))
    )
    named = classes.groupBy(F.col("class").alias("__class")).agg(F.min("first_id").alias("class_id"))
    by_key = classes.join(named, F.col("class") == F.col("__class")).select(
        F.col("key").alias("__key"), "class_id", F.col("class").alias("class"), F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    return signed.select("doc_id", "row", "key").join(by_key, F.col("key") == F.col("__key")).select(
        "doc_id", "row", "class_id", "class", "n_copies", "n_links"
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of docs (doc_id, text and any columns) with the smallest doc_id of each class, one for each class.

    Ties of ids go to the smaller hash of id and text; of rows equal in both one stays.
    """
    found = near_duplicates(docs, threshold, recall)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("__first")
    chosen = found.groupBy("class").agg(first).select(F.col("__first.row").alias("__row"))
    repeats = found.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("__times")).where("__times > 1").select("__row")
    hashed = docs.withColumn("__own", F.xxhash64("doc_id", "text"))
    same = F.col("__own") == F.col("__row")
    single = hashed.join(chosen.join(repeats, "__row", "left_anti"), same, "left_semi")
    repeated = hashed.join(chosen.join(repeats, "__row", "left_semi"), same, "left_semi").dropDuplicates(["__own"])
    return single.unionByName(repeated).select(*docs.columns)
