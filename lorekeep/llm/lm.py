"""Language-model scoring: deleted interpolation of bigram, unigram and uniform estimates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import small_batches, written

END = 1  # key of the end token; word keys are odd hashes
BLOCK_CHARS = 8_000_000
PART_CHARS = 8_000_000
CONTEXTS = 16  # buckets of the count of the context: 0, 1, 2-3, 4-7, ...
STEPS = 4  # grid steps per doubling of a count in the evidence
ROUNDS = 60
PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token keys of some texts, and for each token, with an end behind each text, its place among them, and the number
    of tokens of each text.

    Words are what stands between ASCII white space, with A-Z lower-cased: what bytes.lower and bytes.split do.
    """
    import xxhash

    own = [text.encode().lower().split() for text in texts]
    seen = {word: place for place, word in enumerate(set().union(*own), 1)}
    keys = np.empty(len(seen) + 1, np.uint64)
    keys[0] = END
    keys[1:] = np.fromiter((xxhash.xxh3_64_intdigest(word) for word in seen), np.uint64, len(seen)) | np.uint64(1)
    sizes = np.array([len(ws) + 1 for ws in own], np.int64)
    token = np.zeros(sizes.sum(), np.int64)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = np.fromiter((i for ws in own for i in map(seen.__getitem__, ws)), np.int64, len(token) - len(texts))
    return keys, token, sizes


def pair_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of (token before, token); pair keys are even, token keys odd."""
    with np.errstate(over="ignore"):
        mixed = (before * PAIR) ^ (before >> np.uint64(29))
        mixed = (mixed + keys) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * PAIR) & ~np.uint64(1)


class Block:
    """The texts of a block as keys, with the sorted distinct keys of its tokens and pairs.

    The token before the first one of a text is the end of another.
    """

    def __init__(self, texts: list[str], trained: np.ndarray) -> None:
        keys, place, self.sizes = tokenize(texts)
        self.trained = np.repeat(trained, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = self.before(place, 0)
        pairs, pair = np.unique(before * len(keys) + place, return_inverse=True)
        both = np.concatenate([keys, pair_keys(keys[pairs // len(keys)], keys[pairs % len(keys)])])
        self.distinct, at = np.unique(both, return_inverse=True)
        self.token, self.pair = at[place], at[len(keys) + pair]
        counts = np.bincount(self.token[self.trained], minlength=len(self.distinct))
        self.counts = counts + np.bincount(self.pair[self.trained], minlength=len(self.distinct))
        self.end = at[0]

    def before(self, of_token: np.ndarray, end: float) -> np.ndarray:
        """Of each token the value of the token before it; ``end`` before the first."""
        out = np.concatenate([of_token[:1], of_token[:-1]])
        out[self.first] = end
        return out


def _parts(distinct: np.ndarray, parts: int) -> np.ndarray:
    """Borders of the parts in sorted keys: parts are equal ranges of the key space."""
    step = (1 << 64) // parts
    return np.searchsorted(distinct, np.array([step * k for k in range(1, parts)], np.uint64), "left")


def _send(parts: int):
    """Block -> one row for each part of the key space: the block's keys in it and their counts in training texts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _block(table)
        cut = [0, *_parts(block.distinct, parts).tolist(), len(block.distinct)]
        keys = [_packed_keys(block.distinct[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        counts = [_packed(block.counts[a:b].astype(np.uint64)) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * parts, pa.int32()),
                "part": pa.array(range(parts), pa.int32()),
                "keys": pa.array(keys, pa.binary()),
                "counts": pa.array(counts, pa.binary()),
            }
        )

    return run


def _block(table: pa.Table) -> Block:
    texts = [text or "" for text in table.column("text").to_pylist()]
    return Block(texts, table.column("trained").to_numpy().astype(bool))


def _count(table: pa.Table) -> pa.Table:
    """Part -> one row for each block, the training counts of the keys it sent, in its order; block -1 has the part's totals."""
    keys = [_unpacked_keys(k) for k in table.column("keys").to_pylist()]
    counts = [_unpacked(c) for c in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    single = (distinct & np.uint64(1) == 1) & (total > 0)
    back, begin = [], 0
    for own in keys:
        back.append(_packed(total[at[begin : begin + len(own)]]))
        begin += len(own)
    totals = np.array([single.sum(), total[single].sum()], np.uint64)
    part = table.column("part").combine_chunks()
    return pa.table(
        {
            "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array([-1], pa.int32())]),
            "part": pa.concat_arrays([part, part[:1]]),
            "totals": pa.array([*back, totals.tobytes()], pa.binary()),
        }
    )


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, each in as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = (int(steps.max()).bit_length() + 7) // 8 if len(keys) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _packed(values: np.ndarray) -> bytes:
    """Counts in one byte each; 255 stands for a count that follows behind them in eight."""
    large = values[values >= 255]
    return np.uint64(len(values)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:8], np.uint64)[0])
    values = np.frombuffer(data[8 : 8 + n], np.uint8).astype(np.uint64)
    values[values == 255] = np.frombuffer(data[8 + n :], np.uint64)
    return values


def _totals(block: Block, back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the block: training counts of the pair, the token before and the token."""
    order = np.argsort(back.column("part").to_numpy())
    sent = back.column("totals").to_pylist()
    total = np.concatenate([_unpacked(sent[i]) for i in order]).astype(np.float64)
    single = total[block.token]
    return total[block.pair], block.before(single, total[block.end]), single


def _context(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)) + 1, 0).astype(np.int64), CONTEXTS - 1)


def _evidence(docs: pa.Table, back: pa.Table) -> pa.Table:
    """How often, over the training tokens of a block, each cell of a grid over (context bucket, deleted estimates) occurs.

    Deleted: a token's own occurrence is taken out of its counts, so that its estimates are those of a model that has
    not seen it.
    """
    block = _block(docs)
    pair, before, single = (c[block.trained] for c in _totals(block, back))
    grid = lambda c: np.where(c > 0, np.rint(STEPS * np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)
    cell = (grid(before - 1) << 24 | grid(pair - 1) << 12 | grid(single - 1)) if len(pair) else np.zeros(0, np.int64)
    cells, times = np.unique(cell, return_counts=True)
    return pa.table({"cell": pa.array(cells, pa.int64()), "times": pa.array(times, pa.int64())})


def learn(cells: dict[int, int], total: float, distinct: float) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation on the deleted counts."""
    if not cells:
        return np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    key = np.array(list(cells), np.int64)
    times = np.array(list(cells.values()), np.float64)
    value = lambda grid: np.where(grid > 0, 2 ** ((grid - 1) / STEPS), 0)
    before, pair, single = (value(key >> shift & 0xFFF) for shift in (24, 12, 0))
    estimates = np.stack(
        [
            np.where(before > 0, np.minimum(1, pair / np.maximum(before, 1)), 0),
            single / max(1, total - 1),
            np.full(len(key), 1 / (distinct + 1)),
        ]
    )
    bucket = _context(np.rint(before + 1e-9))
    weights = np.tile([1 / 3] * 3, (CONTEXTS, 1))
    for _ in range(ROUNDS):
        shares = weights[bucket].T * estimates
        shares *= times / shares.sum(0)
        mass = np.stack([np.bincount(bucket, weights=s, minlength=CONTEXTS) for s in shares], 1)
        smoothed = mass + mass.sum(0) / mass.sum()  # a bucket without evidence takes the weights of all
        weights = smoothed / smoothed.sum(1, keepdims=True)
    return weights


def _score(weights: np.ndarray, total: float, distinct: float):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        block = _block(docs)
        pair, before, single = _totals(block, back)
        mix = weights[_context(before)].T
        probability = (
            mix[0] * np.where(before > 0, pair / np.maximum(before, 1), 0)
            + mix[1] * single / max(1, total)
            + mix[2] / (distinct + 1)
        )
        # Where the context was never seen, the bigram has no estimate and its share goes to the others.
        probability = np.where(before > 0, probability, probability / (mix[1] + mix[2]))
        base = np.log10((single + 0.5) / (total + 0.5 * (distinct + 1)))
        kept = {name: docs.column(name) for name in docs.column_names if name not in ("text", "block", "trained")}
        return pa.table(
            kept
            | {
                "n_tokens": pa.array(block.sizes),
                "n_known": pa.array(np.add.reduceat((single > 0).astype(np.int64), block.first)),
                "base_score": pa.array(np.add.reduceat(base, block.first)),
                "score": pa.array(np.add.reduceat(np.log10(probability), block.first)),
            }
        )

    return run


def score(docs: DataFrame, trained: str = "trained") -> DataFrame:
    """Score the whole texts of docs (text, a boolean ``trained`` and id columns) under a model of those that train it.

    Adds n_tokens (lower-cased words and one end), n_known (tokens met in training), train_tokens, base_score (add-half
    unigrams) and score: the sum of log10 of w2 c(u v) / c(u) + w1 c(v) / N + w0 / (V + 1), the weights w depending on the count of u
    in powers of two. They are learned by expectation-maximisation on the counts of all training tokens, each taken out
    of its own counts. Columns of these names are replaced; null texts count as empty, a table without training texts has the
    uniform estimate only, an empty table gives no rows.

    Texts are dealt out by a hash into blocks of about BLOCK_CHARS. A block sends each of its distinct keys once to the part of
    the key space it belongs to, and gets the counts back as one byte a key, in the order sent; so a frequent word is one
    row per block, and texts never meet counts by a join on words. Keys are 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) + F.count("*")).first()[0]
    blocks, parts = max(1, -(-chars // BLOCK_CHARS)), max(1, -(-chars // PART_CHARS))
    text = F.coalesce(F.col("text"), F.lit(""))
    ready = docs.drop(*(set(new) & set(docs.columns))).withColumnRenamed(trained, "trained")
    ready = ready.withColumns({"text": text, "block": F.pmod(F.xxhash64("text", *[c for c in ready.columns if c not in ("text", "trained")]), F.lit(blocks)).cast("int")})
    by_block = ready.groupBy("block")
    sent = by_block.applyInArrow(_send(parts), "block int, part int, keys binary, counts binary")
    counted = sent.groupBy("part").applyInArrow(_count, "block int, part int, totals binary")
    counted = written(counted, "lm-counts")
    back = counted.where("block >= 0")
    totals = [np.frombuffer(r["totals"], np.uint64) for r in counted.where("block < 0").select("totals").collect()]
    distinct, total = np.sum(totals, 0).tolist() if totals else (0, 0)
    grid = by_block.cogroup(back.groupBy("block")).applyInArrow(_evidence, "cell long, times long")
    cells = {r["cell"]: r["times"] for r in grid.groupBy("cell").agg(F.sum("times").alias("times")).collect()}
    weights = learn(cells, total, distinct)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name not in ("text", "block", "trained")]
    schema = ", ".join([*fields, "n_tokens long, n_known long, base_score double, score double"])
    scored = by_block.cogroup(back.groupBy("block")).applyInArrow(_score(weights, float(total), float(distinct)), schema)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
