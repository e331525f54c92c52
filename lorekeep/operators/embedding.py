"""Embeddings: a deterministic term-hash vector, and a hook for a model of the user's own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.prices import EMBEDDING_BUDGET_USD
from lorekeep.functions.tokens import token_count, ws_pieces, ws_tokens
from lorekeep.operators.budget import cost_summary, with_cost
from lorekeep.operators.chunking import drop_blank

HASH_DIMS = 256


def terms(text: Column) -> Column:
    return ws_tokens(ws_pieces(F.lower(text)))


PART_TOKENS = 1 << 19  # that are counted at once


def in_parts(tokens: pa.Array, made: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``made`` over runs of rows with PART_TOKENS tokens each, or one row: what it holds at once does not grow with the rows of a batch."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    done, start = [], 0
    while start < len(tokens):
        met = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, met + PART_TOKENS, side="right")))
        done.append(made(tokens.slice(start, stop - start)))
        start = stop
    return pa.concat_arrays(done) if done else made(tokens)


def hash_vector(text: Column, dims: int = HASH_DIMS) -> Column:
    """Unit vector of signed term counts; null when all counts cancel out or there is no term.

    A term's bucket is the first 8 hex digits of its md5 modulo ``dims``; the 9th digit below 8 means
    plus, else minus. The vector is made within the row's task: counting with explode and groupBy
    would shuffle every term of the corpus.
    """

    def part(tokens: pa.Array) -> pa.Array:
        rows = len(tokens)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(tokens.flatten())
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        digests = np.frombuffer(b"".join([hashlib.md5(word).digest() for word in words]), np.uint8).reshape(-1, 16)
        bucket = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % dims
        sign = np.where(digests[:, 4] < 0x80, 1.0, -1.0)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(rows), lengths) * dims
        if len(codes):
            sums = np.bincount(cells + bucket[codes], weights=sign[codes], minlength=rows * dims)
        else:
            sums = np.zeros(rows * dims)
        sums = sums.reshape(rows, dims)
        norms = np.sqrt((sums * sums).sum(axis=1))
        unit = sums / np.where(norms == 0, 1, norms)[:, None]
        offsets = np.arange(rows + 1, dtype=np.int32) * dims
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))
        return pc.if_else(pa.array(norms > 0), lists, pa.scalar(None, lists.type))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(tokens: pa.Array) -> pa.Array:
        return in_parts(tokens, part)

    return vectors(terms(text))


def embed_hash(df: DataFrame, col: str = "content", out: str = "values", dims: int = HASH_DIMS) -> DataFrame:
    """Blank texts are dropped before embedding."""
    return drop_blank(df, col).withColumn(out, hash_vector(F.col(col), dims))


def embed_model(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list]],
    col: str = "content",
    out: str = "values",
    batch: int = 100,
) -> DataFrame:
    """Vectors of a user-supplied model. ``load`` runs once per task and returns texts -> vectors.

    A call that fails gives null vectors for its texts only; the rest goes on.
    """
    source = drop_blank(df, col)
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator) -> Iterator:
        model = load()
        for frame in frames:
            texts, vectors = frame[col].tolist(), []
            for start in range(0, len(texts), batch):
                piece = texts[start : start + batch]
                try:
                    made = [None if v is None else [float(x) for x in v] for v in model(piece)]
                    if len(made) != len(piece):
                        raise ValueError("the model must return one vector per text")
                except Exception:
                    made = [None] * len(piece)
                vectors.extend(made)
            yield frame.assign(**{out: vectors})

    return source.mapInPandas(run, schema)


def embed_endpoint(
    df: DataFrame,
    col: str = "content",
    model: str = "text-embedding-3-small",
    dims: int = HASH_DIMS,
    budget: float = EMBEDDING_BUDGET_USD,
) -> DataFrame:
    """Texts to vector, tokens and cost; a blank or null text has no vector and costs nothing. Every row also has the cost summary of the call:
    model, total_tokens, total_cost_usd, monthly_budget_usd, budget_used_percent. Its one row is summed from the token counts alone.
    """
    counted = df.withColumn("token_count", token_count(F.col(col)))
    costed = with_cost(counted, model, "token_count").withColumn("model", F.lit(model))
    ledger = costed.select("model", F.col("token_count").alias("tokens"), "cost_usd")
    summary = cost_summary(ledger, budget, by=["model"])
    embedded = costed.drop("model").withColumn("values", hash_vector(F.coalesce(F.col(col), F.lit("")), dims))
    return embedded.crossJoin(F.broadcast(summary))
