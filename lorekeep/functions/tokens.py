"""Token counts and token arrays.

``ws`` counts non-empty pieces between white space. It stands in for a byte-pair encoding, whose
vocabulary needs a download, and its counts do not equal that encoding's counts. ``chars4`` is the
four-characters-per-token rule of thumb. ``bpe`` uses the installed encoding and raises a clear error
when its vocabulary is not available.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = ("ws", "chars4", "bpe")
BPE_ENCODING = "cl100k_base"  # fixed value


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\A\s*\z")


def load_bpe():
    try:
        import tiktoken

        return tiktoken.get_encoding(BPE_ENCODING)
    except Exception as error:
        raise RuntimeError(
            f"tokenizer 'bpe' needs the {BPE_ENCODING} vocabulary in the local cache; use 'ws' or 'chars4'"
        ) from error


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def bpe_ids(text: pa.Array) -> pa.Array:
    encoding = load_bpe()
    return pa.array(
        [None if t is None else encoding.encode(t) for t in text.to_pylist()], pa.list_(pa.int32())
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def bpe_windows(ids: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Decoded text of each window of a token id array."""
    encoding = load_bpe()
    rows = zip(ids.to_pylist(), starts.to_pylist(), ends.to_pylist())
    return pa.array(
        [[encoding.decode(row[a:b]) for a, b in zip(lo, hi)] for row, lo, hi in rows],
        pa.list_(pa.string()),
    )


def ws_pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\s+", -1)


def _leading(pieces: Column) -> Column:
    return (F.element_at(pieces, 1) == "").cast("int")


def ws_size(pieces: Column) -> Column:
    """Only the first and last piece of a white-space split can be empty."""
    trailing = (F.element_at(pieces, -1) == "").cast("int")
    return F.greatest(F.size(pieces) - _leading(pieces) - trailing, F.lit(0))


def ws_tokens(pieces: Column) -> Column:
    return F.slice(pieces, F.lit(1) + _leading(pieces), ws_size(pieces))


def token_count(text: Column, tokenizer: str = "ws") -> Column:
    if tokenizer == "ws":
        return ws_size(ws_pieces(text))
    if tokenizer == "chars4":
        return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")
    if tokenizer == "bpe":
        load_bpe()
        return F.size(bpe_ids(F.coalesce(text, F.lit(""))))
    raise ValueError(f"tokenizer must be one of {TOKENIZERS}")
