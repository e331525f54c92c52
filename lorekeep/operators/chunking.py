"""Overlapping token windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import tokens as tk

CHUNK_SIZE = 500  # fixed value
CHUNK_OVERLAP = 50  # fixed value
METADATA = ("source", "source_id", "author", "timestamp", "url")


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(~tk.is_blank(F.col(col)))


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Windows start every size-overlap tokens and stop with the first one that reaches the end."""
    many = F.ceil((n - F.lit(overlap)) / F.lit(size - overlap)).cast("int")
    return F.when(n <= size, 1).otherwise(many)


def chunk(
    df: DataFrame,
    col: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    tokenizer: str = "ws",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per chunk: content, token_count, chunk_index, total_chunks, start_token, end_token.

    The windows of a document are built as one array and then exploded, so neither the text nor its
    tokens are copied once per chunk. A document of one chunk keeps its text; longer ones under ``ws``
    are words joined by single spaces. Blank texts give no chunk. ``keep`` lists other columns to
    carry (default all but ``col``).
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    if tokenizer not in tk.TOKENIZERS:
        raise ValueError(f"tokenizer must be one of {tk.TOKENIZERS}")
    carried = list(keep) if keep is not None else [name for name in df.columns if name != col]
    stride = size - overlap
    base = df.withColumn("__text", F.col(col))
    if tokenizer == "ws":
        base = base.withColumn("__pieces", tk.ws_pieces(F.col("__text")))
        base = base.withColumn("__tokens", tk.ws_tokens(F.col("__pieces")))
        base = base.withColumn("__n", F.size("__tokens"))
        part = lambda start, length: F.array_join(F.slice(F.col("__tokens"), start + 1, length), " ")
    elif tokenizer == "chars4":
        base = base.withColumn("__n", tk.token_count(F.col("__text"), tokenizer))
        part = lambda start, length: F.substring(F.col("__text"), start * 4 + 1, length * 4)
    else:
        tk.load_bpe()
        base = base.withColumn("__tokens", tk.bpe_ids(F.col("__text")))
        base = base.withColumn("__n", F.size("__tokens"))
        part = None
    # a blank text gets no windows here; a filter would compute a derived text twice
    total = window_count(F.col("__n"), size, overlap)
    blank = F.col("__n") == 0 if tokenizer == "ws" else tk.is_blank(F.col("__text"))
    base = base.withColumn("__total", F.when(blank, 0).otherwise(total))

    end_of = lambda index: F.least(index * stride + size, F.col("__n"))
    indexes = F.sequence(F.lit(0), F.col("__total") - 1)
    if tokenizer == "bpe":
        base = base.withColumn(
            "__parts",
            tk.bpe_windows(
                F.col("__tokens"),
                F.transform(indexes, lambda i: i * stride),
                F.transform(indexes, end_of),
            ),
        )
        content = lambda i: F.get(F.col("__parts"), i)
    else:
        content = lambda i: part(i * stride, end_of(i) - i * stride)
    window = lambda i: F.struct(
        F.when(F.col("__total") == 1, F.col("__text")).otherwise(content(i)).alias("content"),
        (end_of(i) - i * stride).alias("token_count"),
        i.alias("chunk_index"),
        F.col("__total").alias("total_chunks"),
        (i * stride).alias("start_token"),
        end_of(i).alias("end_token"),
    )
    windows = F.when(F.col("__total") > 0, F.transform(indexes, window))
    exploded = base.select(*carried, F.explode(windows).alias("__chunk"))
    return exploded.select(*carried, "__chunk.*")


def chunk_documents(
    df: DataFrame,
    content: str = "content",
    extra: str | None = "extra",
    key: str | None = None,
    **options,
) -> DataFrame:
    """Chunks with the standard metadata; an extra key of the same name overrides it.

    ``df`` has source, source_id, author, timestamp, url and a map<string,string> of extras. Only keys
    that are present with a value override.
    """
    base = df
    if extra:
        present = lambda name: F.coalesce(F.try_element_at(F.col(extra), F.lit(name)), F.col(name))
        base = base.withColumns({name: present(name) for name in METADATA})
        standard = F.array(*[F.lit(name) for name in METADATA])
        base = base.withColumn(
            "extra", F.map_filter(F.col(extra), lambda name, _: ~F.array_contains(standard, name))
        )
    carried = [*([key] if key else []), *METADATA, *(["extra"] if extra else [])]
    return chunk(base, content, keep=carried, **options)


def chunk_stats(chunks: DataFrame, *doc_keys: str) -> DataFrame:
    """Per document: tokens (overlap not counted), chunks, tokens per chunk."""
    stats = chunks.groupBy(*doc_keys).agg(
        F.max("end_token").alias("total_tokens"), F.count(F.lit(1)).alias("num_chunks")
    )
    return stats.withColumn("avg_chunk_size", F.col("total_tokens") / F.col("num_chunks"))
