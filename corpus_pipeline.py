"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, mixing, near, quality, toxicity
from lorekeep.llm.common import fold, load, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with(docs: DataFrame, new: set[str], body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``body`` over docs, of which the columns are given back; those that clash with its new ones step aside meanwhile."""
    aside = {name: f"__own_{name}" for name in docs.columns if name in new}
    done = body(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(aside.get(name, name)).alias(name) for name in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from the labelled ones among them, scores below one half."""
    labels = load(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0)
    model = toxicity.fit(docs, labels)
    new = {"toxicity", "n_clauses", "worst_clause"}
    return _with(docs, new, lambda own: toxicity.score(own, model).where("toxicity < 0.5"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones."""
    trusted = load(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    model = quality.fit(docs, trusted)
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"}
    return _with(docs, new, lambda own: quality.judge(own, model).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near duplicates."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources interleave by target weight; each file holds a run of it."""
    return _with(docs, {"block", "slot", "position"}, lambda own: mixing.in_order(mixing.mix(own)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids in place of the text, their number, and whether they decode to the text."""
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    added = {"n_tokens": F.size("ids").cast("long"), "lossless": lossless}
    return done.withColumns(added).drop("text", "decoded", "n_replaced")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

# The pattern grammar and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
