"""Quality rules: hashed n-gram log-likelihood ratios between a trusted target and the raw corpus."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import let, words

BUCKETS = 16_384


def _tokens(text: Column) -> Column:
    """Runs of letters and digits, and runs of other visible characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"), F.lit(0))


def _hashed(text: Column, buckets: int) -> Column:
    """Buckets of all tokens and all neighbouring pairs of a text."""

    def both(tokens: Column) -> Column:
        n = F.size(tokens)
        single = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        later = F.when(n > 1, F.slice(tokens, F.lit(2), n - 1)).otherwise(F.array().cast("array<string>"))
        pair = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")
        return F.concat(single, F.filter(F.zip_with(tokens, later, lambda a, b: F.when(b.isNotNull(), pair(a, b))), lambda x: x.isNotNull()))

    return let(_tokens(text), both)


def fit(docs: DataFrame, trusted: DataFrame, max_trusted: int = 50_000, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratios`` array<double>: log of target over raw probability for each bucket.

    The raw multinomial counts the n-grams of all docs (text); the target multinomial those of docs whose doc_id is
    in ``trusted`` (doc_id), of which about ``max_trusted`` with the lowest hashes are used, so that they can be broadcast. Both are
    smoothed by one half in each bucket. Tasks send one row per bucket.
    """
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    share = min(1.0, max_trusted / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    flagged = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left").select(
        F.col("__id").isNotNull().cast("long").alias("__target"), _hashed(F.col("text"), buckets).alias("__grams")
    )
    counts = (
        flagged.select("__target", F.explode("__grams").alias("__at"))
        .groupBy("__at")
        .agg(F.count("*").alias("__raw"), F.sum("__target").alias("__hits"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("__bucket"))
    filled = every.join(counts, F.col("__bucket") == F.col("__at"), "left").select(
        "__bucket", F.coalesce("__raw", F.lit(0)).alias("__raw"), F.coalesce("__hits", F.lit(0)).alias("__hits")
    )
    held = filled.agg(
        F.array_sort(F.collect_list(F.struct("__bucket", "__raw", "__hits"))).alias("__all"),
        (F.sum("__raw") + 0.5 * buckets).alias("__raws"),
        (F.sum("__hits") + 0.5 * buckets).alias("__targets"),
    )
    ratio = lambda x: F.log((x["__hits"] + 0.5) / F.col("__targets")) - F.log((x["__raw"] + 0.5) / F.col("__raws"))
    return held.select(F.transform("__all", ratio).alias("ratios"))


def score(docs: DataFrame, model: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``llr`` double: the mean log-likelihood ratio of the n-grams of the whole text, 0 for a text without any.

    The one row of ``model``, ``buckets`` numbers, becomes a constant of the plan. Null texts count as empty; other columns stay,
    one called llr is replaced.
    """
    ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in model.first()["ratios"]])), "array<double>")

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(ratios, g))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    return docs.withColumn("llr", let(_hashed(F.col("text"), buckets), mean))


def _repeated_words(own: Column) -> Column:
    """Words covered by a window of three words that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(rows: Column) -> Column:
            twin = lambda x, k: F.get(rows, k)["h"] == x["h"]
            hits = F.filter(rows, lambda x, k: F.coalesce(twin(x, k - 1), F.lit(False)) | F.coalesce(twin(x, k + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, marked))

    n = F.size(own)
    window = lambda i: F.xxhash64(F.get(own, i), F.get(own, i + 1), F.get(own, i + 2))
    return F.when(n < 3, 0).otherwise(let(F.transform(F.sequence(F.lit(0), n - 3), window), covered))


def base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed of the whole text (null: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    both = let(words(F.col("text")), lambda own: F.struct(F.size(own).alias("n"), _repeated_words(own).alias("r")))
    counted = docs.withColumn("__words", both).withColumns(
        {
            "n_words": F.col("__words.n").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("__words.r").cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("__words")


def judge(docs: DataFrame, model: DataFrame, threshold: float = -0.2, buckets: int = BUCKETS) -> DataFrame:
    """Add the base counts, llr and ``kept``: false if the base rules fail or the ratio is below ``threshold``.

    Every document is decided, by the same threshold and without chance. Ties with the threshold stay. Null and empty texts fail
    the base rules. Columns of the same names are replaced, an empty table gives no rows.
    """
    judged = base_counts(score(docs, model, buckets))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
