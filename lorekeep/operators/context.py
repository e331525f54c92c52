"""From hits to answers: context text, citations, summaries, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.identity import source_of
from lorekeep.functions.tokens import token_count
from lorekeep.operators.embedding import terms
from lorekeep.operators.search import rerank

# Sizes and texts of answers and digests.
CONTEXT_HITS = 5
CONTEXT_CHARS = 500
CITED_SOURCES = 3
DIGEST_PER_NAMESPACE = 10
DIGEST_PER_SOURCE = 5
DIGEST_ITEMS = 10
DIGEST_CHARS = 300
NO_INFORMATION = "No relevant information found."
FAILED_SUMMARY = "Failed to generate summary. Please try again."
FAILED_DIGEST = "Unable to generate digest summary."
ANSWER_HEADER = "📚 *Knowledge Base Results for:* _{query}_\n"
SOURCES_HEADER = "\n*Sources:*"
DIGEST_TITLE = "📊 *Weekly Knowledge Digest* | {from} - {to}"
DIGEST_STATS = "_Knowledge Base Stats:_"
DIGEST_TOTAL = "• Total Documents: "
DIGEST_SOURCES = "• Sources: Slack, Notion, Google Drive"
DIGEST_HINT = "💡 Use `/summarize [your question]` to search the knowledge base anytime!"
NOT_AVAILABLE = "N/A"


def nonempty_context(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("content") != "")


def _joined(items: Column, separator: str) -> Column:
    """Texts of an array of {rank, text}, in rank order."""
    return F.array_join(F.transform(F.array_sort(items), lambda i: i["text"]), separator)


def answer_context(hits: DataFrame, n: int = CONTEXT_HITS, chars: int = CONTEXT_CHARS, ranking: str = "score") -> DataFrame:
    """One context text per query from its n best non-empty hits.

    ``ranking='source_order'`` takes the hits namespace by namespace (slack, notion, drive) instead of by
    score over all of them.
    """
    found = nonempty_context(hits)
    if ranking == "score":
        ranked = rerank(found, n)
    elif ranking == "source_order":
        place = F.array_position(F.array(*map(F.lit, ("slack/", "notion/", "drive/"))), F.col("namespace"))
        window = Window.partitionBy("query_id").orderBy(place, F.col("score").desc_nulls_last(), "id")
        ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    else:
        raise ValueError("ranking must be 'score' or 'source_order'")
    piece = F.concat(
        F.lit("Source: "), source_of(F.col("namespace")), F.lit("\nContent: "), F.substring("content", 1, chars)
    )
    item = F.struct("rank", piece.alias("text"))
    return ranked.groupBy("query_id").agg(
        _joined(F.collect_list(item), "\n\n").alias("context"), F.count(F.lit(1)).alias("hits_used")
    )


def citation(rank: Column, source: Column, url: Column, timestamp: Column) -> Column:
    """``1. Slack - <url|Link> (2024-01-31)``; link and date only where present."""
    present = lambda value: value.isNotNull() & (value != "")
    return F.concat(
        rank.cast("string"),
        F.lit(". "),
        F.initcap(source),
        F.when(present(url), F.concat(F.lit(" - <"), url, F.lit("|Link>"))).otherwise(""),
        F.when(present(timestamp), F.concat(F.lit(" ("), F.substring(timestamp, 1, 10), F.lit(")"))).otherwise(""),
    )


def citations(hits: DataFrame, n: int = CITED_SOURCES) -> DataFrame:
    """Source lines of the n best non-empty hits of each query; hits carry url and timestamp (text)."""
    line = citation(F.col("rank"), source_of(F.col("namespace")), F.col("url"), F.col("timestamp"))
    return rerank(nonempty_context(hits), n).select("query_id", "rank", line.alias("line"))


def answer_render(summaries: DataFrame, lines: DataFrame) -> DataFrame:
    """Header, summary and source lines as one text per query (query_id, text, summary)."""
    cited = lines.groupBy("query_id").agg(
        _joined(F.collect_list(F.struct("rank", F.col("line").alias("text"))), "\n").alias("__lines")
    )
    before, after = ANSWER_HEADER.split("{query}")
    header = F.concat(F.lit(before), F.col("text"), F.lit(after))
    return summaries.join(cited, "query_id", "left").select(
        "query_id",
        F.concat_ws("\n", header, F.col("summary"), F.lit(SOURCES_HEADER), F.col("__lines")).alias("answer"),
    )


def extractive_summary(queries: DataFrame, contexts: DataFrame, n: int = 3) -> DataFrame:
    """Stand-in for a hosted model: the n sentences with most query terms, in their original order.

    ``queries`` has query_id and text, ``contexts`` query_id and context. A query without context, or
    whose terms appear in no sentence, gets the fixed no-information text. Everything happens within a
    query's row, whose context is bounded, so nothing is exploded or shuffled but the join.
    """
    joined = queries.select("query_id", "text").join(contexts.select("query_id", "context"), "query_id", "left")
    sentences = F.split(F.coalesce("context", F.lit("")), r"[.!?\n]+\s*", -1)
    scored = joined.withColumn("__asked", F.array_distinct(terms(F.col("text")))).withColumn(
        "__scored",
        F.transform(
            sentences,
            lambda s, i: F.struct(
                (-F.size(F.array_intersect(terms(s), F.col("__asked")))).alias("worse"),
                i.alias("place"),
                F.trim(s).alias("text"),
            ),
        ),
    )
    relevant = F.filter("__scored", lambda s: s["worse"] < 0)
    best = F.slice(F.array_sort(relevant), 1, n)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct(s["place"].alias("place"), s["text"].alias("text"))))
    text = F.array_join(F.transform(ordered, lambda s: s["text"]), ". ")
    return scored.select(
        "query_id", "text", F.when(F.size(best) > 0, F.concat(text, F.lit("."))).otherwise(NO_INFORMATION).alias("summary")
    )


def model_summary(
    contexts: DataFrame,
    load: Callable[[], Callable[[str, str], str]],
    failed: str = FAILED_SUMMARY,
) -> DataFrame:
    """Summaries by a user's model. ``load`` runs once per task and returns (query text, context) -> text.

    A blank context gives the no-information text without a call; a failing call gives ``failed``.
    """
    schema = T.StructType([*contexts.schema.fields, T.StructField("summary", T.StringType())])

    def run(frames: Iterator) -> Iterator:
        model = load()

        def answer(text, context):
            if not context:
                return NO_INFORMATION
            try:
                return model(text, context)
            except Exception:
                return failed

        for frame in frames:
            made = [answer(t, c) for t, c in zip(frame["text"], frame["context"])]
            yield frame.assign(summary=made)

    return contexts.mapInPandas(run, schema)


def search_response(queries: DataFrame, hits: DataFrame, k: int = 5, tokenizer: str = "ws") -> DataFrame:
    """Per query: its token count and a map from source to its (at most k) hits in rank order."""
    hit = F.struct("rank", "id", "score")
    per_source = hits.where(F.col("rank") <= k).groupBy("query_id", source_of(F.col("namespace")).alias("source")).agg(
        F.array_sort(F.collect_list(hit)).alias("hits")
    )
    per_query = per_source.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "hits")))).alias("results")
    )
    asked = queries.select("query_id", "text", token_count(F.col("text"), tokenizer).alias("token_count"))
    return asked.join(per_query, "query_id", "left")


def digest(hits: DataFrame, as_of: Column, days: int = 7, total: int = DIGEST_ITEMS, ranking: str = "score") -> DataFrame:
    """Best items of the last days: 10 per namespace, of these 5 per source, of these 10 overall.

    ``hits`` has namespace, id, score and ts. The two inner cuts are by the same order within the same
    group, so the tighter one is applied. Compat ``ranking='source_order'`` fills the places source by source.
    """
    window = hits.where((F.col("ts") > as_of - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= as_of))
    score = F.col("score").desc_nulls_last()
    per_source = F.row_number().over(Window.partitionBy("namespace").orderBy(score, "id"))
    kept = window.withColumn("__rank", per_source).where(
        F.col("__rank") <= min(DIGEST_PER_SOURCE, DIGEST_PER_NAMESPACE)
    )
    place = F.array_position(F.array(*map(F.lit, ("slack/", "notion/", "drive/"))), F.col("namespace"))
    order = [score, F.col("id")] if ranking == "score" else [place, F.col("__rank")]
    # limited first, so the window below sees ``total`` rows
    best = kept.orderBy(*order).limit(total)
    position = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return best.withColumn("position", position).drop("__rank")


def digest_context(items: DataFrame, chars: int = DIGEST_CHARS) -> DataFrame:
    """One text with source, date and shortened content of each digest item."""
    piece = F.concat(
        F.lit("Source: "),
        source_of(F.col("namespace")),
        F.lit("\nDate: "),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(NOT_AVAILABLE)),
        F.lit("\nContent: "),
        F.substring(F.coalesce("content", F.lit("")), 1, chars),
    )
    item = F.struct(F.col("position").alias("rank"), piece.alias("text"))
    return items.agg(_joined(F.collect_list(item), "\n\n").alias("context"), F.count(F.lit(1)).alias("items"))


def render_digest(body: DataFrame, stats: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The digest message from a one-row body (digest) and a one-row total (total_vector_count)."""
    one = lambda df: df.withColumn("__one", F.lit(1))
    before, rest = DIGEST_TITLE.split("{from}")
    between = rest.split("{to}")[0]
    title = F.concat(
        F.lit(before),
        F.date_format(as_of - F.make_dt_interval(F.lit(days)), "MMM dd"),
        F.lit(between),
        F.date_format(as_of, "MMM dd, yyyy"),
    )
    total = F.coalesce(F.format_number("total_vector_count", 0), F.lit(NOT_AVAILABLE))
    lines = [
        title,
        F.lit(""),
        F.coalesce("digest", F.lit("")),
        F.lit(""),
        F.lit(DIGEST_STATS),
        F.concat(F.lit(DIGEST_TOTAL), total),
        F.lit(DIGEST_SOURCES),
        F.lit(""),
        F.lit(DIGEST_HINT),
        F.lit(""),
    ]
    return one(body).join(one(stats), "__one", "left").select(F.concat_ws("\n", *lines).alias("message"))
