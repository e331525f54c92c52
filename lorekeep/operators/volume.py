"""Token volume, cost projection and the audit decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import prices as pr
from lorekeep.functions.tokens import token_count

# Text fields in the order they are joined; the title comes last.
TEXT_FIELDS = ("text", "content", "text_content", "body", "message", "description", "summary")
TITLE_FIELD = "title"
# Drive exports keep their text and title under these names; compat leaves them out.
DRIVE_FIELDS = ("content_preview", "name")

# Report texts.
WITHIN = "✅ WITHIN BUDGET"
OVER = "❌ OVER BUDGET"
GO = "✅ GO"
NO_GO = "🛑 NO-GO"
ADVICE_OVER = "⚠️ Estimated costs exceed budget. Consider implementing rate limiting or batch processing."
ADVICE_VOLUME = "💡 High token volume detected. Consider caching frequently accessed content."
ADVICE_ALWAYS = (
    "✅ Implement incremental updates to reduce redundant embedding generation.",
    "💰 Monitor actual usage and adjust batch sizes to optimize costs.",
)
PII_TEXT = {True: ("PASSED", "Approved for embeddings"), False: ("FAILED", "Remove PII before proceeding")}
BUDGET_TEXT = {
    True: ("WITHIN BUDGET", "Approved for pilot"),
    False: ("OVER BUDGET", "Reduce scope or increase budget"),
}


def extract_text(df: DataFrame, extra_fields: Sequence[str] = DRIVE_FIELDS, compat: bool = False) -> Column:
    """Present text fields joined by spaces; absent and null ones are skipped."""
    order = [*TEXT_FIELDS, TITLE_FIELD, *(() if compat else extra_fields)]
    return F.concat_ws(" ", *[F.col(name) for name in order if name in df.columns])


def sample_stats(df: DataFrame, text: Column | None = None, tokenizer: str = "ws") -> DataFrame:
    """Items, tokens and tokens per item; an empty sample has average 0."""
    tokens = token_count(extract_text(df) if text is None else text, tokenizer)
    return df.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"),
    ).withColumn(
        "avg_tokens_per_item",
        F.coalesce(F.try_divide(F.col("total_tokens"), F.col("total_items")), F.lit(0.0)),
    )


def project(stats: DataFrame, per_week: int = pr.ITEMS_PER_WEEK) -> DataFrame:
    weekly = F.col("avg_tokens_per_item") * F.lit(per_week)
    return stats.withColumns(
        {
            "weekly_items": F.lit(per_week),
            "weekly_tokens": weekly,
            "monthly_items": F.round(F.lit(per_week * pr.WEEKS_PER_MONTH), 2),
            "monthly_tokens": weekly * F.lit(pr.WEEKS_PER_MONTH),
        }
    )


def project_cost(projection: DataFrame) -> DataFrame:
    """Monthly USD: embeddings, summary input, summary output at 20 % of the input, totals."""
    millions = F.col("monthly_tokens") / F.lit(1_000_000.0)
    price = {name: F.lit(usd) for name, usd in pr.PROJECTION_PRICES.items()}
    spent_in = millions * price["claude_input"]
    spent_out = millions * F.lit(pr.OUTPUT_SHARE) * price["claude_output"]
    costed = projection.withColumns(
        {
            "embedding_cost_usd": F.round(millions * price["embedding_ada"], 2),
            "input_cost_usd": F.round(spent_in, 2),
            "output_cost_usd": F.round(spent_out, 2),
            "summary_cost_usd": F.round(spent_in + spent_out, 2),
        }
    )
    total = F.round(F.col("embedding_cost_usd") + F.col("summary_cost_usd"), 2)
    return costed.withColumn("total_monthly_usd", total)


def budget_check(
    costs: DataFrame, budget: float = pr.ESTIMATE_BUDGET_USD, cost: str = "total_monthly_usd"
) -> DataFrame:
    """A budget of zero leaves the utilisation null instead of failing."""
    spent, cap = F.col(cost), F.lit(float(budget))
    within = spent <= cap
    return costs.withColumns(
        {
            "budget_limit_usd": cap,
            "utilization_percent": F.round(F.try_divide(spent, cap) * 100, 2),
            "within_budget": within,
            "remaining_budget_usd": F.round(cap - spent, 2),
            "status": F.when(within, WITHIN).otherwise(OVER),
        }
    )


def recommend(checked: DataFrame) -> DataFrame:
    advice = F.array_compact(
        F.array(
            F.when(~F.col("within_budget"), ADVICE_OVER),
            F.when(F.round("monthly_tokens", 2) > pr.HIGH_VOLUME_TOKENS, ADVICE_VOLUME),
            *[F.lit(text) for text in ADVICE_ALWAYS],
        )
    )
    return checked.withColumn("recommendations", advice)


def go_no_go(gate: DataFrame, budget: DataFrame) -> DataFrame:
    """Join of two one-row aggregates: ready only if the scan passed and the cost fits."""
    pii, cost = F.col("pii_check"), F.col("budget_check")
    both = gate.select(F.col("passed").alias("pii_check"), F.lit(1).alias("__one")).join(
        budget.select(F.col("within_budget").alias("budget_check"), F.lit(1).alias("__one")), "__one"
    )
    say = lambda flag, texts, i: F.when(flag, texts[True][i]).otherwise(texts[False][i])
    return both.select(
        pii,
        cost,
        (pii & cost).alias("ready_for_pilot"),
        F.when(pii & cost, GO).otherwise(NO_GO).alias("overall_status"),
        say(pii, PII_TEXT, 0).alias("pii_status"),
        say(pii, PII_TEXT, 1).alias("pii_recommendation"),
        say(cost, BUDGET_TEXT, 0).alias("budget_status"),
        say(cost, BUDGET_TEXT, 1).alias("budget_recommendation"),
    )
