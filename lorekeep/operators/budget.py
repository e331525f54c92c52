"""Embedding cost: estimates, gates, ledger summaries and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import prices as pr
from lorekeep.operators.running import running_total, with_batch

BATCH = 100  # fixed value: texts per embedding call


def with_cost(df: DataFrame, model: Column | str = "text-embedding-3-small", tokens: str = "tokens") -> DataFrame:
    name = F.lit(model) if isinstance(model, str) else model
    return df.withColumn("cost_usd", pr.token_cost(F.col(tokens), name))


def budget_state(spent: Column, cap: float, alert: float) -> Column:
    return (
        F.when(spent > cap, "halted")
        .when((F.lit(cap) > 0) & (spent >= F.lit(cap * alert)), "alert")
        .otherwise("ok")
    )


def budget_gate(
    df: DataFrame,
    order: Sequence[str],
    cap: float = pr.EMBEDDING_BUDGET_USD,
    alert: float = pr.ALERT_SHARE,
    month: str = "month",
    cost: str = "cost_usd",
) -> DataFrame:
    """Running cost per month; ``accepted`` while it stays within the cap, with the state at each row.

    Money is summed in whole nano-dollars, so the result does not depend on the order of partial sums.
    """
    nanos = F.round(F.col(cost) * 1e9).cast("bigint")
    running = running_total(df, nanos, order, [month], "__nanos")
    spent = F.col("__nanos") / F.lit(1e9)
    return running.withColumns(
        {"running_cost_usd": spent, "accepted": spent <= cap, "state": budget_state(spent, cap, alert)}
    ).drop("__nanos")


def batch_gate(
    df: DataFrame,
    cap: float = pr.EMBEDDING_BUDGET_USD,
    already_spent: float = 0.0,
    by: Sequence[str] = (),
    cost: str = "cost_usd",
) -> DataFrame:
    """All-or-nothing: a batch whose total would pass the cap is halted as a whole.

    ``by`` names the batch columns; without it the whole frame is one batch.
    """
    total = F.round(F.sum(cost), 9)
    if not by:
        spent = df.agg(total.alias("batch_cost_usd")).scalar()
        return df.withColumns({"batch_cost_usd": spent, "accepted": spent + already_spent <= cap})
    decided = df.groupBy(*by).agg(total.alias("batch_cost_usd"))
    decided = decided.withColumn("accepted", F.col("batch_cost_usd") + already_spent <= cap)
    return df.join(decided, list(by))


def even_allocation(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    size: int = BATCH,
    model: str = "text-embedding-3-small",
    tokens: str = "tokens",
) -> DataFrame:
    """Spread each batch's tokens (whole division) and cost over its rows."""
    batched = with_batch(df, order, group, size)
    per_batch = Window.partitionBy(*group, "batch")
    total, rows = F.sum(tokens).over(per_batch), F.count(F.lit(1)).over(per_batch)
    return batched.withColumns(
        {
            "allocated_tokens": F.floor(total / rows),
            "allocated_cost_usd": pr.token_cost(total, F.lit(model)) / rows,
        }
    )


def cost_summary(
    ledger: DataFrame, budget: float = pr.EMBEDDING_BUDGET_USD, by: Sequence[str] = ("month", "model")
) -> DataFrame:
    """Per month and model, or as ``by`` says: tokens, cost to 4 places, budget, share used in percent; without a budget the share is 0."""
    summed = ledger.groupBy(*by).agg(F.sum("tokens").alias("total_tokens"), F.sum("cost_usd").alias("__cost"))
    share = F.round(F.col("__cost") / F.lit(float(budget)) * 100, 2) if budget > 0 else F.lit(0.0)
    return summed.select(
        *by,
        "total_tokens",
        F.round("__cost", 4).alias("total_cost_usd"),
        F.lit(float(budget)).alias("monthly_budget_usd"),
        share.alias("budget_used_percent"),
    )


def budget_alerts(
    ledger: DataFrame,
    budget: float = pr.EMBEDDING_BUDGET_USD,
    alert: float = pr.ALERT_SHARE,
    month: str = "month",
    day: str = "day",
    cost: str = "cost_usd",
) -> DataFrame:
    """Daily running cost within each month against the budget; the window sees 31 rows a month."""
    daily = ledger.groupBy(month, day).agg(F.sum(cost).alias("day_cost_usd"))
    so_far = Window.partitionBy(month).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("day_cost_usd").over(so_far)
    return daily.withColumn("running_cost_usd", spent).withColumn(
        "state", budget_state(F.round("running_cost_usd", 9), budget, alert)
    )
