"""Prices and projection constants. Money is double; rounding is part of the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per one million tokens.
EMBEDDING_PRICES = {
    "text-embedding-3-small": 0.02,
    "text-embedding-3-large": 0.13,
    "text-embedding-ada-002": 0.10,
}
DEFAULT_EMBEDDING_PRICE = 0.02
PROJECTION_PRICES = {
    "embedding_ada": 0.10,
    "gpt4_input": 10.00,
    "gpt4_output": 30.00,
    "claude_input": 3.00,
    "claude_output": 15.00,
}
WEEKS_PER_MONTH = 4.33
OUTPUT_SHARE = 0.2
ITEMS_PER_WEEK = 1000
ESTIMATE_BUDGET_USD = 50.0
EMBEDDING_BUDGET_USD = 100.0
ALERT_SHARE = 0.75
HIGH_VOLUME_TOKENS = 10_000_000


def price_of(model: Column) -> Column:
    """Price of a model name; three literals, so no join is needed."""
    price = F
    for name, usd in EMBEDDING_PRICES.items():
        price = price.when(model == name, F.lit(usd))
    return price.otherwise(F.lit(DEFAULT_EMBEDDING_PRICE))


def token_cost(tokens: Column, model: Column) -> Column:
    return tokens * (price_of(model) / F.lit(1_000_000.0))
