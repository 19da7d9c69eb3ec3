"""Model prices and cost arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# USD per 1,000 tokens (input, output) by lower-case model name.
MODEL_PRICES = {
    "gpt-4": ("0.03", "0.06"),
    "gpt-4-turbo": ("0.01", "0.03"),
    "gpt-4-turbo-preview": ("0.01", "0.03"),
    "gpt-4o": ("0.005", "0.015"),
    "gpt-4o-mini": ("0.00015", "0.0006"),
    "gpt-3.5-turbo": ("0.0005", "0.0015"),
    "gpt-3.5-turbo-16k": ("0.003", "0.004"),
    "claude-3-opus": ("0.015", "0.075"),
    "claude-3-sonnet": ("0.003", "0.015"),
    "claude-3-haiku": ("0.00025", "0.00125"),
    "claude-3-5-sonnet": ("0.003", "0.015"),
    "default": ("0.001", "0.002"),
}

PRICE_TYPE = "decimal(10,6)"
MONEY_TYPE = "decimal(10,6)"


def price(model: Column, side: str, prices: dict | None = None) -> Column:
    """Price per 1,000 tokens; unknown models take the ``default`` price.

    The list is a literal map: a lookup, not a join, so there is nothing to shuffle.
    """
    prices = prices or MODEL_PRICES
    place = 0 if side == "input" else 1
    pairs = []
    for name, both in prices.items():
        pairs += [F.lit(name), F.lit(Decimal(both[place])).cast(PRICE_TYPE)]
    table = F.create_map(*pairs)
    fallback = F.lit(Decimal(prices["default"][place])).cast(PRICE_TYPE)
    return F.coalesce(F.try_element_at(table, F.lower(model)), fallback)


def token_cost(tokens: Column, per_thousand: Column) -> Column:
    """Exact cost before rounding (9 decimals)."""
    thousandth = F.lit(Decimal("0.001")).cast("decimal(4,3)")
    return (tokens.cast("decimal(12,0)") * per_thousand * thousandth).cast("decimal(22,9)")


def money(cost: Column) -> Column:
    """Half-up to 6 places."""
    return cost.cast(MONEY_TYPE)
