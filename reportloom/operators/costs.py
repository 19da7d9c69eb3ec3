"""Usage ledger: cost of each call, filters, and reports over the ledger."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import pricing


def price_lookup(usage: DataFrame, prices: dict | None = None) -> DataFrame:
    """Add input_price and output_price per 1,000 tokens."""
    return usage.withColumns(
        {f"{side}_price": pricing.price(F.col("model_name"), side, prices) for side in ("input", "output")}
    )


def calculate_cost(usage: DataFrame, prices: dict | None = None) -> DataFrame:
    """Add total_tokens, input_cost, output_cost, total_cost.

    The total is rounded from the unrounded parts, so it may differ from their rounded sum.
    """
    cost = {
        side: pricing.token_cost(F.col(f"{side}_tokens"), pricing.price(F.col("model_name"), side, prices))
        for side in ("input", "output")
    }
    return usage.withColumns(
        {
            "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
            "input_cost": pricing.money(cost["input"]),
            "output_cost": pricing.money(cost["output"]),
            "total_cost": pricing.money(cost["input"] + cost["output"]),
        }
    )


def _moment(rows: DataFrame, value: dt.datetime, column: str = "timestamp") -> Column:
    """A literal of the column's own timestamp type, so the comparison reaches the scan."""
    return F.lit(value).cast("timestamp_ntz").cast(rows.schema[column].dataType)


def usage_filter(
    usage: DataFrame,
    user_id: str | None = None,
    session_id: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """AND of the given conditions; empty ones are ignored.

    Dates are midnight timestamps, so of the end day only 00:00:00 itself is inside.
    """
    conditions: list[Column] = []
    for column, value in (("user_id", user_id), ("session_id", session_id), ("model_name", model_name)):
        if value:
            conditions.append(F.col(column) == value)
    if start_date:
        conditions.append(F.col("timestamp") >= _moment(usage, dt.datetime.fromisoformat(start_date)))
    if end_date:
        conditions.append(F.col("timestamp") <= _moment(usage, dt.datetime.fromisoformat(end_date)))
    return usage.where(reduce(lambda a, b: a & b, conditions)) if conditions else usage


def last_n_days(usage: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Rows from midnight ``days`` before ``as_of`` on."""
    start = dt.datetime.combine(as_of - dt.timedelta(days=days), dt.time())
    return usage.where(F.col("timestamp") >= _moment(usage, start))


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def cost_summary(usage: DataFrame) -> DataFrame:
    """One row of totals; an empty ledger gives zeros and NULL times."""
    return usage.agg(
        F.count(F.lit(1)).alias("total_requests"),
        _total("input_tokens").alias("total_input_tokens"),
        _total("output_tokens").alias("total_output_tokens"),
        _total("total_tokens").alias("total_tokens"),
        _total("total_cost").cast("double").alias("total_cost_usd"),
        F.coalesce(F.avg("total_cost"), F.lit(0)).cast("double").alias("avg_cost_per_request"),
        F.min("timestamp").alias("first_request"),
        F.max("timestamp").alias("last_request"),
    )


def _by(usage: DataFrame, *keys: Column) -> DataFrame:
    return usage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("total_cost").cast("double").alias("cost_usd"),
    )


def _costliest_first(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(F.col("cost_usd").desc_nulls_first(), F.col(key).asc_nulls_last())


def cost_by_model(usage: DataFrame) -> DataFrame:
    return _costliest_first(_by(usage, F.col("model_name").alias("model")), "model")


def cost_by_operation(usage: DataFrame) -> DataFrame:
    rows = _by(usage, F.col("operation_type").alias("operation")).drop("tokens")
    return _costliest_first(rows, "operation")


def cost_by_user(usage: DataFrame) -> DataFrame:
    return _by(usage, F.col("user_id"))


def cost_by_session(usage: DataFrame) -> DataFrame:
    return _by(usage, F.col("session_id"))


def daily_costs(usage: DataFrame) -> DataFrame:
    """Per calendar day, newest first."""
    rows = _by(usage, F.to_date("timestamp").alias("date"))
    return rows.orderBy(F.col("date").desc_nulls_first())


def monthly_costs(usage: DataFrame) -> DataFrame:
    return _by(usage, F.to_date(F.date_trunc("month", "timestamp")).alias("month"))


def cost_rollup(usage: DataFrame) -> DataFrame:
    """Totals, per model and per operation from one scan.

    ``level`` is ``all``, ``model`` or ``operation``; the other key is NULL.
    """
    m, o = F.col("model_name"), F.col("operation_type")
    # Rows first fold to (model, operation) pairs, so the expansion into three grouping
    # sets happens on a handful of rows rather than on every ledger row.
    pairs = usage.groupBy(m, o).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("tok"), F.sum("total_cost").alias("cost")
    )
    level = (
        F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "model").otherwise("operation")
    )
    return (
        pairs.groupingSets([[m], [o], []], m, o)
        .agg(
            level.alias("level"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("requests"),
            F.sum("tok").alias("tokens"),
            F.sum("cost").cast("double").alias("cost_usd"),
        )
        .select("level", F.col("model_name").alias("model"), F.col("operation_type").alias("operation"),
                "requests", "tokens", "cost_usd")
    )
