"""Usage ledger queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reportloom.operators import costs as op
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_U = f"WITH {tb.USAGE_SQL}"
_BY = "count(*) AS requests, sum(total_tokens) AS tokens, CAST(sum(total_cost) AS DOUBLE) AS cost_usd"
_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _money(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query(
    "price_lookup",
    f"{_U} SELECT event_id, CAST(input_price AS DOUBLE) AS input_price, CAST(output_price AS DOUBLE) AS output_price FROM usage",
)
def price_lookup(spark, sf_dir):
    priced = op.price_lookup(tb.calls(spark, sf_dir)).select("event_id", "input_price", "output_price")
    return _money(priced, "input_price", "output_price")


@query(
    "calculate_cost",
    f"""{_U} SELECT event_id, total_tokens, CAST(input_cost AS DOUBLE) AS input_cost,
       CAST(output_cost AS DOUBLE) AS output_cost, CAST(total_cost AS DOUBLE) AS total_cost FROM usage""",
)
def calculate_cost(spark, sf_dir):
    costs = ("input_cost", "output_cost", "total_cost")
    return _money(tb.usage(spark, sf_dir).select("event_id", "total_tokens", *costs), *costs)


_SUMMARY = """count(*) AS total_requests, coalesce(sum(input_tokens), 0) AS total_input_tokens,
  coalesce(sum(output_tokens), 0) AS total_output_tokens, coalesce(sum(total_tokens), 0) AS total_tokens,
  coalesce(CAST(sum(total_cost) AS DOUBLE), 0) AS total_cost_usd,
  round(coalesce(CAST(sum(total_cost) AS DOUBLE) / count(*), 0), 8) AS avg_cost_per_request,
  strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS first_request,
  strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS last_request"""


def _summary(df):
    return op.cost_summary(df).withColumns(
        {
            "avg_cost_per_request": F.round("avg_cost_per_request", 8),
            "first_request": F.date_format("first_request", _TS),
            "last_request": F.date_format("last_request", _TS),
        }
    )


@query("cost_summary", f"{_U} SELECT {_SUMMARY} FROM usage")
def cost_summary(spark, sf_dir):
    return _summary(tb.usage(spark, sf_dir))


@query("cost_summary_empty", f"{_U} SELECT {_SUMMARY} FROM usage WHERE user_id = 'nobody'")
def cost_summary_empty(spark, sf_dir):
    return _summary(op.usage_filter(tb.usage(spark, sf_dir), user_id="nobody"))


@query(
    "usage_filter",
    f"""{_U} SELECT {_SUMMARY} FROM usage WHERE timestamp >= TIMESTAMP '2024-01-05'
  AND timestamp <= TIMESTAMP '2024-01-20' AND model_name = 'gpt-4o'""",
)
def usage_filter(spark, sf_dir):
    return _summary(
        op.usage_filter(tb.usage(spark, sf_dir), start_date="2024-01-05", end_date="2024-01-20", model_name="gpt-4o")
    )


@query("cost_by_model", f"{_U} SELECT model_name AS model, {_BY} FROM usage GROUP BY model_name")
def cost_by_model(spark, sf_dir):
    return op.cost_by_model(tb.usage(spark, sf_dir))


@query(
    "cost_by_operation",
    f"""{_U} SELECT operation_type AS operation, count(*) AS requests, CAST(sum(total_cost) AS DOUBLE) AS cost_usd
FROM usage GROUP BY operation_type""",
)
def cost_by_operation(spark, sf_dir):
    return op.cost_by_operation(tb.usage(spark, sf_dir))


@query("cost_by_user", f"{_U} SELECT user_id, {_BY} FROM usage GROUP BY user_id")
def cost_by_user(spark, sf_dir):
    return op.cost_by_user(tb.usage(spark, sf_dir))


@query("cost_by_session", f"{_U} SELECT session_id, {_BY} FROM usage GROUP BY session_id")
def cost_by_session(spark, sf_dir):
    return op.cost_by_session(tb.usage(spark, sf_dir))


DAILY_SQL = f"{_U} SELECT strftime(timestamp, '%Y-%m-%d') AS date, {_BY} FROM usage GROUP BY ALL"


@query("daily_costs", DAILY_SQL)
def daily_costs(spark, sf_dir):
    return op.daily_costs(tb.usage(spark, sf_dir)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "last_n_days",
    f"""{_U} SELECT strftime(timestamp, '%Y-%m-%d') AS date, {_BY} FROM usage
WHERE timestamp >= DATE '2024-01-30' - INTERVAL 7 DAY GROUP BY ALL""",
)
def last_n_days(spark, sf_dir):
    recent = op.last_n_days(tb.usage(spark, sf_dir), dt.date(2024, 1, 30), 7)
    return op.daily_costs(recent).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("monthly_costs", f"{_U} SELECT strftime(timestamp, '%Y-%m') AS month, {_BY} FROM usage GROUP BY ALL")
def monthly_costs(spark, sf_dir):
    return op.monthly_costs(tb.usage(spark, sf_dir)).withColumn("month", F.date_format("month", "yyyy-MM"))


@query(
    "cost_rollup",
    f"""{_U}
SELECT 'all' AS level, NULL AS model, NULL AS operation, {_BY} FROM usage
UNION ALL SELECT 'model', model_name, NULL, {_BY} FROM usage GROUP BY model_name
UNION ALL SELECT 'operation', NULL, operation_type, {_BY} FROM usage GROUP BY operation_type""",
)
def cost_rollup(spark, sf_dir):
    return op.cost_rollup(tb.usage(spark, sf_dir))
