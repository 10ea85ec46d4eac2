"""The inventory rules and the rule-based insight as SQL functions, so SQL
users can call them (`SELECT rule_insight(avg_sales, trend, volatility) ...`).
They are SQL-bodied temporary functions: Catalyst inlines them like any
built-in expression, so no Python runs per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfcast.functions import rules as R

_HI = f"(coalesce(volatility, 0D) > coalesce(avg_sales, 0D) * {R.VOLATILITY_RATIO})"

FUNCTIONS = {
    "safety_stock": (
        "volatility DOUBLE", "INT", f"CAST(volatility * {R.SAFETY_MULTIPLIER} AS INT)"),
    "reorder_point": (
        "avg_sales DOUBLE, volatility DOUBLE", "INT",
        f"CAST(avg_sales * {R.LEAD_TIME_DAYS} + volatility * {R.SAFETY_MULTIPLIER} AS INT)"),
    "safety_stock_95": (
        "volatility DOUBLE", "INT", f"CAST({R.Z_95}D * volatility * sqrt({float(R.LEAD_TIME_DAYS)}D) AS INT)"),
    "economic_order_quantity": (
        "avg_sales DOUBLE", "INT",
        f"CAST(sqrt(2 * avg_sales * 365 * {R.ORDER_COST} / {R.HOLDING_COST}) AS INT)"),
    "rule_insight": (
        "avg_sales DOUBLE, trend STRING, volatility DOUBLE", "STRING",
        "concat('Demand Analysis:\\n- Average daily sales: ', "
        "format_string('%.2f', bround(coalesce(avg_sales, 0D), 2)), ' units\\n- Trend: ', "
        "coalesce(trend, 'stable'), '\\n- Volatility: ', "
        f"CASE WHEN {_HI} THEN '{R.INSIGHT_HIGH}' ELSE '{R.INSIGHT_MODERATE}' END, "
        "'\\n\\nRecommendations:\\n- Safety stock: ', "
        f"CAST(CAST(coalesce(volatility, 0D) * {R.SAFETY_MULTIPLIER} AS INT) AS STRING), "
        "' units\\n- Reorder point: ', "
        f"CAST(CAST(coalesce(avg_sales, 0D) * {R.LEAD_TIME_DAYS} + coalesce(volatility, 0D) * "
        f"{R.SAFETY_MULTIPLIER} AS INT) AS STRING), "
        "' units\\n- Review frequency: ', "
        f"CASE WHEN {_HI} THEN '{R.REVIEW_DAILY}' ELSE '{R.REVIEW_WEEKLY}' END, '\\n')"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (params, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
