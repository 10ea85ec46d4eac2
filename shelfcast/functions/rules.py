"""Inventory rules and recommendation text as column expressions.

All rules are projections over one row per series, so they run in the same
codegen stage as the aggregate that feeds them.  Numbers follow Python's
`int()` (truncate) and the text follows Python's float printing, see
`py_repr` / `py_repr_2dp`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.functions.exprs import col_, fixed, trunc_int

# Fixed values of the reference's inventory rules.
LEAD_TIME_DAYS = 7
Z_95 = 1.65
ORDER_COST = 100
HOLDING_COST = 5
VOLATILITY_RATIO = 0.3
RELIABLE_ACCURACY = 85
ADEQUATE_VOLUME = 30
ORDER_DAYS = 14
SAFETY_MULTIPLIER = 2
RISK_SAFETY_MULTIPLIER = 2.5
INTERVAL_Z = 1.96


def py_repr(c: str | Column) -> Column:
    """Python `repr(float)` for the magnitudes that occur here: integral values
    print with one decimal ('123.0'), others use the shortest round-trip text."""
    x = col_(c)
    return (F.when(x.isNull(), F.lit("NaN"))
            .when((x == F.floor(x)) & (F.abs(x) < F.lit(1e15)), F.format_string("%.1f", x))
            .otherwise(x.cast("string")))


def py_int_text(c: str | Column) -> Column:
    """Python `str(int(x))` for a double: truncation, and no overflow for
    values beyond the BIGINT range (they are integral already)."""
    x = col_(c)
    return (F.when(F.abs(x) < F.lit(9e18), x.cast("bigint").cast("string"))
            .otherwise(F.format_string("%.0f", x)))


def py_repr_2dp(c: str | Column) -> Column:
    """Python `repr` of a value already rounded to 2 decimals: '45.2', '45.0', '45.05'."""
    x = col_(c)
    return F.when(x.isNull(), F.lit("NaN")).otherwise(
        F.regexp_replace(F.format_string("%.2f", x), r"(\.\d)0$", "$1"))


def order_quantity(avg: Column) -> Column:
    return trunc_int(avg * ORDER_DAYS)


def safety_stock_simple(vol: Column) -> Column:
    return trunc_int(vol * SAFETY_MULTIPLIER)


def reorder_point_simple(avg: Column, vol: Column) -> Column:
    return trunc_int(avg * LEAD_TIME_DAYS + vol * SAFETY_MULTIPLIER)


def safety_stock_service(vol: Column) -> Column:
    # Evaluated left to right as in the reference: (z * vol) * sqrt(lead time).
    return trunc_int(F.lit(Z_95) * vol * F.sqrt(F.lit(float(LEAD_TIME_DAYS))))


def reorder_point_service(avg: Column, vol: Column) -> Column:
    return trunc_int(avg * LEAD_TIME_DAYS + safety_stock_service(vol))


def economic_order_quantity(avg: Column) -> Column:
    return trunc_int(F.sqrt(F.lit(2) * avg * 365 * ORDER_COST / HOLDING_COST))


def is_volatile(avg: Column, vol: Column, ratio: float = VOLATILITY_RATIO) -> Column:
    return vol > avg * ratio


def risk_safety_stock(vol: Column) -> Column:
    return trunc_int(vol * RISK_SAFETY_MULTIPLIER)


# Recommendation text of the reference, placeholders in braces.
DEMAND_ANALYSIS_TEMPLATE = (
    "Product {product_id} at Store {store_id} shows a {trend_desc} trend with average daily sales of {avg} units.\n"
    "\n"
    "Forecast Accuracy: {accuracy}% - {accuracy_grade}\n"
    "\n"
    "Procurement Recommendations:\n"
    "1. Order Quantity: {order_qty} units for 2-week supply\n"
    "2. Safety Stock: {safety} units (2x volatility)\n"
    "3. Reorder Point: {reorder} units\n"
    "\n"
    "The {vol_class} volatility suggests {vol_advice}."
)
INVENTORY_TEMPLATE = (
    "Inventory Optimization for Product {product_id}:\n"
    "\n"
    "Safety Stock: {safety} units\n"
    "- Calculated for 95% service level with 7-day lead time\n"
    "- Protects against demand variability of {vol_2f}\n"
    "\n"
    "Reorder Point: {reorder} units\n"
    "- Triggers when inventory drops to this level\n"
    "\n"
    "Economic Order Quantity: {eoq} units\n"
    "- Minimizes total inventory costs\n"
    "\n"
    "Current Status: {stock_status}"
)
RISK_TEMPLATE = (
    "Supply Chain Risk Assessment - Product {product_id}:\n"
    "\n"
    "HIGH VOLATILITY DETECTED (σ = {vol_2f})\n"
    "\n"
    "Key Risks:\n"
    "1. Demand Uncertainty: {cv_1f}% coefficient of variation\n"
    "2. Stockout Risk: Elevated due to unpredictable demand patterns\n"
    "3. Overstock Risk: Potential for excess inventory during low-demand periods\n"
    "\n"
    "Mitigation Strategies:\n"
    "- Implement daily demand monitoring\n"
    "- Establish flexible supplier agreements\n"
    "- Consider safety stock increase to {raised_stock} units\n"
    "- Enable expedited shipping option for emergency replenishment\n"
    "\n"
    "Trend: {trend_upper} - Adjust base stock levels accordingly."
)
RULE_INSIGHT_TEMPLATE = (
    "Demand Analysis:\n"
    "- Average daily sales: {avg_2f} units\n"
    "- Trend: {trend}\n"
    "- Volatility: {vol_level}\n"
    "\n"
    "Recommendations:\n"
    "- Safety stock: {safety} units\n"
    "- Reorder point: {reorder} units\n"
    "- Review frequency: {review}\n"
)
# Branch texts.
TREND_UP, TREND_DOWN = "upward", "downward"
RELIABLE, NEEDS_WORK = "Reliable forecasts", "Model needs improvement"
VOL_HIGH, VOL_MODERATE = "high", "moderate"
ADVICE_HIGH = "frequent monitoring and dynamic reordering"
ADVICE_MODERATE = "standard inventory management practices"
STOCK_OK = "Stock levels adequate"
STOCK_JIT = "Low-volume product, consider JIT approach"
INSIGHT_HIGH, INSIGHT_MODERATE = "High", "Moderate"
REVIEW_DAILY, REVIEW_WEEKLY = "Daily", "Weekly"


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Concatenate literal pieces and column values of a `{name}` template."""
    import re
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def demand_analysis_text(store: Column, product: Column, avg: Column, accuracy: Column,
                         trend: Column, vol: Column) -> Column:
    """Inputs are the context values (already rounded to 2 dp)."""
    hi = is_volatile(avg, vol)
    return fill_template(DEMAND_ANALYSIS_TEMPLATE, {
        "product_id": product, "store_id": store,
        "trend_desc": F.when(trend == "increasing", F.lit(TREND_UP)).otherwise(F.lit(TREND_DOWN)),
        "avg": py_repr_2dp(avg), "accuracy": py_repr_2dp(accuracy),
        "accuracy_grade": F.when(accuracy > RELIABLE_ACCURACY, F.lit(RELIABLE)).otherwise(F.lit(NEEDS_WORK)),
        "order_qty": order_quantity(avg), "safety": safety_stock_simple(vol),
        "reorder": reorder_point_simple(avg, vol),
        "vol_class": F.when(hi, F.lit(VOL_HIGH)).otherwise(F.lit(VOL_MODERATE)),
        "vol_advice": F.when(hi, F.lit(ADVICE_HIGH)).otherwise(F.lit(ADVICE_MODERATE)),
    })


def inventory_text(product: Column, avg: Column, vol: Column) -> Column:
    return fill_template(INVENTORY_TEMPLATE, {
        "product_id": product, "safety": safety_stock_service(vol),
        "vol_2f": fixed(vol, 2),
        "reorder": reorder_point_service(avg, vol), "eoq": economic_order_quantity(avg),
        "stock_status": F.when(avg > ADEQUATE_VOLUME, F.lit(STOCK_OK)).otherwise(F.lit(STOCK_JIT)),
    })


def coefficient_of_variation_pct(avg: Column, vol: Column) -> Column:
    return F.try_divide(vol, avg) * 100


def risk_text(product: Column, avg: Column, vol: Column, trend: Column) -> Column:
    return fill_template(RISK_TEMPLATE, {
        "product_id": product, "vol_2f": fixed(vol, 2),
        "cv_1f": fixed(coefficient_of_variation_pct(avg, vol), 1),
        "raised_stock": risk_safety_stock(vol), "trend_upper": F.upper(trend),
    })


def rule_insight_text(avg: Column, trend: Column, vol: Column) -> Column:
    """Fallback insight for a request context; missing fields default to
    0 / 'stable' / 0 and the figures use the unrounded inputs."""
    a = F.coalesce(avg.cast("double"), F.lit(0.0))
    t = F.coalesce(trend, F.lit("stable"))
    v = F.coalesce(vol.cast("double"), F.lit(0.0))
    hi = is_volatile(a, v)
    return fill_template(RULE_INSIGHT_TEMPLATE, {
        "avg_2f": fixed(a, 2), "trend": t,
        "vol_level": F.when(hi, F.lit(INSIGHT_HIGH)).otherwise(F.lit(INSIGHT_MODERATE)),
        # Clients send any number: texts, so that none is too large.
        "safety": py_int_text(v * SAFETY_MULTIPLIER), "reorder": py_int_text(a * LEAD_TIME_DAYS + v * SAFETY_MULTIPLIER),
        "review": F.when(hi, F.lit(REVIEW_DAILY)).otherwise(F.lit(REVIEW_WEEKLY)),
    })


def prediction_intervals(forecast: Column, sigma: Column, z: float = INTERVAL_Z) -> Column:
    """array<struct<day, lower, upper>>: lower clamps at 0, width is the same every day."""
    return F.transform(forecast, lambda f, i: F.struct(
        (i + 1).alias("day"),
        F.greatest(F.lit(0.0), f - F.lit(z) * sigma).alias("lower"),
        (f + F.lit(z) * sigma).alias("upper")))
