"""DuckDB SQL for the correctness oracle, as composable CTEs.

Each entry of `CTES` is (dependencies, body).  `with_ctes(final, *names)`
emits the WITH clause in dependency order.  Conventions mirror the Spark
side: Monday=0 weekday is `isodow(d) - 1`, Python `int()` is
`trunc(x)::INT`, half-to-even rounding is `round_even`, doubles compared
across engines are rounded to 6 dp.
"""

from __future__ import annotations

L, H = 14, 7
FEATURES = ("sales", "price", "promotion", "inventory", "day_of_week", "month", "is_holiday")
W = "PARTITION BY store_id, product_id ORDER BY date"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def r2(expr: str) -> str:
    return f"(floor(({expr}) * 100.0 + 0.5) / 100.0)"


def with_ctes(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + final


def r6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5) / 1e6)"


# ---------------------------------------------------------------- panel
cte("panel", (), """
SELECT date, store_id, product_id, sales,
       (floor(((floor((revenue) * 100.0 + 0.5) / 100.0) / sales) * 1e6 + 0.5) / 1e6) AS price, promotion,
       sales + 10 + ((store_id * 7 + product_id * 13 + dayofyear(date)) % 40) AS inventory,
       (isodow(date) - 1)::INT AS day_of_week, month(date)::INT AS month,
       CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS is_holiday
FROM (
  SELECT n.n_regionkey::INT AS store_id, (l.l_partkey % 20)::INT AS product_id,
         CAST(l.l_shipdate AS DATE) AS date,
         sum(l.l_quantity) AS sales, sum(l.l_extendedprice) AS revenue,
         max(CASE WHEN l.l_discount >= 0.09 THEN 1 ELSE 0 END) AS promotion
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  WHERE l.l_partkey IS NOT NULL AND l.l_shipdate IS NOT NULL
  GROUP BY 1, 2, 3
) t""")

cte("bounds", ("panel",), "SELECT min(date) AS lo, max(date) AS hi FROM panel")
cte("spine", ("bounds",), """
SELECT CAST(d AS DATE) AS date FROM bounds, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS g(d)""")
cte("grid", ("spine", "panel"), """
SELECT k.store_id, k.product_id, s.date
FROM (SELECT DISTINCT store_id, product_id FROM panel) k, spine s""")

# ---------------------------------------------------------------- windows
_x_lists = ",\n       ".join(
    f"list({f}) OVER ({W} ROWS BETWEEN CURRENT ROW AND {L - 1} FOLLOWING) AS x_{f}" for f in FEATURES)
cte("framed", ("panel",), f"""
SELECT store_id, product_id, date AS start_date,
       (row_number() OVER ({W}) - 1)::INT AS pos,
       count(*) OVER (PARTITION BY store_id, product_id) AS n_rows,
       {_x_lists},
       list(sales) OVER ({W} ROWS BETWEEN {L} FOLLOWING AND {L + H - 1} FOLLOWING) AS y,
       list(date) OVER ({W} ROWS BETWEEN {L} FOLLOWING AND {L + H - 1} FOLLOWING) AS y_date
FROM panel""")
cte("windows", ("framed",), f"""
SELECT * EXCLUDE (n_rows) FROM framed
WHERE pos <= n_rows - {L + H} AND len(x_sales) = {L} AND len(y) = {H}""")

# ---------------------------------------------------------------- baselines
SEASON = 7
TEMP = 2.0
FC_EXPR = {
    "seasonal_naive": f"list_transform(range(1, {H + 1}), lambda h: x_sales[{L - SEASON} + ((h - 1) % {SEASON}) + 1])",
    "moving_average": f"list_transform(range({H}), lambda h: list_sum(x_sales) / len(x_sales))",
    "linear_trend": (
        f"list_transform(range(1, {H + 1}), lambda h: list_sum(x_sales) / {L}.0 + "
        f"(list_sum(list_transform(x_sales, lambda v, i: (i - 1 - {(L - 1) / 2}) * v)) / {L * (L * L - 1) / 12}) "
        f"* ({L - 1 - (L - 1) / 2} + h))"),
    "recency_weighted": (
        f"list_transform(range({H}), lambda h: "
        f"list_sum(list_transform(x_sales, lambda v, i: v * exp(tanh({TEMP} * (i - 1) / {L - 1})))) / "
        f"list_sum(list_transform(range({L}), lambda t: exp(tanh({TEMP} * t / {L - 1})))))"),
}
for _m, _e in FC_EXPR.items():
    cte(f"fc_{_m}", ("windows",), f"SELECT *, {_e} AS forecast, '{_m}' AS model FROM windows")
    cte(f"long_{_m}", (f"fc_{_m}",), f"""
SELECT store_id, product_id, pos AS origin_pos, start_date AS origin_date,
       unnest(range(1, {H + 1}))::INT AS horizon, unnest(y_date) AS date,
       unnest(forecast) AS forecast, model
FROM fc_{_m}""")
    cte(f"fr_{_m}", (f"long_{_m}", "panel"), f"""
SELECT f.*, p.sales AS actual_sales, p.price
FROM long_{_m} f JOIN panel p USING (store_id, product_id, date)""")

cte("fr_all", tuple(f"fr_{m}" for m in FC_EXPR), "\nUNION ALL\n".join(
    f"SELECT * FROM fr_{m}" for m in FC_EXPR))

# ---------------------------------------------------------------- series metrics / context
# One forecast per day, straight from the panel: a seasonal-naive forecast of the
# shortest horizon is the sales seven rows earlier, from the 15th row on, in
# series that hold at least one window.
cte("day_fr", ("panel",), f"""
SELECT store_id, product_id, date, price, sales AS actual_sales, week_before AS forecast
FROM (SELECT *, lag(sales, {SEASON}) OVER ({W}) AS week_before, row_number() OVER ({W}) AS n,
             count(*) OVER (PARTITION BY store_id, product_id) AS n_rows FROM panel) t
WHERE n > {L} AND n_rows >= {L + H}""")
cte("metrics", ("day_fr",), f"""
SELECT store_id, product_id, count(*) AS n_days,
       avg(actual_sales) AS avg_sales, avg(forecast) AS avg_forecast,
       1 - avg(abs(forecast - actual_sales)) / avg(actual_sales) AS forecast_accuracy,
       CASE WHEN arg_max(actual_sales, date) > arg_min(actual_sales, date)
            THEN 'increasing' ELSE 'decreasing' END AS trend,
       stddev_samp(actual_sales) AS volatility,
       list(actual_sales ORDER BY date) FILTER (WHERE rk <= 7) AS recent_sales
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rk FROM day_fr) t
GROUP BY store_id, product_id""")


def py_repr(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'NaN' WHEN {x} = floor({x}) AND abs({x}) < 1e15 "
            f"THEN printf('%.1f', {x}) ELSE CAST({x} AS VARCHAR) END)")


def py_int_text(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 9e18 THEN trunc({x})::BIGINT::VARCHAR ELSE printf('%.0f', {x}) END)"


def py_repr_2dp(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'NaN' ELSE "
            f"regexp_replace(printf('%.2f', {x}), '(\\.\\d)0$', '\\1') END)")


cte("ctx0", ("metrics",), """
SELECT store_id, product_id,
       round_even(avg_sales, 2) AS avg_daily_sales,
       round_even(forecast_accuracy * 100, 2) AS forecast_accuracy,
       trend, round_even(volatility, 2) AS volatility, recent_sales,
       avg_sales AS raw_avg_sales, volatility AS raw_volatility
FROM metrics""")
cte("ctx", ("ctx0",), f"""
SELECT *, '{{"store_id": ' || store_id || ', "product_id": ' || product_id ||
       ', "avg_daily_sales": ' || {py_repr_2dp('avg_daily_sales')} ||
       ', "forecast_accuracy": ' || {py_repr_2dp('forecast_accuracy')} ||
       ', "trend": "' || trend || '", "volatility": ' || {py_repr_2dp('volatility')} ||
       ', "recent_sales": [' || array_to_string(list_transform(recent_sales, lambda v: {py_repr('v')}), ', ') ||
       ']}}' AS context_json
FROM ctx0""")


def tint(x: str) -> str:
    return f"trunc({x})::INT"


# Text templates in SQL: the same fixed texts as shelfcast.functions.rules.
def demand_text(avg="avg_daily_sales", acc="forecast_accuracy", vol="volatility") -> str:
    hi = f"({vol} > {avg} * 0.3)"
    return (
        f"'Product ' || product_id || ' at Store ' || store_id || ' shows a ' || "
        f"(CASE WHEN trend = 'increasing' THEN 'upward' ELSE 'downward' END) || "
        f"' trend with average daily sales of ' || {py_repr_2dp(avg)} || ' units.' || chr(10) || chr(10) || "
        f"'Forecast Accuracy: ' || {py_repr_2dp(acc)} || '% - ' || "
        f"(CASE WHEN {acc} > 85 THEN 'Reliable forecasts' ELSE 'Model needs improvement' END) || chr(10) || chr(10) || "
        f"'Procurement Recommendations:' || chr(10) || "
        f"'1. Order Quantity: ' || {tint(f'{avg} * 14')} || ' units for 2-week supply' || chr(10) || "
        f"'2. Safety Stock: ' || {tint(f'{vol} * 2')} || ' units (2x volatility)' || chr(10) || "
        f"'3. Reorder Point: ' || {tint(f'{avg} * 7 + {vol} * 2')} || ' units' || chr(10) || chr(10) || "
        f"'The ' || (CASE WHEN {hi} THEN 'high' ELSE 'moderate' END) || ' volatility suggests ' || "
        f"(CASE WHEN {hi} THEN 'frequent monitoring and dynamic reordering' "
        f"ELSE 'standard inventory management practices' END) || '.'")


def safety_service(vol="volatility") -> str:
    return tint(f"1.65 * {vol} * sqrt(7.0)")


def reorder_service(avg="avg_daily_sales", vol="volatility") -> str:
    return tint(f"{avg} * 7 + {safety_service(vol)}")


def eoq(avg="avg_daily_sales") -> str:
    return tint(f"sqrt(2 * {avg} * 365 * 100 / 5)")


def inventory_text(avg="avg_daily_sales", vol="volatility") -> str:
    return (
        f"'Inventory Optimization for Product ' || product_id || ':' || chr(10) || chr(10) || "
        f"'Safety Stock: ' || {safety_service(vol)} || ' units' || chr(10) || "
        f"'- Calculated for 95% service level with 7-day lead time' || chr(10) || "
        f"'- Protects against demand variability of ' || printf('%.2f', {vol}) || chr(10) || chr(10) || "
        f"'Reorder Point: ' || {reorder_service(avg, vol)} || ' units' || chr(10) || "
        f"'- Triggers when inventory drops to this level' || chr(10) || chr(10) || "
        f"'Economic Order Quantity: ' || {eoq(avg)} || ' units' || chr(10) || "
        f"'- Minimizes total inventory costs' || chr(10) || chr(10) || "
        f"'Current Status: ' || (CASE WHEN {avg} > 30 THEN 'Stock levels adequate' "
        f"ELSE 'Low-volume product, consider JIT approach' END)")


def risk_text(avg="avg_daily_sales", vol="volatility") -> str:
    return (
        f"'Supply Chain Risk Assessment - Product ' || product_id || ':' || chr(10) || chr(10) || "
        f"'HIGH VOLATILITY DETECTED (σ = ' || printf('%.2f', {vol}) || ')' || chr(10) || chr(10) || "
        f"'Key Risks:' || chr(10) || "
        f"'1. Demand Uncertainty: ' || printf('%.1f', {vol} / {avg} * 100) || '% coefficient of variation' || chr(10) || "
        f"'2. Stockout Risk: Elevated due to unpredictable demand patterns' || chr(10) || "
        f"'3. Overstock Risk: Potential for excess inventory during low-demand periods' || chr(10) || chr(10) || "
        f"'Mitigation Strategies:' || chr(10) || "
        f"'- Implement daily demand monitoring' || chr(10) || "
        f"'- Establish flexible supplier agreements' || chr(10) || "
        f"'- Consider safety stock increase to ' || {tint(f'{vol} * 2.5')} || ' units' || chr(10) || "
        f"'- Enable expedited shipping option for emergency replenishment' || chr(10) || chr(10) || "
        f"'Trend: ' || upper(trend) || ' - Adjust base stock levels accordingly.'")


def rule_insight_text(avg: str, trend: str, vol: str) -> str:
    a, t, v = f"coalesce({avg}, 0.0)", f"coalesce({trend}, 'stable')", f"coalesce({vol}, 0.0)"
    hi = f"({v} > {a} * 0.3)"
    return (
        f"'Demand Analysis:' || chr(10) || "
        f"'- Average daily sales: ' || printf('%.2f', {a}) || ' units' || chr(10) || "
        f"'- Trend: ' || {t} || chr(10) || "
        f"'- Volatility: ' || (CASE WHEN {hi} THEN 'High' ELSE 'Moderate' END) || chr(10) || chr(10) || "
        f"'Recommendations:' || chr(10) || "
        f"'- Safety stock: ' || {tint(f'{v} * 2')} || ' units' || chr(10) || "
        f"'- Reorder point: ' || {tint(f'{a} * 7 + {v} * 2')} || ' units' || chr(10) || "
        f"'- Review frequency: ' || (CASE WHEN {hi} THEN 'Daily' ELSE 'Weekly' END) || chr(10)")


cte("examples", ("ctx",), f"""
SELECT store_id, product_id, 1 AS kind,
       'Analyze the demand pattern for this product and provide procurement recommendations.' AS instruction,
       context_json AS input, {demand_text()} AS output, avg_daily_sales, volatility
FROM ctx
UNION ALL
SELECT store_id, product_id, 2 AS kind,
       'Based on the sales data, recommend optimal inventory levels.' AS instruction,
       context_json AS input, {inventory_text()} AS output, avg_daily_sales, volatility
FROM ctx
UNION ALL
SELECT store_id, product_id, 3 AS kind,
       'Identify supply chain risks for this product.' AS instruction,
       context_json AS input, {risk_text()} AS output, avg_daily_sales, volatility
FROM ctx WHERE raw_volatility > raw_avg_sales * 0.3""")
