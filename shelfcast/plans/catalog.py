"""Registered queries: each reads the given tables (or DataFrames Spark
derives from them) over their whole extent, and pairs with DuckDB SQL when
the result is expressible there."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.exprs import r6
from shelfcast.operators import forecasts as fc
from shelfcast.operators import insights as ins
from shelfcast.operators import panel as pn
from shelfcast.operators import windows as wn
from shelfcast.plans import sql as S
from shelfcast.plans.registry import register
from shelfcast.sources.tables import read_table

PANEL_COLS = "date, store_id, product_id, sales, price, promotion, inventory, day_of_week, month, is_holiday"


def _panel(spark, d):
    return pn.load_panel(spark, d)


# ---------------------------------------------------------------- panel & calendar

register("demand_panel", S.with_ctes(f"SELECT {PANEL_COLS} FROM panel", "panel"))(
    lambda spark, d: _panel(spark, d))


@register("calendar_features", """
SELECT date, (isodow(date) - 1)::INT AS day_of_week, month(date)::INT AS month,
       dayofyear(date)::INT AS day_of_year,
       CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS is_holiday
FROM (SELECT DISTINCT CAST(CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS DATE) AS date
      FROM lineitem WHERE l_shipdate IS NOT NULL) t""")
def _calendar(spark, d):
    # Dates arrive as text (the reference's CSV) and are parsed with to_date.
    days = (read_table(spark, d, "lineitem").where(F.col("l_shipdate").isNotNull())
            .select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_text")).distinct()
            .select(F.to_date("date_text", "yyyy-MM-dd").alias("date")))
    return pn.calendar_features(days).withColumn("day_of_year", F.dayofyear("date")).select(
        "date", "day_of_week", "month", "day_of_year", "is_holiday")


register("date_spine", S.with_ctes("SELECT date FROM spine", "spine"))(
    lambda spark, d: pn.date_spine(_panel(spark, d)))

register("dense_panel", S.with_ctes("""
SELECT g.date, g.store_id, g.product_id, coalesce(p.sales, 0.0) AS sales, p.price,
       coalesce(p.promotion, 0) AS promotion, coalesce(p.inventory, p.sales, 0.0) AS inventory,
       CASE WHEN p.sales IS NULL THEN 1 ELSE 0 END AS imputed,
       (isodow(g.date) - 1)::INT AS day_of_week, month(g.date)::INT AS month,
       CASE WHEN isodow(g.date) - 1 >= 5 THEN 1 ELSE 0 END AS is_holiday
FROM grid g LEFT JOIN panel p USING (store_id, product_id, date)""", "grid", "panel"))(
    lambda spark, d: pn.dense_panel(_panel(spark, d)))

register("missing_days", S.with_ctes("""
SELECT g.store_id, g.product_id, g.date FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.store_id = g.store_id
                  AND p.product_id = g.product_id AND p.date = g.date)""", "grid", "panel"))(
    lambda spark, d: pn.missing_days(_panel(spark, d)).select("store_id", "product_id", "date"))

register("seasonal_term", S.with_ctes("""
SELECT date, dayofyear(date)::INT AS day_of_year,
       (floor((20.0 * sin(2 * pi() * dayofyear(date) / 365.0)) * 1e6 + 0.5) / 1e6) AS seasonal_sin,
       (floor((20.0 * cos(2 * pi() * dayofyear(date) / 365.0)) * 1e6 + 0.5) / 1e6) AS seasonal_cos
FROM (SELECT DISTINCT date FROM panel) t""", "panel"))(
    lambda spark, d: pn.seasonal_term(_panel(spark, d)))

# ---------------------------------------------------------------- EDA

register("daily_sales", S.with_ctes(
    "SELECT date, sum(sales) AS total_sales, count(*) AS n_series FROM panel GROUP BY date", "panel"))(
    lambda spark, d: pn.daily_sales(_panel(spark, d)))

register("weekday_profile", S.with_ctes(
    "SELECT day_of_week, (floor((avg(sales)) * 1e6 + 0.5) / 1e6) AS avg_sales, count(*) AS n_rows FROM panel GROUP BY day_of_week",
    "panel"))(lambda spark, d: pn.weekday_profile(_panel(spark, d)))

register("avg_daily_demand", S.with_ctes("""
SELECT NULL::INT AS store_id, NULL::INT AS product_id, (floor((avg(total)) * 1e6 + 0.5) / 1e6) AS avg_daily_demand,
       count(*) AS n_days
FROM (SELECT date, sum(sales) AS total FROM panel GROUP BY date) t
UNION ALL
SELECT store_id, product_id, (floor((avg(sales)) * 1e6 + 0.5) / 1e6), count(*) FROM panel GROUP BY store_id, product_id""",
    "panel"))(lambda spark, d: pn.avg_daily_demand(_panel(spark, d)))

register("seasonality_rollup", S.with_ctes("""
SELECT month, day_of_week, level, n_rows, (floor((avg_sales) * 1e6 + 0.5) / 1e6) AS avg_sales,
       (floor((avg_sales / (SELECT avg(sales) FROM panel)) * 1e6 + 0.5) / 1e6) AS seasonal_index
FROM (SELECT month, day_of_week, grouping_id(month, day_of_week) AS level, count(*) AS n_rows,
             avg(sales) AS avg_sales
      FROM panel GROUP BY ROLLUP (month, day_of_week)) t""", "panel"))(
    lambda spark, d: pn.seasonality_rollup(_panel(spark, d)))

_PRODUCT_CV = """
SELECT product_id, avg(sales) AS avg_sales, stddev_samp(sales) AS std_sales, count(*) AS n_rows,
       stddev_samp(sales) / avg(sales) AS cv
FROM panel GROUP BY product_id"""
register("volatile_products", S.with_ctes(f"""
SELECT product_id, (floor((avg_sales) * 1e6 + 0.5) / 1e6) AS avg_sales, (floor((std_sales) * 1e6 + 0.5) / 1e6) AS std_sales,
       (floor((cv) * 1e6 + 0.5) / 1e6) AS cv, n_rows
FROM ({_PRODUCT_CV}) t ORDER BY cv DESC, product_id LIMIT 5""", "panel"))(
    lambda spark, d: pn.volatile_products(_panel(spark, d)))

register("volatility_rank", S.with_ctes("""
SELECT store_id, product_id, cv,
       (rank() OVER (ORDER BY cv DESC))::INT AS cv_rank,
       (dense_rank() OVER (ORDER BY cv DESC))::INT AS cv_dense_rank,
       (floor((percent_rank() OVER (ORDER BY cv DESC)) * 1e6 + 0.5) / 1e6) AS cv_percent_rank
FROM (SELECT store_id, product_id, (floor((stddev_samp(sales) / avg(sales)) * 1e6 + 0.5) / 1e6) AS cv
      FROM panel GROUP BY store_id, product_id) t""", "panel"))(
    lambda spark, d: pn.volatility_rank(_panel(spark, d)))

register("promo_uplift", S.with_ctes("""
SELECT product_id, count_if(promotion = 1)::BIGINT AS n_promo, count_if(promotion = 0)::BIGINT AS n_base,
       (floor((avg(sales) FILTER (WHERE promotion = 1)) * 1e6 + 0.5) / 1e6) AS avg_promo,
       (floor((avg(sales) FILTER (WHERE promotion = 0)) * 1e6 + 0.5) / 1e6) AS avg_base,
       (floor((avg(sales) FILTER (WHERE promotion = 1) - avg(sales) FILTER (WHERE promotion = 0)) * 1e6 + 0.5) / 1e6) AS uplift,
       (floor(((avg(sales) FILTER (WHERE promotion = 1) - avg(sales) FILTER (WHERE promotion = 0))
             / avg(sales) FILTER (WHERE promotion = 0) * 100) * 1e6 + 0.5) / 1e6) AS uplift_pct
FROM panel GROUP BY product_id""", "panel"))(lambda spark, d: pn.promo_uplift(_panel(spark, d)))

register("describe_panel", S.with_ctes("\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, (floor((avg({c}::DOUBLE)) * 1e6 + 0.5) / 1e6) AS mean,
       (floor((stddev_samp({c}::DOUBLE)) * 1e6 + 0.5) / 1e6) AS std, (floor((min({c}::DOUBLE)) * 1e6 + 0.5) / 1e6) AS min,
       (floor((quantile_cont({c}::DOUBLE, 0.25)) * 1e6 + 0.5) / 1e6) AS p25, (floor((quantile_cont({c}::DOUBLE, 0.5)) * 1e6 + 0.5) / 1e6) AS p50,
       (floor((quantile_cont({c}::DOUBLE, 0.75)) * 1e6 + 0.5) / 1e6) AS p75, (floor((max({c}::DOUBLE)) * 1e6 + 0.5) / 1e6) AS max
FROM panel""" for c in pn.NUMERIC_COLUMNS), "panel"))(lambda spark, d: pn.describe_panel(_panel(spark, d)))

_PANEL_TYPES = dict(date="date", store_id="int", product_id="int", sales="double", price="double",
                    promotion="int", inventory="double", day_of_week="int", month="int", is_holiday="int")
register("quality_profile", S.with_ctes("\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count_if({c} IS NULL)::BIGINT AS nulls,
       count(DISTINCT {c}) AS distinct_values FROM panel""" for c, t in _PANEL_TYPES.items()), "panel"))(
    lambda spark, d: pn.quality_profile(_panel(spark, d)))

# ---------------------------------------------------------------- windows

_X_COLS = ", ".join(f"list_transform(x_{f}, lambda v: (floor((v) * 1e6 + 0.5) / 1e6)) AS x_{f}" if f == "price" else f"x_{f}"
                    for f in S.FEATURES)


# Sketches of each store and month, merged to stores and held against exact figures.
register("sketch_rollup", S.with_ctes("""
SELECT store_id, probability, count(*) AS n, true AS rank_ok, true AS distinct_ok
FROM panel, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS probability) GROUP BY store_id, probability""", "panel"))(
    lambda spark, d: _sketch_rollup(spark, d))


def _sketch_rollup(spark, d):
    from shelfcast.operators import sketches as sk
    from shelfcast.session import materialize
    panel = materialize(_panel(spark, d), "panel")
    return sk.sketch_check(panel, materialize(sk.sketch_table(panel), "sketches"))


@register("sliding_windows", S.with_ctes(
    f"SELECT store_id, product_id, pos, start_date, {_X_COLS}, y FROM windows", "windows"))
def _sliding(spark, d):
    w = wn.sliding_windows(_panel(spark, d))
    return w.select("store_id", "product_id", "pos", "start_date",
                    *[f"x_{f}" for f in pn.FEATURES], "y")


register("window_stats", S.with_ctes("""
SELECT count(*) AS n_series, sum(n_rows)::BIGINT AS n_rows, sum(n_windows)::BIGINT AS n_windows,
       count_if(n_windows = 0)::BIGINT AS series_without_windows, min(n_rows) AS min_series_rows,
       max(n_rows) AS max_series_rows, 14 AS lookback, 7 AS horizon, 7 AS n_features
FROM (SELECT store_id, product_id, count(*) AS n_rows, greatest(0, count(*) - 20) AS n_windows
      FROM panel GROUP BY ALL) t""", "panel"))(lambda spark, d: wn.window_stats(_panel(spark, d)))

register("latest_window", S.with_ctes(f"""
SELECT store_id, product_id, min(date) AS first_date, max(date) AS last_date, count(*)::INT AS n_days,
       {", ".join(f"list({f} ORDER BY date) AS x_{f}" for f in S.FEATURES)}
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rk FROM panel) t
WHERE rk <= 14 GROUP BY store_id, product_id""", "panel"))(
    lambda spark, d: wn.latest_window(_panel(spark, d)))

# ---------------------------------------------------------------- baselines


def _baseline_query(model):
    def q(spark, d):
        w = wn.sliding_windows(_panel(spark, d))
        out = fc.rounded_forecast(fc.baseline_forecast(w, model))
        return out.select("store_id", "product_id", "pos", "start_date", "forecast", "y")
    return q


for _m in fc.BASELINES:
    register(_m, S.with_ctes(
        f"SELECT store_id, product_id, pos, start_date, list_transform(forecast, lambda v: (floor((v) * 1e6 + 0.5) / 1e6)) AS forecast, y "
        f"FROM fc_{_m}", f"fc_{_m}"))(_baseline_query(_m))


@register("forecast_results", S.with_ctes("""
SELECT store_id, product_id, origin_date, horizon, date, model, actual_sales, (floor((forecast) * 1e6 + 0.5) / 1e6) AS forecast
FROM fr_seasonal_naive""", "fr_seasonal_naive"))
def _forecast_results(spark, d):
    # The registered query takes the join path (forecast rows joined back to
    # the panel); the metric queries use the join-free path.
    from shelfcast.session import materialize
    fr = fc.forecast_results(materialize(_panel(spark, d), "panel"), join_actuals=True)  # both sides read one panel
    return fr.select("store_id", "product_id", "origin_date", "horizon", "date", "model",
                     "actual_sales", r6("forecast").alias("forecast"))


# ---------------------------------------------------------------- series context & rules

def _metrics(spark, d):
    return ins.series_metrics(fc.daily_forecasts(_panel(spark, d)), daily=True)


def _ctx(spark, d):
    return ins.series_context(_metrics(spark, d))


@register("series_metrics", S.with_ctes("""
SELECT store_id, product_id, n_days, (floor((avg_sales) * 1e6 + 0.5) / 1e6) AS avg_sales, (floor((avg_forecast) * 1e6 + 0.5) / 1e6) AS avg_forecast,
       (floor((forecast_accuracy) * 1e6 + 0.5) / 1e6) AS forecast_accuracy, trend, (floor((volatility) * 1e6 + 0.5) / 1e6) AS volatility, recent_sales
FROM metrics""", "metrics"))
def _series_metrics(spark, d):
    return _metrics_out(_metrics(spark, d))


def _metrics_out(m):
    return m.select("store_id", "product_id", "n_days", *[r6(c).alias(c) for c in (
        "avg_sales", "avg_forecast", "forecast_accuracy")], "trend", r6("volatility").alias("volatility"),
        "recent_sales")


register("series_context", S.with_ctes("""
SELECT store_id, product_id, avg_daily_sales, forecast_accuracy, trend, volatility, recent_sales, context_json
FROM ctx""", "ctx"))(lambda spark, d: _ctx(spark, d).select(
    "store_id", "product_id", "avg_daily_sales", "forecast_accuracy", "trend", "volatility",
    "recent_sales", "context_json"))

register("demand_analysis", S.with_ctes(f"""
SELECT store_id, product_id, avg_daily_sales, forecast_accuracy, volatility,
       {S.tint('avg_daily_sales * 14')} AS order_quantity, {S.tint('volatility * 2')} AS safety_stock,
       {S.tint('avg_daily_sales * 7 + volatility * 2')} AS reorder_point,
       CASE WHEN forecast_accuracy > 85 THEN 'Reliable forecasts' ELSE 'Model needs improvement' END
         AS accuracy_grade,
       CASE WHEN volatility > avg_daily_sales * 0.3 THEN 'high' ELSE 'moderate' END AS volatility_class,
       {S.demand_text()} AS text
FROM ctx""", "ctx"))(lambda spark, d: ins.demand_analysis(_ctx(spark, d)))

register("inventory_recommendation", S.with_ctes(f"""
SELECT store_id, product_id, avg_daily_sales, volatility,
       {S.safety_service()} AS safety_stock, {S.reorder_service()} AS reorder_point,
       {S.eoq()} AS economic_order_quantity,
       CASE WHEN avg_daily_sales > 30 THEN 'Stock levels adequate'
            ELSE 'Low-volume product, consider JIT approach' END AS stock_status,
       {S.inventory_text()} AS text
FROM ctx""", "ctx"))(lambda spark, d: ins.inventory_recommendation(_ctx(spark, d)))

register("risk_filter", S.with_ctes("""
SELECT store_id, product_id, (floor((raw_avg_sales) * 1e6 + 0.5) / 1e6) AS avg_sales, (floor((raw_volatility) * 1e6 + 0.5) / 1e6) AS volatility,
       (floor((raw_volatility / raw_avg_sales * 100) * 1e6 + 0.5) / 1e6) AS cv_pct
FROM ctx WHERE raw_volatility > raw_avg_sales * 0.3""", "ctx"))(
    lambda spark, d: ins.risk_filter(_ctx(spark, d)))

register("risk_filter_high", S.with_ctes("""
SELECT store_id, product_id, (floor((raw_avg_sales) * 1e6 + 0.5) / 1e6) AS avg_sales, (floor((raw_volatility) * 1e6 + 0.5) / 1e6) AS volatility,
       (floor((raw_volatility / raw_avg_sales * 100) * 1e6 + 0.5) / 1e6) AS cv_pct
FROM ctx WHERE raw_volatility > raw_avg_sales * 0.62""", "ctx"))(
    lambda spark, d: ins.risk_filter(_ctx(spark, d), 0.62))

register("risk_assessment", S.with_ctes(f"""
SELECT store_id, product_id, avg_daily_sales, volatility,
       (floor((volatility / avg_daily_sales * 100) * 1e6 + 0.5) / 1e6) AS cv_pct,
       {S.tint('volatility * 2.5')} AS raised_safety_stock, {S.risk_text()} AS text
FROM ctx WHERE raw_volatility > raw_avg_sales * 0.3""", "ctx"))(
    lambda spark, d: ins.risk_assessment(_ctx(spark, d)))

register("instruction_examples", S.with_ctes(
    "SELECT store_id, product_id, kind, instruction, input, output FROM examples", "examples"))(
    lambda spark, d: ins.instruction_examples(_ctx(spark, d)))

register("instruction_text", S.with_ctes("""
SELECT store_id, product_id, kind,
       '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input
       || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text
FROM examples""", "examples"))(
    lambda spark, d: _through_json(ins.instruction_text(ins.instruction_examples(_ctx(spark, d))), "instructions"))

register("instruction_counts", S.with_ctes(
    "SELECT kind, instruction, count(*) AS n_examples FROM examples GROUP BY kind, instruction", "examples"))(
    lambda spark, d: ins.instruction_counts(ins.instruction_examples(_ctx(spark, d))))

register("knowledge_base", S.with_ctes("""
SELECT store_id, product_id, (floor((avg_sales) * 1e6 + 0.5) / 1e6) AS avg_sales, (floor((avg_forecast) * 1e6 + 0.5) / 1e6) AS avg_forecast,
       trend, 'increasing' AS reference_trend
FROM metrics""", "metrics"))(lambda spark, d: ins.knowledge_base(_metrics(spark, d)).select(
    "store_id", "product_id", r6("avg_sales").alias("avg_sales"), r6("avg_forecast").alias("avg_forecast"),
    "trend", F.lit("increasing").alias("reference_trend")))

register("kb_text", S.with_ctes(f"""
SELECT store_id, product_id,
       'Product ' || product_id || ' at Store ' || store_id || ': Average sales ' || {S.py_repr('avg_sales')}
       || ', trend ' || trend AS text
FROM metrics""", "metrics"))(lambda spark, d: ins.kb_text(ins.knowledge_base(_metrics(spark, d))))


# ---------------------------------------------------------------- metrics & model comparison
from shelfcast.operators import metrics as mt  # noqa: E402
from shelfcast.operators import scaling as sc  # noqa: E402
from shelfcast.operators import splits as sp  # noqa: E402

R6 = S.r6


def _err_sql(a="actual_sales", p="forecast"):
    return (f"count(*) AS n, {R6(f'avg(pow({p} - {a}, 2))')} AS mse, {R6(f'avg(abs({p} - {a}))')} AS mae, "
            f"{R6(f'avg(abs(({a} - {p}) / ({a} + 1e-8))) * 100')} AS mape, "
            f"{R6(f'avg(CASE WHEN {a} <> 0 THEN abs(({a} - {p}) / {a}) END) * 100')} AS mape_nonzero, "
            f"{R6(f'sqrt(avg(pow({p} - {a}, 2)))')} AS rmse, {R6(f'avg({a} - {p})')} AS bias")


def _fr(spark, d, models=("seasonal_naive",)):
    return fc.forecast_results(_panel(spark, d), models)


register("forecast_metrics", S.with_ctes(
    f"SELECT model, {_err_sql()} FROM fr_seasonal_naive GROUP BY model", "fr_seasonal_naive"))(
    lambda spark, d: mt.forecast_metrics(_fr(spark, d)))

register("forecast_metrics_sets", S.with_ctes(f"""
SELECT model, grouping_id(model, horizon, store_id, product_id) AS level, horizon, store_id, product_id,
       {_err_sql()}
FROM fr_seasonal_naive
GROUP BY GROUPING SETS ((model), (model, horizon), (model, store_id), (model, store_id, product_id))""",
    "fr_seasonal_naive"))(lambda spark, d: mt.forecast_metrics_sets(_fr(spark, d)))

register("model_comparison", S.with_ctes(f"""
SELECT *, mape < 15.0 AS meets_target FROM (SELECT model, {_err_sql()} FROM fr_all GROUP BY model) t""",
    "fr_all"))(lambda spark, d: mt.model_comparison(mt.window_metrics(wn.sliding_windows(_panel(spark, d)), fc.BASELINES)))

register("direction_accuracy", S.with_ctes(f"""
SELECT store_id, product_id, count(*) AS n_pairs,
       {R6('avg(CASE WHEN da = dp THEN 1.0 ELSE 0.0 END)')} AS direction_accuracy
FROM (SELECT store_id, product_id,
             sign(actual_sales - lag(actual_sales) OVER w) AS da, sign(forecast - lag(forecast) OVER w) AS dp
      FROM day_fr WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date)) t
WHERE da IS NOT NULL GROUP BY store_id, product_id""", "day_fr"))(
    lambda spark, d: mt.direction_accuracy(_fr(spark, d)))

_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in fc.BASELINES) + "]"
register("model_selection", S.with_ctes(f"""
SELECT store_id, product_id, best_model, best_mse, n_models FROM (
  SELECT store_id, product_id, model AS best_model, {R6('mse')} AS best_mse,
         count(*) OVER (PARTITION BY store_id, product_id) AS n_models,
         row_number() OVER (PARTITION BY store_id, product_id
                            ORDER BY {R6('mse')}, list_position({_MODEL_LIST}, model)) AS rn
  FROM (SELECT store_id, product_id, model, avg(pow(forecast - actual_sales, 2)) AS mse
        FROM fr_all GROUP BY store_id, product_id, model) t) u
WHERE rn = 1""", "fr_all"))(lambda spark, d: mt.model_selection(_fr(spark, d, fc.BASELINES)))



def _costs_sql(demand, supply, src):
    return S.with_ctes(f"""
SELECT store_id, product_id, count(*) AS n_days,
       {R6(f'sum(greatest({supply} - {demand}, 0.0))')} AS excess_units,
       {R6(f'sum(greatest({demand} - {supply}, 0.0))')} AS short_units,
       {S.r2(f'sum(greatest({supply} - {demand}, 0.0) * price * 0.2)')} AS holding_cost,
       {S.r2(f'sum(greatest({demand} - {supply}, 0.0) * price * 0.25)')} AS stockout_cost,
       {R6(f'avg(CASE WHEN {demand} <= {supply} THEN 1.0 ELSE 0.0 END)')} AS service_level
FROM {src} GROUP BY store_id, product_id""", src)


register("inventory_costs", _costs_sql("sales", "inventory", "panel"))(
    lambda spark, d: mt.inventory_costs(_panel(spark, d)))
register("forecast_costs", _costs_sql("actual_sales", "forecast", "day_fr"))(
    lambda spark, d: mt.forecast_costs(_fr(spark, d)))

# ---------------------------------------------------------------- splits

register("hash_split", S.with_ctes("""
SELECT store_id, product_id, pos, bucket, CASE WHEN bucket < 20 THEN 'test' ELSE 'train' END AS split
FROM (SELECT store_id, product_id, pos,
             ((('0x' || substr(md5(concat_ws('~', '42', store_id::VARCHAR, product_id::VARCHAR, pos::VARCHAR)),
                              1, 8))::BIGINT) % 100)::INT AS bucket
      FROM windows) t""", "windows"))(
    lambda spark, d: sp.hash_split(wn.sliding_windows(_panel(spark, d))).select(
        "store_id", "product_id", "pos", "bucket", "split"))


@register("time_split", S.with_ctes("""
SELECT store_id, product_id, pos, split FROM (
  SELECT w.store_id, w.product_id, w.pos,
         CASE WHEN w.y_date[len(w.y_date)] < c.cutoff THEN 'train'
              WHEN w.start_date >= c.cutoff THEN 'test' END AS split
  FROM windows w, (SELECT lo + CAST(floor(datediff('day', lo, hi) * 0.8) AS INT) AS cutoff FROM bounds) c) t
WHERE split IS NOT NULL""", "windows", "bounds"))
def _time_split(spark, d):
    panel = _panel(spark, d)
    out = sp.time_split(wn.sliding_windows(panel, with_dates=True), sp.cutoff_date(panel))
    return out.select("store_id", "product_id", "pos", "split")


# ---------------------------------------------------------------- scalers

S.cte("wts", ("panel",), f"""
SELECT *, sum(is_start) OVER (PARTITION BY store_id, product_id ORDER BY date
                              ROWS BETWEEN {S.L - 1} PRECEDING AND CURRENT ROW) AS weight
FROM (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY store_id, product_id ORDER BY date) - 1)
                          <= count(*) OVER (PARTITION BY store_id, product_id) - {S.L + S.H} THEN 1 ELSE 0 END
                  AS is_start FROM panel) t""")
S.cte("wts_train", ("panel", "bounds"), f"""
SELECT *, sum(is_start) OVER (PARTITION BY store_id, product_id ORDER BY date
                              ROWS BETWEEN {S.L - 1} PRECEDING AND CURRENT ROW) AS weight
FROM (SELECT p.*, CASE WHEN lead(date, {S.L + S.H - 1}) OVER (PARTITION BY store_id, product_id ORDER BY date)
                            < b.lo + CAST(floor(datediff('day', b.lo, b.hi) * 0.8) AS INT) THEN 1 ELSE 0 END AS is_start
      FROM panel p, bounds b) t""")
S.cte("xmeans_train", ("wts_train",), "SELECT " + ", ".join(
    f"sum(weight * {f}::DOUBLE) / sum(weight) AS m_{f}" for f in S.FEATURES) + " FROM wts_train WHERE weight > 0")
S.cte("xparams_train", ("wts_train", "xmeans_train"), "\nUNION ALL\n".join(
    f"SELECT 'x' AS kind, {i} AS idx, '{f}' AS name, any_value(m_{f}) AS mean, "
    f"coalesce(nullif(sqrt(sum(weight * pow({f}::DOUBLE - m_{f}, 2)) / sum(weight)), 0), 1.0) AS scale "
    f"FROM wts_train, xmeans_train WHERE weight > 0" for i, f in enumerate(S.FEATURES)))
S.cte("xmeans", ("wts",), "SELECT " + ", ".join(
    f"sum(weight * {f}::DOUBLE) / sum(weight) AS m_{f}" for f in S.FEATURES) + " FROM wts WHERE weight > 0")
S.cte("xparams", ("wts", "xmeans"), "\nUNION ALL\n".join(
    f"SELECT 'x' AS kind, {i} AS idx, '{f}' AS name, any_value(m_{f}) AS mean, "
    f"coalesce(nullif(sqrt(sum(weight * pow({f}::DOUBLE - m_{f}, 2)) / sum(weight)), 0), 1.0) AS scale "
    f"FROM wts, xmeans WHERE weight > 0" for i, f in enumerate(S.FEATURES)))
S.cte("yparams", ("windows",), """
SELECT 'y' AS kind, idx::INT AS idx, 'y' || (idx + 1) AS name, avg(v) AS mean,
       coalesce(nullif(stddev_pop(v), 0), 1.0) AS scale
FROM (SELECT unnest(range(len(y))) AS idx, unnest(y) AS v FROM windows) t GROUP BY idx""")

register("scaler_fit_x", S.with_ctes(
    f"SELECT kind, idx, name, {R6('mean')} AS mean, {R6('scale')} AS scale FROM xparams", "xparams"))(
    lambda spark, d: sc.fit_input_scaler(_panel(spark, d)).select(
        "kind", "idx", "name", r6("mean").alias("mean"), r6("scale").alias("scale")))

register("scaler_fit_y", S.with_ctes(
    f"SELECT kind, idx, name, {R6('mean')} AS mean, {R6('scale')} AS scale FROM yparams", "yparams"))(
    lambda spark, d: sc.fit_target_scaler(wn.sliding_windows(_panel(spark, d))).select(
        "kind", "idx", "name", r6("mean").alias("mean"), r6("scale").alias("scale")))

register("scaler_fit_train", S.with_ctes(
    f"SELECT kind, idx, name, {R6('mean')} AS mean, {R6('scale')} AS scale FROM xparams_train", "xparams_train"))(
    lambda spark, d: _scaler_fit_train(spark, d))


def _scaler_fit_train(spark, d):
    from shelfcast.operators import learned
    panel = _panel(spark, d)
    return learned.fit_train_scaler(panel, sp.cutoff_date(panel)).select(
        "kind", "idx", "name", r6("mean").alias("mean"), r6("scale").alias("scale"))


_XS_LISTS = ", ".join(f"list({R6(f'(v_{f} - m_{f}) / s_{f}')} ORDER BY i) AS xs_{f}" for f in S.FEATURES)
_XS_CELLS = ", ".join(f"unnest(x_{f}) AS v_{f}" for f in S.FEATURES)
_PIVOT = ", ".join(f"max(CASE WHEN name = '{f}' THEN mean END) AS m_{f}, "
                   f"max(CASE WHEN name = '{f}' THEN scale END) AS s_{f}" for f in S.FEATURES)


@register("scaled_windows", S.with_ctes("", "windows", "xparams", "yparams") + f""",
xrow AS MATERIALIZED (SELECT {_PIVOT} FROM xparams),
yrows AS MATERIALIZED (SELECT idx, mean, scale FROM yparams),
xs AS (SELECT store_id, product_id, pos, {_XS_LISTS}
       FROM (SELECT store_id, product_id, pos, unnest(range({S.L})) AS i, {_XS_CELLS} FROM windows) c, xrow
       GROUP BY store_id, product_id, pos),
yy AS (SELECT store_id, product_id, pos, list({R6('(v - mean) / scale')} ORDER BY idx) AS ys
       FROM (SELECT store_id, product_id, pos, unnest(range({S.H}))::INT AS idx, unnest(y) AS v FROM windows) c
       JOIN yrows USING (idx) GROUP BY store_id, product_id, pos)
SELECT * FROM xs JOIN yy USING (store_id, product_id, pos)""")
def _scaled(spark, d):
    panel = _panel(spark, d)
    w = wn.sliding_windows(panel)
    out = sc.scale_windows(w, sc.fit_input_scaler(panel), sc.fit_target_scaler(w))
    cols = [f"xs_{f}" for f in pn.FEATURES] + ["ys"]
    return out.select("store_id", "product_id", "pos",
                      *[F.transform(c, lambda v: r6(v)).alias(c) for c in cols])


# ---------------------------------------------------------------- batch scoring
from shelfcast.operators import scoring as scr  # noqa: E402

S.cte("rk_panel", ("panel",), """
SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rk,
       max(date) OVER (PARTITION BY store_id, product_id) AS last_date
FROM panel""")
S.cte("req", ("rk_panel",), """
SELECT store_id, product_id, kind, CASE WHEN store_id % 2 = 0 THEN 'pytorch' ELSE 'tensorflow' END AS framework,
       x_sales, n_days, first_date, last_date
FROM (
  SELECT store_id, product_id, 'rows' AS kind, list(sales ORDER BY date) FILTER (WHERE rk <= 14) AS x_sales,
         count(*) FILTER (WHERE rk <= 14) AS n_days,
         strftime(min(date) FILTER (WHERE rk <= 14), '%Y-%m-%d') AS first_date,
         strftime(max(date) FILTER (WHERE rk <= 14), '%Y-%m-%d') AS last_date
  FROM rk_panel GROUP BY store_id, product_id
  UNION ALL
  SELECT store_id, product_id, 'calendar', list(sales ORDER BY date) FILTER (WHERE date > last_date - 14),
         count(*) FILTER (WHERE date > last_date - 14),
         strftime(min(date) FILTER (WHERE date > last_date - 14), '%Y-%m-%d'),
         strftime(max(date) FILTER (WHERE date > last_date - 14), '%Y-%m-%d')
  FROM rk_panel GROUP BY store_id, product_id) t""")
_SIGMA = "sqrt(list_sum(list_transform(x_sales, lambda v: pow(v - list_sum(x_sales) / len(x_sales), 2))) / len(x_sales))"
S.cte("scored", ("req",), f"""
SELECT *, CASE WHEN framework = 'pytorch' THEN {S.FC_EXPR['recency_weighted']}
               ELSE {S.FC_EXPR['seasonal_naive']} END AS fc,
       {_SIGMA} AS sigma
FROM req""")


def _requests(spark, d):
    return scr.forecast_requests(_panel(spark, d))


def _through_json(df, name):
    """`df` by way of JSON lines in the shared folder: the sink, then the scan."""
    from shelfcast.session import shared_path
    from shelfcast.sources.files import read_json, write_json
    path = shared_path(df.sparkSession, f"json/{name}")
    write_json(df, path)
    return read_json(df.sparkSession, path, df.schema)


@register("batch_forecast", S.with_ctes(f"""
SELECT store_id, product_id, kind, framework,
       CASE WHEN len(x_sales) <> 14 THEN 'Historical data must contain exactly 14 days' END AS error,
       CASE WHEN len(x_sales) = 14 THEN list_transform(fc, lambda v: {R6('v')}) END AS forecast,
       CASE WHEN len(x_sales) = 14 THEN list_transform(fc, lambda v: {R6('greatest(0.0, v - 1.96 * sigma)')}) END
         AS interval_lower,
       CASE WHEN len(x_sales) = 14 THEN list_transform(fc, lambda v: {R6('v + 1.96 * sigma')}) END
         AS interval_upper
FROM scored""", "scored"))
def _batch_forecast(spark, d):
    out = scr.batch_forecast(_requests(spark, d), scr.framework_models(spark), with_timestamp=True)
    out = _through_json(out, "responses")  # `generated_at` stays in the sink
    return out.select("store_id", "product_id", "kind", "framework", "error",
                      F.transform("forecast", lambda v: r6(v)).alias("forecast"),
                      F.transform("confidence_intervals", lambda s: r6(s["lower"])).alias("interval_lower"),
                      F.transform("confidence_intervals", lambda s: r6(s["upper"])).alias("interval_upper"))


register("batch_summary", S.with_ctes("""
SELECT count(*) AS total, count_if(len(x_sales) = 14)::BIGINT AS successful, count_if(len(x_sales) <> 14)::BIGINT AS failed
FROM req""", "req"))(lambda spark, d: scr.batch_summary(
    scr.batch_forecast(_requests(spark, d), scr.framework_models(spark))))


@register("request_parse", S.with_ctes("""
SELECT store_id, product_id, kind, framework, n_days::INT AS n_days, first_date, last_date,
       list_sum(x_sales) AS total_sales
FROM req""", "req"))
def _request_parse(spark, d):
    bodies = _through_json(_requests(spark, d), "requests")
    parsed = scr.parse_requests(scr.requests_to_json(bodies))
    h = F.col("historical_data")
    return parsed.select("store_id", "product_id", "kind", "framework", F.size(h).alias("n_days"),
                         h[0]["date"].alias("first_date"), F.element_at(h, -1)["date"].alias("last_date"),
                         F.aggregate(h, F.lit(0.0), lambda a, day: a + day["sales"]).alias("total_sales"))


@register("prediction_interval", S.with_ctes(f"""
SELECT store_id, product_id, kind, NULL AS error, unnest(range(1, 8))::INT AS day,
       unnest(list_transform(fc, lambda v: {R6('v')})) AS forecast,
       unnest(list_transform(fc, lambda v: {R6('greatest(0.0, v - 1.96 * sigma)')})) AS lower,
       unnest(list_transform(fc, lambda v: {R6('v + 1.96 * sigma')})) AS upper
FROM (SELECT *, {S.FC_EXPR['seasonal_naive']} AS fc, {_SIGMA} AS sigma FROM req WHERE len(x_sales) = 14) t
UNION ALL
SELECT store_id, product_id, kind, 'Historical data must contain exactly 14 days', NULL, NULL, NULL, NULL
FROM req WHERE len(x_sales) <> 14""", "req"))
def _prediction_interval(spark, d):
    from shelfcast.functions.exprs import array_pop_std
    from shelfcast.functions.rules import prediction_intervals
    x = F.transform("historical_data", lambda day: day["sales"])
    valid = F.size("historical_data") == wn.LOOKBACK
    f = F.when(valid, fc.seasonal_naive_expr(x))
    iv = _requests(spark, d).select(
        "store_id", "product_id", "kind", F.when(~valid, F.lit(scr.WRONG_LENGTH)).alias("error"),
        F.explode_outer(F.when(valid, prediction_intervals(f, array_pop_std(x)))).alias("i"), f.alias("f"))
    return iv.select("store_id", "product_id", "kind", "error", F.col("i.day").alias("day"),
                     r6(F.element_at("f", F.col("i.day"))).alias("forecast"),
                     r6("i.lower").alias("lower"), r6("i.upper").alias("upper"))


_QUESTION = scr.INSIGHT_QUESTION.replace("'", "''")
register("rule_insights", S.with_ctes(f"""
SELECT store_id, product_id, '{_QUESTION}' AS query,
       {S.rule_insight_text('avg_daily_sales', 'trend', 'volatility')} AS insights
FROM ctx""", "ctx"))(lambda spark, d: _through_json(scr.rule_insights(
    scr.insight_requests(_ctx(spark, d)), with_timestamp=True), "insights").drop("generated_at"))


# Clients' own contexts: what is missing or of another type takes the defaults.
register("free_form_insights", S.with_ctes(f"""
SELECT store_id, product_id, kind, CASE WHEN kind = 5 THEN '{scr.INVALID_BODY}' END AS error,
       CASE WHEN kind <> 5 THEN '{_QUESTION}' END AS query, avg_sales, trend, volatility,
       CASE WHEN kind <> 5 THEN {S.rule_insight_text('avg_sales', 'trend', 'volatility')} END AS insights
FROM (SELECT store_id, product_id, kind, CASE WHEN kind IN (0, 2) THEN avg_daily_sales ELSE 0.0 END AS avg_sales,
             CASE WHEN kind < 3 THEN trend ELSE 'stable' END AS trend,
             CASE WHEN kind < 3 THEN coalesce(volatility, 0.0) ELSE 0.0 END AS volatility
      FROM (SELECT *, ((store_id * 7 + product_id) % 6)::INT AS kind FROM ctx) c) t""", "ctx"))(
    lambda spark, d: scr.free_form_insights(scr.free_form_requests(_ctx(spark, d))))


def _ctx_repr_sql():
    def val(x, text=False):
        if text:
            return f"CASE WHEN {x} IS NULL THEN 'None' ELSE '''' || {x} || '''' END"
        return f"CASE WHEN {x} IS NULL THEN 'None' ELSE {S.py_repr(x)} END"
    return (f"'{{''avg_sales'': ' || ({val('avg_daily_sales')}) || ', ''trend'': ' || ({val('trend', True)}) || "
            f"', ''volatility'': ' || ({val('volatility')}) || '}}'")


register("insight_prompt", S.with_ctes(f"""
SELECT store_id, product_id,
       '### Instruction:' || chr(10) || '{_QUESTION}' || chr(10) || chr(10) || '### Input:' || chr(10) ||
       'Store: ' || store_id || chr(10) || 'Product: ' || product_id || chr(10) || 'Context: ' || {_ctx_repr_sql()}
       || chr(10) || chr(10) || '### Response:' AS prompt
FROM ctx""", "ctx"))(lambda spark, d: scr.insight_prompt(scr.insight_requests(_ctx(spark, d))))


# ---------------------------------------------------------------- retrieval
from shelfcast.functions.exprs import PY_WHITESPACE, WORD_PATTERN, NUMBER_PATTERN  # noqa: E402
from shelfcast.operators import retrieval as rt  # noqa: E402
from shelfcast.operators import textscore as ts  # noqa: E402

S.cte("centroids", (), """
SELECT label AS query_label, list(m ORDER BY idx) AS c
FROM (SELECT label, idx, avg(v) AS m
      FROM (SELECT label, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings) t
      GROUP BY label, idx) u
GROUP BY label""")
S.cte("cos_hits", ("centroids",), f"""
SELECT * FROM (
  SELECT query_label, (row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id))::INT AS rank,
         vec_id, label, score
  FROM (SELECT c.query_label, e.vec_id, e.label,
               {R6('list_cosine_similarity(e.embedding::DOUBLE[], c.c)')} AS score
        FROM embeddings e, centroids c) s) t
WHERE rank <= 3""")


def _cos_hits(spark, d):
    emb = read_table(spark, d, "embeddings")
    from shelfcast.session import materialize
    q = materialize(rt.label_centroids(emb).select(F.col("label").alias("query_id"), "vector"), "centroids")
    return emb, rt.cosine_topk(emb, q)


@register("cosine_topk", S.with_ctes("SELECT query_label, rank, vec_id, label, score FROM cos_hits", "cos_hits"))
def _cosine_topk(spark, d):
    emb, hits = _cos_hits(spark, d)
    return hits.join(emb.select("vec_id", "label"), "vec_id").select(
        F.col("query_id").alias("query_label"), "rank", "vec_id", "label", "score")


@register("rag_prompt", S.with_ctes("""
SELECT query_label, question,
       'Use the following context to answer the question:' || chr(10) || chr(10) || 'Context:' || chr(10) ||
       string_agg('{"vec_id": ' || vec_id || ', "label": ' || label || ', "similarity": ' || CAST(score AS VARCHAR)
                  || '}', chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || question || chr(10) ||
       chr(10) || 'Answer:' AS prompt
FROM (SELECT *, 'Which stored items are closest to label ' || query_label || '?' AS question FROM cos_hits) t
GROUP BY query_label, question""", "cos_hits"))
def _rag_prompt(spark, d):
    emb, hits = _cos_hits(spark, d)
    q = F.concat(F.lit("Which stored items are closest to label "), F.col("query_id").cast("string"), F.lit("?"))
    out = rt.rag_prompt(hits, emb, q)
    return out.select(F.col("query_id").alias("query_label"), "question", "prompt")




def _tfidf_ctes(docs, doc_id, texts, query_id):
    """CTEs up to `scored`: (doc_id, query_id, score) of all pairs that share a term."""
    return f"""
dt AS (SELECT {doc_id}, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term FROM {docs}),
tf AS (SELECT {doc_id}, term, count(*) AS tf FROM dt GROUP BY {doc_id}, term),
nd AS (SELECT count(DISTINCT {doc_id}) AS n FROM {docs}),
idf AS (SELECT term, ln((1.0 + any_value(nd.n)) / (1.0 + count(*))) + 1.0 AS idf FROM tf, nd GROUP BY term),
w AS (SELECT {doc_id}, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT {doc_id}, sqrt(sum(w * w)) AS norm FROM w GROUP BY {doc_id}),
qt AS (SELECT {query_id}, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term FROM {texts}),
qtf AS (SELECT {query_id}, term, count(*) AS tf FROM qt GROUP BY {query_id}, term),
qw AS (SELECT {query_id}, term, tf * coalesce(idf, ln(1.0 + nd.n) + 1.0) AS w FROM qtf LEFT JOIN idf USING (term), nd),
qunit AS (SELECT {query_id}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {query_id})) AS qw FROM qw),
scored AS (SELECT d.{doc_id}, d.{query_id}, {R6('d.dot / n.norm')} AS score
           FROM (SELECT u.{doc_id}, q.{query_id}, sum(u.w * q.qw) AS dot
                 FROM w u JOIN qunit q USING (term) GROUP BY u.{doc_id}, q.{query_id}) d
           JOIN norm n USING ({doc_id})),
ranked AS (SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY {query_id} ORDER BY score DESC, {doc_id}))::INT AS rank FROM scored) t
WHERE rank <= 3)"""


@register("tfidf_retrieve", "WITH" + _tfidf_ctes("documents", "doc_id", "benchmark", "item_id")
          + "\nSELECT item_id, rank, doc_id, score FROM ranked")
def _tfidf(spark, d):
    return rt.tfidf_retrieve(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


# The knowledge base as records and texts, and a question about each series.
S.cte("kb", ("metrics",), f"""
SELECT store_id * 1000 + product_id AS kb_id, store_id, product_id, avg_sales, avg_forecast, trend,
       'Product ' || product_id || ' at Store ' || store_id || ': Average sales ' || {S.py_repr('avg_sales')}
       || ', trend ' || trend AS text
FROM metrics""")
S.cte("asked", ("kb",), """
SELECT kb_id AS question_id, 'What is the sales trend of product ' || product_id || ' at store ' || store_id || '?' AS text
FROM kb""")
_KB_SQL = (S.with_ctes("", "kb", "asked") + ", " + _tfidf_ctes("kb", "kb_id", "asked", "question_id") + f"""
SELECT r.question_id, a.text AS question,
       'Use the following context to answer the question:' || chr(10) || chr(10) || 'Context:' || chr(10) ||
       string_agg('{{"store_id": ' || k.store_id || ', "product_id": ' || k.product_id || ', "avg_sales": '
                  || {S.py_repr('k.avg_sales')} || ', "avg_forecast": ' || {S.py_repr('k.avg_forecast')}
                  || ', "trend": "' || k.trend || '"}}', chr(10) ORDER BY r.rank)
       || chr(10) || chr(10) || 'Question: ' || a.text || chr(10) || chr(10) || 'Answer:' AS prompt
FROM ranked r JOIN kb k USING (kb_id) JOIN asked a USING (question_id) GROUP BY r.question_id, a.text""")


@register("kb_question_prompt", _KB_SQL)
def _kb_question_prompt(spark, d):
    from shelfcast.functions.rules import py_repr
    from shelfcast.session import materialize
    kb = ins.knowledge_base(_metrics(spark, d))
    kb_id = (F.col("store_id") * 1000 + F.col("product_id")).alias("kb_id")
    text = ins.kb_text(kb).select(kb_id, "store_id", "product_id", "text")
    records = materialize(kb.select(
        kb_id, F.col("store_id").cast("string"), F.col("product_id").cast("string"), py_repr(F.col("avg_sales")).alias("avg_sales"),
        py_repr(F.col("avg_forecast")).alias("avg_forecast"), F.concat(F.lit('"'), "trend", F.lit('"')).alias("trend"))
        .join(text.select("kb_id", "text"), "kb_id"), "kb")
    asked = records.select(F.col("kb_id").alias("question_id"), F.concat(
        F.lit("What is the sales trend of product "), "product_id", F.lit(" at store "), "store_id", F.lit("?")).alias("question"))
    hits = rt.tfidf_retrieve(records, asked.withColumnRenamed("question", "text"), corpus_id="kb_id", query_id="question_id")
    return rt.kb_prompt(hits, records, asked, "question_id", "kb_id",
                        ("store_id", "product_id", "avg_sales", "avg_forecast", "trend"))


_LSH_BITS = 8
_SIG = lambda v: " + ".join(
    f"(CASE WHEN list_sum(list_transform({v}, lambda v, i: v::DOUBLE * "
    f"(('0x' || substr(md5('{j}:' || i), 1, 8))::BIGINT / 4294967296.0 - 0.5))) >= 0 THEN {1 << j} ELSE 0 END)"
    for j in range(_LSH_BITS))


@register("lsh_topk", S.with_ctes(f"""
SELECT query_label, rank, vec_id, score FROM (
  SELECT query_label, vec_id, {R6('list_cosine_similarity(embedding::DOUBLE[], c)')} AS score,
         (row_number() OVER (PARTITION BY query_label
                             ORDER BY {R6('list_cosine_similarity(embedding::DOUBLE[], c)')} DESC, vec_id))::INT AS rank
  FROM (SELECT *, min(CASE WHEN held >= 3 THEN dist END) OVER (PARTITION BY query_label) AS reach
        FROM (SELECT q.query_label, q.c, e.vec_id, e.embedding, bit_count(xor(q.sig, e.sig)) AS dist,
                     count(*) OVER (PARTITION BY q.query_label ORDER BY bit_count(xor(q.sig, e.sig))) AS held
              FROM (SELECT vec_id, embedding, ({_SIG('embedding')})::BIGINT AS sig FROM embeddings) e,
                   (SELECT query_label, c, ({_SIG('c')})::BIGINT AS sig FROM centroids) q) p) h
  WHERE reach IS NULL OR dist <= reach) s
WHERE rank <= 3""", "centroids"))
def _lsh(spark, d):
    from shelfcast.session import materialize
    emb = read_table(spark, d, "embeddings")
    q = materialize(rt.label_centroids(emb).select(F.col("label").alias("query_id"), "vector"), "centroids")
    return rt.lsh_topk(emb, q, bits=_LSH_BITS).select(F.col("query_id").alias("query_label"), "rank", "vec_id", "score")


@register("cells_topk")
def _cells(spark, d):
    """Approximate hits with their recall against the exact ones."""
    from shelfcast.session import materialize
    emb = read_table(spark, d, "embeddings")
    q = materialize(rt.label_centroids(emb).select(F.col("label").alias("query_id"), "vector"), "centroids")
    found = materialize(rt.cells_topk(emb, q), "cells-hits")
    return found.join(rt.recall(found, rt.cosine_topk(emb, q)), "query_id").select(
        F.col("query_id").alias("query_label"), "rank", "vec_id", "score", "candidates", r6("recall").alias("recall"))


# ---------------------------------------------------------------- text scoring

_WS = PY_WHITESPACE
register("text_length", f"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''))::INT AS n_words,
       length(text)::INT AS n_chars
FROM documents""")(lambda spark, d: ts.text_length(read_table(spark, d, "documents")))

register("extract_numbers", f"""
SELECT doc_id, regexp_extract_all(text, '{NUMBER_PATTERN}') AS numbers,
       len(regexp_extract_all(text, '{NUMBER_PATTERN}'))::INT AS n_numbers
FROM documents""")(lambda spark, d: ts.numbers_in_text(read_table(spark, d, "documents")))


def _expected_map_sql():
    return ("[{'k': 'avg_daily_sales', 'v': avg_daily_sales}, "
            f"{{'k': 'safety_stock', 'v': {S.tint('volatility * 2')}::DOUBLE}}, "
            f"{{'k': 'reorder_point', 'v': {S.tint('avg_daily_sales * 7 + volatility * 2')}::DOUBLE}}, "
            f"{{'k': 'economic_order_quantity', 'v': {S.eoq()}::DOUBLE}}]")


def _hit_sql(v, text="output"):
    return f"(contains({text}, {S.py_int_text(v)}) OR contains({text}, {S.py_repr(v)}))::INT"


def _strict_sql(v):
    nums = f"regexp_extract_all(output, '{NUMBER_PATTERN}')"
    return (f"(list_contains({nums}, {S.py_int_text(v)}) OR list_contains({nums}, {S.py_repr(v)}))::INT")


_NUMERIC_SQL = (S.with_ctes(f"""
SELECT store_id, product_id, kind, len(ev)::INT AS n_checks, n_hits,
       {R6('n_hits / len(ev)')} AS numeric_accuracy, strict_hits
FROM (SELECT *, list_sum(list_transform(ev, lambda e: {_hit_sql('e.v')}))::INT AS n_hits,
             list_sum(list_transform(ev, lambda e: {_strict_sql('e.v')}))::INT AS strict_hits
      FROM (SELECT *, {_expected_map_sql()} AS ev FROM examples) t) u""", "examples"))


def _numeric_accuracy(spark, d):
    from shelfcast.functions import rules
    ex = ins.instruction_examples(_ctx(spark, d), keep_context=True)
    avg, vol = F.col("avg_daily_sales"), F.col("volatility")
    expected = F.create_map(
        F.lit("avg_daily_sales"), avg,
        F.lit("safety_stock"), rules.safety_stock_simple(vol).cast("double"),
        F.lit("reorder_point"), rules.reorder_point_simple(avg, vol).cast("double"),
        F.lit("economic_order_quantity"), rules.economic_order_quantity(avg).cast("double"))
    checks, hits, score = ts.numeric_accuracy_expr(F.col("output"), expected)
    return ex.select("store_id", "product_id", "kind", checks.alias("n_checks"), hits.alias("n_hits"),
                     r6(score).alias("numeric_accuracy"),
                     ts.strict_number_hits(F.col("output"), expected).alias("strict_hits"))


register("numeric_accuracy", _NUMERIC_SQL)(_numeric_accuracy)

S.cte("pairs", (), """
SELECT u.conv_id, u.turn, u.text AS reference, a.text AS generated
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
S.cte("ptoks", ("pairs",), f"""
SELECT conv_id, turn, regexp_extract_all(lower(generated), '{WORD_PATTERN}') AS g,
       regexp_extract_all(lower(reference), '{WORD_PATTERN}') AS r
FROM pairs""")


def _rouge_sql(n):
    def grams(c):
        return (f"CASE WHEN len({c}) >= {n} THEN list_transform(range(0, len({c}) - {n - 1}), "
                f"lambda i: array_to_string({c}[i + 1:i + {n}], ' ')) ELSE [] END")
    return f"""
SELECT t.conv_id, t.turn, t.n_gen, t.n_ref, coalesce(o.overlap, 0) AS overlap
FROM (SELECT conv_id, turn, len(gg) AS n_gen, len(rr) AS n_ref FROM
      (SELECT conv_id, turn, {grams('g')} AS gg, {grams('r')} AS rr FROM ptoks) x) t
LEFT JOIN (
  SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS overlap
  FROM (SELECT conv_id, turn, gram, count(*) AS c FROM
        (SELECT conv_id, turn, unnest({grams('g')}) AS gram FROM ptoks) x GROUP BY ALL) a
  JOIN (SELECT conv_id, turn, gram, count(*) AS c FROM
        (SELECT conv_id, turn, unnest({grams('r')}) AS gram FROM ptoks) y GROUP BY ALL) b
    USING (conv_id, turn, gram)
  GROUP BY a.conv_id, a.turn) o USING (conv_id, turn)"""


def _prf(n, src):
    p = f"CASE WHEN {src}.n_gen > 0 THEN {src}.overlap / {src}.n_gen ELSE 0.0 END"
    r = f"CASE WHEN {src}.n_ref > 0 THEN {src}.overlap / {src}.n_ref ELSE 0.0 END"
    f = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    return f"{R6(p)} AS rouge{n}_p, {R6(r)} AS rouge{n}_r, {R6(f)} AS rouge{n}_f"


S.cte("rouge1", ("ptoks",), _rouge_sql(1))
S.cte("rouge2", ("ptoks",), _rouge_sql(2))
register("rouge_n", S.with_ctes(f"""
SELECT a.conv_id, a.turn, {_prf(1, 'a')}, {_prf(2, 'b')}
FROM rouge1 a JOIN rouge2 b USING (conv_id, turn)""", "rouge1", "rouge2"))(
    lambda spark, d: ts.rouge_n(ts.conversation_pairs(read_table(spark, d, "conversations"))))

register("exact_numbers", S.with_ctes(f"""
SELECT conv_id, turn, regexp_extract_all(generated, '{NUMBER_PATTERN}') = regexp_extract_all(reference, '{NUMBER_PATTERN}') AS exact
FROM pairs""", "pairs"))(
    lambda spark, d: ts.conversation_pairs(read_table(spark, d, "conversations")).select(
        "conv_id", "turn", ts.exact_numbers(F.col("generated"), ts.extract_numbers("reference")).alias("exact")))

# LCS as a dynamic program in SQL: the outer list_reduce walks the generated
# tokens, the inner one builds the next DP row left to right.
_LCS_SQL = ("list_reduce(g, lambda prev, a: list_reduce(range(1, len(r) + 1), lambda row, j: list_append(row, "
            "CASE WHEN a = r[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], row[j]) END), [0]), "
            "list_transform(range(len(r) + 1), lambda x: 0))[-1]")
S.cte("lcs", ("ptoks",), f"SELECT conv_id, turn, len(g) AS n_gen, len(r) AS n_ref, {_LCS_SQL} AS lcs FROM ptoks")
S.cte("rougel", ("lcs",), f"""
SELECT conv_id, turn, n_gen, n_ref, lcs,
       CASE WHEN n_gen > 0 THEN lcs / n_gen ELSE 0.0 END AS p,
       CASE WHEN n_ref > 0 THEN lcs / n_ref ELSE 0.0 END AS rc
FROM lcs""")
register("rouge_l", S.with_ctes(f"""
SELECT conv_id, turn, n_gen::INT AS n_gen, n_ref::INT AS n_ref, lcs::BIGINT AS lcs, {R6('p')} AS rougeL_p,
       {R6('rc')} AS rougeL_r, {R6('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END')} AS rougeL_f
FROM rougel""", "rougel"))(
    lambda spark, d: ts.rouge_l(ts.conversation_pairs(read_table(spark, d, "conversations"))))

_PERPLEXITY_SQL = (f"""
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term FROM documents),
counts AS (SELECT term, count(*) AS c FROM toks GROUP BY term),
tot AS (SELECT sum(c) AS n, count(*) AS v FROM counts),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
agg AS (SELECT doc_id, sum(tf) AS n_tokens,
               sum(tf * -ln((coalesce(c, 0) + 1.0) / (n + v))) AS nll
        FROM tf LEFT JOIN counts USING (term), tot GROUP BY doc_id)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, (floor(exp(nll / n_tokens) * 1e4 + 0.5) / 1e4) AS perplexity,
       {R6('greatest(0.0, 1 - exp(nll / n_tokens) / 100.0)')} AS coherence
FROM agg""")


def _corpus_perplexity(spark, d):
    return ts.corpus_perplexity(read_table(spark, d, "documents"))


register("corpus_perplexity", _PERPLEXITY_SQL)(_corpus_perplexity)


S.cte("numsc", ("pairs",), f"""
SELECT conv_id, turn,
       CASE WHEN len(ks) > 0 THEN list_sum(list_transform(ks, lambda k: {_hit_sql('k::DOUBLE', 'generated')})) / len(ks)
            ELSE 0.0 END AS numeric,
       len(list_filter(regexp_split_to_array(generated, '{PY_WHITESPACE}'), lambda x: x <> ''))::INT AS length
FROM (SELECT *, list_distinct(regexp_extract_all(reference, '{NUMBER_PATTERN}')) AS ks FROM pairs) t""")
S.cte("conv_counts", (), f"""
SELECT term, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term
                                  FROM conversations) t GROUP BY term""")
S.cte("coh", ("pairs", "conv_counts"), f"""
SELECT conv_id, turn,
       {R6('greatest(0.0, 1 - exp(sum(tf * -ln((coalesce(c, 0) + 1.0) / (n + v))) / sum(tf)) / 100.0)')} AS coherence
FROM (SELECT conv_id, turn, term, count(*) AS tf
      FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(generated), '{WORD_PATTERN}')) AS term
            FROM pairs) x GROUP BY conv_id, turn, term) g
LEFT JOIN conv_counts USING (term),
(SELECT sum(c) AS n, count(*) AS v FROM conv_counts) tot
GROUP BY conv_id, turn""")


@register("overall_score", S.with_ctes(f"""
SELECT r.conv_id, r.turn, r.f AS factual_accuracy, {R6('n.numeric')} AS numerical_accuracy,
       coalesce(c.coherence, 0.0) AS coherence, n.length,
       {R6('r.f * 0.4 + n.numeric * 0.4 + coalesce(c.coherence, 0.0) * 0.2')} AS overall
FROM (SELECT conv_id, turn, {R6('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END')} AS f
      FROM rougel) r
JOIN numsc n USING (conv_id, turn)
LEFT JOIN coh c USING (conv_id, turn)""", "rougel", "numsc", "coh"))
def _overall(spark, d):
    conv = read_table(spark, d, "conversations")
    from shelfcast.session import materialize
    counts, n, v = ts.unigram_model(ts.counted_terms(conv, []))
    return ts.overall_score(materialize(ts.conversation_pairs(conv), "pairs"), counts, n, v)


# ---------------------------------------------------------------- monitoring & streams
from shelfcast.operators import monitoring as mon  # noqa: E402
from shelfcast.streaming import events as stm  # noqa: E402

register("event_counts", f"""
SELECT event_type, count(*) AS n_events, {R6('sum(value)')} AS total_value FROM events GROUP BY event_type""")(
    lambda spark, d: mon.event_counts(read_table(spark, d, "events")))

_BOUNDS = "[" + ", ".join("'inf'::DOUBLE" if b == float("inf") else repr(b) for b in mon.LATENCY_BUCKETS) + "]"
register("latency_histogram", f"""
WITH bk AS (SELECT unnest({_BOUNDS}) AS le, unnest(range({len(mon.LATENCY_BUCKETS)}))::INT AS b),
per AS (SELECT event_type, len(list_filter({_BOUNDS}, lambda x: x < value * 0.001))::INT AS b, count(*) AS c,
               sum(value * 0.001) AS s
        FROM events GROUP BY ALL),
g AS (SELECT t.event_type, bk.b, bk.le, coalesce(p.c, 0) AS c, p.s
      FROM (SELECT DISTINCT event_type FROM per) t CROSS JOIN bk
      LEFT JOIN per p ON p.event_type = t.event_type AND p.b = bk.b)
SELECT event_type, le,
       (sum(c) OVER (PARTITION BY event_type ORDER BY b ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_count,
       (sum(c) OVER (PARTITION BY event_type))::BIGINT AS count,
       {R6('sum(s) OVER (PARTITION BY event_type)')} AS sum_seconds
FROM g""")(lambda spark, d: mon.latency_histogram(read_table(spark, d, "events")))

register("tumbling_events", f"""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS n_events, {R6('sum(value)')} AS total_value
FROM events GROUP BY ALL""")(lambda spark, d: mon.tumbling(read_table(spark, d, "events")))

register("sliding_events", f"""
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n_events,
       {R6('sum(value)')} AS total_value
FROM (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts) - to_days(r.i::INT) AS window_start
      FROM events, range(7) r(i)) t
GROUP BY ALL""")(lambda spark, d: mon.sliding(read_table(spark, d, "events")))

register("session_events", f"""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events,
       {R6('sum(value)')} AS total_value
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                            OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR
                           THEN 1 ELSE 0 END AS new
            FROM events) t) u
GROUP BY user_id, sid""")(lambda spark, d: mon.sessions_split(read_table(spark, d, "events")))

def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


# availableNow ends with the watermark at max(ts) - 1 day: exactly the windows
# ending at or before it are closed and emitted.
register("stream_tumbling", f"""
SELECT window_start, window_end, event_type, n_events, total_value FROM (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
         event_type, count(*) AS n_events, {R6('sum(value)')} AS total_value
  FROM events GROUP BY ALL) t
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")(
    lambda spark, d: stm.stream_tumbling(spark, d).select(
        _ntz("window_start"), _ntz("window_end"), "event_type", "n_events", "total_value"))

register("stream_dedup", """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM events) t
WHERE rn = 1""")(lambda spark, d: stm.stream_dedup(spark, d).select(
    "event_id", _ntz("ts"), "user_id", "event_type", "value"))

register("stream_scale", f"""
SELECT e.event_id, e.event_type, e.value,
       {R6('(e.value - p.m) / p.s')} AS z
FROM events e JOIN (SELECT event_type, avg(value) AS m,
                           CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS s
                    FROM events GROUP BY event_type) p USING (event_type)""")(
    lambda spark, d: stm.stream_scale(spark, d))
register("stream_forecast", S.with_ctes("""
SELECT store_id, product_id, strftime(max(date), '%Y-%m-%d') AS last_date, count(*)::INT AS n_days,
       CASE WHEN count(*) = 14 THEN list_transform(range(7), lambda h: list(sales ORDER BY date)[8 + h]) END AS seasonal_naive,
       CASE WHEN count(*) = 14 THEN list_transform(range(7), lambda h: (floor(list_sum(list(sales ORDER BY date)) / 14 * 1e6 + 0.5) / 1e6)) END
         AS moving_average
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rk FROM panel) t
WHERE rk <= 14 GROUP BY store_id, product_id""", "panel"))(
    lambda spark, d: stm.stream_forecast(spark, _panel(spark, d)).withColumn(
        "moving_average", F.transform("moving_average", lambda v: r6(v))))

# A window or session is written once the watermark, a day behind the last event, has passed its end.
register("stream_sliding", f"""
SELECT * FROM (
  SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n_events,
         {R6('sum(value)')} AS total_value
  FROM (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts) - to_days(r.i::INT) AS window_start
        FROM events, range(7) r(i)) t
  GROUP BY ALL) w
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")(
    lambda spark, d: stm.stream_sliding(spark, d).select(
        _ntz("window_start"), _ntz("window_end"), "event_type", "n_events", "total_value"))

register("stream_sessions", f"""
SELECT * FROM (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events,
         {R6('sum(value)')} AS total_value
  FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
                             THEN 0 ELSE 1 END AS new FROM events) t) u
  GROUP BY user_id, sid) s
WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")(
    lambda spark, d: stm.stream_sessions(spark, d).select(
        "user_id", _ntz("session_start"), _ntz("session_end"), "n_events", "total_value"))

register("stream_series_lives", S.with_ctes(f"""
SELECT store_id, product_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_days,
       sum(sales)::DOUBLE AS total_sales, {R6('avg(sales) FILTER (WHERE back <= 14)')} AS last_mean
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id, life ORDER BY date DESC) AS back
      FROM (SELECT *, sum(new) OVER (PARTITION BY store_id, product_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS life
            FROM (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY store_id, product_id ORDER BY date) <= 14
                                 THEN 0 ELSE 1 END AS new FROM panel) t) u) v, bounds
GROUP BY store_id, product_id, life, hi
HAVING max(date) + 14 < hi - 1 OR max(date) < (SELECT max(p.date) FROM panel p WHERE p.store_id = v.store_id AND p.product_id = v.product_id)
""", "panel", "bounds"))(lambda spark, d: stm.stream_series_lives(_panel(spark, d)).withColumn("last_mean", r6("last_mean")))

register("stream_forecast_errors", S.with_ctes("""
SELECT f.store_id, f.product_id, f.date + 7 AS date, f.sales::DOUBLE AS forecast, a.sales::DOUBLE AS actual_sales,
       abs(f.sales - a.sales)::DOUBLE AS abs_error
FROM panel f LEFT JOIN panel a ON a.store_id = f.store_id AND a.product_id = f.product_id AND a.date = f.date + 7, bounds
WHERE f.date + 7 <= hi - 1""", "panel", "bounds"))(lambda spark, d: stm.stream_forecast_errors(_panel(spark, d)))

# The streaming counters end in the same state as the batch aggregates.
from shelfcast.plans.registry import ORACLES as _ORACLES  # noqa: E402
register("stream_event_counts", _ORACLES["event_counts"])(lambda spark, d: stm.stream_event_counts(spark, d))
register("stream_latency_histogram", _ORACLES["latency_histogram"])(
    lambda spark, d: stm.stream_latency_histogram(spark, d))

# ---------------------------------------------------------------- token budget & prompts
MAX_LEN = 512
S.cte("itext", ("examples",), """
SELECT store_id, product_id, kind,
       '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input
       || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text
FROM examples""")
register("token_budget", S.with_ctes(f"""
SELECT store_id, product_id, kind, len(tok)::INT AS n_tokens, len(tok[1:{MAX_LEN}])::INT AS n_kept,
       ({MAX_LEN} - len(tok[1:{MAX_LEN}]))::INT AS n_pad, len(tok) > {MAX_LEN} AS truncated,
       CASE WHEN tok IS NOT NULL THEN list_concat(tok[1:{MAX_LEN}],
            list_transform(range({MAX_LEN} - len(tok[1:{MAX_LEN}])), lambda i: '<pad>')) END AS input_tokens
FROM (SELECT *, list_filter(regexp_split_to_array(text, '{PY_WHITESPACE}'), lambda x: x <> '') AS tok
      FROM itext) t""", "itext"))(
    lambda spark, d: ins.token_budget(ins.instruction_text(ins.instruction_examples(_ctx(spark, d)))))

register("analysis_prompt", S.with_ctes("""
SELECT store_id, product_id,
       'Analyze the following product data and provide:' || chr(10) || '1. Demand trend assessment' || chr(10) ||
       '2. Inventory recommendations' || chr(10) || '3. Risk factors' || chr(10) || chr(10) || 'Data: ' ||
       context_json || chr(10) || chr(10) || 'Focus on actionable insights for procurement team.' AS prompt
FROM ctx""", "ctx"))(lambda spark, d: scr.analysis_prompt(_ctx(spark, d)))


# ---------------------------------------------------------------- learned model & files
from shelfcast.operators import experiments as ex  # noqa: E402
from shelfcast.operators import learned as lrn  # noqa: E402
from shelfcast.sources import files as fl  # noqa: E402


@register("ar_linear_forecast")
def _ar_linear(spark, d):
    return lrn.ar_linear_forecast(_panel(spark, d), stm.run_dir(spark, "ar-linear"))


# What the 98-feature fit leaves in its normal equations: nothing, at each step
# and feature, over all training windows.
register("ar_linear_residuals", S.with_ctes(f"""
SELECT s.step::INT AS step, j.feature::INT AS feature, count(*) AS n, 0.0::DOUBLE AS moment
FROM windows w, (SELECT lo + CAST(floor(datediff('day', lo, hi) * 0.8) AS INT) AS cutoff FROM bounds) c,
     range({S.H}) s(step), range(-1, {S.L * len(S.FEATURES)}) j(feature)
WHERE w.y_date[len(w.y_date)] < c.cutoff GROUP BY ALL""", "windows", "bounds"))(
    lambda spark, d: lrn.residual_moments(_panel(spark, d)))


# The same with the window's mean alone: its least squares are closed forms.
_MEAN = "(list_sum(list_transform(x_sales, lambda v: (v - m) / s)) / len(x_sales))"


@register("mean_linear_forecast", S.with_ctes("", "windows", "bounds", "xparams_train") + f""",
cut AS MATERIALIZED (SELECT lo + CAST(floor(datediff('day', lo, hi) * 0.8) AS INT) AS cutoff FROM bounds),
parted AS (SELECT w.*, CASE WHEN w.y_date[len(w.y_date)] < c.cutoff THEN 'train'
                            WHEN w.start_date >= c.cutoff THEN 'test' END AS split FROM windows w, cut c),
xp AS MATERIALIZED (SELECT mean AS m, scale AS s FROM xparams_train WHERE name = 'sales'),
cells AS (SELECT store_id, product_id, pos, start_date, y, split, f, unnest(range(7))::INT AS idx, unnest(y) AS v
          FROM (SELECT parted.*, {_MEAN} AS f FROM parted, xp WHERE split IS NOT NULL) t),
yp AS MATERIALIZED (SELECT idx, avg(v) AS ym, coalesce(nullif(stddev_pop(v), 0), 1.0) AS ysd
                    FROM cells WHERE split = 'train' GROUP BY idx),
fit AS MATERIALIZED (SELECT idx, regr_slope((v - ym) / ysd, f) AS b, regr_intercept((v - ym) / ysd, f) AS a
                     FROM cells JOIN yp USING (idx) WHERE split = 'train' GROUP BY idx)
SELECT store_id, product_id, pos, start_date, list({R6('(a + b * f) * ysd + ym')} ORDER BY idx) AS forecast, y
FROM cells JOIN yp USING (idx) JOIN fit USING (idx) WHERE split = 'test'
GROUP BY store_id, product_id, pos, start_date, y""")
def _mean_linear(spark, d):
    return lrn.ar_linear_forecast(_panel(spark, d), stm.run_dir(spark, "mean-linear"), reg=0.0, features="mean")


def _grid_sql(model, season, temperature):
    expr = (f"list_transform(range(1, {S.H + 1}), lambda h: x_sales[{S.L} - {season} + ((h - 1) % {season}) + 1])"
            if model == "seasonal_naive" else S.FC_EXPR["recency_weighted"].replace(f"tanh({S.TEMP} *", f"tanh({temperature} *"))
    return f"""
SELECT '{model}' AS model, {season or 'NULL'}::INT AS season, {temperature or 'NULL'}::DOUBLE AS temperature,
       unnest({expr}) AS p, unnest(y) AS a FROM windows"""


register("experiment_grid", S.with_ctes(f"""
SELECT model, season, temperature, count(*) AS n, {R6('avg(abs(p - a))')} AS mae, {R6('sqrt(avg(pow(p - a, 2)))')} AS rmse,
       {R6('avg(abs((a - p) / (a + 1e-8))) * 100')} AS mape, avg(abs((a - p) / (a + 1e-8))) * 100 < 15.0 AS meets_target
FROM ({" UNION ALL ".join(_grid_sql(*g) for g in lrn.GRID)}) t GROUP BY model, season, temperature""", "windows"))(
    lambda spark, d: lrn.experiment_grid(_panel(spark, d)))


@register("learned_grid")
def _learned_grid(spark, d):
    return ex.learned_grid(_panel(spark, d))


# The one-feature form: ridge slopes in closed form, one row a penalty and fold.
@register("mean_learned_grid", S.with_ctes("", "windows", "bounds", "panel") + f""",
cuts AS MATERIALIZED (
  SELECT k, lo + CAST(floor(datediff('day', lo, hi) * o) AS INT) AS cut,
         CASE WHEN o = {ex.ORIGINS[-1]} THEN hi + 1 ELSE lo + CAST(floor(datediff('day', lo, hi) * nxt) AS INT) END AS stop
  FROM bounds, (SELECT unnest(range({len(ex.ORIGINS)})) AS k, unnest({list(ex.ORIGINS)}) AS o,
                       unnest({[*ex.ORIGINS[1:], 1.0]}) AS nxt)),
early AS (SELECT w.* FROM windows w, cuts WHERE k = 0 AND y_date[len(y_date)] < cut),
xp AS MATERIALIZED (SELECT avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1.0) AS s FROM (SELECT unnest(x_sales) AS v FROM early)),
yp AS MATERIALIZED (SELECT idx, avg(v) AS ym, coalesce(nullif(stddev_pop(v), 0), 1.0) AS ysd
                    FROM (SELECT unnest(range({S.H})) AS idx, unnest(y) AS v FROM early) GROUP BY idx),
cells AS MATERIALIZED (
  SELECT start_date, y_date[len(y_date)] AS last, f, idx, v, (v - ym) / ysd AS z, ym, ysd
  FROM (SELECT start_date, y_date, {_MEAN} AS f, unnest(range({S.H})) AS idx, unnest(y) AS v FROM windows, xp) JOIN yp USING (idx)),
fit AS MATERIALIZED (
  SELECT k, idx, count(*) AS n_train, avg(f) AS fm, avg(z) AS zm, covar_pop(f, z) AS cov, var_pop(f) AS var
  FROM cells JOIN cuts ON last < cut GROUP BY k, idx)
SELECT k::INT AS fold, cut AS origin, penalty, any_value(n_train) AS n_train, count(*) // {S.H} AS n_test,
       {R6('avg(pow(z - (zm + b * (f - fm)), 2))')} AS loss,
       {R6('avg(abs((v - ((zm + b * (f - fm)) * ysd + ym)) / (v + 1e-8))) * 100')} AS mape,
       avg(abs((v - ((zm + b * (f - fm)) * ysd + ym)) / (v + 1e-8))) * 100 < 15.0 AS meets_target
FROM (SELECT *, cov / (var + penalty) AS b FROM fit, (SELECT unnest({list(ex.PENALTIES)}::DOUBLE[]) AS penalty)) JOIN cuts USING (k)
JOIN cells USING (idx) WHERE start_date >= cut AND last < stop GROUP BY k, cut, penalty""")
def _mean_learned_grid(spark, d):
    return ex.learned_grid(_panel(spark, d), features="mean")


@register("csv_roundtrip", S.with_ctes(f"""
SELECT store_id, product_id, date, horizon, model, actual_sales, {R6('forecast')} AS forecast,
       NULL::VARCHAR AS _corrupt_record
FROM fr_seasonal_naive""", "fr_seasonal_naive"))
def _csv_roundtrip(spark, d):
    """Panel -> CSV -> typed read -> forecast results -> CSV -> typed read:
    the reference's file hand-off between its stages."""
    base = stm.run_dir(spark, "csv")
    fl.write_csv(_panel(spark, d), f"{base}/sales")
    sales = fl.read_sales_csv(spark, f"{base}/sales").drop(fl.CORRUPT)
    fr = fc.forecast_results(sales).select(*[f.name for f in fl.FORECAST_SCHEMA.fields])
    fl.write_csv(fr, f"{base}/forecasts")
    back = fl.read_forecast_csv(spark, f"{base}/forecasts")
    return back.select(*[c for c in back.columns if c != "forecast"], r6("forecast").alias("forecast"))


# ---------------------------------------------------------------- bucketed storage

@register("bucketed_series_metrics", _ORACLES["series_metrics"])
def _bucketed_metrics(spark, d):
    """Series metrics over a panel stored by series: no shuffle by series."""
    from shelfcast.session import shared_path
    path = shared_path(spark, "bucketed/panel")
    panel = fl.write_bucketed(_panel(spark, d), "panel_" + path.rsplit("-", 1)[1], path)
    return _metrics_out(ins.series_metrics(fc.daily_forecasts(panel), daily=True))


# ---------------------------------------------------------------- SQL API
from shelfcast.functions.sql_functions import register_sql_functions  # noqa: E402


def _rule_insights_sql(spark, d):
    """Rule-based insights through the SQL API: a temp view of the series
    context and the SQL-bodied `rule_insight` function."""
    register_sql_functions(spark)
    view = "shelfcast_series_context"
    _ctx(spark, d).createOrReplaceTempView(view)
    q = scr.INSIGHT_QUESTION.replace("'", "''")
    return spark.sql(f"SELECT store_id, product_id, '{q}' AS query, "
                     f"rule_insight(avg_daily_sales, trend, volatility) AS insights FROM {view}")


register("rule_insights_sql", S.with_ctes(f"""
SELECT store_id, product_id, '{_QUESTION}' AS query,
       {S.rule_insight_text('avg_daily_sales', 'trend', 'volatility')} AS insights
FROM ctx""", "ctx"))(_rule_insights_sql)
