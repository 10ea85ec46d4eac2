"""Multi-step forecasts over look-back windows (14 days in -> 7 days out).

The reference trains recurrent networks on one machine.  Here the same
contract (window in, H values out) is served by:

* closed-form baselines written as array expressions (seasonal naive, moving
  average, least-squares trend, recency-weighted softmax average) - these run
  inside whole-stage codegen and have DuckDB oracles;
* a pooled direct multi-output regression fitted with Spark ML (one
  `LinearRegression` per horizon step), see `ar_linear_forecast`.

Forecast rows are joined back to the actual sales by (store, product, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import let, r6
from shelfcast.operators.panel import KEYS
from shelfcast.operators.windows import HORIZON, LOOKBACK, sliding_windows

# Weekly season; recency temperature of the softmax weighting.
SEASON = 7
RECENCY_TEMPERATURE = 2.0
BASELINES = ("seasonal_naive", "moving_average", "linear_trend", "recency_weighted")


def _steps(horizon: int):
    return F.sequence(F.lit(1), F.lit(horizon))


def _sum(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def seasonal_naive_expr(x, lookback: int = LOOKBACK, horizon: int = HORIZON, season: int = SEASON):
    """Day t+h repeats day t+h-season (the last week of the window)."""
    return F.transform(_steps(horizon),
                       lambda h: F.element_at(x, F.lit(lookback - season) + F.pmod(h - 1, F.lit(season)) + 1))


def moving_average_expr(x, lookback: int = LOOKBACK, horizon: int = HORIZON):
    """Mean of the look-back, repeated over the horizon."""
    return F.array_repeat(_sum(x) / F.size(x), horizon)


def linear_trend_expr(x, lookback: int = LOOKBACK, horizon: int = HORIZON):
    """Least-squares line through (position, sales) of the window, extrapolated."""
    n = float(lookback)
    t_mean = (n - 1) / 2.0
    t_ss = n * (n * n - 1) / 12.0          # sum of (t - t_mean)^2 for t = 0..n-1
    y_mean = _sum(x) / F.lit(n)
    slope = _sum(F.transform(x, lambda v, i: (i - F.lit(t_mean)) * v)) / F.lit(t_ss)
    # Mean and slope are computed once per window, then extrapolated.
    return let(F.struct(y_mean.alias("m"), slope.alias("b")), lambda s: F.transform(
        _steps(horizon), lambda h: s["m"] + s["b"] * (F.lit(n - 1 - t_mean) + h)))


def recency_weight_values(lookback: int = LOOKBACK, temperature: float = RECENCY_TEMPERATURE) -> list[float]:
    """Softmax over step scores tanh(temperature * t/(L-1)): the attention idea
    'recent days might be more important' with fixed, not learned, scores."""
    import math
    scores = [math.exp(math.tanh(temperature * t / (lookback - 1))) for t in range(lookback)]
    total = sum(scores)
    return [s / total for s in scores]


def recency_weights(lookback: int = LOOKBACK, temperature: float = RECENCY_TEMPERATURE):
    """The weights as a literal array (constant for every window)."""
    return F.array(*[F.lit(w) for w in recency_weight_values(lookback, temperature)])


def recency_weighted_expr(x, lookback: int = LOOKBACK, horizon: int = HORIZON,
                          temperature: float = RECENCY_TEMPERATURE):
    ctx = _sum(F.zip_with(x, recency_weights(lookback, temperature), lambda v, w: v * w))
    return F.array_repeat(ctx, horizon)


MODEL_EXPRS = {
    "seasonal_naive": seasonal_naive_expr,
    "moving_average": moving_average_expr,
    "linear_trend": linear_trend_expr,
    "recency_weighted": recency_weighted_expr,
}


def baseline_forecast(windows: DataFrame, model: str, **params) -> DataFrame:
    return windows.withColumn("forecast", MODEL_EXPRS[model](F.col("x_sales"), **params))


def seasonal_naive(windows: DataFrame, **params) -> DataFrame:
    return baseline_forecast(windows, "seasonal_naive", **params)


def moving_average(windows: DataFrame, **params) -> DataFrame:
    return baseline_forecast(windows, "moving_average", **params)


def linear_trend(windows: DataFrame, **params) -> DataFrame:
    return baseline_forecast(windows, "linear_trend", **params)


def recency_weighted(windows: DataFrame, **params) -> DataFrame:
    return baseline_forecast(windows, "recency_weighted", **params)


def rounded_forecast(df: DataFrame) -> DataFrame:
    return df.withColumn("forecast", F.transform("forecast", lambda v: r6(v)))


def forecast_long(windows: DataFrame, models=("seasonal_naive",), with_actuals: bool = True) -> DataFrame:
    """One row per (series, window, model, horizon step) with the target date.
    All models are evaluated in one projection over the windows and exploded
    once, so the windows (and their shuffle) are computed a single time.
    With `with_actuals`, the actual sales and unit price of the target day
    come from the window's own horizon frame, so no join is needed.
    Needs windows built with `with_dates=True`."""
    fields = [F.col("y_date").alias("d")]
    if with_actuals:
        fields += [F.col("y").alias("a"), F.col("y_price").alias("pr")]
    per_model = F.array(*[F.struct(F.lit(m).alias("model"),
                                   F.arrays_zip(MODEL_EXPRS[m](F.col("x_sales")).alias("f"), *fields).alias("steps"))
                          for m in models])
    by_model = windows.select(*KEYS, F.col("pos").alias("origin_pos"),
                              F.col("start_date").alias("origin_date"),
                              F.explode(per_model).alias("m"))
    extra = [F.col("col.a").alias("actual_sales"), F.col("col.pr").alias("price")] if with_actuals else []
    return by_model.select(*KEYS, "origin_pos", "origin_date", F.col("m.model").alias("model"),
                           F.posexplode("m.steps")).select(
        *KEYS, "origin_pos", "origin_date",
        (F.col("pos") + 1).alias("horizon"),
        F.col("col.d").alias("date"),
        F.col("col.f").alias("forecast"),
        "model", *extra)


def one_per_day(fr: DataFrame) -> DataFrame:
    """One row per (series, day, model): the forecast of the smallest horizon.
    The last days of a series have no one-step forecast, as a window needs a
    whole horizon of actuals; they keep the shortest one there is.  The rows are
    partitioned by series already, so this adds no shuffle."""
    rest = [c for c in fr.columns if c not in (*KEYS, "date", "model")]
    return (fr.groupBy(*KEYS, "date", "model").agg(F.min_by(F.struct(*rest), "horizon").alias("r"))
            .select(*KEYS, "date", "model", "r.*"))


def daily_forecasts(panel: DataFrame, model: str = "seasonal_naive") -> DataFrame:
    """The rows of `one_per_day(forecast_results(panel))` without the others:
    each window emits its steps up to the first day of the next window's
    horizon, the last window all of them.  One row a day, no further shuffle."""
    windows = sliding_windows(panel, with_dates=True)
    ahead = F.lead("pos").over(Window.partitionBy(*KEYS).orderBy("start_date"))
    steps = F.arrays_zip(MODEL_EXPRS[model](F.col("x_sales")).alias("f"), F.col("y_date").alias("d"), F.col("y").alias("a"),
                         F.col("y_price").alias("pr"))
    own = F.slice(steps, 1, F.least(F.coalesce(ahead - F.col("pos"), F.lit(HORIZON)), F.lit(HORIZON)))
    return windows.select(*KEYS, F.col("pos").alias("origin_pos"), F.col("start_date").alias("origin_date"), own.alias("s")).select(
        *KEYS, "origin_pos", "origin_date", F.posexplode("s")).select(
        *KEYS, F.col("col.d").alias("date"), F.lit(model).alias("model"), "origin_pos", "origin_date",
        (F.col("pos") + 1).alias("horizon"), F.col("col.f").alias("forecast"), F.col("col.a").alias("actual_sales"),
        F.col("col.pr").alias("price"))


def attach_actuals(fc_long: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecast <-> actual (J1): inner equi-join on (store, product, date), for
    forecasts that do not carry their actuals; also brings the day's price."""
    actual = panel.select(*KEYS, "date", F.col("sales").alias("actual_sales"), "price")
    return fc_long.join(actual, [*KEYS, "date"], "inner")


def forecast_results(panel: DataFrame, models=("seasonal_naive",), join_actuals: bool = False) -> DataFrame:
    """(store_id, product_id, origin_pos, origin_date, horizon, date, model,
    forecast, actual_sales, price): the table the insight stage reads.

    By default the actuals ride along in the windows (one shuffle in total);
    `join_actuals=True` takes the general path of joining forecast rows back
    to the panel, as needed for forecasts produced outside the windows."""
    windows = sliding_windows(panel, with_dates=True)
    if join_actuals:
        return attach_actuals(forecast_long(windows, models, with_actuals=False), panel)
    return forecast_long(windows, models)
