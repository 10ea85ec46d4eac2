"""Forecast error metrics, model comparison and business metrics.

All metrics are plain aggregates (partial + final HashAggregate), so they
need one shuffle keyed by the grouping and never hold a group in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import let, r2, r6
from shelfcast.operators.forecasts import MODEL_EXPRS, one_per_day
from shelfcast.operators.panel import KEYS

# MAPE epsilon of the reference; the MAPE quality target (%).
MAPE_EPSILON = 1e-8
MAPE_TARGET = 15.0
# Business-metric parameters (README formulas): holding rate on unit cost,
# lost profit as a share of the unit price.
HOLDING_RATE = 0.2
LOST_PROFIT_RATE = 0.25
METRIC_NAMES = ("mse", "mae", "mape", "mape_nonzero", "rmse", "bias")


def error_aggs(actual: str = "actual_sales", pred: str = "forecast") -> list:
    a, p = F.col(actual), F.col(pred)
    return [
        F.count("*").alias("n"),
        F.avg(F.pow(p - a, 2)).alias("mse"),
        F.avg(F.abs(p - a)).alias("mae"),
        (F.avg(F.abs((a - p) / (a + F.lit(MAPE_EPSILON)))) * 100).alias("mape"),
        (F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100).alias("mape_nonzero"),
        F.sqrt(F.avg(F.pow(p - a, 2))).alias("rmse"),
        F.avg(a - p).alias("bias"),
    ]


def _rounded(df: DataFrame, keep) -> DataFrame:
    return df.select(*keep, "n", *[r6(m).alias(m) for m in METRIC_NAMES])


def forecast_metrics(fr: DataFrame) -> DataFrame:
    """MSE / MAE / MAPE (with epsilon, and over non-zero actuals) / RMSE /
    bias (mean of actual - predicted) per model, over every (window, step)."""
    return _rounded(fr.groupBy("model").agg(*error_aggs()), ["model"])


def forecast_metrics_sets(fr: DataFrame) -> DataFrame:
    """The same metrics at four grains in one pass: per model, per horizon
    step, per store and per series (GROUPING SETS)."""
    g = fr.groupingSets(
        [["model"], ["model", "horizon"], ["model", "store_id"], ["model", "store_id", "product_id"]],
        "model", "horizon", "store_id", "product_id",
    ).agg(F.grouping_id().alias("level"), *error_aggs())
    return _rounded(g, ["model", "level", "horizon", "store_id", "product_id"])


def model_comparison(metrics: DataFrame, target: float = MAPE_TARGET) -> DataFrame:
    """Stacked models' metrics (`forecast_metrics` or `window_metrics`) with the
    quality gate MAPE < target."""
    return metrics.withColumn("meets_target", F.col("mape") < F.lit(target))


def window_metrics(windows: DataFrame, models) -> DataFrame:
    """`forecast_metrics` of several models straight from windows: a window
    sums its own errors, so that it is one row a model, not one a step."""
    y = F.col("y")

    def sums(model: str):
        def of(f):
            each = lambda term: F.aggregate(F.zip_with(f, y, lambda p, a: F.coalesce(term(p, a), F.lit(0.0))), F.lit(0.0),
                                            lambda t, v: t + v)
            return F.struct(F.lit(model).alias("model"), F.size(y).alias("n"), each(lambda p, a: (p - a) * (p - a)).alias("sq"),
                            each(lambda p, a: F.abs(p - a)).alias("abs"), each(lambda p, a: a - p).alias("bias"),
                            each(lambda p, a: F.abs((a - p) / (a + F.lit(MAPE_EPSILON)))).alias("rel"),
                            each(lambda p, a: F.when(a != 0, F.abs((a - p) / a))).alias("rel_nz"),
                            F.size(F.filter(y, lambda a: a != 0)).alias("n_nz"))
        return let(MODEL_EXPRS[model](F.col("x_sales")), of)

    rows = windows.select(F.explode(F.array(*[sums(m) for m in models])).alias("m")).select("m.*")
    g = rows.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "sq", "abs", "bias", "rel", "rel_nz", "n_nz")])
    mean = lambda c: F.col(c) / F.col("n")
    return g.select("model", "n", r6(mean("sq")).alias("mse"), r6(mean("abs")).alias("mae"), r6(mean("rel") * 100).alias("mape"),
                    r6(F.try_divide(F.col("rel_nz"), F.col("n_nz")) * 100).alias("mape_nonzero"),
                    r6(F.sqrt(mean("sq"))).alias("rmse"), r6(mean("bias")).alias("bias"))


def direction_accuracy(fr: DataFrame, model: str = "seasonal_naive") -> DataFrame:
    """Share of days where sign(a[t]-a[t-1]) == sign(p[t]-p[t-1]) per series;
    the first day of a series has no direction and is excluded."""
    f = one_per_day(fr.where(F.col("model") == model))
    w = Window.partitionBy(*KEYS).orderBy("date")
    a, p = F.col("actual_sales"), F.col("forecast")
    d = f.select(*KEYS, "date",
                 F.signum(a - F.lag(a).over(w)).alias("da"),
                 F.signum(p - F.lag(p).over(w)).alias("dp"))
    # The window's shuffle on (store, product) already satisfies this grouping.
    return (d.where(F.col("da").isNotNull())
            .groupBy(*KEYS)
            .agg(F.count("*").alias("n_pairs"),
                 r6(F.avg((F.col("da") == F.col("dp")).cast("double"))).alias("direction_accuracy")))


def model_selection(fr: DataFrame, model_order=None) -> DataFrame:
    """Best model per series by lowest MSE; ties go to the earlier model in
    `model_order` (strict '<' keeps the first best, as the reference does)."""
    per = fr.groupBy(*KEYS, "model").agg(F.avg(F.pow(F.col("forecast") - F.col("actual_sales"), 2)).alias("mse"))
    from shelfcast.operators.forecasts import BASELINES
    order = list(model_order or BASELINES)
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    per = per.withColumn("ord", F.struct(r6("mse").alias("mse"), rank.alias("rank"), F.col("model")))
    return per.groupBy(*KEYS).agg(
        F.min_by("model", "ord").alias("best_model"),
        F.min("ord").getField("mse").alias("best_mse"),
        F.count("*").alias("n_models"))


def inventory_costs(panel: DataFrame, holding_rate: float = HOLDING_RATE,
                    lost_profit_rate: float = LOST_PROFIT_RATE) -> DataFrame:
    """The stock on hand against the day's sales: excess = max(inventory -
    sales, 0) costs `price * holding_rate`, shortage = max(sales - inventory, 0)
    costs `price * lost_profit_rate`; service level = share of days in stock."""
    return _supply_costs(panel, "sales", "inventory", holding_rate, lost_profit_rate)


def forecast_costs(fr: DataFrame, model: str = "seasonal_naive", holding_rate: float = HOLDING_RATE,
                   lost_profit_rate: float = LOST_PROFIT_RATE) -> DataFrame:
    """The same with each day's forecast as the supply."""
    return _supply_costs(one_per_day(fr.where(F.col("model") == model)), "actual_sales", "forecast",
                         holding_rate, lost_profit_rate)


def _supply_costs(days: DataFrame, demand: str, supply: str, holding_rate: float, lost_profit_rate: float) -> DataFrame:
    a, p, price = F.col(demand), F.col(supply), F.col("price")
    excess = F.greatest(p - a, F.lit(0.0))
    short = F.greatest(a - p, F.lit(0.0))
    g = days.groupBy(*KEYS).agg(
        F.count("*").alias("n_days"),
        F.sum(excess).alias("excess_units"),
        F.sum(short).alias("short_units"),
        F.sum(excess * price * F.lit(holding_rate)).alias("holding_cost"),
        F.sum(short * price * F.lit(lost_profit_rate)).alias("stockout_cost"),
        F.avg((a <= p).cast("double")).alias("service_level"),
    )
    return g.select(*KEYS, "n_days", *[r6(c).alias(c) for c in ("excess_units", "short_units")],
                    *[r2(c).alias(c) for c in ("holding_cost", "stockout_cost")], r6("service_level").alias("service_level"))
