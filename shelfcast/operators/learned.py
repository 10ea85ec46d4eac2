"""Learned multi-step forecaster with Spark ML (the reference's neural
models, re-aimed as a pooled direct multi-output linear autoregression).

* Features: the scaled 14 x 7 window flattened feature-major into a 98-long
  vector, or only the mean of its scaled sales (`FEATURE_SETS`); labels: the
  scaled 7 targets.  Ridge fits take one pass over the training windows for all
  seven labels (`leastsquares`); an elastic net is one Spark ML
  `LinearRegression` per horizon step (`fit_steps`).
* Leakage-free by default: time split, scalers fitted on training windows only.
* The panel and the scaled windows are tables of their own in the shared
  folder, so that no pass computes them again.
* Persistence: the ridge model and both scalers are parquet tables, and scoring
  reads them back; the 7 step models of `fit_steps` form one `PipelineModel`
  (`write().overwrite().save` / `PipelineModel.load`).
* Scoring is `mapInPandas`: the model rides with the function and is applied to
  Arrow batches with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import r6
from shelfcast.operators import leastsquares as ls
from shelfcast.operators import scaling as sc
from shelfcast.operators.panel import FEATURES, KEYS
from shelfcast.operators.splits import cutoff_date, time_split
from shelfcast.operators.windows import HORIZON, LOOKBACK, sliding_windows
from shelfcast.session import materialize

# The penalty keeps the normal equations well posed: calendar features are
# collinear (the weekend flag is a function of the weekday).
DEFAULT_REG = 1e-3

# Features of a scaled window.
FEATURE_SETS = {
    "window": lambda: F.flatten(F.array(*[F.col(f"xs_{f}") for f in FEATURES])),
    "mean": lambda: F.array(F.aggregate("xs_sales", F.lit(0.0), lambda a, x: a + x) / F.size("xs_sales")),
}


def split_windows(panel: DataFrame, train_fraction: float = 0.8):
    """Windows with their time split, and the scalers of the training windows."""
    cutoff = cutoff_date(panel, train_fraction)
    windows = time_split(sliding_windows(panel, with_dates=True), cutoff)
    return windows, fit_train_scaler(panel, cutoff), sc.fit_target_scaler(windows.where(F.col("split") == "train"))


def fit_train_scaler(panel: DataFrame, cutoff) -> DataFrame:
    """Input scaler of the windows whose last target day is before `cutoff`."""
    end_date = F.lead("date", LOOKBACK + HORIZON - 1).over(Window.partitionBy(*KEYS).orderBy("date"))
    return sc.fit_input_scaler(panel, selected=F.coalesce(end_date < F.lit(cutoff), F.lit(False)))


def prepared(panel: DataFrame, train_fraction: float = 0.8, features: str = "window"):
    """(scaled, x_params, y_params); `scaled` holds what fitting reads, as a table."""
    panel = materialize(panel, "learn-panel")
    windows, x_params, y_params = split_windows(panel, train_fraction)
    return materialize(scaled_features(windows, x_params, y_params, features), "learn-windows"), x_params, y_params


def scaled_features(windows: DataFrame, x_params: DataFrame, y_params: DataFrame, features: str,
                    carry: tuple[str, ...] = ("split",)) -> DataFrame:
    scaled = sc.scale_windows(windows, x_params, y_params).withColumn("f", FEATURE_SETS[features]())
    return scaled.select(*KEYS, "pos", "start_date", *carry, "f", "ys", "y")


def fit_steps(train: DataFrame, reg: float = DEFAULT_REG, elastic: float = 0.0, max_iter: int = 100) -> PipelineModel:
    rows = train.select(array_to_vector("f").alias("features"), *[F.col("ys")[h].alias(f"label_{h}") for h in range(HORIZON)])
    models = []
    for h in range(HORIZON):
        lr = LinearRegression(featuresCol="features", labelCol=f"label_{h}", predictionCol=f"pred_{h}",
                              regParam=reg, elasticNetParam=elastic, maxIter=max_iter,
                              solver="normal" if elastic == 0.0 else "auto", standardization=False)
        models.append(lr.fit(rows))
    return PipelineModel(stages=models)


def step_models(model: PipelineModel) -> ls.LinearModel:
    """The step models of `fit_steps` as one function."""
    return ls.LinearModel(np.array([m.coefficients.toArray() for m in model.stages]),
                          np.array([m.intercept for m in model.stages]))


def predict(model: ls.LinearModel, scaled: DataFrame, y_params: DataFrame) -> DataFrame:
    """`scaled` with its forecast in sales units."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scaled.schema)
    out = scaled.mapInPandas(pandas_scorer(model), f"{fields}, z array<double>")
    return out.withColumn("forecast", sc.inverse_scale_y(F.col("z"), y_params)).drop("z")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def ar_linear_forecast(panel: DataFrame, model_dir: str, reg: float = DEFAULT_REG, features: str = "window") -> DataFrame:
    """Fit on the training windows, save the model and both scalers, load them
    back, and forecast the test windows from their raw values."""
    spark = panel.sparkSession
    panel = materialize(panel, "learn-panel")
    windows, x_params, y_params = split_windows(panel)
    sc.save_params(x_params, f"{model_dir}/x_params")
    sc.save_params(y_params, f"{model_dir}/y_params")
    train = materialize(scaled_features(windows.where(F.col("split") == "train"), x_params, y_params, features)
                        .select("f", "ys"), "learn-train")
    ls.fit(train, reg).save(spark, f"{model_dir}/model")

    model = ls.LinearModel.load(spark, f"{model_dir}/model")
    x_params, y_params = (sc.load_params(spark, f"{model_dir}/{k}_params") for k in "xy")
    test = scaled_features(windows.where(F.col("split") == "test"), x_params, y_params, features)
    out = predict(model, test.drop("ys", "split"), y_params)
    return out.select(*KEYS, "pos", "start_date", F.transform("forecast", lambda v: r6(v)).alias("forecast"), "y")


def pandas_scorer(model: ls.LinearModel):
    """mapInPandas function applying the model with NumPy to a feature array
    column `f`; other columns pass through.  The coefficients (7 x 98 doubles at
    most) ride in the closure."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.vstack(pdf["f"].to_numpy()) if len(pdf) else np.zeros((0, model.coef.shape[1]))
            yield pdf.assign(z=list(model(x)))
    return score


# Parameters compared by `experiment_grid`: model, season, recency temperature.
GRID = (("seasonal_naive", 1, None), ("seasonal_naive", 7, None), ("seasonal_naive", 14, None),
        ("recency_weighted", None, 0.5), ("recency_weighted", None, 2.0), ("recency_weighted", None, 8.0))


def residual_moments(panel: DataFrame, reg: float = DEFAULT_REG, features: str = "window") -> DataFrame:
    """(step, feature, n, moment) of the fit over the training windows: what
    its normal equations leave, which is zero."""
    scaled, _, _ = prepared(panel, features=features)
    train = scaled.where(F.col("split") == "train").select("f", "ys")
    return ls.residual_moments(train, ls.fit(train, reg), reg)


def experiment_grid(panel: DataFrame, grid=GRID) -> DataFrame:
    """One row per parameter set of the closed-form baselines, with its error
    over all windows and the MAPE < 15 % gate, in one pass: every window sums
    its own errors for all sets, and the sums are aggregated by set."""
    from shelfcast.operators.forecasts import recency_weighted_expr, seasonal_naive_expr
    from shelfcast.operators.metrics import MAPE_EPSILON, MAPE_TARGET
    x, y = F.col("x_sales"), F.col("y")

    def total(f, term):
        return F.aggregate(F.zip_with(f, y, term), F.lit(0.0), lambda a, v: a + v)

    def config(model, season, temperature):
        f = seasonal_naive_expr(x, season=season) if model == "seasonal_naive" else recency_weighted_expr(x, temperature=temperature)
        return F.struct(F.lit(model).alias("model"), F.lit(season).cast("int").alias("season"),
                        F.lit(temperature).cast("double").alias("temperature"),
                        total(f, lambda p, a: F.abs(p - a)).alias("abs"), total(f, lambda p, a: (p - a) * (p - a)).alias("sq"),
                        total(f, lambda p, a: F.abs((a - p) / (a + F.lit(MAPE_EPSILON)))).alias("rel"), F.size(y).alias("n"))
    sums = (sliding_windows(panel).select(F.explode(F.array(*[config(*g) for g in grid])).alias("g")).select("g.*")
            .groupBy("model", "season", "temperature")
            .agg(F.sum("abs").alias("abs"), F.sum("sq").alias("sq"), F.sum("rel").alias("rel"), F.sum("n").alias("n")))
    mape = F.col("rel") / F.col("n") * 100
    return sums.select("model", "season", "temperature", "n", r6(F.col("abs") / F.col("n")).alias("mae"),
                       r6(F.sqrt(F.col("sq") / F.col("n"))).alias("rmse"), r6(mape).alias("mape"),
                       (mape < F.lit(MAPE_TARGET)).alias("meets_target"))
