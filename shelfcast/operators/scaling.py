"""Standard scalers for windows, fitted without materialising the windows.

Input scaler (one mean/scale per feature): the reference flattens every
window to (N*14, 7) rows, so a panel row counts once for every window that
covers it.  That multiplicity is a sliding sum over row positions: with
`start(q)` = 1 when a selected window starts at position q, a row at
position p weighs sum(start(q) for q in p-L+1..p).  One window pass computes
it; the fit is then one weighted aggregate.
No 14x explode, and selecting windows (e.g. train only) just changes `start`.

Target scaler (one mean/scale per horizon step) aggregates `posexplode(y)`.

Parameters form a 14-row table (kind, idx, name, mean, scale); it is bounded
by the feature count, so applying it inlines the values as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.exprs import safe_div
from shelfcast.operators.panel import FEATURES, KEYS
from shelfcast.operators.windows import HORIZON, LOOKBACK

PARAM_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("idx", T.IntegerType()),
    T.StructField("name", T.StringType()), T.StructField("mean", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
])


def window_weights(panel: DataFrame, selected: Column | None = None,
                   lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Panel rows with `weight` = number of selected windows covering the row.
    `selected` is a predicate over (`pos`, `start_date`, keys) of a window start."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    pos = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    framed = panel.withColumns({"pos": pos, "n_rows": n})
    starts = (F.col("pos") <= F.col("n_rows") - lookback - horizon)
    if selected is not None:
        starts = starts & selected
    framed = framed.withColumn("is_start", starts.cast("int"))
    return framed.withColumn("weight", F.sum("is_start").over(w.rowsBetween(-(lookback - 1), 0)))


def fit_input_scaler(panel: DataFrame, selected: Column | None = None) -> DataFrame:
    """(kind, idx, name, mean, scale) per feature: one aggregate of the weight,
    the weighted sum and the weighted squares of every feature."""
    w = F.col("weight").cast("double")
    v = lambda f: F.col(f).cast("double")
    sums = window_weights(panel, selected).where(F.col("weight") > 0).agg(F.sum(w).alias("w"), *[
        x for f in FEATURES for x in (F.sum(w * v(f)).alias(f"s_{f}"), F.sum(w * v(f) * v(f)).alias(f"q_{f}"))])
    rows = F.array(*[F.struct(F.lit("x").alias("kind"), F.lit(i).alias("idx"), F.lit(f).alias("name"),
                              safe_div(f"s_{f}", "w").alias("mean"), safe_div(f"q_{f}", "w").alias("square"))
                     for i, f in enumerate(FEATURES)])
    var = F.col("square") - F.col("mean") * F.col("mean")
    # What rounding leaves of a constant feature's variance is none: scale 1.
    flat = var.isNull() | (var <= F.lit(1e-12) * F.col("square"))
    return sums.select(F.explode(rows).alias("r")).select("r.*").select(
        "kind", "idx", "name", "mean", F.when(flat, F.lit(1.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("scale"))


def fit_target_scaler(windows: DataFrame) -> DataFrame:
    steps = windows.select(F.posexplode("y").alias("idx", "v"))
    g = steps.groupBy("idx").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return g.select(
        F.lit("y").alias("kind"), F.col("idx").cast("int").alias("idx"),
        F.concat(F.lit("y"), (F.col("idx") + 1).cast("string")).alias("name"), "mean",
        F.when(F.col("std").isNull() | (F.col("std") == 0), F.lit(1.0)).otherwise(F.col("std")).alias("scale"))


def _params(params: DataFrame, kind: str) -> list:
    # Bounded: one row per feature or horizon step.
    return sorted((r["idx"], r["mean"], r["scale"]) for r in params.where(F.col("kind") == kind).collect())


def scale_windows(windows: DataFrame, x_params: DataFrame, y_params: DataFrame | None = None) -> DataFrame:
    """z = (v - mean) / scale on every x_<feature> array and on y (per step)."""
    px = {FEATURES[i]: (m, s) for i, m, s in _params(x_params, "x")}
    cols = {f"xs_{f}": F.transform(f"x_{f}", _zscore(*px[f])) for f in FEATURES}
    if y_params is not None:
        py = _params(y_params, "y")
        means = F.array(*[F.lit(m) for _, m, _ in py])
        scales = F.array(*[F.lit(s) for _, _, s in py])
        cols["ys"] = F.transform("y", lambda v, i: (v - F.element_at(means, i + 1)) / F.element_at(scales, i + 1))
    return windows.withColumns(cols)


def _zscore(mean: float, scale: float):
    return lambda v: (v - F.lit(mean)) / F.lit(scale)


def inverse_scale_y(col: Column, y_params: DataFrame) -> Column:
    """Back to sales units with each step's own (mean, scale)."""
    py = _params(y_params, "y")
    means = F.array(*[F.lit(m) for _, m, _ in py])
    scales = F.array(*[F.lit(s) for _, _, s in py])
    return F.transform(col, lambda z, i: z * F.element_at(scales, i + 1) + F.element_at(means, i + 1))


def save_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAM_SCHEMA).parquet(path)
