"""Look-back / horizon windows over each (store, product) series.

A window starting at row position p holds rows p..p+L-1 as inputs and the
sales of rows p+L..p+L+H-1 as targets (row positions, not calendar days, as
in the reference).  Series with fewer than L+H rows yield no window.

Inputs are kept feature-major: one `array<...>` column per feature
(`x_sales`, `x_price`, ...), each of length L, plus `y` (length H).  That
layout lets every downstream baseline, scaler and metric work with built-in
higher-order functions.

Scale notes: all frames share one `partitionBy(store, product).orderBy(date)`
so the plan has one Exchange and one Sort.  A series' row count is bounded by
the number of calendar days in the panel (the panel grain is one row per
series and day), so a hot series can never grow a window partition beyond
the calendar, however many fact rows feed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.panel import FEATURES, KEYS

# Fixed values of the reference: 14 days in, 7 days out.
LOOKBACK = 14
HORIZON = 7


def series_window():
    return Window.partitionBy(*KEYS).orderBy("date")


def with_position(panel: DataFrame) -> DataFrame:
    """0-based row position within the series and the series length."""
    w = series_window()
    return panel.withColumns({
        "pos": F.row_number().over(w) - 1,
        "n_rows": F.count(F.lit(1)).over(Window.partitionBy(*KEYS)),
    })


def sliding_windows(panel: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON,
                    features=FEATURES, with_dates: bool = False) -> DataFrame:
    w = series_window()
    fx = w.rowsBetween(0, lookback - 1)
    fy = w.rowsBetween(lookback, lookback + horizon - 1)
    cols = [F.collect_list(f).over(fx).alias(f"x_{f}") for f in features]
    cols.append(F.collect_list("sales").over(fy).alias("y"))
    if with_dates:
        cols.append(F.collect_list("date").over(fy).alias("y_date"))
        cols.append(F.collect_list("price").over(fy).alias("y_price"))
    framed = panel.select(
        *KEYS, F.col("date").alias("start_date"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy(*KEYS)).alias("n_rows"),
        *cols,
    )
    # Complete-window gate on row position; the size checks also drop a window
    # whose frame lost a NULL value (collect_list skips NULLs).
    full = framed.where(
        (F.col("pos") <= F.col("n_rows") - lookback - horizon)
        & (F.size("x_sales") == lookback) & (F.size("y") == horizon))
    return full.drop("n_rows")


def window_stats(panel: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Shape report: windows per series (max(0, n-L-H+1)), totals and the
    number of series too short to give a window."""
    per_series = panel.groupBy(*KEYS).agg(F.count("*").alias("n_rows"))
    per_series = per_series.withColumn(
        "n_windows", F.greatest(F.lit(0), F.col("n_rows") - lookback - horizon + 1))
    return per_series.agg(
        F.count("*").alias("n_series"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_windows").alias("n_windows"),
        F.count_if(F.col("n_windows") == 0).alias("series_without_windows"),
        F.min("n_rows").alias("min_series_rows"),
        F.max("n_rows").alias("max_series_rows"),
        F.lit(lookback).alias("lookback"), F.lit(horizon).alias("horizon"),
        F.lit(len(FEATURES)).alias("n_features"),
    )


def latest_window(panel: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """The last `lookback` days of every series, oldest first, as one request
    row: the input a scoring request must carry."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("date").desc())
    recent = panel.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= lookback)
    day = F.struct("date", *FEATURES)
    # The window's exchange on (store, product) already satisfies the grouping.
    g = recent.groupBy(*KEYS).agg(F.array_sort(F.collect_list(day)).alias("days"))
    return g.select(*KEYS,
                    F.col("days")[0]["date"].alias("first_date"),
                    F.element_at("days", -1)["date"].alias("last_date"),
                    F.size("days").alias("n_days"),
                    *[F.transform("days", _field(f)).alias(f"x_{f}") for f in FEATURES])


def _field(name: str):
    return lambda d: d[name]
