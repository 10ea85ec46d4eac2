"""Experiments with the learned model: a rolling-origin grid of penalties."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.exprs import r6
from shelfcast.operators import scaling as sc
from shelfcast.operators.learned import fit_train_scaler, scaled_features
from shelfcast.operators.leastsquares import moments
from shelfcast.operators.metrics import MAPE_EPSILON, MAPE_TARGET
from shelfcast.operators.panel import date_bounds
from shelfcast.operators.windows import HORIZON, sliding_windows
from shelfcast.session import materialize

# Rolling origins, as shares of the panel's days; the last fold ends with the panel.
ORIGINS = (0.5, 0.6, 0.7, 0.8, 0.9)
PENALTIES = (0.0, 1e-3, 1e-2, 1e-1, 1.0)


def learned_grid(panel: DataFrame, features: str = "window", penalties=PENALTIES, origins=ORIGINS) -> DataFrame:
    """One row per penalty and rolling-origin fold of the learned model: the
    training and test windows, the scaled squared loss over the test windows
    (from their moments) and the MAPE in sales units (one scan for all).

    A fold trains on windows that end before its origin and tests on windows
    that lie between its origin and the next.  The scalers are those of the first
    fold's training windows, so that no fold sees later days; a fold without
    windows of either kind has no row."""
    panel = materialize(panel, "grid-panel")
    lo, hi = date_bounds(panel)
    cuts = [lo + dt.timedelta(days=int((hi - lo).days * o)) for o in origins] + [hi + dt.timedelta(days=1)]
    windows = sliding_windows(panel, with_dates=True)
    last = F.element_at("y_date", -1)
    x_params = fit_train_scaler(panel, cuts[0])
    y_params = sc.fit_target_scaler(windows.where(last < F.lit(cuts[0])))
    # A window that ends in block b (after b origins) trains all folds from b
    # on, and tests fold b - 1 if it begins in that block, too.
    block = sum((last >= F.lit(c)).cast("int") for c in cuts[:-1])
    begins = sum((F.col("start_date") >= F.lit(c)).cast("int") for c in cuts[:-1])
    placed = windows.withColumns({"block": block, "inside": (begins == block) & (block > 0)})
    scaled = scaled_features(placed, x_params, y_params, features, ("block", "inside"))
    rows = materialize(scaled.select("block", "inside", "f", "ys", "y"), "grid-windows")
    by_block = moments(rows, ["block", "inside"])
    folds = []
    for k in range(len(cuts) - 1):
        train = [m for (b, _), m in by_block.items() if b <= k]
        test = by_block.get((k + 1, True))
        if not train or test is None:
            continue
        total = train[0]
        for m in train[1:]:
            total = total + m
        for p in penalties:
            model = total.ridge(p)
            folds.append((k, float(p), total.n, test.n, float(test.loss(model).mean()), model))
    return _with_mape(rows, folds, y_params, cuts)


def _with_mape(rows: DataFrame, folds: list[tuple], y_params: DataFrame, cuts: list) -> DataFrame:
    scale = [(r["mean"], r["scale"]) for r in sorted(y_params.collect(), key=lambda r: r["idx"])]  # a row a step
    mean, by = np.array([m for m, _ in scale]), np.array([s for _, s in scale])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, part in b.groupby("block"):
                x, y = np.stack(part["f"].to_numpy()), np.stack(part["y"].to_numpy()).astype(float)
                out += [(k, p, float(np.abs((y - (model(x) * by + mean)) / (y + MAPE_EPSILON)).sum()))
                        for k, p, _, _, _, model in folds if k == block - 1]
            yield pd.DataFrame(out, columns=["fold", "penalty", "rel"])

    sums = (rows.where("inside").select("block", "f", "y").mapInPandas(errors, "fold int, penalty double, rel double")
            .groupBy("fold", "penalty").agg(F.sum("rel").alias("rel")))
    known = rows.sparkSession.createDataFrame(
        [(k, cuts[k], p, n, t, loss) for k, p, n, t, loss, _ in folds],
        "fold int, origin date, penalty double, n_train long, n_test long, loss double")
    mape = F.col("rel") / (F.col("n_test") * HORIZON) * 100
    return known.join(sums, ["fold", "penalty"]).select(
        "fold", "origin", "penalty", "n_train", "n_test", r6("loss").alias("loss"), r6(mape).alias("mape"),
        (mape < F.lit(MAPE_TARGET)).alias("meets_target"))
