"""Train/test splits of windows.

* `hash_split`: the reference's seeded random 80/20 split, made engine
  neutral: a window's bucket is md5(seed~store~product~pos) mod 100, so the
  split is stable across runs, partitionings and engines (sizes are ~20 %).
* `time_split`: the leakage-free alternative - one cut-off day for the panel;
  windows entirely before it train, windows entirely after it test, windows
  straddling it are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.panel import date_bounds

# Fixed values of the reference split: seed 42, test share 20 %.
SEED = 42
TEST_PERCENT = 20
TRAIN_FRACTION = 0.8


def hash_bucket(*cols, seed: int = SEED) -> Column:
    key = F.concat_ws("~", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(100)).cast("int")


def hash_split(windows: DataFrame, seed: int = SEED, test_percent: int = TEST_PERCENT) -> DataFrame:
    b = hash_bucket("store_id", "product_id", "pos", seed=seed)
    return windows.withColumns({"bucket": b,
                                "split": F.when(b < test_percent, F.lit("test")).otherwise(F.lit("train"))})


def cutoff_date(panel: DataFrame, train_fraction: float = TRAIN_FRACTION):
    lo, hi = date_bounds(panel)
    import datetime as dt
    return lo + dt.timedelta(days=int((hi - lo).days * train_fraction))


def time_split(windows: DataFrame, cutoff) -> DataFrame:
    """Needs windows built with `with_dates=True` (last target day = y_date[-1])."""
    first, last = F.col("start_date"), F.element_at("y_date", -1)
    split = (F.when(last < F.lit(cutoff), F.lit("train"))
             .when(first >= F.lit(cutoff), F.lit("test")))
    return windows.withColumn("split", split).where(F.col("split").isNotNull())
