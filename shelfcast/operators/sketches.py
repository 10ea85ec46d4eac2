"""Mergeable summaries of the panel, kept as a table and merged to any grain.

`sketch_table` holds, for each store and month, a KLL sketch of a numeric column
(quantiles, ranks) and a HyperLogLog sketch of another column's distinct values.
A coarser grain is a merge of these rows: the panel is not read again, and no
value is shuffled.  The KLL sketch with `KLL_K` = 1,000 has a rank error well
under 1 %, the HLL sketch with 2^`HLL_LG_K` registers a standard error of about
0.8 %; `sketch_check` measures both against the exact figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KLL_K = 1_000
HLL_LG_K = 14
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)
RANK_ERROR = 0.01
DISTINCT_ERROR = 0.04


def sketch_table(panel: DataFrame, value: str = "sales", distinct: str = "price", by: tuple[str, ...] = ("store_id",)) -> DataFrame:
    """(by, month, n, sum, quantiles, distincts): one row of sketches a group
    and calendar month; nulls are left out of the sketches."""
    month = F.trunc("date", "month").alias("month_start")
    return panel.groupBy(*by, month).agg(
        F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(HLL_LG_K)).alias("distincts"))


def merged(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sketches of a coarser grain (of the whole table, where `by` is empty)."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distincts").alias("distincts"))


def quantiles(sketches: DataFrame, by: tuple[str, ...], probabilities=PROBABILITIES) -> DataFrame:
    """(by, n, mean, n_distinct, probability, quantile), one row a probability."""
    each = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double(
        "quantiles", F.lit(float(p))).alias("quantile")) for p in probabilities])
    rows = sketches.where(F.col("n") > 0).select(
        *by, "n", (F.col("total") / F.col("n")).alias("mean"), F.hll_sketch_estimate("distincts").alias("n_distinct"),
        F.explode(each).alias("_q"))
    return rows.select(*by, "n", "mean", "n_distinct", "_q.probability", "_q.quantile")


def sketch_check(panel: DataFrame, sketches: DataFrame, by: tuple[str, ...] = ("store_id",), value: str = "sales",
                 distinct: str = "price") -> DataFrame:
    """(by, probability, n, rank_ok, distinct_ok): whether each merged quantile's
    exact rank is within `RANK_ERROR` of its probability (a value with ties holds
    all their ranks), and the distinct count within `DISTINCT_ERROR`."""
    found = quantiles(merged(sketches, by), by)
    wide = found.groupBy(*by).pivot("probability", [float(p) for p in PROBABILITIES]).agg(F.first("quantile"))
    names = [f"q{i}" for i in range(len(PROBABILITIES))]
    limits = wide.toDF(*by, *names)
    v = F.col(value).cast("double")
    ranks = panel.join(limits, list(by)).where(v.isNotNull()).groupBy(*by).agg(
        *[F.struct(F.count_if(v < F.col(q)).alias("below"), F.count_if(v <= F.col(q)).alias("upto")).alias(q) for q in names],
        F.count_distinct(distinct).alias("exact_distinct"))
    rows = found.join(ranks, list(by))
    pick = F.coalesce(*[F.when(F.col("probability") == float(p), F.col(q)) for p, q in zip(PROBABILITIES, names)])
    return rows.withColumn("_r", pick).select(
        *by, "probability", "n",
        ((F.col("_r.below") / F.col("n") <= F.col("probability") + RANK_ERROR)
         & (F.col("_r.upto") / F.col("n") >= F.col("probability") - RANK_ERROR)).alias("rank_ok"),
        (F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= F.col("exact_distinct") * DISTINCT_ERROR).alias("distinct_ok"))
