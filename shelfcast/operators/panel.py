"""Demand panel: one row per (date, store_id, product_id), built from fact lines.

Scale notes
-----------
* The panel grain is (series, calendar day), so its size is bounded by
  `#series x #days` no matter how many fact lines arrive; at 100 TB the work
  is the fact scan + map-side partial aggregation, and only partial
  aggregates cross the shuffle.
* `nation` (25 rows) is broadcast unconditionally.  How the supplier -> store
  map is joined is left to the planner's size threshold and to AQE, which
  splits a hot supplier's partition.
* Hot (store, product, day) groups are absorbed by the partial aggregation
  before the exchange, so a key holding a third of all lines costs one
  partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.exprs import r2, r6, safe_div, weekday_mon0
from shelfcast.sources.tables import read_table

KEYS = ("store_id", "product_id")
# Panel feature order of the reference (sales first).
FEATURES = ("sales", "price", "promotion", "inventory", "day_of_week", "month", "is_holiday")

# Fixed values of the fact -> panel mapping.
PRODUCTS = 20             # product_id = l_partkey mod 20
PROMO_DISCOUNT = 0.09     # a line with discount >= 0.09 counts as promoted


def store_map(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """(s_suppkey, store_id): supplier's region is the store."""
    nat = F.broadcast(nation.select("n_nationkey", F.col("n_regionkey").cast("int").alias("store_id")))
    return (supplier.select("s_suppkey", "s_nationkey")
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "store_id"))


def calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """day_of_week (Mon=0), month, is_holiday (weekend flag)."""
    d = F.col(date_col)
    return df.withColumns({
        "day_of_week": weekday_mon0(d),
        "month": F.month(d),
        "is_holiday": (weekday_mon0(d) >= 5).cast("int"),
    })


def inventory_offset(store: str = "store_id", product: str = "product_id", date: str = "date"):
    """Deterministic stand-in for the reference's random 10..49 stock buffer."""
    return 10 + F.pmod(F.col(store) * 7 + F.col(product) * 13 + F.dayofyear(F.col(date)), F.lit(40))


def demand_panel(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    stores = store_map(supplier, nation)
    lines = lineitem.select(
        "l_suppkey", "l_quantity", "l_extendedprice",
        (F.col("l_partkey") % PRODUCTS).cast("int").alias("product_id"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_discount") >= F.lit(PROMO_DISCOUNT)).cast("int").alias("promo_line"),
    ).where(F.col("l_partkey").isNotNull() & F.col("l_shipdate").isNotNull())
    daily = (lines.join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy("store_id", "product_id", "date")
             .agg(F.sum("l_quantity").alias("sales"),
                  F.sum("l_extendedprice").alias("revenue"),
                  F.max("promo_line").alias("promotion")))
    panel = daily.select(
        "date", "store_id", "product_id", "sales",
        # Revenue is a sum of cent amounts: rounding it to cents recovers the
        # exact total whatever the summation order, so the unit price is the
        # same double on every run and engine.
        r6(safe_div(r2(F.col("revenue")), F.col("sales"))).alias("price"),
        "promotion",
        (F.col("sales") + inventory_offset()).alias("inventory"),
    )
    return calendar_features(panel)


def load_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(read_table(spark, sf_dir, "lineitem"),
                        read_table(spark, sf_dir, "supplier"),
                        read_table(spark, sf_dir, "nation"))


# ---------------------------------------------------------------- calendar

def date_bounds(panel: DataFrame) -> tuple:
    """Global first/last day: two scalars, the only values brought to the driver."""
    row = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return row["lo"], row["hi"]


def date_spine(panel: DataFrame) -> DataFrame:
    """Every calendar day between the panel's first and last day
    (`pd.date_range(start, end, freq='D')`)."""
    lo, hi = date_bounds(panel)
    spark = panel.sparkSession
    days = (hi - lo).days + 1 if lo is not None else 0
    # Rows come from Spark's range, so the day list is generated in parallel.
    return (spark.range(0, days).select(F.date_add(F.lit(lo), F.col("id").cast("int")).alias("date")))


def series_keys(panel: DataFrame) -> DataFrame:
    return panel.select(*KEYS).distinct()


def dense_panel(panel: DataFrame, fill: float = 0.0) -> DataFrame:
    """Every (day x series) of the panel's span; missing days get zero sales
    (the reference's triple loop).  Each series row expands its own day list
    with `sequence`, so no cartesian join is planned."""
    lo, hi = date_bounds(panel)
    grid = series_keys(panel).select(
        *KEYS, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("date"))
    observed = panel.select("date", *KEYS, "sales", "price", "promotion", "inventory")
    dense = grid.join(observed, ["date", *KEYS], "left").select(
        "date", *KEYS,
        F.coalesce("sales", F.lit(fill)).alias("sales"),
        "price",
        F.coalesce("promotion", F.lit(0)).alias("promotion"),
        F.coalesce("inventory", F.col("sales"), F.lit(fill)).alias("inventory"),
        F.col("sales").isNull().cast("int").alias("imputed"),
    )
    return calendar_features(dense)


def missing_days(panel: DataFrame) -> DataFrame:
    """(series, day) pairs of the span with no panel row: left-anti join."""
    lo, hi = date_bounds(panel)
    grid = series_keys(panel).select(
        *KEYS, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("date"))
    return grid.join(panel.select("date", *KEYS), ["date", *KEYS], "left_anti")


def seasonal_term(panel: DataFrame, amplitude: float = 20.0, period: float = 365.0) -> DataFrame:
    """Yearly sine term `amplitude * sin(2*pi*dayofyear/period)` per day, with the cosine twin."""
    days = panel.select("date").distinct()
    angle = 2 * F.pi() * F.dayofyear("date") / F.lit(period)
    return days.select(
        "date", F.dayofyear("date").alias("day_of_year"),
        r6(F.lit(amplitude) * F.sin(angle)).alias("seasonal_sin"),
        r6(F.lit(amplitude) * F.cos(angle)).alias("seasonal_cos"),
    )


# ---------------------------------------------------------------- EDA

def daily_sales(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.sum("sales").alias("total_sales"),
                                     F.count("*").alias("n_series"))


def weekday_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy("day_of_week").agg(r6(F.avg("sales")).alias("avg_sales"),
                                            F.count("*").alias("n_rows"))


def avg_daily_demand(panel: DataFrame) -> DataFrame:
    """Average daily demand overall (mean of daily totals) and per series."""
    overall = (daily_sales(panel)
               .agg(F.avg("total_sales").alias("avg_daily_demand"),
                    F.count("*").alias("n_days"))
               .select(F.lit(None).cast("int").alias("store_id"),
                       F.lit(None).cast("int").alias("product_id"),
                       r6("avg_daily_demand").alias("avg_daily_demand"), "n_days"))
    per_series = panel.groupBy(*KEYS).agg(r6(F.avg("sales")).alias("avg_daily_demand"),
                                          F.count("*").alias("n_days"))
    return overall.unionByName(per_series)


def seasonality_rollup(panel: DataFrame) -> DataFrame:
    """Mean sales by (month, weekday) with rollup subtotals and the index
    against the grand mean."""
    from pyspark.sql import Window
    rolled = (panel.rollup("month", "day_of_week")
              .agg(F.avg("sales").alias("avg_sales"), F.count("*").alias("n_rows"),
                   F.grouping_id().alias("level")))
    # The rollup has at most 12 x 7 + 12 + 1 rows (calendar cells), so the
    # grand mean is read off its total row with a window over that tiny table.
    grand = F.max(F.when(F.col("level") == 3, F.col("avg_sales"))).over(Window.partitionBy())
    return rolled.select("month", "day_of_week", "level", "n_rows",
                         r6("avg_sales").alias("avg_sales"),
                         r6(safe_div(F.col("avg_sales"), grand)).alias("seasonal_index"))


def product_volatility(panel: DataFrame) -> DataFrame:
    """Coefficient of variation of daily sales per product (over all stores)."""
    return (panel.groupBy("product_id")
            .agg(F.avg("sales").alias("avg_sales"), F.stddev_samp("sales").alias("std_sales"),
                 F.count("*").alias("n_rows"))
            .withColumn("cv", safe_div(F.col("std_sales"), F.col("avg_sales"))))


def volatile_products(panel: DataFrame, k: int = 5) -> DataFrame:
    """Top-k products by coefficient of variation (ties by product id)."""
    v = product_volatility(panel)
    return (v.orderBy(F.col("cv").desc_nulls_last(), "product_id").limit(k)
            .select("product_id", r6("avg_sales").alias("avg_sales"),
                    r6("std_sales").alias("std_sales"), r6("cv").alias("cv"), "n_rows"))


def volatility_rank(panel: DataFrame) -> DataFrame:
    """rank / dense_rank / percent_rank of series by CV (highest first),
    computed with the distributed `global_rank` (no single-task window)."""
    from shelfcast.functions.exprs import global_rank
    s = (panel.groupBy(*KEYS)
         .agg(F.avg("sales").alias("avg_sales"), F.stddev_samp("sales").alias("std_sales"))
         .select(*KEYS, r6(safe_div(F.col("std_sales"), F.col("avg_sales"))).alias("cv")))
    ranked = global_rank(s, "cv", descending=True)
    return ranked.select(*KEYS, "cv", F.col("rank").cast("int").alias("cv_rank"),
                         F.col("dense_rank").cast("int").alias("cv_dense_rank"),
                         r6("percent_rank").alias("cv_percent_rank"))


def promo_uplift(panel: DataFrame) -> DataFrame:
    """Mean sales with and without promotion per product, uplift and uplift %."""
    g = panel.groupBy("product_id").agg(
        F.avg(F.when(F.col("promotion") == 1, F.col("sales"))).alias("avg_promo"),
        F.avg(F.when(F.col("promotion") == 0, F.col("sales"))).alias("avg_base"),
        F.count_if(F.col("promotion") == 1).alias("n_promo"),
        F.count_if(F.col("promotion") == 0).alias("n_base"),
    )
    return g.select(
        "product_id", "n_promo", "n_base",
        r6("avg_promo").alias("avg_promo"), r6("avg_base").alias("avg_base"),
        r6(F.col("avg_promo") - F.col("avg_base")).alias("uplift"),
        r6(safe_div(F.col("avg_promo") - F.col("avg_base"), F.col("avg_base")) * 100).alias("uplift_pct"),
    )


NUMERIC_COLUMNS = ("sales", "price", "promotion", "inventory", "day_of_week", "month", "is_holiday")


def exact_quantiles(df: DataFrame, columns, quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """(column, q0, q1, ...): quantiles with linear interpolation, by rank.

    Values are counted by (column, value), and the counted values range-
    partitioned once into a table; running counts in a partition, on top of the
    totals of the partitions before it, tell which values hold a rank."""
    from pyspark.sql import Window

    from shelfcast.session import materialize
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                          for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    held = materialize(counted.repartitionByRange(n_parts, "column", "v")
                       .withColumn("_pid", F.spark_partition_id()), "quantile-values")
    within = Window.partitionBy("_pid", "column").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and column.
    parts = held.groupBy("_pid", "column").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy("column").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", "column", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                         F.sum("_n").over(Window.partitionBy("column")).alias("_total"))
    ranked = held.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, ["_pid", "column"])
    before = F.col("_off") + F.col("_in")
    at = lambda rank: F.max(F.when((before <= rank) & (rank < before + F.col("n")), F.col("v")))
    aggs = []
    for i, q in enumerate(quantiles):
        place = F.lit(q) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return ranked.groupBy("column").agg(*aggs)


def describe_panel(panel: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """`describe()`: count, mean, std, min, quartiles, max per numeric column,
    one row per column.  Exact percentiles interpolate linearly like pandas;
    `exact=False` uses the bounded-memory `percentile_approx`."""
    aggs = []
    for c in NUMERIC_COLUMNS:
        x = F.col(c).cast("double")
        approx = [] if exact else [F.percentile_approx(x, q, accuracy).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *approx))
    wide = panel.agg(F.array(*aggs).alias("stats"))
    s = wide.select(F.explode("stats").alias("s")).select("s.*")
    if exact:
        s = s.join(exact_quantiles(panel, NUMERIC_COLUMNS), "column", "left")
    s = s.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    return s.select("column", "count", *[r6(c).alias(c) for c in
                                          ("mean", "std", "min", "p25", "p50", "p75", "max")])


def quality_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """`info()`-like profile: type, non-null count, null count and distinct
    count per column, one row per column.  Exact distinct counts expand the
    input once per column; `exact=False` uses HyperLogLog sketches
    (`approx_count_distinct`, one pass, bounded memory) for large tables."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
        aggs.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(c).alias("non_null"), F.count_if(c.isNull()).alias("nulls"),
            distinct.alias("distinct_values"),
        ))
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")
