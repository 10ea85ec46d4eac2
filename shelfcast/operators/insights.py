"""Per-series context, rule-based recommendations and instruction datasets.

Everything here is one aggregation per series over the forecast results,
followed by projections: a single shuffle on (store, product), shared by the
`row_number` that picks the last 7 actuals, so the bounded `collect_list`
never holds more than 7 values per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import rules
from shelfcast.functions.exprs import bround2, r6, safe_div
from shelfcast.operators.forecasts import one_per_day
from shelfcast.operators.panel import KEYS

RECENT_DAYS = 7
# The three instruction texts of the reference.
DEMAND_INSTRUCTION = ("Analyze the demand pattern for this product and provide procurement "
                      "recommendations.")
INVENTORY_INSTRUCTION = "Based on the sales data, recommend optimal inventory levels."
RISK_INSTRUCTION = "Identify supply chain risks for this product."
# Fixed value: training-text layout.
TRAINING_TEXT = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"


def series_metrics(forecast_results: DataFrame, model: str = "seasonal_naive",
                   recent: int = RECENT_DAYS, daily: bool = False) -> DataFrame:
    """avg sales, forecast accuracy, trend (last vs first by date, ties count
    as decreasing), sample std, the last `recent` actuals in date order, over
    one forecast per day up to the series' last day; `daily` rows (of
    `forecasts.daily_forecasts`) are that already."""
    fr = forecast_results.where(F.col("model") == model)
    fr = fr if daily else one_per_day(fr)
    w = Window.partitionBy(*KEYS).orderBy(F.col("date").desc())
    ranked = fr.withColumn("rk", F.row_number().over(w))
    a, f = F.col("actual_sales"), F.col("forecast")
    g = ranked.groupBy(*KEYS).agg(
        F.count("*").alias("n_days"),
        F.avg(a).alias("avg_sales"),
        F.avg(F.abs(f - a)).alias("mae"),
        F.min_by(a, "date").alias("first_sales"),
        F.max_by(a, "date").alias("last_sales"),
        F.stddev_samp(a).alias("volatility"),
        F.avg(f).alias("avg_forecast"),
        F.collect_list(F.when(F.col("rk") <= recent, F.struct("date", a.alias("v")))).alias("tail"),
    )
    return g.select(
        *KEYS, "n_days", "avg_sales", "avg_forecast",
        (F.lit(1.0) - safe_div(F.col("mae"), F.col("avg_sales"))).alias("forecast_accuracy"),
        F.when(F.col("last_sales") > F.col("first_sales"), F.lit("increasing"))
         .otherwise(F.lit("decreasing")).alias("trend"),
        "volatility",
        F.transform(F.array_sort("tail"), lambda s: s["v"]).alias("recent_sales"),
    )


def context_json(store, product, avg, acc, trend, vol, recent) -> F.Column:
    """`json.dumps(context)` text: ', ' and ': ' separators, Python float text."""
    nums = F.array_join(F.transform(recent, lambda v: rules.py_repr(v)), ", ")
    return F.concat(
        F.lit('{"store_id": '), store.cast("string"),
        F.lit(', "product_id": '), product.cast("string"),
        F.lit(', "avg_daily_sales": '), rules.py_repr_2dp(avg),
        F.lit(', "forecast_accuracy": '), rules.py_repr_2dp(acc),
        F.lit(', "trend": "'), trend,
        F.lit('", "volatility": '), rules.py_repr_2dp(vol),
        F.lit(', "recent_sales": ['), nums, F.lit("]}"),
    )


def series_context(metrics: DataFrame) -> DataFrame:
    """Context record per series: values rounded half-to-even to 2 dp, the
    accuracy as a percentage, and its JSON text; keeps raw avg/volatility for
    the risk trigger, which the reference evaluates on unrounded values."""
    ctx = metrics.select(
        *KEYS,
        bround2("avg_sales").alias("avg_daily_sales"),
        bround2(F.col("forecast_accuracy") * 100).alias("forecast_accuracy"),
        "trend",
        bround2("volatility").alias("volatility"),
        "recent_sales",
        F.col("avg_sales").alias("raw_avg_sales"),
        F.col("volatility").alias("raw_volatility"),
    )
    return ctx.withColumn("context_json", context_json(
        F.col("store_id"), F.col("product_id"), F.col("avg_daily_sales"), F.col("forecast_accuracy"),
        F.col("trend"), F.col("volatility"), F.col("recent_sales")))


def demand_analysis(ctx: DataFrame) -> DataFrame:
    avg, vol = F.col("avg_daily_sales"), F.col("volatility")
    return ctx.select(
        *KEYS, "avg_daily_sales", "forecast_accuracy", "volatility",
        rules.order_quantity(avg).alias("order_quantity"),
        rules.safety_stock_simple(vol).alias("safety_stock"),
        rules.reorder_point_simple(avg, vol).alias("reorder_point"),
        F.when(F.col("forecast_accuracy") > rules.RELIABLE_ACCURACY, F.lit(rules.RELIABLE))
         .otherwise(F.lit(rules.NEEDS_WORK)).alias("accuracy_grade"),
        F.when(rules.is_volatile(avg, vol), F.lit(rules.VOL_HIGH))
         .otherwise(F.lit(rules.VOL_MODERATE)).alias("volatility_class"),
        rules.demand_analysis_text(F.col("store_id"), F.col("product_id"), avg,
                                   F.col("forecast_accuracy"), F.col("trend"), vol).alias("text"),
    )


def inventory_recommendation(ctx: DataFrame) -> DataFrame:
    avg, vol = F.col("avg_daily_sales"), F.col("volatility")
    return ctx.select(
        *KEYS, "avg_daily_sales", "volatility",
        rules.safety_stock_service(vol).alias("safety_stock"),
        rules.reorder_point_service(avg, vol).alias("reorder_point"),
        rules.economic_order_quantity(avg).alias("economic_order_quantity"),
        F.when(avg > rules.ADEQUATE_VOLUME, F.lit(rules.STOCK_OK))
         .otherwise(F.lit(rules.STOCK_JIT)).alias("stock_status"),
        rules.inventory_text(F.col("product_id"), avg, vol).alias("text"),
    )


def risk_filter(ctx: DataFrame, ratio: float = rules.VOLATILITY_RATIO) -> DataFrame:
    """Series whose raw volatility exceeds `ratio` x raw average."""
    return ctx.where(rules.is_volatile(F.col("raw_avg_sales"), F.col("raw_volatility"), ratio)).select(
        *KEYS, r6("raw_avg_sales").alias("avg_sales"), r6("raw_volatility").alias("volatility"),
        r6(rules.coefficient_of_variation_pct(F.col("raw_avg_sales"), F.col("raw_volatility"))).alias("cv_pct"))


def risk_assessment(ctx: DataFrame) -> DataFrame:
    avg, vol = F.col("avg_daily_sales"), F.col("volatility")
    return ctx.where(rules.is_volatile(F.col("raw_avg_sales"), F.col("raw_volatility"))).select(
        *KEYS, "avg_daily_sales", "volatility",
        r6(rules.coefficient_of_variation_pct(avg, vol)).alias("cv_pct"),
        rules.risk_safety_stock(vol).alias("raised_safety_stock"),
        rules.risk_text(F.col("product_id"), avg, vol, F.col("trend")).alias("text"),
    )


def instruction_examples(ctx: DataFrame, keep_context: bool = False) -> DataFrame:
    """Two examples per series plus a risk example when the raw volatility
    exceeds 0.3 x raw average: one pass, `explode` of a filtered array."""
    avg, vol = F.col("avg_daily_sales"), F.col("volatility")
    inp = F.col("context_json")
    ex = F.array(
        F.struct(F.lit(1).alias("kind"), F.lit(DEMAND_INSTRUCTION).alias("instruction"), inp.alias("input"),
                 rules.demand_analysis_text(F.col("store_id"), F.col("product_id"), avg,
                                            F.col("forecast_accuracy"), F.col("trend"), vol).alias("output")),
        F.struct(F.lit(2).alias("kind"), F.lit(INVENTORY_INSTRUCTION).alias("instruction"), inp.alias("input"),
                 rules.inventory_text(F.col("product_id"), avg, vol).alias("output")),
        F.when(rules.is_volatile(F.col("raw_avg_sales"), F.col("raw_volatility")),
               F.struct(F.lit(3).alias("kind"), F.lit(RISK_INSTRUCTION).alias("instruction"), inp.alias("input"),
                        rules.risk_text(F.col("product_id"), avg, vol, F.col("trend")).alias("output"))),
    )
    kept = F.filter(ex, lambda e: e.isNotNull())
    extra = ["avg_daily_sales", "volatility"] if keep_context else []
    return ctx.select(*KEYS, *extra, F.explode(kept).alias("e")).select(*KEYS, "e.*", *extra)


def instruction_text(examples: DataFrame) -> DataFrame:
    return examples.select(*KEYS, "kind", rules.fill_template(TRAINING_TEXT, {
        "instruction": F.col("instruction"), "input": F.col("input"), "output": F.col("output"),
    }).alias("text"))


def instruction_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("kind", "instruction").agg(F.count("*").alias("n_examples"))


def knowledge_base(metrics: DataFrame, constant_trend: bool = False) -> DataFrame:
    """(store_id, product_id, avg_sales, avg_forecast, trend).  The reference
    hard-codes 'increasing'; `constant_trend=True` reproduces that, the default
    keeps the computed trend."""
    trend = F.lit("increasing") if constant_trend else F.col("trend")
    return metrics.select(*KEYS, "avg_sales", "avg_forecast", trend.alias("trend"))


def kb_text(kb: DataFrame) -> DataFrame:
    """"Product p at Store s: Average sales a, trend t" (a printed as Python does)."""
    return kb.select(*KEYS, F.concat(
        F.lit("Product "), F.col("product_id").cast("string"), F.lit(" at Store "),
        F.col("store_id").cast("string"), F.lit(": Average sales "), rules.py_repr(F.col("avg_sales")),
        F.lit(", trend "), F.col("trend")).alias("text"))


PAD = "<pad>"
MAX_TOKENS = 512


def token_budget(texts: DataFrame, max_tokens: int = MAX_TOKENS, pad: str = PAD) -> DataFrame:
    """Batched tokenisation to a fixed length: whitespace tokens truncated to
    `max_tokens` and padded; the text column is dropped (only tokens and the
    truncation report remain)."""
    from shelfcast.functions.exprs import word_tokens
    tok = word_tokens("text")
    kept = F.slice(tok, 1, max_tokens)
    out = texts.select(*KEYS, "kind", tok.alias("_tok")).withColumn("_kept", F.slice("_tok", 1, max_tokens))
    return out.select(
        *KEYS, "kind", F.size("_tok").alias("n_tokens"), F.size("_kept").alias("n_kept"),
        (F.lit(max_tokens) - F.size("_kept")).alias("n_pad"), (F.size("_tok") > max_tokens).alias("truncated"),
        F.concat("_kept", F.array_repeat(F.lit(pad), F.lit(max_tokens) - F.size("_kept"))).alias("input_tokens"))
