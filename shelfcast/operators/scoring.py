"""Batch scoring: forecast requests as rows, one bad request never fails the batch.

The reference serves one JSON request at a time and loops over a batch
sequentially.  Here a batch is a DataFrame of requests; validation, model
routing, forecasting and interval computation are one projection, and the
error of a request is a nullable column of its row.

Requests are derived from the panel (the latest days of every series), so
the batch grows with the data.  Two requests per series:
* `rows`: the last 14 rows of the series (valid);
* `calendar`: the rows inside the last 14 calendar days (short when the
  series has gaps -> rejected with the reference's message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions import rules
from shelfcast.functions.exprs import array_pop_std
from shelfcast.operators.forecasts import MODEL_EXPRS
from shelfcast.operators.panel import FEATURES, KEYS
from shelfcast.operators.windows import LOOKBACK

# Request contract and messages of the reference.
DEFAULT_FRAMEWORK = "pytorch"
WRONG_LENGTH = "Historical data must contain exactly 14 days"
NOT_LOADED = {"pytorch": "PyTorch model not loaded", "tensorflow": "TensorFlow model not loaded"}
MISSING_FIELD = "Historical data has a missing field"
# Which model answers each framework name; any name other than "pytorch"
# goes to the "tensorflow" entry, as in the reference.
FRAMEWORK_MODELS = (("pytorch", "recency_weighted"), ("tensorflow", "seasonal_naive"))

DAY_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("sales", T.DoubleType()),
    T.StructField("price", T.DoubleType()), T.StructField("promotion", T.IntegerType()),
    T.StructField("inventory", T.DoubleType()), T.StructField("day_of_week", T.IntegerType()),
    T.StructField("month", T.IntegerType()), T.StructField("is_holiday", T.IntegerType()),
])
REQUEST_SCHEMA = T.StructType([
    T.StructField("store_id", T.IntegerType()), T.StructField("product_id", T.IntegerType()),
    T.StructField("historical_data", T.ArrayType(DAY_SCHEMA)),
    T.StructField("framework", T.StringType()),
])
INSIGHT_CONTEXT = T.StructType([
    T.StructField("avg_sales", T.DoubleType()), T.StructField("trend", T.StringType()),
    T.StructField("volatility", T.DoubleType()),
])


def forecast_requests(panel: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(store_id, product_id, kind, framework, historical_data) built in one
    window pass + one grouping on the same (store, product) partitioning."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("date").desc())
    last = F.max("date").over(Window.partitionBy(*KEYS))
    tagged = panel.select(*KEYS, "date", *FEATURES, F.row_number().over(w).alias("rk"), last.alias("last_date"))
    day = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), *FEATURES)
    g = tagged.groupBy(*KEYS).agg(
        F.collect_list(F.when(F.col("rk") <= lookback, day)).alias("rows"),
        F.collect_list(F.when(F.col("date") > F.date_sub("last_date", lookback), day)).alias("calendar"),
    )
    both = g.select(*KEYS, F.explode(F.array(
        F.struct(F.lit("rows").alias("kind"), F.array_sort("rows").alias("h")),
        F.struct(F.lit("calendar").alias("kind"), F.array_sort("calendar").alias("h")))).alias("r"))
    framework = F.when(F.col("store_id") % 2 == 0, F.lit("pytorch")).otherwise(F.lit("tensorflow"))
    return both.select(*KEYS, F.col("r.kind").alias("kind"), framework.alias("framework"),
                       F.col("r.h").alias("historical_data"))


def framework_models(spark: SparkSession, available=FRAMEWORK_MODELS) -> DataFrame:
    return spark.createDataFrame(list(available), "framework_key string, model string")


def _pick_forecast(model: Column, x: Column) -> Column:
    expr = F.lit(None).cast("array<double>")
    for name, fn in MODEL_EXPRS.items():
        expr = F.when(model == name, fn(x)).otherwise(expr)
    return expr


def batch_forecast(requests: DataFrame, models: DataFrame, with_timestamp: bool = False) -> DataFrame:
    """Responses: forecast (7 values), intervals, nullable insights, and an
    `error` text for rejected requests (length check, missing model, missing
    field).  `models` is the framework -> model table (a handful of rows,
    broadcast); a framework whose model row is absent gets 'not loaded'."""
    key = F.when(F.col("framework") == "pytorch", F.lit("pytorch")).otherwise(F.lit("tensorflow"))
    routed = requests.withColumn("framework_key", key).join(F.broadcast(models), "framework_key", "left")
    hist = F.col("historical_data")
    x = F.transform(hist, lambda d: d["sales"])
    any_null = F.exists(hist, lambda d: F.exists(
        F.array(*[d[f].isNull() for f in FEATURES]), lambda b: b))
    error = (F.when(F.size(hist) != LOOKBACK, F.lit(WRONG_LENGTH))
             .when(F.col("model").isNull(), F.when(F.col("framework_key") == "pytorch", F.lit(NOT_LOADED["pytorch"]))
                   .otherwise(F.lit(NOT_LOADED["tensorflow"])))
             .when(any_null, F.lit(MISSING_FIELD)))
    fc = _pick_forecast(F.col("model"), x)
    sigma = array_pop_std(x)
    out = routed.select(
        *KEYS, "kind", "framework", error.alias("error"),
        F.when(error.isNull(), fc).alias("forecast"),
        F.when(error.isNull(), rules.prediction_intervals(fc, sigma)).alias("confidence_intervals"),
        F.lit(None).cast("string").alias("insights"),
    )
    if with_timestamp:
        out = out.withColumn("generated_at", F.current_timestamp())
    return out


def batch_summary(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count("*").alias("total"),
                         F.count_if(F.col("error").isNull()).alias("successful"),
                         F.count_if(F.col("error").isNotNull()).alias("failed"))


def requests_to_json(requests: DataFrame) -> DataFrame:
    """Request bodies as JSON text (the API's wire format)."""
    return requests.select(*KEYS, "kind", F.to_json(F.struct(
        "store_id", "product_id", "historical_data", "framework")).alias("body"))


def parse_requests(bodies: DataFrame) -> DataFrame:
    """JSON bodies -> typed request rows with `from_json`; a missing framework
    defaults to "pytorch" as in the request model."""
    r = bodies.select("kind", F.from_json("body", REQUEST_SCHEMA).alias("r"))
    return r.select("r.store_id", "r.product_id", "kind",
                    F.coalesce("r.framework", F.lit(DEFAULT_FRAMEWORK)).alias("framework"),
                    F.col("r.historical_data").alias("historical_data"))


# ---------------------------------------------------------------- insights

# Fixed value: the question attached to generated insight requests.
INSIGHT_QUESTION = "What inventory actions do you recommend for this product?"
# The inference prompt of the reference and its numbered-ask form.
INFERENCE_PROMPT = ("### Instruction:\n{query}\n\n### Input:\nStore: {store_id}\nProduct: {product_id}\n"
                    "Context: {context}\n\n### Response:")
ANALYSIS_PROMPT = ("Analyze the following product data and provide:\n1. Demand trend assessment\n"
                   "2. Inventory recommendations\n3. Risk factors\n\nData: {json_data}\n\n"
                   "Focus on actionable insights for procurement team.")


def insight_requests(ctx: DataFrame, question: str = INSIGHT_QUESTION) -> DataFrame:
    """One insight request per series; its context carries the series-context
    values (2 dp), as a client holding that record would send them."""
    return ctx.select(*KEYS, F.lit(question).alias("query"), F.struct(
        F.col("avg_daily_sales").alias("avg_sales"), "trend",
        F.col("volatility").alias("volatility")).alias("context"))


def rule_insights(requests: DataFrame, with_timestamp: bool = False) -> DataFrame:
    c = F.col("context")
    out = requests.select(*KEYS, "query", rules.rule_insight_text(
        c["avg_sales"], c["trend"], c["volatility"]).alias("insights"))
    if with_timestamp:
        out = out.withColumn("generated_at", F.current_timestamp())
    return out


# ---------------------------------------------------------------- free-form contexts

INVALID_BODY = "Request is not a JSON object"
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$"


def _typed(body: Column, path: str, kind: str, pattern: str) -> Column:
    """The value at `path` where its own type matches; null where it is missing
    or of another type (a number written as text is text)."""
    value = F.try_variant_get(body, path, "variant")
    return F.when(F.schema_of_variant(value).rlike(pattern), F.try_variant_get(body, path, kind))


def free_form_insights(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Insights of requests whose context is any JSON: its known keys count
    where they have the right type, and take the rule's defaults elsewhere;
    other keys are ignored.  A body that is no JSON object has an `error` and no
    insights.  Other columns of `bodies` pass through."""
    v = F.try_parse_json(body)
    rest = [c for c in bodies.columns if c != body]
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    read = bodies.select(
        *rest, F.when(~is_object, F.lit(INVALID_BODY)).alias("error"), _typed(v, "$.query", "string", "^STRING$").alias("query"),
        F.coalesce(_typed(v, "$.context.avg_sales", "double", NUMBERS), F.lit(0.0)).alias("avg_sales"),
        F.coalesce(_typed(v, "$.context.trend", "string", "^STRING$"), F.lit("stable")).alias("trend"),
        F.coalesce(_typed(v, "$.context.volatility", "double", NUMBERS), F.lit(0.0)).alias("volatility"))
    text = rules.rule_insight_text(F.col("avg_sales"), F.col("trend"), F.col("volatility"))
    return read.withColumn("insights", F.when(F.col("error").isNull(), text))


def free_form_requests(ctx: DataFrame, question: str = INSIGHT_QUESTION) -> DataFrame:
    """One body per series, as clients of all sorts send them: `kind` 0 whole, 1
    without the mean, 2 with more keys, 3 with values of other types, 4 with a
    text for a context, 5 cut off."""
    kind = F.pmod(F.col("store_id") * 7 + F.col("product_id"), F.lit(6)).cast("int")
    avg, trend, vol = F.col("avg_daily_sales"), F.col("trend"), F.col("volatility")
    whole = F.struct(avg.alias("avg_sales"), "trend", vol.alias("volatility"))
    contexts = [whole, F.struct("trend", vol.alias("volatility")),
                F.struct(avg.alias("avg_sales"), "trend", vol.alias("volatility"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
                         F.struct(F.lit(1).alias("avg_sales")).alias("nested")),
                F.struct(avg.cast("string").alias("avg_sales"), F.lit(3).alias("trend"), F.array(vol).alias("volatility")),
                F.lit("see above"), whole]
    texts = [F.to_json(F.struct("store_id", "product_id", F.lit(question).alias("query"), c.alias("context"))) for c in contexts]
    texts[5] = F.substring(texts[5], F.lit(1), F.length(texts[5]) - 2)
    return ctx.select(*KEYS, kind.alias("kind"), F.element_at(F.array(*texts), kind + 1).alias("body"))


def context_repr(c: Column) -> Column:
    """Python `str(dict)` of the context: single quotes, Python float text."""
    def val(x, is_text=False):
        if is_text:
            return F.when(x.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), x, F.lit("'")))
        return F.when(x.isNull(), F.lit("None")).otherwise(rules.py_repr(x))
    return F.concat(F.lit("{'avg_sales': "), val(c["avg_sales"]), F.lit(", 'trend': "),
                    val(c["trend"], True), F.lit(", 'volatility': "), val(c["volatility"]), F.lit("}"))


def insight_prompt(requests: DataFrame) -> DataFrame:
    ctx_text = context_repr(F.col("context"))
    prompt = rules.fill_template(INFERENCE_PROMPT, {
        "query": F.col("query"), "store_id": F.col("store_id"), "product_id": F.col("product_id"),
        "context": ctx_text})
    return requests.select(*KEYS, prompt.alias("prompt"))


def analysis_prompt(ctx: DataFrame) -> DataFrame:
    """The numbered-ask template over the series context JSON."""
    return ctx.select(*KEYS, rules.fill_template(ANALYSIS_PROMPT, {"json_data": F.col("context_json")})
                      .alias("prompt"))
