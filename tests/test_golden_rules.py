"""Hand-computed golden rows (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import rules
from shelfcast.functions.exprs import array_pop_std, extract_numbers
from shelfcast.operators import insights as ins
from shelfcast.operators import metrics as mt
from shelfcast.operators import scoring as scr
from shelfcast.operators import textscore as ts


@pytest.mark.parametrize("avg,vol,oq,ss,rp,ss95,rp95,eoq,cv,raised,cls,stock", [
    (45.2, 15.5, 632, 31, 347, 67, 383, 812, "34.3", 38, "high", rules.STOCK_OK),
    (25.0, 5.0, 350, 10, 185, 21, 196, 604, "20.0", 12, "moderate", rules.STOCK_JIT),
    (30.0, 9.0, 420, 18, 228, 39, 249, 661, "30.0", 22, "moderate", rules.STOCK_JIT),
])
def test_inventory_rules(spark, avg, vol, oq, ss, rp, ss95, rp95, eoq, cv, raised, cls, stock):
    df = spark.createDataFrame([(avg, vol)], "a double, v double")
    a, v = F.col("a"), F.col("v")
    r = df.select(
        rules.order_quantity(a), rules.safety_stock_simple(v), rules.reorder_point_simple(a, v),
        rules.safety_stock_service(v), rules.reorder_point_service(a, v), rules.economic_order_quantity(a),
        F.format_string("%.1f", F.bround(rules.coefficient_of_variation_pct(a, v), 1)),
        rules.risk_safety_stock(v),
        F.when(rules.is_volatile(a, v), "high").otherwise("moderate"),
        F.when(a > rules.ADEQUATE_VOLUME, rules.STOCK_OK).otherwise(rules.STOCK_JIT)).first()
    assert tuple(r) == (oq, ss, rp, ss95, rp95, eoq, cv, raised, cls, stock)


def _fr(spark):
    actual = [10, 20, 30, 40, 50, 60, 70, 80]
    fcst = [12, 18, 33, 40, 45, 66, 70, 76]
    import datetime as dt
    rows = [(0, 1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1, "seasonal_naive", float(a), float(f), 10.0)
            for i, (a, f) in enumerate(zip(actual, fcst))]
    return spark.createDataFrame(rows, "store_id int, product_id int, date date, horizon int, model string, "
                                       "actual_sales double, forecast double, price double")


def test_series_metrics_golden(spark):
    m = ins.series_metrics(_fr(spark)).first()
    assert m["avg_sales"] == 45.0
    assert round(m["forecast_accuracy"] * 100, 2) == 93.89
    assert m["trend"] == "increasing"
    assert round(m["volatility"], 2) == 24.49
    assert m["recent_sales"] == [20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0]
    ctx = ins.series_context(ins.series_metrics(_fr(spark))).first()
    assert ctx["context_json"] == ('{"store_id": 0, "product_id": 1, "avg_daily_sales": 45.0, '
                                   '"forecast_accuracy": 93.89, "trend": "increasing", "volatility": 24.49, '
                                   '"recent_sales": [20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0]}')
    ex = ins.instruction_examples(ins.series_context(ins.series_metrics(_fr(spark))))
    assert sorted(r["kind"] for r in ex.collect()) == [1, 2, 3]     # risk example emitted


def test_error_metrics_golden(spark):
    r = mt.forecast_metrics(_fr(spark)).first()
    assert r["mse"] == 11.75 and r["mae"] == 2.75 and r["bias"] == 0.0
    assert abs(r["mape"] - 8.124999996) < 1e-6 and r["mape_nonzero"] == 8.125
    assert abs(r["rmse"] - 3.427827) < 1e-6
    d = mt.direction_accuracy(_fr(spark)).first()
    assert d["direction_accuracy"] == 1.0 and d["n_pairs"] == 7


def test_prediction_interval_golden(spark):
    df = spark.createDataFrame([([40.0 + 2 * i for i in range(14)],)], "x array<double>")
    sig = df.select(array_pop_std("x")).first()[0]
    assert abs(sig - 8.062258) < 1e-6
    iv = df.select(rules.prediction_intervals(F.array(F.lit(10.0), F.lit(52.0)), array_pop_std("x")).alias("i")).first()["i"]
    assert iv[0]["day"] == 1 and iv[0]["lower"] == 0.0 and abs(iv[0]["upper"] - 25.802025) < 1e-6
    assert abs(iv[1]["lower"] - 36.197975) < 1e-6 and abs(iv[1]["upper"] - 67.802025) < 1e-6
    const = spark.createDataFrame([([5.0] * 14,)], "x array<double>")
    c = const.select(rules.prediction_intervals(F.array(F.lit(7.0)), array_pop_std("x")).alias("i")).first()["i"][0]
    assert c["lower"] == c["upper"] == 7.0


def test_rule_insight_empty_context(spark):
    df = spark.createDataFrame([(None, None, None)], "a double, t string, v double")
    txt = df.select(rules.rule_insight_text(F.col("a"), F.col("t"), F.col("v"))).first()[0]
    assert txt == ("Demand Analysis:\n- Average daily sales: 0.00 units\n- Trend: stable\n- Volatility: Moderate\n\n"
                   "Recommendations:\n- Safety stock: 0 units\n- Reorder point: 0 units\n- Review frequency: Weekly\n")


def test_numeric_accuracy_golden(spark):
    df = spark.createDataFrame([("Order 632 units, safety 31", {"order": 632.0, "safety": 31.0, "eoq": 812.0}),
                                ("nothing", {})], "t string, m map<string,double>")
    out = df.select(*ts.numeric_accuracy_expr(F.col("t"), F.col("m"))).collect()
    assert (out[0][0], out[0][1]) == (3, 2) and abs(out[0][2] - 2 / 3) < 1e-12
    assert out[1][2] == 0.0


def test_extract_numbers_golden(spark):
    df = spark.createDataFrame([("a 12 b 3.5 c 7.",)], "t string")
    assert df.select(extract_numbers("t")).first()[0] == ["12", "3.5", "7."]


def test_lcs_golden():
    assert ts.lcs_length("the cat on mat".split(), "the cat sat on the mat".split()) == 4


def test_batch_validation(spark):
    day = lambda i: {"date": f"2024-11-{i + 1:02d}", "sales": 40.0 + i, "price": 10.5, "promotion": 0,
                     "inventory": 100.0, "day_of_week": i % 7, "month": 11, "is_holiday": 0}
    reqs = [(0, n, "x", "pytorch", [day(i) for i in range(n)]) for n in (13, 14, 15)]
    reqs.append((1, 14, "x", "tensorflow", [day(i) for i in range(14)]))
    df = spark.createDataFrame(reqs, "store_id int, product_id int, kind string, framework string, "
                               "historical_data array<struct<date:string,sales:double,price:double,promotion:int,"
                               "inventory:double,day_of_week:int,month:int,is_holiday:int>>")
    # Only the pytorch model is loaded: the tensorflow request gets 'not loaded'.
    models = scr.framework_models(spark, available=(("pytorch", "recency_weighted"),))
    out = {(r["store_id"], r["product_id"]): r for r in scr.batch_forecast(df, models).collect()}
    assert out[(0, 13)]["error"] == scr.WRONG_LENGTH and out[(0, 15)]["error"] == scr.WRONG_LENGTH
    assert out[(0, 14)]["error"] is None and len(out[(0, 14)]["forecast"]) == 7
    assert out[(1, 14)]["error"] == "TensorFlow model not loaded"
    s = scr.batch_summary(scr.batch_forecast(df.where("store_id = 0"), models)).first()
    assert (s["total"], s["successful"]) == (3, 1)


def test_py_float_text(spark):
    df = spark.createDataFrame([(45.2,), (45.0,), (45.05,), (-3.5,), (123456789.25,)], "x double")
    got = [r[0] for r in df.select(rules.py_repr_2dp("x")).collect()]
    assert got == [repr(45.2), repr(45.0), repr(45.05), repr(-3.5), repr(123456789.25)]
    got = [r[0] for r in df.select(rules.py_repr("x")).collect()][:4]
    assert got == [repr(45.2), repr(45.0), repr(45.05), repr(-3.5)]


def test_fixed_matches_python_on_binary_ties(spark):
    vals = [45.125, 0.125, 2.5, 10.375, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from shelfcast.functions.exprs import fixed
    got = [r[0] for r in df.select(fixed("x", 2)).collect()]
    assert got[:4] == [f"{v:.2f}" for v in vals[:4]]


def test_sql_functions_match_column_rules(spark):
    from shelfcast.functions.sql_functions import register_sql_functions
    register_sql_functions(spark)
    rows = [(45.2, "increasing", 15.5), (25.0, None, 5.0), (None, None, None), (30.0, "decreasing", 9.0),
            (45.125, "stable", 20.0)]
    df = spark.createDataFrame(rows, "a double, t string, v double")
    df.createOrReplaceTempView("ctx_rows")
    got = spark.sql("SELECT rule_insight(a, t, v) AS s, safety_stock(v) AS ss, reorder_point(a, v) AS rp, "
                    "safety_stock_95(v) AS s95, economic_order_quantity(a) AS eoq FROM ctx_rows").collect()
    ref = df.select(rules.rule_insight_text(F.col("a"), F.col("t"), F.col("v")).alias("s"),
                    rules.safety_stock_simple(F.col("v")).alias("ss"),
                    rules.reorder_point_simple(F.col("a"), F.col("v")).alias("rp"),
                    rules.safety_stock_service(F.col("v")).alias("s95"),
                    rules.economic_order_quantity(F.col("a")).alias("eoq")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in ref]
    assert got[0]["ss"] == 31 and got[0]["rp"] == 347 and got[0]["s95"] == 67 and got[0]["eoq"] == 812
