"""Edge cases: single-row series, NULL keys, zero vectors, empty texts."""

import datetime as dt

from shelfcast.functions.exprs import cosine, word_count
from shelfcast.operators import insights as ins
from shelfcast.operators import panel as pn
from shelfcast.operators import textscore as ts


def test_single_row_series_has_null_volatility_and_no_risk(spark):
    rows = [(0, 1, dt.date(2024, 1, 1), 1, "seasonal_naive", 50.0, 40.0, 9.0)]
    fr = spark.createDataFrame(rows, "store_id int, product_id int, date date, horizon int, model string, "
                                     "actual_sales double, forecast double, price double")
    ctx = ins.series_context(ins.series_metrics(fr))
    r = ctx.first()
    assert r["volatility"] is None and r["trend"] == "decreasing"      # ties count as decreasing
    kinds = [e["kind"] for e in ins.instruction_examples(ctx).collect()]
    assert kinds == [1, 2]                                              # unknown volatility is not a risk
    assert ins.risk_filter(ctx).count() == 0


def test_null_fact_keys_are_dropped(spark):
    li = spark.createDataFrame(
        [(1, 1, 5.0, 100.0, 0.0, dt.datetime(2024, 1, 1)), (None, 1, 5.0, 100.0, 0.0, dt.datetime(2024, 1, 1)),
         (2, 1, 5.0, 100.0, 0.1, None), (3, None, 5.0, 100.0, 0.0, dt.datetime(2024, 1, 2))],
        "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
        "l_shipdate timestamp_ntz")
    sup = spark.createDataFrame([(1, 7)], "s_suppkey long, s_nationkey int")
    nat = spark.createDataFrame([(7, 3)], "n_nationkey int, n_regionkey int")
    p = pn.demand_panel(li, sup, nat).collect()
    assert len(p) == 1 and p[0]["store_id"] == 3 and p[0]["product_id"] == 1 and p[0]["sales"] == 5.0
    assert p[0]["day_of_week"] == 0 and p[0]["is_holiday"] == 0          # 2024-01-01 is a Monday


def test_cosine_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 1.0]


def test_empty_texts(spark):
    df = spark.createDataFrame([(0, 0, "", "a b"), (1, 0, "  \n ", "")],
                               "conv_id long, turn long, generated string, reference string")
    assert [r[0] for r in df.select(word_count("generated")).collect()] == [0, 0]
    r1 = {r["conv_id"]: r for r in ts.rouge_n(df).collect()}
    assert r1[0]["rouge1_f"] == 0.0 and r1[1]["rouge2_r"] == 0.0
    rl = {r["conv_id"]: r for r in ts.rouge_l(df).collect()}
    assert rl[0]["lcs"] == 0 and rl[1]["rougeL_f"] == 0.0


def test_weekday_is_monday_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 11, 1),), (dt.date(2024, 11, 3),)], "date date")
    r = pn.calendar_features(df).collect()
    assert (r[0]["day_of_week"], r[0]["is_holiday"]) == (4, 0)         # Friday
    assert (r[1]["day_of_week"], r[1]["is_holiday"]) == (6, 1)         # Sunday
