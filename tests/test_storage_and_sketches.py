"""Bucketed panels, sketches, free-form contexts and row counts of plans."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.exprs import r6
from shelfcast.operators import forecasts as fc
from shelfcast.operators import insights as ins
from shelfcast.operators import metrics as mt
from shelfcast.operators import scaling as sc
from shelfcast.operators import scoring as scr
from shelfcast.operators import sketches as sk
from shelfcast.operators import windows as wn
from shelfcast.session import shared_path
from shelfcast.sources import files as fl
from test_plans import _plan


@pytest.fixture(scope="module")
def bucketed(spark, small_panel):
    path = shared_path(spark, "bucketed/test")
    yield fl.write_bucketed(small_panel, "panel_test", path, 8)
    spark.sql("DROP TABLE panel_test")


def test_bucketed_panel_needs_no_shuffle(spark, small_panel, bucketed):
    assert bucketed.count() == small_panel.count()
    by_series = {"windows": wn.sliding_windows(bucketed), "scaler": sc.window_weights(bucketed),
                 "metrics": ins.series_metrics(fc.daily_forecasts(bucketed), daily=True)}
    for name, df in by_series.items():
        assert "hashpartitioning" not in _plan(df), name
    # A scaler is one row: only its partial sums meet.
    assert "hashpartitioning" not in _plan(sc.fit_input_scaler(bucketed))
    assert sorted(sc.fit_input_scaler(bucketed).select("name", r6("mean").alias("m")).collect()) == sorted(
        sc.fit_input_scaler(small_panel).select("name", r6("mean").alias("m")).collect())
    assert wn.sliding_windows(bucketed).count() == wn.sliding_windows(small_panel).count()


def test_sketches_merge_to_any_grain(spark, small_panel):
    table = sk.sketch_table(small_panel)
    whole = sk.merged(table, ())
    assert whole.count() == 1
    n, total = whole.select("n", "total").first()
    assert (n, total) == small_panel.agg(F.count("sales"), F.sum("sales")).first()[:2]
    exact = sorted(r["sales"] for r in small_panel.select("sales").collect())
    for r in sk.quantiles(whole, ()).collect():
        below, upto = sum(v < r["quantile"] for v in exact) / n, sum(v <= r["quantile"] for v in exact) / n
        assert below <= r["probability"] + sk.RANK_ERROR and upto >= r["probability"] - sk.RANK_ERROR
    assert all(r["rank_ok"] and r["distinct_ok"] for r in sk.sketch_check(small_panel, table).collect())


def test_sketch_errors_at_size(spark):
    """200,000 distinct values over many groups: rank error under 1 %."""
    days = spark.range(200_000).select(
        (F.col("id") % 3).cast("int").alias("store_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 700).cast("int")).alias("date"),
        F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).alias("sales"), F.col("id").alias("price"))
    got = sk.sketch_check(days, sk.sketch_table(days)).collect()
    assert len(got) == 15 and all(r["rank_ok"] and r["distinct_ok"] for r in got)
    assert sk.quantiles(sk.merged(sk.sketch_table(days.limit(0)), ()), ()).count() == 0


def test_free_form_contexts(spark):
    bodies = {
        "whole": '{"query": "q", "context": {"avg_sales": 10, "trend": "increasing", "volatility": 4.5}}',
        "empty": '{"query": "q", "context": {}}', "none": '{"query": "q"}', "null": '{"query": "q", "context": null}',
        "nulls": '{"query": "q", "context": {"avg_sales": null, "trend": null, "volatility": null}}',
        "types": '{"query": 7, "context": {"avg_sales": "10", "trend": 1, "volatility": [4.5]}}',
        "list": '{"query": "q", "context": [1, 2]}', "big": '{"query": "q", "context": {"avg_sales": 1e300, "volatility": true}}',
        "extra": '{"query": "q", "context": {"avg_sales": 10, "x": {"volatility": 9}, "volatility": 1}}',
        "cut": '{"query": "q"', "array": "[]", "text": '"q"', "blank": "", "missing": None}
    df = spark.createDataFrame(list(bodies.items()), "name string, body string")
    got = {r["name"]: r for r in scr.free_form_insights(df).collect()}
    assert {n for n, r in got.items() if r["error"]} == {"cut", "array", "text", "blank", "missing"}
    values = {n: (r["avg_sales"], r["trend"], r["volatility"]) for n, r in got.items()}
    assert values["whole"] == (10.0, "increasing", 4.5) and values["extra"] == (10.0, "stable", 1.0)
    assert values["big"] == (1e300, "stable", 0.0)
    assert all(values[n] == (0.0, "stable", 0.0) for n in ("empty", "none", "null", "nulls", "types", "list", "cut"))
    assert got["types"]["query"] is None and got["whole"]["query"] == "q"
    assert all((r["insights"] is None) == (r["error"] is not None) for r in got.values())
    assert json.loads(bodies["whole"])["query"] == got["whole"]["query"]


def test_daily_forecasts_are_the_shortest_ones(spark, small_panel):
    cols = ["store_id", "product_id", "date", "horizon", "origin_pos", "forecast", "actual_sales", "price"]
    want = fc.one_per_day(fc.forecast_results(small_panel)).select(cols).collect()
    assert sorted(want) == sorted(fc.daily_forecasts(small_panel).select(cols).collect())
    holes = small_panel.withColumn("sales", F.when(F.dayofmonth("date") != 17, F.col("sales")))
    want = fc.one_per_day(fc.forecast_results(holes)).select(cols).collect()
    assert sorted(want) == sorted(fc.daily_forecasts(holes).select(cols).collect()) and want


def test_window_metrics_equal_row_metrics(spark, small_panel):
    zero = small_panel.withColumn("sales", F.when(F.dayofmonth("date") != 9, F.col("sales").cast("double")).otherwise(F.lit(0.0)))
    rows = {r["model"]: r for r in mt.forecast_metrics(fc.forecast_results(zero, fc.BASELINES)).collect()}
    sums = {r["model"]: r for r in mt.window_metrics(wn.sliding_windows(zero), fc.BASELINES).collect()}
    assert rows.keys() == sums.keys() == set(fc.BASELINES)
    for m in rows:
        assert rows[m]["n"] == sums[m]["n"]
        for c in mt.METRIC_NAMES:
            assert abs(rows[m][c] - sums[m][c]) <= 1e-5 * max(1.0, abs(rows[m][c])), (m, c)
    # One row a window and model reaches the aggregate, not one a step.
    p = _plan(mt.window_metrics(wn.sliding_windows(small_panel), fc.BASELINES))
    assert p.count("Generate explode") == 1


def test_responses_carry_one_time_a_batch(spark, small_panel):
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(minutes=1)
    out = scr.batch_forecast(scr.forecast_requests(small_panel), scr.framework_models(spark), with_timestamp=True)
    times = {r["generated_at"] for r in out.select("generated_at").collect()}
    assert len(times) == 1 and None not in times
    after = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(minutes=1)
    assert before <= spark.createDataFrame([(t,) for t in times], "t timestamp").select(F.col("t").cast("timestamp_ntz")).first()[0] <= after
