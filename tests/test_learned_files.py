"""Spark ML forecaster, its pandas scoring hook, and the file sources."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import experiments as ex
from shelfcast.operators import learned as lrn
from shelfcast.operators import leastsquares as ls
from shelfcast.operators import panel as pn
from shelfcast.operators import windows as wn
from shelfcast.sources import files as fl


def test_pandas_scorer_matches_spark_ml(spark, small_panel, tmp_path):
    from pyspark.ml.functions import array_to_vector
    scaled, _, _ = lrn.prepared(small_panel)
    model = lrn.fit_steps(scaled.where(F.col("split") == "train"), reg=0.01)
    lrn.save_model(model, str(tmp_path / "m"))
    loaded = lrn.load_model(str(tmp_path / "m"))
    test = scaled.where(F.col("split") == "test").select("store_id", "product_id", "pos", "f")
    spark_pred = {(r["store_id"], r["product_id"], r["pos"]): [r[f"pred_{h}"] for h in range(7)]
                  for r in loaded.transform(test.withColumn("features", array_to_vector("f"))).collect()}
    schema = "store_id int, product_id int, pos int, f array<double>, z array<double>"
    pd_pred = {(r["store_id"], r["product_id"], r["pos"]): r["z"]
               for r in test.mapInPandas(lrn.pandas_scorer(lrn.step_models(loaded)), schema).collect()}
    assert spark_pred and spark_pred.keys() == pd_pred.keys()
    for k, v in spark_pred.items():
        assert all(abs(a - b) < 1e-6 for a, b in zip(v, pd_pred[k]))


@pytest.mark.parametrize("features", ["window", "mean"])
def test_one_pass_fit_matches_spark_ml(spark, small_panel, tmp_path, features):
    scaled, _, _ = lrn.prepared(small_panel, features=features)
    train = scaled.where(F.col("split") == "train")
    for penalty in (1e-3, 0.1):
        one, seven = ls.fit(train, penalty), lrn.step_models(lrn.fit_steps(train, penalty))
        assert np.abs(one.coef - seven.coef).max() < 1e-6 and np.abs(one.intercept - seven.intercept).max() < 1e-6
    one.save(spark, str(tmp_path / "m"))
    again = ls.LinearModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(one.coef, again.coef) and np.array_equal(one.intercept, again.intercept)


def test_moments_add_up_and_give_the_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 4)) + 5
    y = x @ rng.standard_normal((4, 2)) + rng.standard_normal((500, 2))
    df = spark.createDataFrame([(i % 3, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))],
                               "k int, f array<double>, ys array<double>").repartition(5)
    parts = ls.moments(df, ["k"], labels=2)
    whole = ls.moments(df.withColumn("k", F.lit(0)), ["k"], labels=2)[0,]
    total = parts[0,] + parts[1,] + parts[2,]
    assert np.allclose(total.matrix, whole.matrix) and total.n == 500
    assert np.allclose((total - parts[2,]).matrix, (parts[0,] + parts[1,]).matrix)
    model = whole.ridge(0.0)
    want = np.linalg.lstsq(np.column_stack([x, np.ones(500)]), y, rcond=None)[0]
    assert np.allclose(model.coef, want[:-1].T) and np.allclose(model.intercept, want[-1])
    assert np.allclose(whole.loss(model), ((y - model(x)) ** 2).mean(axis=0))
    assert ls.moments(df.limit(0), ["k"], labels=2) == {}


def test_learned_grid_matches_a_fit_per_fold(spark, small_panel):
    """Folds by hand: pandas windows, one ridge fit each."""
    origins = (0.15, 0.4, 0.7)
    got = {(r["fold"], r["penalty"]): r for r in ex.learned_grid(
        small_panel, features="window", penalties=(0.01, 1.0), origins=origins).collect()}
    rows = wn.sliding_windows(small_panel, with_dates=True).toPandas()
    days = small_panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    cuts = [days["lo"] + dt.timedelta(days=int((days["hi"] - days["lo"]).days * o)) for o in origins] + [days["hi"] + dt.timedelta(days=1)]
    last = rows["y_date"].map(lambda d: d[-1])
    x = np.stack([np.concatenate([r[f"x_{f}"] for f in pn.FEATURES]) for _, r in rows.iterrows()]).astype(float)
    y = np.stack(rows["y"].to_numpy()).astype(float)
    first = (last < cuts[0]).to_numpy()
    by = x[first].reshape(-1, 7, 14)
    m, s = by.mean(axis=(0, 2)), by.std(axis=(0, 2))
    xs = ((x.reshape(-1, 7, 14) - m[None, :, None]) / np.where(s < 1e-9, 1, s)[None, :, None]).reshape(len(x), -1)
    ym, ysd = y[first].mean(axis=0), y[first].std(axis=0)
    ys = (y - ym) / ysd
    seen = set()
    for k in range(len(origins)):
        train = (last < cuts[k]).to_numpy()
        test = (rows["start_date"] >= cuts[k]).to_numpy() & (last < cuts[k + 1]).to_numpy()
        if not (train.any() and test.any()):
            continue
        for p in (0.01, 1.0):
            a, b = xs[train] - xs[train].mean(axis=0), ys[train] - ys[train].mean(axis=0)
            coef = np.linalg.solve(a.T @ a / train.sum() + p * np.eye(98), a.T @ b / train.sum())
            z = (xs[test] - xs[train].mean(axis=0)) @ coef + ys[train].mean(axis=0)
            r = got[k, p]
            seen.add((k, p))
            assert (r["n_train"], r["n_test"]) == (train.sum(), test.sum())
            assert abs(r["loss"] - ((z - ys[test]) ** 2).mean()) < 1e-5
            assert abs(r["mape"] - np.abs((y[test] - (z * ysd + ym)) / (y[test] + 1e-8)).mean() * 100) < 1e-3
    assert seen == set(got) and len(seen) >= 4


def test_csv_roundtrip_keeps_rows_and_flags_corrupt_lines(spark, small_panel, tmp_path):
    path = str(tmp_path / "sales")
    fl.write_csv(small_panel, path)
    back = fl.read_sales_csv(spark, path)
    assert back.count() == small_panel.count()
    assert sum(r[fl.CORRUPT] is not None for r in back.select("date", fl.CORRUPT).collect()) == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.csv").write_text("date,store_id,product_id,sales,price,promotion,inventory,day_of_week,month,"
                               "is_holiday\n2024-01-01,1,2,3.0,4.0,0,5.0,0,1,0\nnot-a-date,x,2,3.0,4.0,0,5.0,0,1,0\n")
    rows = fl.read_sales_csv(spark, str(bad)).collect()
    assert len(rows) == 2 and sum(r[fl.CORRUPT] is not None for r in rows) == 1


def test_parquet_sink_partitions_by_store(spark, small_panel, tmp_path):
    path = str(tmp_path / "pq")
    fl.write_parquet(small_panel, path)
    import os
    assert any(d.startswith("store_id=") for d in os.listdir(path))
    assert spark.read.parquet(path).count() == small_panel.count()
