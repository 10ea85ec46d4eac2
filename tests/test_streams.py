"""Streams whose result must not depend on files, batches or restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfcast.streaming import events as stm

DAY = dt.date(2024, 1, 1)


def panel(spark, rows, parts=5):
    df = spark.createDataFrame([(s, p, DAY + dt.timedelta(days=d), float(v)) for s, p, d, v in rows],
                               "store_id int, product_id int, date date, sales double")
    return df.orderBy(F.rand(3)).repartition(parts)


def some_days(seed=4, series=6, span=240):
    rng = random.Random(seed)
    rows = []
    for s in range(series):
        d = rng.randint(0, 30)
        while d < span:
            rows.append((s % 3, s, d, rng.randint(1, 50)))
            d += rng.choice([1, 1, 1, 2, 5, 15, 16, 40])
    return rows


def plain_lives(rows, silent=14):
    hi, out = max(d for *_, d, _ in rows), set()
    for key in {(s, p) for s, p, *_ in rows}:
        days = sorted((d, v) for s, p, d, v in rows if (s, p) == key)
        lives = [[days[0]]]
        for a, b in zip(days, days[1:]):
            if b[0] - a[0] > silent:
                lives.append([])
            lives[-1].append(b)
        for i, life in enumerate(lives):
            if i < len(lives) - 1 or life[-1][0] + silent < hi - 1:
                last = [v for _, v in life[-14:]]
                out.add((*key, DAY + dt.timedelta(days=life[0][0]), DAY + dt.timedelta(days=life[-1][0]), len(life),
                         float(sum(v for _, v in life)), round(sum(last) / len(last), 9)))
    return out


def test_silent_series_leave_the_state(spark):
    """Each slice is a run of its own that goes on from the checkpoint."""
    rows = some_days()
    want = plain_lives(rows)
    assert len(want) > 20
    for slices in (1, 3):
        got = stm.stream_series_lives(panel(spark, rows), slices=slices).collect()
        assert {(*r[:6], round(r[6], 9)) for r in got} == want and len(got) == len(want)


def test_forecast_errors_equal_the_batch_join(spark):
    """Unsorted files of many partitions; days without an actual have nulls."""
    rows = some_days(9)
    p = panel(spark, rows, parts=7)
    sales = {(s, i, d): float(v) for s, i, d, v in rows}
    hi = max(d for *_, d, _ in rows)
    want = {(s, i, DAY + dt.timedelta(days=d + 7), v, sales.get((s, i, d + 7))) for (s, i, d), v in sales.items() if d + 7 <= hi - 1}
    assert any(w[4] is None for w in want) and any(w[4] is not None for w in want)
    for slices in (1, 4):
        got = stm.stream_forecast_errors(p, slices=slices).collect()
        assert {tuple(r[:5]) for r in got} == want and len(got) == len(want)
        assert all((r["abs_error"] is None) == (r["actual_sales"] is None) for r in got)


def test_slices_hold_every_row_once(spark):
    rows = spark.createDataFrame([(i, DAY + dt.timedelta(days=i % 11)) for i in range(40)] + [(99, None)], "i int, day date")
    stream, feed = stm.sliced_stream(rows.withColumn("at", F.col("day").cast("timestamp")), "at", "slices-test", 3)
    out = stm.run_append(stream.select("i"), "slices-test", feed)
    assert sorted(r["i"] for r in out.collect()) == [*range(40), 99]
