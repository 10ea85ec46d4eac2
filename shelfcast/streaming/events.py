"""Structured Streaming jobs over the event and demand tables.

Sources are `readStream` file sources over the table directory; sinks are
parquet (append) or `foreachBatch` writers (update mode), with checkpoints
and outputs in a fresh folder under the cluster's shared checkpoint folder
(`spark.checkpoint.dir`), so a restarted driver or lost executor resumes
from the committed offsets and state instead of recomputing.

* `stream_tumbling`  daily windows per event type, watermark 1 day, append.
* `stream_dedup`     late-data drop + `dropDuplicatesWithinWatermark(event_id)`.
* `stream_scale`     stream-static join with per-type scaling parameters.
* `stream_sliding`, `stream_sessions`  sliding windows and user sessions, append.
* `stream_forecast`  rolling last-14-days state per series with
                     `applyInPandasWithState`; emits seasonal-naive and
                     moving-average forecasts (state is bounded: 14 values/key).
* `stream_series_lives` runs of a series, as state that ends: an event-time
                     timer emits a silent series' last row and clears its state.
* `stream_forecast_errors` stream-stream join of forecasts and actuals, with
                     watermarks on both sides and rows for actuals that never come.
* `stream_event_counts` / `stream_latency_histogram`  the prediction counter
                     and latency histogram as an update-mode streaming
                     aggregation written with foreachBatch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfcast.functions.exprs import r6
from shelfcast.operators.monitoring import SESSION_GAP, event_time
from shelfcast.session import shared_path
from shelfcast.sources.tables import read_table

WATERMARK = "1 day"
DEDUP_WATERMARK = "1 hour"


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run's checkpoint and output, in the shared folder."""
    return shared_path(spark, f"streams/{name}")


#: Pieces of the event table's time span, each a batch of its own.
SLICES = 4


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                 slices: int = SLICES) -> tuple[DataFrame, Iterator[None]]:
    """The event table as a stream in time order, and its feed."""
    return sliced_stream(read_table(spark, sf_dir, table), "ts", table, slices)


def sliced_stream(rows: DataFrame, column: str, name: str, slices: int = SLICES, span=None) -> tuple[DataFrame, Iterator[None]]:
    """Rows as a stream in the order of a date or time column, and its feed: the
    time span is cut into `slices`, and each step of the feed stages the next one
    in the shared folder.  A slice has as many files as the table has partitions,
    in no order, so the runs below read each slice in one batch, after it is
    staged whole and before the next one is: rows are never late because of the
    file they are in, and state is carried from slice to slice.  `span` (first,
    last) makes slices of several streams end at the same times."""
    spark = rows.sparkSession
    stage = run_dir(spark, f"{name}-stage")
    lo, hi = span or rows.agg(F.min(column), F.max(column)).first()
    step = (hi - lo) / slices if lo is not None else None

    def put(i: int) -> None:
        some, at = rows, F.col(column)
        if step:
            some = rows.where(at >= F.lit(lo + i * step)) if i else rows.where(at.isNull() | (at >= F.lit(lo)))
            some = some.where(at.isNull() | (at < F.lit(lo + (i + 1) * step))) if i < slices - 1 else some
        some.write.mode("append").parquet(stage)

    def feed() -> Iterator[None]:
        yield
        for i in range(1, slices if step else 1):
            put(i)
            yield
    put(0)  # the stream's folder has to exist
    return spark.readStream.schema(rows.schema).parquet(stage), feed()


def _run(writer: DataStreamWriter, feed: Iterable[None]) -> None:
    """Run a query to the end of what is staged (availableNow) after each step
    of the feed; each run goes on from the checkpoint of the one before."""
    for _ in feed:
        writer.trigger(availableNow=True).start().awaitTermination()


def run_append(df: DataFrame, name: str, feed: Iterable[None] = (None,)) -> DataFrame:
    """Run an append-mode query to completion into a parquet sink."""
    spark = df.sparkSession
    base = run_dir(spark, name)
    _run(df.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"), feed)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_update(df: DataFrame, name: str, feed: Iterable[None] = (None,)) -> DataFrame:
    """Update-mode query written with foreachBatch; each micro-batch lands in
    its own `batch_id=` folder (overwritten on replay, so retries are idempotent)."""
    spark = df.sparkSession
    base = run_dir(spark, name)
    out = f"{base}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint"), feed)
    return spark.read.parquet(out)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, feed = event_stream(spark, sf_dir)
    ev = event_time(ev).withWatermark("ts", WATERMARK)
    agg = ev.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "event_type", "n_events", "total_value")
    return run_append(out, "tumbling", feed)


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day windows that start every day; a window is written when the
    watermark has passed its end."""
    ev, feed = event_stream(spark, sf_dir)
    ev = event_time(ev).withWatermark("ts", WATERMARK)
    agg = ev.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "event_type", "n_events", "total_value")
    return run_append(out, "sliding", feed)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User sessions with the built-in session window; a session is written
    when the watermark has passed its end."""
    ev, feed = event_stream(spark, sf_dir)
    ev = event_time(ev).withWatermark("ts", WATERMARK)
    agg = ev.groupBy("user_id", F.session_window("ts", SESSION_GAP).alias("w")).agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    out = agg.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                     "n_events", "total_value")
    return run_append(out, "sessions", feed)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, feed = event_stream(spark, sf_dir)
    ev = event_time(ev).withWatermark("ts", DEDUP_WATERMARK)
    uniq = ev.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "ts", "user_id", "event_type", "value")
    return run_append(uniq, "dedup", feed)


def scaling_params(events: DataFrame) -> DataFrame:
    """Per event type mean and population std of `value` (static side)."""
    return events.groupBy("event_type").agg(
        F.avg("value").alias("mean"),
        F.when(F.stddev_pop("value") > 0, F.stddev_pop("value")).otherwise(F.lit(1.0)).alias("scale"))


def stream_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = scaling_params(read_table(spark, sf_dir, "events"))
    ev, feed = event_stream(spark, sf_dir)
    out = ev.join(params, "event_type").select("event_id", "event_type", "value",
                    r6((F.col("value") - F.col("mean")) / F.col("scale")).alias("z"))
    return run_append(out, "scale", feed)


# ---------------------------------------------------------------- rolling state

FORECAST_OUT = ("store_id int, product_id int, last_date string, n_days int, "
                "seasonal_naive array<double>, moving_average array<double>")
STATE_SCHEMA = "days array<string>, sales array<double>"


def _rolling_forecast(lookback: int, horizon: int, season: int):
    def fn(key, pdfs, state):
        if state.exists:
            days, sales = state.get
            hist = pd.DataFrame({"date": list(days), "sales": list(sales)})
        else:
            hist = pd.DataFrame({"date": [], "sales": []})
        parts = [hist] + [p[["date", "sales"]] for p in pdfs]
        allp = pd.concat(parts, ignore_index=True)
        allp = allp.drop_duplicates("date", keep="last").sort_values("date").tail(lookback)
        state.update((allp["date"].tolist(), allp["sales"].astype(float).tolist()))
        x = allp["sales"].astype(float).tolist()
        full = len(x) == lookback
        naive = [x[lookback - season + (h % season)] for h in range(horizon)] if full else None
        mean = [sum(x) / lookback] * horizon if full else None
        yield pd.DataFrame({"store_id": [int(key[0])], "product_id": [int(key[1])],
                            "last_date": [allp["date"].iloc[-1] if len(allp) else None],
                            "n_days": [len(x)], "seasonal_naive": [naive], "moving_average": [mean]})
    return fn


def stream_forecast(spark: SparkSession, panel: DataFrame, lookback: int = 14, horizon: int = 7,
                    season: int = 7) -> DataFrame:
    """Demand rows arrive as a stream, year by year (the panel staged in the
    shared folder); each series keeps its latest `lookback` days as state and
    emits forecasts once the state is full.  Keeping the top-`lookback` days by
    date is order-insensitive, so late files do not corrupt the state.  Returns
    each series' latest emission: its state after the last batch."""
    stage = run_dir(spark, "panel-stage")
    (panel.select("store_id", "product_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "sales",
                  F.year("date").alias("year"))
     .repartitionByRange("date").write.partitionBy("year").parquet(stage))
    schema = spark.read.parquet(stage).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(stage)
    out = rows.groupBy("store_id", "product_id").applyInPandasWithState(
        _rolling_forecast(lookback, horizon, season), FORECAST_OUT, STATE_SCHEMA, "update",
        GroupStateTimeout.NoTimeout)
    emitted = run_update(out, "forecast")
    rest = [c for c in emitted.columns if c not in ("store_id", "product_id", "batch_id")]
    return emitted.groupBy("store_id", "product_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(
        "store_id", "product_id", "r.*")


# ---------------------------------------------------------------- state that ends

SILENT_DAYS = 14
LIFE_OUT = "store_id int, product_id int, first_date date, last_date date, n_days long, total_sales double, last_mean double"
LIFE_STATE = "first int, last int, n long, total double, recent array<double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1)


class SeriesLife(StatefulProcessor):
    """One run of a series' days without `silent` days between two of them.

    Its state is a few numbers and the last `lookback` sales.  A timer stands
    `silent` days (and a half, so that no day is at the edge) after the last
    day: when the watermark passes it, the run's last row is emitted and its
    state is gone.  A gap within the rows at hand ends a run at once, so that
    the result does not depend on how the rows are batched."""

    def __init__(self, silent: int, lookback: int) -> None:
        self.silent, self.lookback = silent, lookback

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE_STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        days = pd.concat([p[["day", "sales"]] for p in rows], ignore_index=True)
        day = days["day"].map(lambda t: (pd.Timestamp(t).date() - EPOCH).days).to_numpy()
        now, ended = (tuple(self.life.get()) if self.life.exists() else None), []
        for i in day.argsort(kind="stable"):
            at, sales = int(day[i]), float(days["sales"].iloc[i])
            if now is not None and at - now[1] > self.silent:
                ended.append(now)
                now = None
            first, last, n, total, recent = now or (at, at, 0, 0.0, [])
            now = (first, max(at, last), n + 1, total + sales, [*recent, sales][-self.lookback:])
        self.life.update(now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((now[1] + self.silent) * 86_400_000 + 43_200_000)
        yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        ended = [tuple(self.life.get())] if self.life.exists() else []
        self.life.clear()
        yield self._rows(key, ended)

    @staticmethod
    def _rows(key, ended: list[tuple]) -> pd.DataFrame:
        rows = [(int(key[0]), int(key[1]), EPOCH + dt.timedelta(days=first), EPOCH + dt.timedelta(days=last), n, total,
                 sum(recent) / len(recent)) for first, last, n, total, recent in ended]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LIFE_OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_series_lives(panel: DataFrame, silent: int = SILENT_DAYS, lookback: int = 14, slices: int = SLICES) -> DataFrame:
    """The runs of each series that have ended, as demand rows arrive: its
    first and last day, days, sales, and the mean of its last `lookback` days.  A
    series that stops leaves the state `silent` days later."""
    spark = panel.sparkSession
    days = panel.select("store_id", "product_id", F.col("date").cast("timestamp").alias("day"), F.col("sales").cast("double").alias("sales"))
    rows, feed = sliced_stream(days, "day", "series-lives", slices)
    out = rows.withWatermark("day", WATERMARK).groupBy("store_id", "product_id").transformWithStateInPandas(
        SeriesLife(silent, lookback), LIFE_OUT, "append", "EventTime")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)  # what transformWithState needs
    try:
        return run_append(out, "series-lives", feed)
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


# ---------------------------------------------------------------- stream-stream join

def weekly_forecasts(panel: DataFrame, season: int = 7) -> DataFrame:
    """Forecast rows as a forecaster emits them, each day one for `season`
    calendar days later: the day's own sales."""
    return panel.select("store_id", "product_id", F.col("date").cast("timestamp").alias("origin"),
                        F.date_add("date", season).cast("timestamp").alias("target"), F.col("sales").cast("double").alias("forecast"))


def stream_forecast_errors(panel: DataFrame, forecasts: DataFrame | None = None, slices: int = SLICES) -> DataFrame:
    """Forecasts (store_id, product_id, origin, target, forecast) joined with the
    actuals as both arrive: (store_id, product_id, date, forecast, actual_sales,
    abs_error).  Both sides wait for each other until the watermark passes the
    day, and no longer; a forecast whose day closes without an actual has nulls.
    Days that the watermark has not passed are left out."""
    spark = panel.sparkSession
    forecasts = weekly_forecasts(panel) if forecasts is None else forecasts
    actuals = panel.select(F.col("store_id").alias("a_store"), F.col("product_id").alias("a_product"),
                           F.col("date").cast("timestamp").alias("day"), F.col("sales").cast("double").alias("actual_sales"))
    span = actuals.agg(F.min("day"), F.max("day")).first()
    left, feed_left = sliced_stream(forecasts, "origin", "forecasts", slices, span)
    right, feed_right = sliced_stream(actuals, "day", "actuals", slices, span)
    joined = left.withWatermark("target", WATERMARK).join(
        right.withWatermark("day", WATERMARK),
        (F.col("store_id") == F.col("a_store")) & (F.col("product_id") == F.col("a_product")) & (F.col("target") == F.col("day")),
        "left_outer").select("store_id", "product_id", F.col("target").cast("date").alias("date"), "forecast", "actual_sales",
                             F.abs(F.col("forecast") - F.col("actual_sales")).alias("abs_error"))
    out = run_append(joined, "forecast-errors", (None for _ in zip(feed_left, feed_right)))
    closed = span[1] - dt.timedelta(days=1) if span[1] is not None else None
    return out.where(F.col("date") <= F.lit(closed).cast("date"))


# ---------------------------------------------------------------- monitoring counters (update mode)

def stream_monitoring_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counter and histogram state per (event type, latency bucket),
    kept by a streaming aggregation in update mode and written per micro-batch
    with foreachBatch.  Returns the latest value of every key: the state after
    the last batch."""
    from shelfcast.operators.monitoring import LATENCY_BUCKETS, VALUE_TO_SECONDS
    bounds = F.array(*[F.lit(b) for b in LATENCY_BUCKETS])
    secs = F.col("value") * F.lit(VALUE_TO_SECONDS)
    ev, feed = event_stream(spark, sf_dir)
    ev = ev.select(
        "event_type", F.size(F.filter(bounds, lambda b: b < secs)).alias("b"), secs.alias("s"), "value")
    state = ev.groupBy("event_type", "b").agg(F.count("*").alias("c"), F.sum("s").alias("s"),
                                              F.sum("value").alias("v"))
    out = run_update(state, "monitoring", feed)
    return out.groupBy("event_type", "b").agg(
        *[F.max_by(c, "batch_id").alias(c) for c in ("c", "s", "v")])


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = stream_monitoring_state(spark, sf_dir)
    return st.groupBy("event_type").agg(F.sum("c").alias("n_events"), r6(F.sum("v")).alias("total_value"))


def stream_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    from shelfcast.operators.monitoring import LATENCY_BUCKETS
    st = stream_monitoring_state(spark, sf_dir)
    bounds = F.array(*[F.lit(b) for b in LATENCY_BUCKETS])
    grid = st.select("event_type").distinct().select("event_type", F.posexplode(bounds).alias("b", "le"))
    g = grid.join(st, ["event_type", "b"], "left").fillna(0, ["c"])
    w = Window.partitionBy("event_type").orderBy("b")
    tot = Window.partitionBy("event_type")
    return g.select("event_type", "le",
                    F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_count"),
                    F.sum("c").over(tot).alias("count"), r6(F.sum("s").over(tot)).alias("sum_seconds"))
