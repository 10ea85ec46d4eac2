"""Monitoring aggregates over the `events` table (batch twins of the streams).

Counters and the latency histogram are plain aggregates.  The histogram
assigns each event to its first bucket (one row per event, no per-bound
explode) and accumulates bucket counts over the tiny (type x bucket) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import r6

# Default latency buckets (seconds) of the metrics client the
# reference uses; the last bucket is +Inf.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
# Event values are latencies in milliseconds.
VALUE_TO_SECONDS = 0.001
SESSION_GAP = "6 hours"


def event_time(events: DataFrame) -> DataFrame:
    """Parquet `ts` is TIMESTAMP_NTZ; watermarks need TIMESTAMP (UTC session)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))


def latency_histogram(events: DataFrame, buckets=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (`le`), plus the per-type count and sum."""
    bounds = F.array(*[F.lit(b) for b in buckets])
    secs = F.col("value") * F.lit(VALUE_TO_SECONDS)
    first = F.size(F.filter(bounds, lambda b: b < secs))       # 0-based index of the first bound >= value
    per = (events.select("event_type", first.alias("b"), secs.alias("s"))
           .groupBy("event_type", "b").agg(F.count("*").alias("c"), F.sum("s").alias("s")))
    grid = per.select("event_type").distinct().select(
        "event_type", F.posexplode(bounds).alias("b", "le"))
    g = grid.join(per, ["event_type", "b"], "left").fillna(0, ["c"])
    w = Window.partitionBy("event_type").orderBy("b")
    tot = Window.partitionBy("event_type")
    return g.select("event_type", "le",
                    F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_count"),
                    F.sum("c").over(tot).alias("count"),
                    r6(F.sum("s").over(tot)).alias("sum_seconds"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    e = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    return e.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "n_events", "total_value")


def sliding(events: DataFrame, size: str = "7 days", slide: str = "1 day") -> DataFrame:
    e = events.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    return e.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "n_events", "total_value")


def sessions(events: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Per-user activity sessions with Spark's `session_window`: a gap of
    `gap` or more starts a new one.  Each user's timeline is one sort group."""
    e = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    return e.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                    "n_events", "total_value")


def sessions_split(events: DataFrame, gap_hours: int = 6, bucket: str = "1 hour") -> DataFrame:
    """Sessions - a gap of `gap_hours` or more starts a new one (Spark's
    `session_window` also merges events exactly one gap apart) - computed so
    that no user's timeline is one task.

    1. Events are sessionised inside (user, time bucket) groups in parallel.
    2. One summary row per (user, bucket) - first/last time and local session
       count, bounded by the calendar - decides whether a bucket's first
       session continues the previous bucket's last one (gap below `gap_hours`)
       and gives each bucket its offset in the user's session numbering.
    3. Events are aggregated by (user, global session id), partially
       aggregated map-side, so even one very long session is split over tasks.
    """
    gap_s = gap_hours * 3600
    t = F.col("ts")
    b = events.withColumn("bucket", F.window("ts", bucket)["start"])
    wb = Window.partitionBy("user_id", "bucket").orderBy("ts", "event_id")
    prev = F.lag("ts").over(wb)
    new = (prev.isNull() | (F.unix_micros(t.cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
                            >= F.lit(gap_s * 1_000_000))).cast("int")
    local = b.withColumn("new", new).withColumn(
        "local_sid", F.sum("new").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    summary = local.groupBy("user_id", "bucket").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("local_sid").alias("n_local"))
    wu = Window.partitionBy("user_id").orderBy("bucket")
    prev_last = F.lag("last_ts").over(wu)
    cont = (prev_last.isNotNull() & (F.unix_micros(F.col("first_ts").cast("timestamp"))
                                     - F.unix_micros(prev_last.cast("timestamp")) < F.lit(gap_s * 1_000_000))).cast("int")
    summary = summary.withColumn("cont", cont).withColumn(
        "base", F.coalesce(F.sum(F.col("n_local") - F.col("cont")).over(
            wu.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tagged = local.join(summary.select("user_id", "bucket", "cont", "base"), ["user_id", "bucket"])
    gsid = F.col("base") + F.col("local_sid") - F.col("cont")
    agg = tagged.groupBy("user_id", gsid.alias("sid")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("last_ts"),
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("total_value"))
    return agg.select("user_id", "session_start",
                      (F.col("last_ts") + F.expr(f"INTERVAL {gap_hours} HOURS")).alias("session_end"),
                      "n_events", "total_value")
