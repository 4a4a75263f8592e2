"""Sums over windows and sessions of event time, and repeated events, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.registry import query, table


def windowed(events: DataFrame, time_col: str, keys: list[str], value_col: str, length: str, late: str) -> DataFrame:
    """(start, keys..., n, total) per window. On a stream a window is complete once events are `late` past its end; what comes later still is not counted. On a table `late` has no effect."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time_col, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, keys..., n) per session: events of a key that follow each other within gap; end is the gap past the last."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, time_col: str, keys: list[str], late: str) -> DataFrame:
    """One event of each key; on a stream, repeats are known for `late` after the first, and state older than that is dropped."""
    if events.isStreaming:
        return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
    others = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min(F.struct(time_col, *(c for c in others if c != time_col))).alias("_first"))
    return first.select(*(c if c in keys else F.col(f"_first.{c}").alias(c) for c in events.columns))


@query("t1_hourly_windows", "SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _hourly(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed(e, "ts", ["event_type"], "value", "1 hour", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_NEW = "lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR"


@query("t2_sessions", f"SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS until, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(f::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, {_NEW} AS f FROM events)) GROUP BY user_id, s")
def _sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions(e, "ts", ["user_id"], "6 hours", "1 day")
    return out.select(*(F.date_format(a, "yyyy-MM-dd HH:mm:ss").alias(b) for a, b in (("start", "start"), ("end", "until"))), "user_id", "n")


@query("t3_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type) AS t FROM events) WHERE ts = t GROUP BY 1, 2")
def _first_seen(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return first_seen(e, "ts", ["user_id", "event_type"], "1 day").select("user_id", "event_type", "event_id")
