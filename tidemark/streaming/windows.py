"""Structured Streaming counterparts of polling: windowed counters, growing bars, first copies and resume points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, key: str, t: str, width: str, late: str) -> DataFrame:
    """Events of each key in tumbling windows; a window is final when the watermark, ``late`` behind the newest event, has passed it.

    Works on a stream (append mode) and on a table alike.
    """
    return events.withWatermark(t, late).groupBy(F.window(t, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Windows in which a key came more often than allowed."""
    return counts.where(F.col("n") > limit)


def streaming_bars(ticks: DataFrame, t: str, width: str, late: str) -> DataFrame:
    """Bars of (symbol, price, volume) ticks: open and close by time, extremes, volume and number."""
    g = ticks.withWatermark(t, late).groupBy(F.window(t, width), "symbol")
    return g.agg(F.min_by("price", t).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", t).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "symbol", "open", "high", "low", "close", "volume", "n")


def first_copies(events: DataFrame, keys: list[str], t: str, late: str) -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed it."""
    return events.withWatermark(t, late).dropDuplicatesWithinWatermark(keys)


def resume_cursor(stored: DataFrame, key: str, t: str, step: str) -> DataFrame:
    """(key, next): where polling of each series goes on."""
    return stored.groupBy(key).agg((F.max(t) + F.expr(f"INTERVAL {step}")).alias("next"))


def request_pages(cursors: DataFrame, key: str, until: str, step: str, size: int) -> DataFrame:
    """(key, start, stop): the windows of at most ``size`` steps that are still to be asked for."""
    span = F.expr(f"INTERVAL {step}")
    end = F.to_timestamp(F.lit(until))
    starts = cursors.where(F.col("next") <= end).select(key, F.explode(F.sequence("next", end, span * size)).alias("start"))
    return starts.select(key, "start", F.least(F.col("start") + span * (size - 1), end).alias("stop"))
