"""Queries of the sources, sinks and streaming operators that can be told as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.cut import read
from tidemark.plans.models import epoch_us
from tidemark.sources import tables as S
from tidemark.streaming import windows as W


def a1_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of the discounted items of one year."""
    s = S.scan(spark, f"{d}/lineitem.parquet", ["l_returnflag", "l_extendedprice"], (F.col("l_discount") >= 0.05) & (F.col("l_quantity") < 25))
    return s.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def a4_requested_only(spark: SparkSession, d: str) -> DataFrame:
    """Candles of the wanted minutes that occur once."""
    from tidemark.operators.candles import parse_candles

    c = parse_candles(read(spark, d, "archive_candles")).where("minute IS NOT NULL")
    ok, _ = S.requested_only(c, c.where("minute % 15 = 0").select("symbol", "minute"))
    return ok.select("symbol", "minute", "open")


def a9_staging_text(spark: SparkSession, d: str) -> DataFrame:
    """Staging lines of the production rows."""
    r = read(spark, d, "production_rows").distinct().select("row_id", "category", F.from_json("related_assets", "array<string>").alias("assets"), F.col("importance").cast("decimal(6,1)").alias("importance"))
    return S.staging_text(r)


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type in windows of six hours."""
    e = read(spark, d, "events").select("event_type", F.timestamp_micros(epoch_us("ts")).alias("t"))
    return W.window_counts(e, "event_type", "t", "6 hours", "1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


def stream_over_limit(spark: SparkSession, d: str) -> DataFrame:
    """Users seen more than three times within an hour."""
    e = read(spark, d, "events").select("user_id", F.timestamp_micros(epoch_us("ts")).alias("t"))
    return W.over_limit(W.window_counts(e, "user_id", "t", "1 hour", "1 hour"), 1).select(F.unix_micros("start").alias("start_us"), "user_id", "n")


# The streaming family has names of its own, as p and a number stand for the numbered problems.
QUERIES = {"a1_pruned_scan": a1_pruned_scan, "a4_requested_only": a4_requested_only, "a9_staging_text": a9_staging_text, "stream_window_counts": stream_window_counts, "stream_over_limit": stream_over_limit}

SQL = {
    "a1_pruned_scan": "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 25 GROUP BY 1",
    "a4_requested_only": """WITH p AS (SELECT symbol, CASE WHEN abs(open_time) >= 100000000000000 THEN open_time ELSE open_time * 1000 END // 60000000 AS minute, open FROM archive_candles)
        SELECT symbol, minute, open FROM p WHERE minute % 15 = 0 QUALIFY count(*) OVER (PARTITION BY symbol, minute) = 1""",
    "a9_staging_text": """SELECT concat_ws(chr(9), row_id, coalesce(category, '\\N'), coalesce('{' || array_to_string(from_json(related_assets, '["VARCHAR"]'), ',') || '}', '\\N'), coalesce(importance::DECIMAL(6, 1)::VARCHAR, '\\N')) AS line FROM (SELECT DISTINCT * FROM production_rows)""",
    "stream_window_counts": "SELECT epoch_us(ts) // 21600000000 * 21600000000 AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_over_limit": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
}
