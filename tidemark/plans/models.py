"""The test tables seen as bars and news, in Spark and as SQL, for queries of the reaction and context operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.cut import read

#: Seconds of a bar of these models.
BAR_S = 3600


def epoch_us(c: str) -> F.Column:
    """Microseconds of a timestamp column, with or without zone; one without is UTC."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars: clicks, views and purchases as three symbols, the value as price, the count as volume."""
    e = read(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    symbol = F.when(F.col("event_type") == "click", "BTC").when(F.col("event_type") == "view", "ETH").otherwise("SOL")
    return e.groupBy(symbol.alias("symbol"), F.floor(epoch_us("ts") / (BAR_S * 1_000_000)).alias("bar")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))


def news(spark: SparkSession, d: str) -> DataFrame:
    """Signups and errors as news: event_id, published_us, source, actor."""
    e = read(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    return e.select("event_id", epoch_us("ts").alias("published_us"), F.col("event_type").alias("source"), F.col("user_id").alias("actor"))


def event_assets(spark: SparkSession, d: str) -> DataFrame:
    """Each news event with each of the three symbols and the bar its reaction counts from."""
    base = (F.floor(F.col("published_us") / (BAR_S * 1_000_000)) + 1).cast("bigint")
    return news(spark, d).select("event_id", "source", "actor", "published_us", base.alias("base"), F.explode(F.array(*[F.lit(s) for s in ("BTC", "ETH", "SOL")])).alias("symbol"))


BARS = """bars AS (SELECT CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' ELSE 'SOL' END AS symbol, epoch_us(ts) // 3600000000 AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2)"""
NEWS = "news AS (SELECT event_id, epoch_us(ts) AS published_us, event_type AS source, user_id AS actor FROM events WHERE event_type IN ('signup', 'error'))"
ASSETS = NEWS + ", ea AS (SELECT event_id, source, actor, published_us, published_us // 3600000000 + 1 AS base, symbol FROM news, (VALUES ('BTC'), ('ETH'), ('SOL')) AS s(symbol))"
PCT = "CASE WHEN {0} > 0 AND {1} > 0 THEN ({0} / {1} - 1) * 100 END"
HORIZONS = (1, 5, 15, 24)
RETURNS = f"""{BARS}, {ASSETS}, hz AS (SELECT unnest([1, 5, 15, 24]) AS horizon), hr AS (SELECT event_id, ea.symbol, base, horizon, source, b.open AS base_open, e.open AS end_open, {PCT.format('e.open', 'b.open')} AS ret
    FROM ea CROSS JOIN hz LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base LEFT JOIN bars e ON e.symbol = ea.symbol AND e.bar = base + horizon)"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns of every event and symbol at every horizon."""
    from tidemark.operators.reactions import horizon_returns

    return horizon_returns(event_assets(spark, d), bars(spark, d), HORIZONS)
