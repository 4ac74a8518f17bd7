"""Queries of the candle store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.plans.cut import read


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_candles(read(spark, d, "archive_candles"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return C.one_per_minute(_parsed(spark, d))


_P = """p AS (SELECT *, CASE WHEN abs(open_time) >= 100000000000000 THEN open_time ELSE open_time * 1000 END AS open_us,
    CASE WHEN abs(close_time) >= 100000000000000 THEN close_time ELSE close_time * 1000 END AS close_us,
    (abs(open_time) >= 100000000000000) <> (abs(close_time) >= 100000000000000) AS mixed FROM archive_candles)"""
_G = _P + """, s AS (SELECT *, open_us // 60000000 AS minute FROM p WHERE NOT mixed AND open_us BETWEEN 1483228800000000 AND 1893455999999999 AND close_us BETWEEN 1483228800000000 AND 1893455999999999
    AND open > 0 AND close > 0 AND high >= open AND high >= close AND low <= open AND low <= close AND high >= low AND volume >= 0 AND open_us % 60000000 = 0),
    r AS (SELECT symbol, minute, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol, minute ORDER BY open, high, low, close, volume) AS k FROM s),
    g AS (SELECT * EXCLUDE k FROM r WHERE k = 1)"""
_D = _G + """, d AS (SELECT symbol, minute // 60 AS bar, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, sum(volume) AS volume, count(*) AS n FROM g GROUP BY 1, 2)"""

_CODES = [
    *[(f"{x}_not_positive", f"{x} <= 0") for x in ("open", "high", "low", "close")],
    ("high_below_open", "high < open"), ("high_below_close", "high < close"), ("low_above_open", "low > open"), ("low_above_close", "low > close"), ("high_below_low", "high < low"),
    *[(f"{x}_negative", f"{x} < 0") for x in ("volume", "quote_volume", "taker_buy_base", "taker_buy_quote", "trade_count")],
    ("open_time_not_minute_aligned", "open_us % 60000000 <> 0"), ("close_time_not_after_open", "close_us <= open_us"), ("close_time_not_1m", "close_us - open_us < 59999000 OR close_us - open_us >= 60000000"),
]


def b1_normalised_times(spark: SparkSession, d: str) -> DataFrame:
    """Every candle row with its opening in microseconds and the parse error, if any."""
    return _parsed(spark, d).select("symbol", "open_time", "open_us", "minute", "error")


def b3_candle_codes(spark: SparkSession, d: str) -> DataFrame:
    """Number of candle rows by their combination of faults."""
    return _parsed(spark, d).groupBy(C.candle_codes().alias("codes")).agg(F.count("*").alias("n"))


def b4_sound_candles(spark: SparkSession, d: str) -> DataFrame:
    """Sound and unsound rows of each symbol."""
    return _parsed(spark, d).groupBy("symbol").agg(F.count_if(C.sound_candle()).alias("sound"), F.count_if(~C.sound_candle()).alias("unsound"))


def b6_copies(spark: SparkSession, d: str) -> DataFrame:
    """Repeated candle rows beyond the first of their key."""
    p = _parsed(spark, d)
    ranked = C.first_of_each(p, ["symbol", "minute"], ["open_us", "open", "high", "low", "close", "volume", "open_time"])
    return ranked.where("copy_no > 1").select("symbol", "minute", "copy_no", "open")


def b7_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that disagree with the stored candle of their minute in open or close."""
    p = _parsed(spark, d).select("symbol", "minute", "open", "close")
    return C.conflicts(p, _grid(spark, d), ["symbol", "minute"], ["open", "close"]).select("symbol", "minute", "open", "stored_open", "close", "stored_close")


def b8_insert_new(spark: SparkSession, d: str) -> DataFrame:
    """The store after loading: first the even minutes, then all; the even ones stay as they were."""
    g = _grid(spark, d).select("symbol", "minute", "open")
    stored = g.where("minute % 2 = 0").withColumn("open", F.col("open") * 2)
    return C.insert_new(g, stored, ["symbol", "minute"]).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("open"), 4).alias("total"))


def b9_row_hash(spark: SparkSession, d: str) -> DataFrame:
    """Distinct raw rows by their hash."""
    return read(spark, d, "archive_candles").select(C.row_hash("symbol", "open_time", "close_time", "trade_count").alias("h")).groupBy("h").agg(F.count("*").alias("n"))


def c3_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps in each symbol's minutes."""
    return C.gaps(_grid(spark, d))


def c4_missing_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minutes missing between the first and the last minute of each symbol."""
    g = _grid(spark, d)
    a = C.availability(g).select("symbol", "first_minute", "last_minute")
    # A sequence holds a day at most, however long the history is.
    days = a.withColumn("day", F.explode(F.sequence(F.floor(F.col("first_minute") / 1440), F.floor(F.col("last_minute") / 1440))))
    start, stop = F.greatest("first_minute", F.col("day") * 1440), F.least("last_minute", F.col("day") * 1440 + 1439)
    return C.missing_minutes(g, days.select(F.col("symbol").alias("id"), "symbol", start.alias("start"), stop.alias("stop")))


def c5_resume_points(spark: SparkSession, d: str) -> DataFrame:
    """Where each symbol's import has to go on."""
    return C.resume_points(_grid(spark, d), 29_145_600)


def c7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of spans of two hours around every full hour between a symbol's first and last minute, also where the candles are missing."""
    g = _grid(spark, d)
    hours = C.availability(g).select("symbol", F.explode(F.sequence(F.floor(F.col("first_minute") / 60), F.floor(F.col("last_minute") / 60))).alias("hour"), "first_minute", "last_minute")
    at = hours.withColumn("minute", F.col("hour") * 60).where(F.col("minute").between(F.col("first_minute"), F.col("last_minute")))
    spans = at.select(F.concat("symbol", F.lit(":"), "minute").alias("id"), "symbol", (F.col("minute") - 60).alias("start"), (F.col("minute") + 60).alias("stop"))
    return C.window_coverage(spans, g, "BTCUSDT")


def c8_coverage_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Those spans by symbol and status, with totals."""
    return c7_coverage(spark, d).rollup("symbol", "status").agg(F.count("*").alias("n")).select(F.coalesce("symbol", F.lit("all")).alias("symbol"), F.coalesce("status", F.lit("all")).alias("status"), "n")


def c9_availability(spark: SparkSession, d: str) -> DataFrame:
    """First, last and number of minutes of each symbol."""
    return C.availability(_grid(spark, d))


def c11_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of each symbol."""
    return C.bars(_grid(spark, d), 60).withColumn("volume", F.round("volume", 4))


def c12_period_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each symbol over its hourly bars."""
    m = C.period_metrics(C.bars(_grid(spark, d), 60), 8760.0)
    return m.select("symbol", *[F.round(c, 6).alias(c) for c in ("return_pct", "max_drawdown_pct", "max_rise_pct", "volatility_pct")], "regime")


def c13_step_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the hourly steps of two symbols."""
    return C.step_correlation(C.bars(_grid(spark, d), 60), "BTCUSDT", "ETHUSDT").select("n", F.round("correlation", 6).alias("correlation"))


def c14_archive_months(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of each symbol's calendar months."""
    return C.archive_months(_grid(spark, d)).withColumn("month", F.col("month").cast("string"))


QUERIES = {f.__name__: f for f in (
    b1_normalised_times, b3_candle_codes, b4_sound_candles, b6_copies, b7_conflicts, b8_insert_new, b9_row_hash, c3_gaps, c4_missing_minutes, c5_resume_points, c7_coverage,
    c8_coverage_by_symbol, c9_availability, c11_hourly_bars, c12_period_metrics, c13_step_correlation, c14_archive_months,
)}

_COVER = _G + """, av AS (SELECT symbol, min(minute) AS first_minute FROM g GROUP BY 1),
    sp AS (SELECT symbol || ':' || minute AS id, symbol, minute - 60 AS start, minute + 60 AS stop FROM g WHERE minute % 60 = 0),
    o AS (SELECT id, count(*) AS own FROM sp JOIN g ON g.symbol = sp.symbol AND g.minute BETWEEN start AND stop GROUP BY 1),
    b AS (SELECT id, count(*) AS bench FROM sp JOIN g ON g.symbol = 'BTCUSDT' AND g.minute BETWEEN start AND stop GROUP BY 1),
    cv AS (SELECT id, sp.symbol, coalesce(own, 0) AS own, coalesce(bench, 0) AS bench, CASE WHEN own = 121 AND bench = 121 THEN 'fully_covered' WHEN start < first_minute THEN 'pre_listing'
        WHEN own > 0 AND bench > 0 THEN 'candle_gap_overlap' ELSE 'missing_context' END AS status FROM sp LEFT JOIN o USING (id) LEFT JOIN b USING (id) LEFT JOIN av ON av.symbol = sp.symbol)"""

_COVER_HOURS = _COVER.replace(
    "sp AS (SELECT symbol || ':' || minute AS id, symbol, minute - 60 AS start, minute + 60 AS stop FROM g WHERE minute % 60 = 0)",
    """fl AS (SELECT symbol, min(minute) AS f, max(minute) AS l FROM g GROUP BY 1), hr AS (SELECT symbol, f, l, unnest(generate_series(f // 60, l // 60)) * 60 AS minute FROM fl),
    sp AS (SELECT symbol || ':' || minute AS id, symbol, minute - 60 AS start, minute + 60 AS stop FROM hr WHERE minute BETWEEN f AND l)""",
)

SQL = {
    "b1_normalised_times": f"""WITH {_P}, q AS (SELECT *, CASE WHEN open_us BETWEEN 1483228800000000 AND 1893455999999999 THEN open_us END AS o, CASE WHEN close_us BETWEEN 1483228800000000 AND 1893455999999999 THEN close_us END AS c FROM p)
        SELECT symbol, open_time, o AS open_us, o // 60000000 AS minute, CASE WHEN symbol IS NULL OR open_time IS NULL OR close_time IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'missing_field'
        WHEN o IS NULL OR c IS NULL THEN 'timestamp_out_of_range' WHEN mixed THEN 'precision_mismatch' END AS error FROM q""",
    "b3_candle_codes": f"WITH {_P} SELECT concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _CODES) + ") AS codes, count(*) AS n FROM p GROUP BY 1",
    "b4_sound_candles": f"""WITH {_P}, q AS (SELECT symbol, coalesce(open > 0 AND close > 0 AND high >= open AND high >= close AND low <= open AND low <= close AND high >= low AND volume >= 0 AND open_us % 60000000 = 0, false) AS ok FROM p)
        SELECT symbol, count(*) FILTER (ok) AS sound, count(*) FILTER (NOT ok) AS unsound FROM q GROUP BY 1""",
    "b6_copies": f"""WITH {_P}, q AS (SELECT symbol, CASE WHEN open_us BETWEEN 1483228800000000 AND 1893455999999999 THEN open_us // 60000000 END AS minute, open, row_number() OVER (PARTITION BY symbol, CASE WHEN open_us BETWEEN 1483228800000000 AND 1893455999999999 THEN open_us // 60000000 END
        ORDER BY open_us NULLS FIRST, open NULLS FIRST, high NULLS FIRST, low NULLS FIRST, close NULLS FIRST, volume NULLS FIRST, open_time NULLS FIRST) AS copy_no FROM p) SELECT symbol, minute, copy_no, open FROM q WHERE copy_no > 1""",
    "b7_conflicts": f"WITH {_G} SELECT p.symbol, g.minute, p.open, g.open AS stored_open, p.close, g.close AS stored_close FROM p JOIN g ON p.symbol = g.symbol AND p.open_us // 60000000 = g.minute WHERE p.open IS DISTINCT FROM g.open OR p.close IS DISTINCT FROM g.close",
    "b8_insert_new": f"WITH {_G} SELECT symbol, count(*) AS n, round(sum(CASE WHEN minute % 2 = 0 THEN open * 2 ELSE open END), 4) AS total FROM g GROUP BY 1",
    "b9_row_hash": "SELECT sha256(concat_ws(',', symbol, open_time, close_time, trade_count)) AS h, count(*) AS n FROM archive_candles GROUP BY 1",
    "c3_gaps": f"WITH {_G}, l AS (SELECT symbol, minute, lag(minute) OVER (PARTITION BY symbol ORDER BY minute) AS b FROM g) SELECT symbol, b + 1 AS gap_start, minute - 1 AS gap_end, minute - b - 1 AS missing FROM l WHERE minute - b > 1",
    "c4_missing_minutes": f"WITH {_G}, a AS (SELECT symbol, min(minute) AS f, max(minute) AS l FROM g GROUP BY 1), w AS (SELECT symbol, unnest(generate_series(f, l)) AS minute FROM a) SELECT symbol AS id, symbol, minute FROM w ANTI JOIN g USING (symbol, minute)",
    "c5_resume_points": f"""WITH {_G}, h AS (SELECT * FROM g WHERE minute >= 29145600), e AS (SELECT symbol, min(minute) + 1 AS hole FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS n WHERE n.symbol = h.symbol AND n.minute = h.minute + 1) GROUP BY 1),
        f AS (SELECT symbol, min(minute) AS f FROM h GROUP BY 1) SELECT symbol, CASE WHEN f > 29145600 THEN 29145600 ELSE hole END AS resume_minute FROM f JOIN e USING (symbol)""",
    "c7_coverage": f"WITH {_COVER_HOURS} SELECT * FROM cv",
    "c8_coverage_by_symbol": f"WITH {_COVER_HOURS} SELECT coalesce(symbol, 'all') AS symbol, coalesce(status, 'all') AS status, count(*) AS n FROM cv GROUP BY ROLLUP (symbol, status)",
    "c9_availability": f"WITH {_G} SELECT symbol, min(minute) AS first_minute, max(minute) AS last_minute, count(DISTINCT minute) AS minutes FROM g GROUP BY 1",
    "c11_hourly_bars": f"WITH {_D} SELECT symbol, bar, open, high, low, close, round(volume, 4) AS volume, n FROM d",
    "c12_period_metrics": f"""WITH {_D}, w AS (SELECT *, max(close) OVER r AS peak, min(close) OVER r AS trough, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS step FROM d WINDOW r AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT symbol, (arg_max(close, bar) / arg_min(close, bar) - 1) * 100 AS a, min(close / peak - 1) * 100 AS b, max(close / trough - 1) * 100 AS c, stddev_samp(step) * sqrt(8760.0) * 100 AS v FROM w GROUP BY 1)
        SELECT symbol, round(a, 6) AS return_pct, round(b, 6) AS max_drawdown_pct, round(c, 6) AS max_rise_pct, round(v, 6) AS volatility_pct, CASE WHEN v >= 80 THEN 'volatile' WHEN a >= 10 THEN 'up' WHEN a <= -10 THEN 'down' ELSE 'flat' END AS regime FROM m""",
    "c13_step_correlation": f"""WITH {_D}, w AS (SELECT a.bar, a.close AS x, b.close AS y FROM d a JOIN d b ON a.bar = b.bar AND a.symbol = 'BTCUSDT' AND b.symbol = 'ETHUSDT'),
        t AS (SELECT w.x / v.x - 1 AS dx, w.y / v.y - 1 AS dy FROM w JOIN w AS v ON v.bar = w.bar - 1) SELECT count(*) AS n, round(corr(dx, dy), 6) AS correlation FROM t""",
    "c14_archive_months": f"""WITH {_G}, h AS (SELECT symbol, CAST(date_trunc('month', make_timestamp(minute * 60000000)) AS DATE) AS month, count(*) AS present FROM g GROUP BY 1, 2),
        m AS (SELECT symbol, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM h GROUP BY symbol), x AS (SELECT m.symbol, m.month, CAST(day(last_day(m.month)) * 1440 AS BIGINT) AS expected, coalesce(present, 0) AS present FROM m LEFT JOIN h USING (symbol, month))
        SELECT symbol, CAST(month AS VARCHAR) AS month, expected, present, expected - present AS missing FROM x""",
}
