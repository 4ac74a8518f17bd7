"""Queries of market reactions and of the context before events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import context as X
from tidemark.operators import reactions as R
from tidemark.plans.models import ASSETS, BARS, HORIZONS, NEWS, PCT, RETURNS, bars, event_assets, news, returns


def _r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def d4_mean_reaction(spark: SparkSession, d: str) -> DataFrame:
    """Mean reaction by symbol and horizon: the flagship."""
    return returns(spark, d).groupBy("symbol", "horizon").agg(F.count("*").alias("events"), F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.median("ret"), 6).alias("median_ret"))


def d1_base_bars(spark: SparkSession, d: str) -> DataFrame:
    """Base and latency bars of the news."""
    s = F.col("published_us") / 1_000_000
    return news(spark, d).select("event_id", R.base_bar(s).alias("base_1m"), R.base_bar(s, latency=1).alias("entry_1m"), R.base_bar(s, 3600).alias("base_1h"))


def d4_reactions(spark: SparkSession, d: str) -> DataFrame:
    """Every event's return at every horizon."""
    return returns(spark, d).select("event_id", "symbol", "horizon", *_r("ret"))


def d5_quality(spark: SparkSession, d: str) -> DataFrame:
    """Number of reactions by quality and reason."""
    return R.reaction_quality(returns(spark, d)).groupBy("symbol", "quality", "reason").agg(F.count("*").alias("n"))


def d8_market_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Mean raw, market-adjusted and abnormal (beta 1.2) return by symbol and horizon."""
    r = returns(spark, d).select("event_id", "symbol", "horizon", "ret")
    b = r.where("symbol = 'BTC'").select("event_id", "horizon", F.col("ret").alias("bench"))
    j = r.join(b, ["event_id", "horizon"])
    is_b = F.col("symbol") == "BTC"
    return j.groupBy("symbol", "horizon").agg(
        F.round(F.avg("ret"), 6).alias("raw"), F.round(F.avg(R.abnormal(F.col("ret"), F.col("bench"), 1.0, is_b)), 6).alias("adjusted"), F.round(F.avg(R.abnormal(F.col("ret"), F.col("bench"), 1.2, is_b)), 6).alias("abnormal"))


def d3_hour_reaction(spark: SparkSession, d: str) -> DataFrame:
    """Extremes and volume change over the five bars after the base."""
    return R.per_base(event_assets(spark, d), lambda e: R.hour_reaction(e, bars(spark, d), 5)).select("event_id", "symbol", *_r("max_ret", "min_ret", "volume_change"))


def _path(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    events = event_assets(spark, d) if events is None else events
    return R.price_path(events.select("event_id", "symbol", "base"), bars(spark, d), 24)


def d9_excursions(spark: SparkSession, d: str) -> DataFrame:
    """Best and worst excursions of long positions over 24 bars."""
    return R.per_base(event_assets(spark, d), lambda e: R.excursions(_path(spark, d, e))).select("event_id", "symbol", *_r("mfe", "mae"), "mfe_at", "mae_at")


def d9_excursions_short(spark: SparkSession, d: str) -> DataFrame:
    """The same for short positions."""
    return R.per_base(event_assets(spark, d), lambda e: R.excursions(_path(spark, d, e), short=True)).select("event_id", "symbol", *_r("mfe", "mae"), "mfe_at", "mae_at")


def d11_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Realised volatility over 24 bars."""
    return R.per_base(event_assets(spark, d), lambda e: R.path_volatility(_path(spark, d, e), 24)).select("event_id", "symbol", *_r("volatility"), "n")


def d13_volume_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Volume after against volume before the event."""
    return R.per_base(event_assets(spark, d), lambda e: R.volume_ratio(e, bars(spark, d), 5)).select("event_id", "symbol", *_r("ratio", "log_ratio"), "shock")


def d17_path_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean path of each symbol by offset."""
    return _path(spark, d).groupBy("symbol", "offset").agg(F.count("*").alias("n"), F.round(F.avg("open_ret"), 6).alias("mean_open_ret"))


def d18_first_passage(spark: SparkSession, d: str) -> DataFrame:
    """First passage of 10 and 50 percent either way."""
    return R.per_base(event_assets(spark, d), lambda e: R.first_passage(_path(spark, d, e), (10.0, 50.0)))


def d19_returned(spark: SparkSession, d: str) -> DataFrame:
    """Events whose return came back to the entry after its best."""
    def back(e: DataFrame) -> DataFrame:
        p = _path(spark, d, e)
        return R.returned_to_entry(p, R.excursions(p))

    return R.per_base(event_assets(spark, d), back).groupBy("symbol", "returned").agg(F.count("*").alias("n"))


def d20_retention(spark: SparkSession, d: str) -> DataFrame:
    """Share of the best excursion left at 24 bars, and what was given back."""
    r = returns(spark, d).where("horizon = 24").select("event_id", "symbol", "ret")
    kept, back = R.retention(F.col("ret"), F.col("mfe"))
    return R.per_base(event_assets(spark, d), lambda e: R.excursions(_path(spark, d, e))).join(r, ["event_id", "symbol"]).select("event_id", "symbol", F.round(kept, 6).alias("kept"), F.round(back, 6).alias("given_back"))


def d22_reaction_class(spark: SparkSession, d: str) -> DataFrame:
    """Whether the market moved before or after each event."""
    e = event_assets(spark, d).select("event_id", "symbol", "base")
    back = R.horizon_returns(e.withColumn("base", F.col("base") - 1), bars(spark, d), (1,)).select("event_id", "symbol", F.col("ret").alias("pre"))
    ahead = R.horizon_returns(e, bars(spark, d), (1,)).select("event_id", "symbol", F.col("ret").alias("post"))
    return back.join(ahead, ["event_id", "symbol"]).groupBy("symbol", R.reaction_class(F.col("pre"), F.col("post"), 25.0).alias("reaction")).agg(F.count("*").alias("n"))


def d23_average(spark: SparkSession, d: str) -> DataFrame:
    """Average reaction over the horizons, and the strongest of them."""
    cols = {h: f"ret_{h}" for h in HORIZONS}
    return R.wide_returns(returns(spark, d), HORIZONS).select("event_id", "symbol", F.round(R.average_reaction(list(cols.values())), 6).alias("average"), R.strongest_horizon(cols).alias("strongest"))


def d25_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Returns assembled from two providers by priority, with their provenance."""
    w = R.wide_returns(returns(spark, d), HORIZONS)
    value, who = R.fallback([("ret_24", "day"), ("ret_15", "half")])
    return w.select("event_id", "symbol", F.round(value, 6).alias("value"), who.alias("provenance"))


def n15_wide(spark: SparkSession, d: str) -> DataFrame:
    """Long returns made wide."""
    return R.wide_returns(returns(spark, d), HORIZONS).select("event_id", "symbol", *_r(*[f"ret_{h}" for h in HORIZONS]))


def e1_pre_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns over the bars before the base."""
    e = event_assets(spark, d).select("event_id", "symbol", (F.col("base") - 1).alias("at"))
    g = bars(spark, d)
    parts = [R.horizon_returns(e.select("event_id", "symbol", (F.col("at") - n).alias("base")), g, (n,)).select("event_id", "symbol", F.col("ret").alias("ret"), F.lit(n).alias("bars")) for n in (1, 5, 24)]
    return parts[0].union(parts[1]).union(parts[2]).select("event_id", "symbol", "bars", *_r("ret"))


def e3_beta(spark: SparkSession, d: str) -> DataFrame:
    """Beta and correlation with the benchmark over 168 bars."""
    return R.per_base(event_assets(spark, d), lambda e: X.beta_before(e, bars(spark, d), "BTC", 168, 20)).select("event_id", "symbol", "n", *_r("beta", "correlation", "used"), "fell_back")


def e6_averages(spark: SparkSession, d: str) -> DataFrame:
    """Moving averages, range and volume score before the base."""
    return R.per_base(event_assets(spark, d), lambda e: X.averages_before(e, bars(spark, d), 20)).select("event_id", "symbol", "n", *_r("sma_distance", "sma_slope", "range_share", "volume_score", "volume_ratio"))


def e7_ema(spark: SparkSession, d: str) -> DataFrame:
    """Exponential average before the base."""
    return R.per_base(event_assets(spark, d), lambda e: X.ema_before(e, bars(spark, d), 12)).select("event_id", "symbol", "n", *_r("ema"))


def e12_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Calendar and session features of the news."""
    return news(spark, d).select("event_id", *[c.alias(n) for n, c in X.calendar(F.timestamp_micros("published_us")).items()])


def _as_of(spark: SparkSession, d: str, tolerance: int | None) -> DataFrame:
    from tidemark.plans.cut import read
    from tidemark.plans.models import epoch_us

    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", epoch_us("ts").alias("t"))
    left, right = e.where("event_type = 'signup'").select("event_id", "user_id", "t"), e.where("event_type = 'view'").select("user_id", "t", F.col("value").alias("seen"))
    return X.as_of(left, right, ["user_id"], "t", ["seen"], tolerance).select("event_id", "user_id", "seen")


def e13_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last view of a user before each signup, of any age."""
    return _as_of(spark, d, None)


def e13_as_of_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The same, at most two days old."""
    return _as_of(spark, d, 2 * 86_400_000_000)


def e14_rolling_score(spark: SparkSession, d: str) -> DataFrame:
    """Rolling score of the closes of each symbol."""
    return X.rolling_score(bars(spark, d), ["symbol"], "bar", "close", 21, 5).select("symbol", "bar", *_r("score"))


def e16_terciles(spark: SparkSession, d: str) -> DataFrame:
    """Terciles of the closes fitted on the earlier bars."""
    return X.tercile_labels(bars(spark, d), "close", F.col("bar") < 473_700).groupBy("symbol", "tercile").agg(F.count("*").alias("n"))


def e17_next_event(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the next news of the same source, and how many follow within the hour."""
    return X.next_event(news(spark, d), "source", "published_us", 3_600_000_000).select("event_id", "to_next", "within")


QUERIES = {f.__name__: f for f in (
    d4_mean_reaction, d1_base_bars, d4_reactions, d5_quality, d8_market_adjusted, d3_hour_reaction, d9_excursions, d9_excursions_short, d11_volatility, d13_volume_ratio, d17_path_summary, d18_first_passage,
    d19_returned, d20_retention, d22_reaction_class, d23_average, d25_fallback, n15_wide, e1_pre_returns, e3_beta, e6_averages, e7_ema, e12_calendar, e13_as_of, e13_as_of_tolerance, e14_rolling_score,
    e16_terciles, e17_next_event,
)}

_PATH = f"""{BARS}, {ASSETS}, path AS (SELECT event_id, ea.symbol, g.bar - base AS "offset", g.open, g.volume, b.open AS p0, {PCT.format('g.open', 'b.open')} AS open_ret, {PCT.format('g.high', 'b.open')} AS high_ret, {PCT.format('g.low', 'b.open')} AS low_ret
    FROM ea JOIN bars b ON b.symbol = ea.symbol AND b.bar = base JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base AND base + 24 WHERE b.open > 0)"""
_EXC = _PATH + """, pk AS (SELECT * FROM path WHERE high_ret IS NOT NULL AND low_ret IS NOT NULL),
    ex AS (SELECT event_id, symbol, max(high_ret) AS mfe, min(low_ret) AS mae, arg_min("offset", struct_pack(a := -high_ret, b := "offset")) AS mfe_at, arg_min("offset", struct_pack(a := low_ret, b := "offset")) AS mae_at FROM pk GROUP BY 1, 2)"""
_WIDE = RETURNS + ", w AS (SELECT event_id, symbol, " + ", ".join(f"max(ret) FILTER (horizon = {h}) AS ret_{h}" for h in HORIZONS) + " FROM hr GROUP BY 1, 2)"
_HOUR = f"{BARS}, {ASSETS}, w AS (SELECT event_id, ea.symbol, g.bar - base AS o, g.* EXCLUDE (symbol, bar) FROM ea JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base - 40 AND base + 5)"
_ASOF = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT l.event_id, l.user_id, {} AS seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""

SQL = {
    "d4_mean_reaction": f"WITH {RETURNS} SELECT symbol, horizon, count(*) AS events, count(ret) AS n, round(avg(ret), 6) AS mean_ret, round(median(ret), 6) AS median_ret FROM hr GROUP BY 1, 2",
    "d1_base_bars": f"WITH {NEWS} SELECT event_id, published_us // 60000000 + 1 AS base_1m, published_us // 60000000 + 2 AS entry_1m, published_us // 3600000000 + 1 AS base_1h FROM news",
    "d4_reactions": f"WITH {RETURNS} SELECT event_id, symbol, horizon, round(ret, 6) AS ret FROM hr",
    "d5_quality": f"""WITH {RETURNS}, q AS (SELECT event_id, symbol, max(base_open) AS b, count(ret) AS n, count(*) AS a, string_agg(CASE WHEN ret IS NULL THEN horizon::VARCHAR END, '|' ORDER BY horizon) AS l FROM hr GROUP BY 1, 2)
        SELECT symbol, CASE WHEN b IS NULL OR b <= 0 THEN 'missing_reference' WHEN n = a THEN 'complete' ELSE 'partial' END AS quality, CASE WHEN b IS NULL OR b <= 0 THEN 'missing_reference' WHEN n < a THEN 'missing_market_data:' || l END AS reason, count(*) AS n FROM q GROUP BY 1, 2, 3""",
    "d8_market_adjusted": f"""WITH {RETURNS}, b AS (SELECT event_id, horizon, ret AS bench FROM hr WHERE symbol = 'BTC') SELECT symbol, horizon, round(avg(ret), 6) AS raw, round(avg(CASE WHEN symbol = 'BTC' THEN ret ELSE ret - bench END), 6) AS adjusted,
        round(avg(CASE WHEN symbol = 'BTC' THEN ret ELSE ret - 1.2::DOUBLE * bench END), 6) AS abnormal FROM hr JOIN b USING (event_id, horizon) GROUP BY 1, 2""",
    "d3_hour_reaction": f"""WITH {_HOUR}, a AS (SELECT event_id, symbol, max(open) FILTER (o = 0) AS p0, max(volume) FILTER (o = 0) AS v0, max(high) FILTER (o > 0) AS hi, min(low) FILTER (o > 0) AS lo, avg(volume) FILTER (o > 0) AS v FROM w WHERE o >= 0 GROUP BY 1, 2)
        SELECT event_id, symbol, round({PCT.format('hi', 'p0')}, 6) AS max_ret, round({PCT.format('lo', 'p0')}, 6) AS min_ret, round({PCT.format('v', 'v0')}, 6) AS volume_change FROM a WHERE p0 IS NOT NULL""",
    "d9_excursions": f"WITH {_EXC} SELECT event_id, symbol, round(mfe, 6) AS mfe, round(mae, 6) AS mae, mfe_at, mae_at FROM ex",
    "d9_excursions_short": f"""WITH {_EXC}, sx AS (SELECT event_id, symbol, max(0 - low_ret) AS mfe, min(0 - high_ret) AS mae, arg_min("offset", struct_pack(a := low_ret, b := "offset")) AS mfe_at, arg_min("offset", struct_pack(a := -high_ret, b := "offset")) AS mae_at FROM pk GROUP BY 1, 2)
        SELECT event_id, symbol, round(mfe, 6) AS mfe, round(mae, 6) AS mae, mfe_at, mae_at FROM sx""",
    "d11_volatility": f"""WITH {_PATH}, l AS (SELECT event_id, symbol, "offset" AS o, open, lag(open) OVER k AS p, lag("offset") OVER k AS q FROM path WINDOW k AS (PARTITION BY event_id, symbol ORDER BY "offset")),
        s AS (SELECT event_id, symbol, CASE WHEN o - q = 1 AND p > 0 AND open > 0 THEN ln(open / p) END AS r FROM l) SELECT event_id, symbol, round(sqrt(sum(r * r)) * 100, 6) AS volatility, count(r) AS n FROM s GROUP BY 1, 2""",
    "d13_volume_ratio": f"""WITH {_HOUR}, a AS (SELECT event_id, symbol, avg(volume) FILTER (o BETWEEN 0 AND 4) / avg(volume) FILTER (o BETWEEN -5 AND -1) AS r FROM w WHERE o BETWEEN -5 AND 4 GROUP BY 1, 2)
        SELECT event_id, symbol, round(r, 6) AS ratio, round(ln(r), 6) AS log_ratio, r >= 2 AS shock FROM a""",
    "d17_path_summary": f'WITH {_PATH} SELECT symbol, "offset", count(*) AS n, round(avg(open_ret), 6) AS mean_open_ret FROM path GROUP BY 1, 2',
    "d18_first_passage": f"""WITH {_PATH} SELECT event_id, symbol, min("offset") FILTER (open_ret >= 10) AS up_10_0, min("offset") FILTER (open_ret <= -10) AS down_10_0, min("offset") FILTER (open_ret >= 50) AS up_50_0, min("offset") FILTER (open_ret <= -50) AS down_50_0 FROM path GROUP BY 1, 2""",
    "d19_returned": f"""WITH {_EXC}, t AS (SELECT event_id, symbol, coalesce(bool_or("offset" >= mfe_at AND open_ret <= 0), false) AS returned FROM path JOIN ex USING (event_id, symbol) GROUP BY 1, 2) SELECT symbol, returned, count(*) AS n FROM t GROUP BY 1, 2""",
    "d20_retention": f"""WITH {_EXC}, e2 AS (SELECT bb.symbol, bb.bar, bb.open FROM bars bb) SELECT ex.event_id, ex.symbol, round({PCT.format('y.open', 'x.open')} / nullif(mfe, 0), 6) AS kept, round(mfe - ({PCT.format('y.open', 'x.open')}), 6) AS given_back
        FROM ex JOIN ea ON ea.event_id = ex.event_id AND ea.symbol = ex.symbol LEFT JOIN e2 x ON x.symbol = ea.symbol AND x.bar = base LEFT JOIN e2 y ON y.symbol = ea.symbol AND y.bar = base + 24""",
    "d22_reaction_class": f"""WITH {BARS}, {ASSETS}, c AS (SELECT ea.symbol, {PCT.format('b.open', 'a.open')} AS pre, {PCT.format('c.open', 'b.open')} AS post FROM ea LEFT JOIN bars a ON a.symbol = ea.symbol AND a.bar = base - 1 LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base
        LEFT JOIN bars c ON c.symbol = ea.symbol AND c.bar = base + 1) SELECT symbol, CASE WHEN pre IS NULL OR post IS NULL THEN NULL WHEN abs(pre) >= 25 AND abs(post) >= 25 THEN 'both' WHEN abs(pre) >= 25 THEN 'pre' WHEN abs(post) >= 25 THEN 'post' ELSE 'none' END AS reaction, count(*) AS n FROM c GROUP BY 1, 2""",
    "d23_average": f"""WITH {_WIDE}, s AS (SELECT event_id, symbol, count(ret) AS k, avg(ret) AS m, arg_max(horizon, struct_pack(a := abs(ret), b := -horizon)) FILTER (ret IS NOT NULL) AS strongest FROM hr GROUP BY 1, 2) SELECT event_id, symbol, round(CASE WHEN k >= 3 THEN m END, 6) AS average, strongest FROM s""",
    "d25_fallback": f"WITH {_WIDE} SELECT event_id, symbol, round(coalesce(ret_24, ret_15), 6) AS value, concat_ws('+', CASE WHEN ret_24 IS NOT NULL THEN 'day' END, CASE WHEN ret_15 IS NOT NULL THEN 'half' END) AS provenance FROM w",
    "n15_wide": f"WITH {_WIDE} SELECT event_id, symbol, " + ", ".join(f"round(ret_{h}, 6) AS ret_{h}" for h in HORIZONS) + " FROM w",
    "e1_pre_returns": f"""WITH {BARS}, {ASSETS}, k AS (SELECT unnest([1, 5, 24]) AS n) SELECT event_id, ea.symbol, n AS bars, round({PCT.format('b.open', 'a.open')}, 6) AS ret FROM ea CROSS JOIN k LEFT JOIN bars a ON a.symbol = ea.symbol AND a.bar = base - 1 - n LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base - 1""",
    "e3_beta": f"""WITH {BARS}, {ASSETS}, st AS (SELECT b.symbol, b.bar, ln(b.open / a.open) AS r FROM bars b JOIN bars a ON a.symbol = b.symbol AND a.bar = b.bar - 1 WHERE a.open > 0 AND b.open > 0), xy AS (SELECT y.symbol, y.bar, y.r AS y, x.r AS x FROM st y JOIN st x ON x.bar = y.bar AND x.symbol = 'BTC'),
        a AS (SELECT event_id, ea.symbol, count(*) AS n, covar_samp(y, x) AS c, CASE WHEN count(*) > 1 THEN var_samp(x) END AS v, CASE WHEN count(*) >= 20 THEN corr(y, x) END AS rho FROM ea JOIN xy ON xy.symbol = ea.symbol AND xy.bar BETWEEN base - 167 AND base - 1 GROUP BY 1, 2),
        f AS (SELECT ea.event_id, ea.symbol, coalesce(n, 0) AS n, CASE WHEN n >= 20 AND v > 1e-16 THEN c / v END AS b, rho FROM ea LEFT JOIN a ON a.event_id = ea.event_id AND a.symbol = ea.symbol) SELECT event_id, symbol, n, round(b, 6) AS beta, round(rho, 6) AS correlation, round(coalesce(b, 1.0), 6) AS used, b IS NULL AS fell_back FROM f""",
    "e6_averages": f"""WITH {_HOUR}, a AS (SELECT event_id, symbol, avg(close) FILTER (o >= -20) AS sma, avg(close) FILTER (o < -20) AS sma0, max(close) FILTER (o = -1) AS last, max(high) FILTER (o >= -20) AS hi, min(low) FILTER (o >= -20) AS lo, max(volume) FILTER (o = -1) AS v,
        avg(volume) FILTER (o >= -20 AND o < -1) AS vm, stddev_samp(volume) FILTER (o >= -20 AND o < -1) AS vs, count(*) FILTER (o >= -20) AS n FROM w WHERE o BETWEEN -40 AND -1 GROUP BY 1, 2)
        SELECT event_id, symbol, n, round(last / nullif(sma, 0) - 1, 6) AS sma_distance, round((sma / nullif(sma0, 0) - 1) / 20, 6) AS sma_slope, round((hi - lo) / nullif(last, 0), 6) AS range_share, round((v - vm) / nullif(vs, 0), 6) AS volume_score, round(v / nullif(vm, 0), 6) AS volume_ratio FROM a""",
    "e7_ema": f"""WITH {_HOUR}, k AS (SELECT event_id, symbol, close, row_number() OVER (PARTITION BY event_id, symbol ORDER BY o) AS k, count(*) OVER (PARTITION BY event_id, symbol) AS n FROM w WHERE o BETWEEN -12 AND -1)
        SELECT event_id, symbol, max(n) AS n, round(sum(CASE WHEN k = 1 THEN pow(11.0 / 13, n - 1) ELSE 2.0 / 13 * pow(11.0 / 13, n - k) END * close), 6) AS ema FROM k GROUP BY 1, 2""",
    "e12_calendar": """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, (isodow(ts) >= 6)::INT AS weekend, month(ts) AS month, (hour(ts) BETWEEN 13 AND 21)::INT AS us_session, (hour(ts) BETWEEN 7 AND 15)::INT AS eu_session, (hour(ts) BETWEEN 0 AND 8)::INT AS asia_session, second(ts) AS second
        FROM events WHERE event_type IN ('signup', 'error')""",
    "e13_as_of": _ASOF.format("r.value"),
    "e13_as_of_tolerance": _ASOF.format("CASE WHEN l.ts - r.ts <= INTERVAL 2 DAY THEN r.value END"),
    "e14_rolling_score": f"WITH {BARS}, s AS (SELECT symbol, bar, close, count(close) OVER k AS n, avg(close) OVER k AS m, stddev_samp(close) OVER k AS s FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT symbol, bar, round(CASE WHEN n >= 5 THEN (close - m) / nullif(s, 0) END, 6) AS score FROM s",
    "e16_terciles": f"WITH {BARS}, q AS (SELECT quantile_cont(close, 0.33) AS a, quantile_cont(close, 0.67) AS b FROM bars WHERE bar < 473700) SELECT symbol, CASE WHEN close <= a THEN 'low' WHEN close >= b THEN 'high' WHEN close IS NOT NULL THEN 'middle' END AS tercile, count(*) AS n FROM bars, q GROUP BY 1, 2",
    "e17_next_event": f"WITH {NEWS} SELECT event_id, lead(published_us) OVER k - published_us AS to_next, count(*) OVER (PARTITION BY source ORDER BY published_us RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING) AS within FROM news WINDOW k AS (PARTITION BY source ORDER BY published_us)",
}
