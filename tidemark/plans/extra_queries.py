"""Queries of coverage by span, inclusive scores, nested folds, memberships and the discovery grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import context as X
from tidemark.operators import dataset as D
from tidemark.operators import reactions as R
from tidemark.operators import signals as K
from tidemark.plans.analysis_queries import _EV, _FR, _events, _one
from tidemark.plans.candle_queries import _G, _grid, _parsed
from tidemark.plans.models import ASSETS, BARS, RETURNS, bars, event_assets, news, returns


def _r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def c10_span_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether a symbol's history reaches an hour around every minute."""
    g = _grid(spark, d)
    return C.span_status(g.select(F.col("minute").alias("id"), "symbol", F.col("minute").alias("at")), g, 60, 60).groupBy("symbol", "status").agg(F.count("*").alias("n"))


def n9_invalid_impact(spark: SparkSession, d: str) -> DataFrame:
    """Unsound candles by their use for reactions from every minute over three."""
    p = _parsed(spark, d)
    base = p.where("minute IS NOT NULL").select("symbol", "minute").distinct()
    used = base.withColumn("role", F.lit("reference")).unionByName(base.select("symbol", (F.col("minute") + 3).alias("minute"), F.lit("endpoint").alias("role")))
    return C.invalid_impact(p, used)


def e9_inclusive_scores(spark: SparkSession, d: str) -> DataFrame:
    """Volume scores that include the last bar, by sample and population deviation."""
    return R.per_base(event_assets(spark, d), lambda e: X.inclusive_scores(e, bars(spark, d), 60)).select("event_id", "symbol", *_r("sample", "population"))


def e11_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Trend before events in regimes, by symbol."""
    a = R.per_base(event_assets(spark, d), lambda e: X.averages_before(e, bars(spark, d), 20))
    return a.groupBy("symbol", X.regime(F.col("sma_distance"), 0.25).alias("trend")).agg(F.count("*").alias("n"))


def e15_crowding(spark: SparkSession, d: str) -> DataFrame:
    """Quadrants of price and volume steps of the bars."""
    g = bars(spark, d)
    j = X.prior_price(g.select("symbol", F.col("bar").alias("base"), "open", "volume"), g, 1).join(g.select("symbol", (F.col("bar") + 1).alias("base"), F.col("volume").alias("v0")), ["symbol", "base"])
    f = X.crowding(F.col("open") - F.col("prior_open"), F.col("volume") - F.col("v0"), F.try_divide(F.col("volume"), F.col("v0")))
    return j.groupBy("symbol", *[c.alias(n) for n, c in f.items()]).agg(F.count("*").alias("n"))


def i2_prior_price(spark: SparkSession, d: str) -> DataFrame:
    """Price a day before the base of every event."""
    return X.prior_price(event_assets(spark, d).select("event_id", "symbol", "base"), bars(spark, d), 24).select("event_id", "symbol", "prior_open")


def i8_nested_folds(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the parts of five nested folds."""
    return D.nested_folds(_one(spark, d), "published_us", "event_id").groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def j4_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of the events by class of source."""
    return D.missing_report(_events(spark, d), "source_class", ["category", "sentiment", "importance", "published_at"])


def _with_rules(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    w = R.wide_returns(returns(spark, d), (1, 5, 15, 24)).join(news(spark, d), "event_id")
    place = F.when(F.col("symbol") == "BTC", 0).when(F.col("symbol") == "ETH", 1).otherwise(2)
    x = w.withColumns({"event_id": F.col("event_id") * 3 + place, "x": (F.col("actor") % 10).cast("double")})
    return x, {**K.threshold_rules({"x": [2.0, 5.0, 8.0]}), "x>=2 again": F.col("x") > 1.5, "none": F.col("x") > 100}


def k27_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Rules left after dropping those that select the same rows."""
    x, rules = _with_rules(spark, d)
    return K.distinct_memberships(x, rules, "event_id")


def k28_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Direction and accuracy of every rule, horizon and band on the earlier events."""
    x, rules = _with_rules(spark, d)
    g = K.discovery_grid(x, rules, {"1": "ret_1", "5": "ret_5", "24": "ret_24"}, [0.0, 10.0, 50.0], F.col("published_us") < 1_705_000_000_000_000, 30)
    return g.select("rule_id", "horizon", "band", "direction", "n", *_r("accuracy", "mean"))


QUERIES = {f.__name__: f for f in (c10_span_status, n9_invalid_impact, e9_inclusive_scores, e11_regimes, e15_crowding, i2_prior_price, i8_nested_folds, j4_missing, k27_memberships, k28_discovery)}

_RULES = [*[(f"x{op}{t}", f"x {op} {t}") for t in (2, 5, 8) for op in (">=", "<=")], ("x>=2 again", "x > 1.5"), ("none", "x > 100")]
_X = _FR + ", w AS (SELECT event_id, symbol, max(ret) FILTER (horizon = 1) AS r1, max(ret) FILTER (horizon = 5) AS r5, max(ret) FILTER (horizon = 24) AS r24 FROM hr GROUP BY 1, 2), x AS (SELECT event_id * 3 + CASE symbol WHEN 'BTC' THEN 0 WHEN 'ETH' THEN 1 ELSE 2 END AS event_id, published_us, actor, source, (actor % 10)::DOUBLE AS x, r1, r5, r24 FROM w JOIN news USING (event_id)), tg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, * FROM x WHERE {t}" for n, t in _RULES) + ")"
_WIN = f"{BARS}, {ASSETS}, w AS (SELECT event_id, ea.symbol, g.bar - base AS o, g.close, g.volume FROM ea JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base - 60 AND base - 1)"

SQL = {
    "c10_span_status": f"""WITH {_G}, a AS (SELECT symbol, min(minute) AS lo, max(minute) AS hi FROM g GROUP BY 1), st AS (SELECT symbol, CASE WHEN minute - 60 >= lo AND minute + 60 <= hi THEN 'covered' WHEN minute - 60 < lo AND minute + 60 > hi THEN 'too_short' WHEN minute - 60 < lo THEN 'starts_late' ELSE 'ends_early' END AS status FROM g JOIN a USING (symbol)) SELECT symbol, status, count(*) AS n FROM st GROUP BY 1, 2""",
    "n9_invalid_impact": f"""WITH {_G}, ok AS (SELECT *, open_us // 60000000 AS m, CASE WHEN open_us BETWEEN 1483228800000000 AND 1893455999999999 AND close_us BETWEEN 1483228800000000 AND 1893455999999999 AND NOT mixed THEN 1 ELSE 0 END AS fine,
        open > 0 AND close > 0 AND high >= open AND high >= close AND low <= open AND low <= close AND high >= low AND volume >= 0 AND open_us % 60000000 = 0 AS sound FROM p), bad AS (SELECT DISTINCT symbol, m FROM ok WHERE fine = 1 AND NOT sound), b AS (SELECT DISTINCT symbol, m FROM ok WHERE open_us BETWEEN 1483228800000000 AND 1893455999999999)
        SELECT CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.symbol = bad.symbol AND b.m = bad.m) THEN 'reference' WHEN EXISTS (SELECT 1 FROM b WHERE b.symbol = bad.symbol AND b.m + 3 = bad.m) THEN 'endpoint' ELSE 'unused' END AS use, count(*) AS n FROM bad GROUP BY 1""",
    "e9_inclusive_scores": f"WITH {_WIN}, a AS (SELECT event_id, symbol, max(volume) FILTER (o = -1) AS v, avg(volume) AS m, stddev_samp(volume) AS s, stddev_pop(volume) AS p FROM w GROUP BY 1, 2) SELECT event_id, symbol, round((v - m) / nullif(s, 0), 6) AS sample, round((v - m) / nullif(p, 0), 6) AS population FROM a",
    "e11_regimes": f"WITH {_WIN}, a AS (SELECT event_id, symbol, max(close) FILTER (o = -1) / nullif(avg(close) FILTER (o >= -20), 0) - 1 AS dist FROM w WHERE o >= -40 GROUP BY 1, 2) SELECT symbol, CASE WHEN dist < -0.25 THEN 'down' WHEN dist > 0.25 THEN 'up' WHEN dist IS NOT NULL THEN 'flat' END AS trend, count(*) AS n FROM a GROUP BY 1, 2",
    "e15_crowding": f"""WITH {BARS}, j AS (SELECT b.symbol, b.open - a.open AS dp, b.volume - a.volume AS dv, b.volume / nullif(a.volume, 0) AS r FROM bars b JOIN bars a ON a.symbol = b.symbol AND a.bar = b.bar - 1)
        SELECT symbol, CASE WHEN dp >= 0 THEN 'up' ELSE 'down' END || '_' || CASE WHEN dv >= 0 THEN 'building' ELSE 'leaving' END AS quadrant, r > 1.2::DOUBLE AS crowded_long, r < 0.8::DOUBLE AS crowded_short, count(*) AS n FROM j GROUP BY 1, 2, 3, 4""",
    "i2_prior_price": f"WITH {BARS}, {ASSETS} SELECT event_id, ea.symbol, b.open AS prior_open FROM ea LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base - 24",
    "i8_nested_folds": f"""WITH {_FR}, k AS (SELECT event_id, (row_number() OVER (ORDER BY published_us, event_id) - 1) / count(*) OVER () AS a FROM o), f AS (SELECT event_id, a, fold, 0.4::DOUBLE + 0.1::DOUBLE * fold AS e FROM k, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)), p AS (SELECT event_id, fold, CASE WHEN a < e THEN 'train' WHEN a < e + 0.1::DOUBLE THEN 'validate' WHEN a < e + 2 * 0.1::DOUBLE THEN 'evaluate' END AS part FROM f)
        SELECT fold, part, count(*) AS n, min(event_id) AS first_id FROM p WHERE part IS NOT NULL GROUP BY 1, 2""",
    "j4_missing": f"WITH {_EV} " + " UNION ALL ".join(f"""SELECT source_class, count(*) AS n, '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing FROM ev GROUP BY 1""" for c in ("category", "sentiment", "importance", "published_at")),
    "k27_memberships": f"WITH {_X}, m AS (SELECT rule_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS l FROM tg GROUP BY 1) SELECT min(rule_id) AS rule_id, any_value(n) AS n FROM m GROUP BY l",
    "k28_discovery": f"""WITH {_X}, l AS (SELECT rule_id, '1' AS horizon, r1 AS v FROM tg WHERE published_us < 1705000000000000 UNION ALL SELECT rule_id, '5', r5 FROM tg WHERE published_us < 1705000000000000 UNION ALL SELECT rule_id, '24', r24 FROM tg WHERE published_us < 1705000000000000),
        a AS (SELECT rule_id, horizon, band, count(*) AS n, avg((v > band)::INT) AS up, avg((v < -band)::INT) AS down, avg(v) AS m FROM l, (SELECT unnest([0.0, 10.0, 50.0])::DOUBLE AS band) WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 30)
        SELECT rule_id, horizon, band, CASE WHEN up >= down THEN 'LONG' ELSE 'SHORT' END AS direction, n, round(greatest(up, down), 6) AS accuracy, round(CASE WHEN up >= down THEN m ELSE -m END, 6) AS mean FROM a""",
}
