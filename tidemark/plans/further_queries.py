"""Further queries: windows, ledgers, joins, audits, baselines and filters composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity as I
from tidemark.functions import textrules as T
from tidemark.operators import dataset as D
from tidemark.operators import dedup as G
from tidemark.operators import quality as Q
from tidemark.operators import reactions as R
from tidemark.operators import release as N
from tidemark.operators import serving as M
from tidemark.operators import signals as K
from tidemark.operators import stats as L
from tidemark.plans.analysis_queries import _EV, _FR, _events, _frame, _one, _rules, _tagged
from tidemark.plans.cut import read, small
from tidemark.plans.models import ASSETS, BARS, PCT, RETURNS, bars, epoch_us, event_assets, returns


def _r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def d12_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of steps, range and mean span over 12 bars."""
    return R.per_base(event_assets(spark, d), lambda e: R.window_ranges(e, bars(spark, d), 12)).select("event_id", "symbol", "n", *_r("step_std", "range_share", "true_range", digits=5))


def d14_volume_shock(spark: SparkSession, d: str) -> DataFrame:
    """Volume over 5 bars against what 60 bars before let expect."""
    return R.per_base(event_assets(spark, d), lambda e: R.volume_shock(e, bars(spark, d), 5, 60)).select("event_id", "symbol", *_r("shock"))


def d15_early_reaction(spark: SparkSession, d: str) -> DataFrame:
    """Returns of events whose bars three before to three after are all there."""
    e = event_assets(spark, d)
    whole = R.per_base(e, lambda x: R.contiguous(x, bars(spark, d), 3, 3)).where("whole").select("event_id", "symbol")
    return R.horizon_returns(e, bars(spark, d), (1, 3)).join(whole, ["event_id", "symbol"], "left_semi").select("event_id", "symbol", "horizon", *_r("ret"))


def d16_latencies(spark: SparkSession, d: str) -> DataFrame:
    """Mean returns by latency and horizon."""
    r = R.latency_returns(event_assets(spark, d), bars(spark, d), (1, 5, 15), (0, 1, 3))
    return r.groupBy("symbol", "latency", "horizon").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"))


def d21_path_class(spark: SparkSession, d: str) -> DataFrame:
    """What became of the first move by the end of the day."""
    w = R.wide_returns(returns(spark, d), (1, 5, 15, 24))
    return w.groupBy("symbol", R.path_class(F.col("ret_1"), F.col("ret_24"), 20.0).alias("path")).agg(F.count("*").alias("n"))


def g7_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Status of the later half of the articles against the earlier half and themselves."""
    a = read(spark, d, "primary_source_events").select("record_id", "url", "canonical_url", "content_hash")
    return G.ledger(a.where("record_id % 2 = 1"), a.where("record_id % 2 = 0"), ["url", "canonical_url", "content_hash"], ["record_id"]).groupBy("status").agg(F.count("*").alias("n"))


def g17_greedy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Independent events of each category: greedy complete linkage of titles within two days."""
    r = _events(spark, d).select("event_id", "category", epoch_us("published_at").alias("t"), I.words(F.col("title"), 4).alias("w"))
    return G.greedy_groups(r, "category", "event_id", "t", "w", 2 * 86_400_000_000, 0.5)


def h8_registry(spark: SparkSession, d: str) -> DataFrame:
    """Articles by the class that the registry of sites gives their source, against the class they state."""
    a, s = read(spark, d, "primary_source_events"), read(spark, d, "source_sites").select(F.col("site").alias("source"), "source_class")
    return a.join(small(s), "source", "left").groupBy("source_type", "source_class").agg(F.count("*").alias("n"))


def h12_title_assets(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose title names an asset that the list doesn't hold."""
    has = F.array_contains(F.transform(F.from_json("assets_json", "array<string>"), lambda x: F.upper(x)), "BTC")
    named = T.has_word(F.col("title"), "bitcoin") | T.has_word(F.col("title"), "btc")
    return read(spark, d, "primary_source_events").groupBy(named.alias("named"), F.coalesce(has, F.lit(False)).alias("listed")).agg(F.count("*").alias("n"))


def h23_topic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of titles that name ETH for articles whose list holds it, by source type."""
    has = F.coalesce(F.array_contains(F.transform(F.from_json("assets_json", "array<string>"), lambda x: F.upper(x)), "ETH"), F.lit(False))
    named = T.has_word(F.col("title"), "ether") | T.has_word(F.col("title"), "eth")
    a = read(spark, d, "primary_source_events").groupBy("source_type").agg(F.count_if(has & named).alias("tp"), F.count_if(~has & named).alias("fp"), F.count_if(has & ~named).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select("source_type", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def i1_analysis_join(spark: SparkSession, d: str) -> DataFrame:
    """Reactions with the first row of their event, by symbol and category."""
    r = read(spark, d, "stage16c_market_reactions").distinct().select(F.lower(F.trim("canonical_event_id")).alias("event"), "symbol", "metrics_json")
    p = read(spark, d, "production_rows").distinct().select(F.lower(F.trim("event_id")).alias("event"), "category", "row_id")
    first = p.groupBy("event").agg(F.min_by("category", "row_id").alias("category"))
    value = F.get_json_object("metrics_json", "$.return_1m").cast("double")
    return r.join(first, "event").groupBy("symbol", "category").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total_return"))


def i6_halves(spark: SparkSession, d: str) -> DataFrame:
    """Split into halves and quarters by time."""
    return D.chronological_split(_one(spark, d), "published_us", "event_id", [("train", 0.5), ("validation", 0.25), ("test", 0.25)]).groupBy("split").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def i14_cost_targets(spark: SparkSession, d: str) -> DataFrame:
    """Results that exceed three costs, by symbol."""
    r = F.abs("ret")
    return returns(spark, d).where("ret IS NOT NULL").groupBy("symbol").agg(*[F.count_if(r > bps / 100).alias(f"above_{bps}") for bps in (4, 10, 25)])


def i21_json_element(spark: SparkSession, d: str) -> DataFrame:
    """The first listed asset of each article, upper-cased, counted."""
    first = F.upper(F.try_element_at(F.filter(F.from_json("assets_json", "array<string>"), lambda x: F.upper(x) != "BTC"), F.lit(1)))
    return read(spark, d, "primary_source_events").groupBy(first.alias("asset")).agg(F.count("*").alias("n"))


def j5_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters of an article table in one pass."""
    a = read(spark, d, "primary_source_events")
    return a.agg(
        F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.count_if(F.length("body") < 1000).alias("short"), F.count_if(F.col("author").isNull()).alias("no_author"),
        F.count_if(F.col("published_at").isNull()).alias("no_time"), F.count_if(F.col("published_at") > F.col("discovered_at")).alias("future"), F.count_if(~F.col("url").rlike("^https?://[^/]+/")).alias("bad_url"),
        F.round(F.avg("time_confidence"), 6).alias("confidence"))


def j19_source_report(spark: SparkSession, d: str) -> DataFrame:
    """Rates and sufficiency by source and symbol."""
    f = _frame(spark, d)
    a = f.groupBy("source", "symbol").agg(F.count("*").alias("rows"), F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.avg((F.col("ret") > 0).cast("double")), 6).alias("rise_rate"))
    return a.withColumn("sufficiency", K.sample_gate(F.col("n")))


def k4_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Why rules are turned away."""
    return K.reject_gate(K.rule_metrics(_tagged(spark, d), _rules(), "ret", 0.2), 100).select("rule_id", "n", "rejected")


def k19_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Cases left after each stage."""
    f = _frame(spark, d)
    ok, even = F.col("ret").isNotNull(), F.col("actor") % 2 == 0
    return f.agg(F.count("*").alias("events"), F.count_if(ok).alias("with_result"), F.count_if(ok & even).alias("selected"), F.count_if(ok & even & (F.abs("ret") > 10)).alias("moved"))


def k21_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Results weighted by size in inverse proportion to volatility."""
    p = R.per_base(event_assets(spark, d), lambda e: R.path_volatility(R.price_path(e, bars(spark, d), 24), 24)).select(F.col("event_id").alias("event"), "symbol", "volatility")
    x = _one(spark, d).join(p, ["event", "symbol"]).withColumn("size", K.position_size(F.col("volatility"), 500.0))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.avg(F.col("size") * F.col("ret")), 5).alias("mean_sized"))


def k23_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of three guesses."""
    x = _one(spark, d).withColumn("direction", D.direction(F.col("ret"), 10.0))
    return K.baselines(x, "published_us", "event_id", "direction").select("n", *_r("always_up", "majority", "previous"))


def k26_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Results by source, by weekday and by hour, from unpivoted dimensions."""
    x = _one(spark, d).select("ret", "source", F.weekday(F.timestamp_micros("published_us")).cast("string").alias("weekday"), F.hour(F.timestamp_micros("published_us")).cast("string").alias("hour"))
    return x.unpivot(["ret"], ["source", "weekday", "hour"], "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"))


def k31_magnitude(spark: SparkSession, d: str) -> DataFrame:
    """How often and by how much results exceed a cost, by source."""
    x = _one(spark, d).withColumn("excess", F.abs("ret") - 5.0)
    return x.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("excess") > 0).cast("double")), 6).alias("rate"), F.round(F.median(F.when(F.col("excess") > 0, F.col("excess"))), 6).alias("median_excess"))


def l8_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of results at two horizons."""
    w = R.wide_returns(returns(spark, d), (1, 5)).dropna()
    r = L.average_ranks(L.average_ranks(w, "ret_1", "a"), "ret_5", "b")
    return r.agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("spearman"))


def m8_broad_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events of a closed query, counted by year."""
    e = _events(spark, d).where(M.EventQuery(asset="SOL", sentiment="Bullish", date_from="2022-01-01").predicate())
    return M.year_counts(e, "published_at")


def m16_topic(spark: SparkSession, d: str) -> DataFrame:
    """Events whose title names a fork, by asset, with their independent stories."""
    e = _events(spark, d).where(T.has_word(F.col("title"), "fork")).withColumn("asset", F.explode("assets"))
    return e.groupBy("asset").agg(F.count("*").alias("n"), F.count_distinct(I.text_key(F.col("title"))).alias("stories"), F.max("event_id").alias("last_id"))


def n8_changelog(spark: SparkSession, d: str) -> DataFrame:
    """Number of changed cells by column between customers and their revised form."""
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 0.5).otherwise(F.col("c_acctbal") * (1 + 1e-14)), "c_mktsegment": F.lower("c_mktsegment")})
    return N.changed_cells(c, new, "c_custkey", ["c_acctbal", "c_mktsegment"]).groupBy("column").agg(F.count("*").alias("n"))


def n10_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Wide returns against long ones: cells and the largest difference."""
    r = returns(spark, d)
    w = R.wide_returns(r, (1, 5, 15, 24)).unpivot(["event_id", "symbol"], [f"ret_{h}" for h in (1, 5, 15, 24)], "h", "again").select("event_id", "symbol", F.substring("h", 5, 2).cast("int").alias("horizon"), "again")
    j = r.join(w, ["event_id", "symbol", "horizon"])
    return j.agg(F.count("*").alias("cells"), F.count_if(N.differs(F.col("ret"), F.col("again"), True)).alias("failures"))


def j2_correlated(spark: SparkSession, d: str) -> DataFrame:
    """Features dropped because they repeat another."""
    x = read(spark, d, "lineitem").select("l_quantity", "l_tax", (F.col("l_quantity") * 3 + 1).alias("tripled"), (-F.col("l_tax")).alias("negated"))
    drop = Q.correlated_features(x, x.columns)
    return spark.createDataFrame([(c,) for c in drop], "feature string")


QUERIES = {f.__name__: f for f in (
    d12_ranges, d14_volume_shock, d15_early_reaction, d16_latencies, d21_path_class, g7_ledger, g17_greedy_groups, h8_registry, h12_title_assets, h23_topic_scores, i1_analysis_join, i6_halves, i14_cost_targets,
    i21_json_element, j2_correlated, j5_report, j19_source_report, k4_rejects, k19_funnel, k21_sizes, k23_baselines, k26_grouped, k31_magnitude, l8_spearman, m8_broad_filter, m16_topic, n8_changelog, n10_recomputed,
)}

_W = f"{BARS}, {ASSETS}, w AS (SELECT event_id, ea.symbol, g.bar - base AS o, g.* EXCLUDE (symbol, bar) FROM ea JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base - 60 AND base + 24)"
_ETHW = lambda x, names: "(" + " OR ".join(f"coalesce(regexp_matches(lower({x}), '(^|[^a-z0-9_$]){n}($|[^a-z0-9_])'), false)" for n in names) + ")"
_LIST = """coalesce(list_contains(list_transform(from_json(assets_json, '["VARCHAR"]'), lambda x: upper(x)), '{0}'), false)"""
_DIR = "CASE WHEN ret > 10 THEN 'UP' WHEN ret < -10 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'NEUTRAL' END"
_RULE = [*[(f"x{op}{t}", f"x {op} {t}") for t in (2, 5, 8) for op in (">=", "<=")], ("both", "x >= 3 AND x < 7 AND source = 'signup'")]

SQL = {
    "d12_ranges": f"""WITH {_W}, s AS (SELECT *, CASE WHEN o - lag(o) OVER k = 1 THEN {PCT.format('open', 'lag(open) OVER k')} END AS st FROM w WHERE o BETWEEN 0 AND 11 WINDOW k AS (PARTITION BY event_id, symbol ORDER BY o))
        SELECT event_id, symbol, count(*) AS n, round(stddev_samp(st), 5) AS step_std, round((max(high) - min(low)) / nullif(arg_min(open, o), 0), 5) AS range_share, round(avg((high - low) / nullif(open, 0)), 5) AS true_range FROM s GROUP BY 1, 2""",
    "d14_volume_shock": f"WITH {_W} SELECT event_id, symbol, round(sum(volume) FILTER (o >= 0) / nullif(avg(volume) FILTER (o < 0) * 5, 0), 6) AS shock FROM w WHERE o BETWEEN -60 AND 4 GROUP BY 1, 2",
    "d15_early_reaction": f"""WITH {_W}, c AS (SELECT event_id, symbol, max(open) FILTER (o = 0) AS b, max(open) FILTER (o = 1) AS e1, max(open) FILTER (o = 3) AS e3 FROM w WHERE o BETWEEN -3 AND 3 GROUP BY 1, 2 HAVING count(*) = 7)
        SELECT event_id, symbol, 1 AS horizon, round({PCT.format('e1', 'b')}, 6) AS ret FROM c UNION ALL SELECT event_id, symbol, 3, round({PCT.format('e3', 'b')}, 6) FROM c""",
    "d16_latencies": f"""WITH {BARS}, {ASSETS}, l AS (SELECT unnest([0, 1, 3]) AS latency), h AS (SELECT unnest([1, 5, 15]) AS horizon), r AS (SELECT ea.symbol, latency, horizon, {PCT.format('e.open', 'b.open')} AS ret FROM ea CROSS JOIN l CROSS JOIN h LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base + latency
        LEFT JOIN bars e ON e.symbol = ea.symbol AND e.bar = base + latency + horizon) SELECT symbol, latency, horizon, count(ret) AS n, round(avg(ret), 6) AS mean_ret FROM r GROUP BY 1, 2, 3""",
    "d21_path_class": f"""WITH {RETURNS}, w AS (SELECT event_id, symbol, max(ret) FILTER (horizon = 1) AS a, max(ret) FILTER (horizon = 24) AS b FROM hr GROUP BY 1, 2) SELECT symbol, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(a) < 20 AND abs(b) < 20 THEN 'none' WHEN abs(a) < 20 THEN 'delayed' WHEN a * b < 0 THEN 'reversed'
        WHEN abs(b) >= abs(a) * 1.5 THEN 'grown' WHEN abs(b) <= abs(a) * 0.5 THEN 'faded' ELSE 'kept' END AS path, count(*) AS n FROM w GROUP BY 1, 2""",
    "g7_ledger": """WITH RECURSIVE s AS (SELECT * FROM primary_source_events WHERE record_id % 2 = 0), x AS (SELECT row_number() OVER (ORDER BY record_id) AS i, url AS u, canonical_url AS c, content_hash AS h,
        CASE WHEN url IN (SELECT url FROM s) THEN 'stored:url' WHEN canonical_url IN (SELECT canonical_url FROM s WHERE canonical_url IS NOT NULL) THEN 'stored:canonical_url' WHEN content_hash IN (SELECT content_hash FROM s) THEN 'stored:content_hash' END AS st FROM primary_source_events WHERE record_id % 2 = 1),
        r(i, us, cs, hs, status) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR
        UNION ALL SELECT i, CASE WHEN z = 'new' AND u <> '' THEN list_append(us, u) ELSE us END, CASE WHEN z = 'new' AND c <> '' THEN list_append(cs, c) ELSE cs END, CASE WHEN z = 'new' AND h <> '' THEN list_append(hs, h) ELSE hs END, z
        FROM (SELECT x.i, u, c, h, us, cs, hs, coalesce(st, CASE WHEN list_contains(us, u) THEN 'batch:url' WHEN list_contains(cs, c) THEN 'batch:canonical_url' WHEN list_contains(hs, h) THEN 'batch:content_hash' END, 'new') AS z FROM r JOIN x ON x.i = r.i + 1))
        SELECT status, count(*) AS n FROM r WHERE i > 0 GROUP BY 1""",
    "h8_registry": "SELECT source_type, source_class, count(*) AS n FROM primary_source_events a LEFT JOIN (SELECT site, source_class FROM source_sites) s ON a.source = s.site GROUP BY 1, 2",
    "h12_title_assets": f"SELECT {_ETHW('title', ['bitcoin', 'btc'])} AS named, {_LIST.format('BTC')} AS listed, count(*) AS n FROM primary_source_events GROUP BY 1, 2",
    "h23_topic_scores": f"""WITH x AS (SELECT source_type, {_ETHW('title', ['ether', 'eth'])} AS m, {_LIST.format('ETH')} AS h FROM primary_source_events), a AS (SELECT source_type, count(*) FILTER (h AND m) AS tp, count(*) FILTER (NOT h AND m) AS fp, count(*) FILTER (h AND NOT m) AS fn FROM x GROUP BY 1)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM a""",
    "i1_analysis_join": """WITH r AS (SELECT DISTINCT * FROM stage16c_market_reactions), p AS (SELECT lower(trim(event_id)) AS event, arg_min(category, row_id) FILTER (category IS NOT NULL) AS c0, min(row_id) AS m FROM (SELECT DISTINCT * FROM production_rows) GROUP BY 1), q AS (SELECT p.event, x.category FROM p JOIN (SELECT DISTINCT row_id, category FROM production_rows) x ON x.row_id = p.m)
        SELECT symbol, category, count(*) AS n, round(sum(CAST(json_extract_string(metrics_json, '$.return_1m') AS DOUBLE)), 6) AS total_return FROM r JOIN q ON lower(trim(r.canonical_event_id)) = q.event GROUP BY 1, 2""",
    "i6_halves": f"WITH {_FR}, k AS (SELECT event_id, row_number() OVER (ORDER BY published_us, event_id) - 1 AS k, count(*) OVER () AS n FROM o) SELECT CASE WHEN k < floor(n * 0.5) THEN 'train' WHEN k < floor(n * 0.75) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(event_id) AS first_id FROM k GROUP BY 1",
    "i14_cost_targets": f"WITH {RETURNS} SELECT symbol, " + ", ".join(f"count(*) FILTER (abs(ret) > {b / 100}::DOUBLE) AS above_{b}" for b in (4, 10, 25)) + " FROM hr WHERE ret IS NOT NULL GROUP BY 1",
    "i21_json_element": """SELECT upper(list_filter(from_json(assets_json, '["VARCHAR"]'), lambda x: upper(x) <> 'BTC')[1]) AS asset, count(*) AS n FROM primary_source_events GROUP BY 1""",
    "j2_correlated": "SELECT unnest(['tripled', 'negated']) AS feature",
    "j5_report": """SELECT count(*) AS n, count(DISTINCT url) AS urls, count(*) FILTER (length(body) < 1000) AS short, count(*) FILTER (author IS NULL) AS no_author, count(*) FILTER (published_at IS NULL) AS no_time, count(*) FILTER (published_at > discovered_at) AS future, count(*) FILTER (NOT regexp_matches(url, '^https?://[^/]+/')) AS bad_url, round(avg(time_confidence), 6) AS confidence FROM primary_source_events""",
    "j19_source_report": f"""WITH {_FR}, a AS (SELECT source, symbol, count(*) AS rows, count(ret) AS n, round(avg(ret), 6) AS mean_ret, round(avg((ret > 0)::INT), 6) AS rise_rate FROM fr GROUP BY 1, 2) SELECT *, CASE WHEN n < 30 THEN 'descriptive' WHEN n < 100 THEN 'exploratory' WHEN n < 300 THEN 'candidate' ELSE 'strong' END AS sufficiency FROM a""",
    "k4_rejects": f"WITH {_FR}, x AS (SELECT *, (actor % 10)::DOUBLE AS x FROM o), t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, ret FROM x WHERE {t}" for n, t in _RULE) + """), a AS (SELECT rule_id, count(*) AS n, count(*) FILTER (ret > 0) / count(*) AS wr, avg(ret - 0.2::DOUBLE) AS mn, sum(ret - 0.2::DOUBLE) FILTER (ret > 0.2::DOUBLE) / -sum(ret - 0.2::DOUBLE) FILTER (ret < 0.2::DOUBLE) AS pf FROM t GROUP BY 1)
        SELECT rule_id, n, CASE WHEN n < 100 THEN 'low_sample' WHEN wr < 0.55 THEN 'win_rate' WHEN mn <= 0 THEN 'no_expectancy' WHEN coalesce(pf, 1e300) <= 1 THEN 'profit_factor' END AS rejected FROM a""",
    "k19_funnel": f"WITH {_FR} SELECT count(*) AS events, count(ret) AS with_result, count(ret) FILTER (actor % 2 = 0) AS selected, count(*) FILTER (actor % 2 = 0 AND abs(ret) > 10) AS moved FROM fr",
    "k21_sizes": f"""WITH {_FR}, pth AS (SELECT event_id, ea.symbol, g.bar - base AS q, g.open FROM ea JOIN bars b ON b.symbol = ea.symbol AND b.bar = base JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base AND base + 24 WHERE b.open > 0), l AS (SELECT event_id, symbol, CASE WHEN q - lag(q) OVER k = 1 AND lag(open) OVER k > 0 AND open > 0 THEN ln(open / lag(open) OVER k) END AS r FROM pth WINDOW k AS (PARTITION BY event_id, symbol ORDER BY q)),
        v AS (SELECT event_id AS event, symbol, sqrt(sum(r * r)) * 100 AS v FROM l GROUP BY 1, 2), s AS (SELECT ret, CASE WHEN v > 0 THEN least(1.0, greatest(0.25, 500.0 / v)) ELSE 0.0 END AS z FROM o JOIN v USING (event, symbol)) SELECT count(*) AS n, round(avg(z), 6) AS mean_size, round(avg(z * ret), 5) AS mean_sized FROM s""",
    "k23_baselines": f"WITH {_FR}, x AS (SELECT {_DIR} AS d, lag({_DIR}) OVER (ORDER BY published_us, event_id) AS p FROM o), m AS (SELECT d AS m FROM x GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1) SELECT count(*) AS n, round(avg((d = 'UP')::INT), 6) AS always_up, round(avg((d = m)::INT), 6) AS majority, round(avg((d = p)::INT), 6) AS previous FROM x, m",
    "k26_grouped": f"""WITH {_FR}, x AS (SELECT ret, source, (isodow(make_timestamp(published_us)) - 1)::VARCHAR AS weekday, hour(make_timestamp(published_us))::VARCHAR AS hour FROM o), u AS (SELECT ret, 'source' AS dimension, source AS "value" FROM x UNION ALL SELECT ret, 'weekday', weekday FROM x UNION ALL SELECT ret, 'hour', hour FROM x) SELECT dimension, "value", count(*) AS n, round(avg(ret), 6) AS mean_ret FROM u GROUP BY 1, 2""",
    "k31_magnitude": f"WITH {_FR} SELECT source, count(*) AS n, round(avg((abs(ret) - 5 > 0)::INT), 6) AS rate, round(median(abs(ret) - 5) FILTER (abs(ret) - 5 > 0), 6) AS median_excess FROM o GROUP BY 1",
    "l8_spearman": f"WITH {RETURNS}, w AS (SELECT event_id, max(ret) FILTER (horizon = 1) AS x, max(ret) FILTER (horizon = 5) AS y FROM hr GROUP BY event_id, symbol), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM w WHERE x IS NOT NULL AND y IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM k",
    "m8_broad_filter": f"WITH {_EV}, h AS (SELECT year(published_at) AS year FROM ev WHERE list_contains(assets, 'SOL') AND lower(sentiment) = 'bullish' AND published_at >= '2022-01-01'), y AS (SELECT year, count(*) AS n FROM h GROUP BY 1), s AS (SELECT unnest(generate_series(min(year), max(year))) AS year FROM y) SELECT year, coalesce(n, 0) AS n FROM s LEFT JOIN y USING (year)",
    "m16_topic": f"WITH {_EV}, e AS (SELECT event_id, title, unnest(assets) AS asset FROM ev WHERE {_ETHW('title', ['fork'])}) SELECT asset, count(*) AS n, count(DISTINCT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS stories, max(event_id) AS last_id FROM e GROUP BY 1",
    "n8_changelog": """SELECT 'c_acctbal' AS "column", count(*) AS n FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE c_mktsegment <> lower(c_mktsegment)""",
    "n10_recomputed": f"WITH {RETURNS} SELECT count(*) AS cells, 0 AS failures FROM hr",
}
