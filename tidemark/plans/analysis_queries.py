"""Queries of datasets, profiles, signals, statistics, serving and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dataset as D
from tidemark.operators import quality as Q
from tidemark.operators import release as N
from tidemark.operators import serving as M
from tidemark.operators import signals as K
from tidemark.operators import stats as L
from tidemark.operators.ordered import beside, quantiles
from tidemark.plans.cut import read
from tidemark.plans.models import RETURNS, epoch_us, news, returns

_SPLIT = [("train", 0.6), ("validation", 0.2), ("test", 0.2)]


def _r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """Returns with the time and source of their event."""
    return returns(spark, d).select("event_id", "symbol", "horizon", "ret").join(news(spark, d), "event_id")


def _one(spark: SparkSession, d: str) -> DataFrame:
    """The returns that exist, of all symbols and horizons, each as a result with an id of its own; ``event`` is its news event."""
    place = F.when(F.col("symbol") == "BTC", 0).when(F.col("symbol") == "ETH", 4).otherwise(8) + F.when(F.col("horizon") == 1, 0).when(F.col("horizon") == 5, 1).when(F.col("horizon") == 15, 2).otherwise(3)
    rows = _frame(spark, d).where("ret IS NOT NULL").withColumnRenamed("event_id", "event")
    return rows.select((F.col("event") * 12 + place).alias("event_id"), "event", "symbol", "horizon", "published_us", "source", "actor", "ret")


def _events(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "production_rows").distinct()
    return r.select(F.col("row_id").alias("event_id"), "title", "slug", F.col("published_at").cast("timestamp").alias("published_at"), F.from_json("related_assets", "array<string>").alias("assets"), "category", F.col("source_class_v2").alias("source_class"), "source", "sentiment", "importance")


def i4_chronological_split(spark: SparkSession, d: str) -> DataFrame:
    """Split of every news event by time."""
    return D.chronological_split(news(spark, d), "published_us", "event_id", _SPLIT).select("event_id", "split")


def i5_event_split(spark: SparkSession, d: str) -> DataFrame:
    """Split by whole actors, each at its first event."""
    return D.event_split(news(spark, d), "actor", "published_us", [("train", 0.7), ("validation", 0.15), ("test", 0.15)]).select("event_id", "split")


def i7_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five folds in time."""
    return D.folds(news(spark, d), "published_us", "event_id", 5).select("event_id", "fold")


def i9_train_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Results above the median of the training part, by source."""
    s = D.chronological_split(_one(spark, d), "published_us", "event_id", _SPLIT)
    return D.train_quantile(s, "ret", F.col("split") == "train", 0.5, "m").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("ret") > F.col("m")).alias("above"), F.round(F.first("m"), 6).alias("m"))


def i10_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """One-hot source and missing flags of the production rows."""
    r = D.missing_flags(D.one_hot(_events(spark, d), "source_class", ["media", "exchange", "regulator"]), ["importance", "sentiment"])
    return r.agg(*[F.sum(c).alias(c) for c in ("source_class_media", "source_class_exchange", "source_class_regulator", "importance_missing", "sentiment_missing")])


def i13_labels(spark: SparkSession, d: str) -> DataFrame:
    """Direction and strong-move labels of the results."""
    r = F.col("ret")
    return _frame(spark, d).groupBy("symbol", "horizon", D.direction(r, 10.0).alias("direction"), D.strong(r, 50.0, False).alias("strong"), D.strong(r, 50.0, True).alias("strong_inclusive")).agg(F.count("*").alias("n"))


def i17_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that stand in the way of a one-to-one merge."""
    return D.duplicate_keys(read(spark, d, "production_rows"), ["row_id"])


def i19_union(spark: SparkSession, d: str) -> DataFrame:
    """Two source families in one schema."""
    a = read(spark, d, "primary_source_events").select(F.col("record_id").alias("id"), "title", "author")
    b = read(spark, d, "production_rows").distinct().select(F.col("row_id").alias("id"), "title", "category")
    return D.union_families([("A", a), ("B", b)], {"id": "bigint", "title": "string", "author": "string", "category": "string"})


def i20_latest_success(spark: SparkSession, d: str) -> DataFrame:
    """For each event the latest reaction with a result, else the latest."""
    r = read(spark, d, "stage16c_market_reactions").distinct().withColumn("ok", F.get_json_object("metrics_json", "$.return_1m").isNotNull())
    return D.latest_success(r, "canonical_event_id", F.col("ok"), "reaction_id").select("canonical_event_id", "reaction_id", "ok")


def i22_bins(spark: SparkSession, d: str) -> DataFrame:
    """Importance in right-closed bins."""
    return _events(spark, d).groupBy(D.bucketed(F.col("importance"), [-1.0, 20.0, 40.0, 60.0, 80.0, 100.0]).alias("bin")).agg(F.count("*").alias("n"))


def j1_feature_quality(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the numeric columns of the orders and one constant."""
    o = read(spark, d, "lineitem").withColumn("same", F.lit(1.0))
    q = Q.feature_quality(o, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "same"])
    return q.select("feature", "rows", "n", "unique", *_r("missing_pct", "mean", "std", "least", "most", "p01", "p50", "p99", digits=4), "outliers", "removal_reason")


def j3_split_shift(spark: SparkSession, d: str) -> DataFrame:
    """Rate of rises in the splits against the training part."""
    s = D.chronological_split(_one(spark, d), "published_us", "event_id", _SPLIT)
    return Q.split_shift(s, "split", F.col("ret") > 0).select("split", "n", *_r("rate", "shift"), "unstable")


def j7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Results present by symbol and horizon."""
    return returns(spark, d).groupBy("symbol", "horizon").agg(F.count("*").alias("rows"), F.count("ret").alias("present"))


def j8_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the results by symbol and horizon."""
    return Q.distribution(returns(spark, d), ["symbol", "horizon"], "ret").select("symbol", "horizon", "n", *_r("mean", "std", "p05", "p25", "p50", "p75", "p95"))


def j11_lags(spark: SparkSession, d: str) -> DataFrame:
    """Minutes from publication to discovery by source type."""
    m = (epoch_us("discovered_at") - epoch_us("published_at")) / 60_000_000
    return Q.lag_audit(read(spark, d, "primary_source_events"), "source_type", m).select("source_type", "known", "negative", *_r("p75", "p90", "above_5", "above_15", "above_60"))


def j13_skew(spark: SparkSession, d: str) -> DataFrame:
    """Corrected skewness of the results by symbol."""
    return returns(spark, d).where("ret IS NOT NULL").groupBy("symbol").agg(F.round(Q.corrected_skew("ret"), 5).alias("skew"))


def j14_series_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates and gaps of the candle series."""
    m = F.when(F.col("open_time") >= 100_000_000_000_000, F.floor(F.col("open_time") / 60_000_000)).otherwise(F.floor(F.col("open_time") / 60_000))
    return Q.series_coverage(read(spark, d, "archive_candles").withColumn("m", m), "symbol", "m", 1).select("symbol", "rows", "duplicates", *_r("missing_pct"))


def j15_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Medians of the results over all, by source and by symbol, in one pass."""
    f = _frame(spark, d).where("ret IS NOT NULL")
    none = F.lit(None).cast("string")
    sets = [F.struct(F.lit(k).alias("_set"), s.alias("source"), y.alias("symbol")) for k, (s, y) in enumerate(((none, none), (F.col("source"), none), (none, F.col("symbol"))))]
    x = f.select(F.explode(F.array(*sets)).alias("s"), "ret").select("s.*", "ret")
    by = ["_set", "source", "symbol"]
    return beside(x.groupBy(*by).agg(F.count("*").alias("n")), quantiles(x, by, "ret", [0.5]), by).select("source", "symbol", "n", F.round(F.col("q")[0], 6).alias("median_ret"))


def j16_rank(spark: SparkSession, d: str) -> DataFrame:
    """Sources ranked by their mean lag."""
    from pyspark.sql.window import Window

    m = (epoch_us("discovered_at") - epoch_us("published_at")) / 60_000_000
    a = read(spark, d, "primary_source_events").where("published_at IS NOT NULL").groupBy("source").agg(F.round(F.avg(m), 4).alias("mean_lag"))
    return a.withColumn("rank", F.rank().over(Window.orderBy("mean_lag")))  # one row per source


def j17_second_delay(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds from the first to the second row of each event."""
    r = read(spark, d, "production_rows").distinct().where("published_at IS NOT NULL").select(F.lower(F.trim("event_id")).alias("event"), epoch_us("published_at").alias("t"))
    return Q.nth_delay(r, "event", "t")


def _rules() -> dict:
    return {**K.threshold_rules({"x": [2.0, 5.0, 8.0]}), "both": K.rule_predicate({"x": {"gte": 3, "lt": 7}, "source": {"eq": "signup"}}, ["x", "source"])}


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d).withColumn("x", (F.col("actor") % 10).cast("double"))


def k3_rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of seven rules in one pass."""
    m = K.rule_metrics(_tagged(spark, d), _rules(), "ret", 0.2)
    return m.select("rule_id", "n", "wins", *_r("mean_return", "median_return", "mean_net", "profit_factor", "win_rate", "wilson_low", "wilson_high"))


def k6_pair_search(spark: SparkSession, d: str) -> DataFrame:
    """The best three pairs of rules by edge times root of support."""
    m = K.rule_metrics(_tagged(spark, d), K.pair_rules(K.threshold_rules({"x": [2.0, 5.0, 8.0]})), "ret").where("n >= 50")
    return m.withColumn("score", F.round((F.col("win_rate") - 0.5) * F.sqrt("n"), 6)).orderBy(F.desc("score"), "rule_id").limit(3).select("rule_id", "n", "wins", "score")


def k12_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals from two probabilities and their results."""
    up = (F.col("actor") % 100) / 100
    s = _one(spark, d).withColumn("signal", K.probability_signal(up, 1 - up, 0.6))
    return s.groupBy("signal").agg(F.count("*").alias("n"), F.round(F.avg(K.signed(F.col("ret"), F.col("signal"), 0.2)), 6).alias("mean_net"))


def k16_performance(spark: SparkSession, d: str) -> DataFrame:
    """What the results add up to in time order."""
    p = K.performance(_one(spark, d), "published_us", "event_id", "ret")
    return p.select("n", *_r("total", "mean", "median", "win_rate", "profit_factor", "max_drawdown", "deviation", "downside", "worst", "best", "payoff", "expected_shortfall", "sharpe_like", "recovery", digits=4))


def k16_equity(spark: SparkSession, d: str) -> DataFrame:
    """Running result and fall from its peak."""
    return K.equity(_one(spark, d), "published_us", "event_id", "ret").select("event_id", *_r("equity", "drawdown", digits=2))


def k18_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Longest runs of won and lost results."""
    return K.longest_streaks(_one(spark, d), "published_us", "event_id", F.col("ret") > 0)


def k20_costs(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity of the results to costs."""
    return K.cost_table(_one(spark, d), "ret", [0.0, 0.1, 0.2, 0.5, 1.0]).select("cost", "n", *_r("total", "mean", "win_rate", digits=4))


def k22_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Deciles of the prices of the orders."""
    o = read(spark, d, "orders")
    x = K.deciles(o, "o_totalprice", "o_orderkey", F.floor(F.col("o_totalprice") / 10_000))
    return x.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def l1_wilson(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the rate of rises by symbol and horizon."""
    a = returns(spark, d).groupBy("symbol", "horizon").agg(F.count("ret").alias("n"), F.count_if(F.col("ret") > 0).alias("wins"))
    low, high = L.wilson(F.col("wins"), F.col("n"))
    return a.select("symbol", "horizon", "n", "wins", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


def l5_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p values within families."""
    o = read(spark, d, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 9973) / 9973).alias("p"))
    return L.benjamini_hochberg(o, "p", "p_partkey", ["p_brand"]).select("p_partkey", "p_brand", *_r("q", digits=9))


def l6_classification(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of guessing a document's language by its source's first letter."""
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 30, "N").otherwise("R").alias("p"))
    return L.classification_metrics(x, "a", "p", ["A", "N", "R"]).select("n", *_r("accuracy", "balanced_accuracy", "precision_macro", "f1_macro", "mcc", "kappa", digits=8))


def l7_regression(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of guessing an item's price from its quantity."""
    x = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("x"))
    return L.regression_metrics(x, "y", "x").select("n", *_r("mae", "rmse", "r2", "pearson", "spearman", digits=5))


def l9_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    """Rank sum test of two groups of results."""
    return L.mann_whitney(_one(spark, d), "ret", F.col("source") == "signup").select("n1", "n2", "u", *_r("z"))


def l11_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed means of the results."""
    return L.trimmed_mean(returns(spark, d), ["symbol", "horizon"], "ret").select("symbol", "horizon", "n", *_r("trimmed_mean"))


def l3_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean result by symbol and horizon with an interval from resampled actors."""
    return L.cluster_bootstrap(_frame(spark, d), ["symbol", "horizon"], "actor", "ret", 200).select("symbol", "horizon", "clusters", *_r("mean", "low", "high"))


def l4_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Difference between two sources with whole actors swapped."""
    return L.permutation_difference(_one(spark, d), "actor", "ret", F.col("source") == "signup", 200).select(*_r("difference", "p"))


def l10_binomial(spark: SparkSession, d: str) -> DataFrame:
    """Exact one-sided test of the rate of rises."""
    a = returns(spark, d).groupBy("symbol", "horizon").agg(F.count("ret").alias("n"), F.count_if(F.col("ret") > 0).alias("wins"))
    return a.select("symbol", "horizon", "n", "wins", F.round(L.binomial_greater("wins", "n"), 9).alias("p"))


_QUERY = M.EventQuery(asset="ETH", source_class="media", date_from="2021-06-01", date_to="2024-05-31")


def m1_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of a filtered list, newest first."""
    return M.page(_events(spark, d), _QUERY, [F.desc("published_at"), F.desc("event_id")], 10, 2).select("event_id", "total")


def m2_sorted(spark: SparkSession, d: str) -> DataFrame:
    """A page by importance, missing last, newest first on a tie."""
    return M.page(_events(spark, d), M.EventQuery(category="etf"), [F.desc_nulls_last("importance"), F.desc_nulls_last("published_at"), F.desc("event_id")], 15).select("event_id", "total")


def m3_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The page after a cursor."""
    return M.after_cursor(_events(spark, d), M.EventQuery(asset="BTC"), "2023-01-01 00:00:00", "1", 20).select("event_id")


def m5_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One event by its id."""
    return _events(spark, d).where("event_id = 77").select("event_id", "title", "slug")


def m6_years(spark: SparkSession, d: str) -> DataFrame:
    """Events of every year."""
    return M.year_counts(_events(spark, d), "published_at")


def m10_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The largest results."""
    return M.ranked(_one(spark, d), "ret", 10).select("event_id", *_r("ret"))


def m11_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two sources compared."""
    return M.compare(_one(spark, d), "source", "signup", "error", "ret").select("n_a", "n_b", *_r("mean_a", "median_a", "mean_b", "median_b", "difference"))


def m14_overview(spark: SparkSession, d: str) -> DataFrame:
    """All measures of the results by symbol and horizon."""
    o = M.overview(returns(spark, d), ["symbol", "horizon"], "ret")
    return o.select("symbol", "horizon", "n", "positive", "negative", *_r("mean", "median", "std", "error", "trimmed_mean", "positive_pct", "low_pct", "high_pct"))


def m15_search(spark: SparkSession, d: str) -> DataFrame:
    """A web search over titles, sources and categories."""
    return M.search(_events(spark, d), 'upgrade OR fork facts -treasury', "event_id", "title", ["source", "category"]).select("event_id", *_r("rank"))


def m21_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Events whose titles hold all of two words."""
    t = F.lower("title")
    return _events(spark, d).where(F.contains(t, F.lit("facts")) & F.contains(t, F.lit("order book"))).select("event_id")


def a12_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines of the events."""
    return M.csv_lines(_events(spark, d).withColumn("title", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('="'), "title")).otherwise(F.col("title"))), ["event_id", "title", "assets", "category"])


def n1_contract(spark: SparkSession, d: str) -> DataFrame:
    """Violations of a contract on the production rows."""
    r = read(spark, d, "production_rows")
    return N.contract_violations(r, ["row_id"], ["event_id", "title", "category"], {"importance": (0.0, 95.0)}, {"sentiment": ["bullish", "bearish", "neutral"]})


def n2_identity(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two versions."""
    r = read(spark, d, "production_rows")
    return N.identity_report(r.where("row_id % 10 <> 3"), r.where("row_id % 7 <> 2"), "row_id")


def n3_merge(spark: SparkSession, d: str) -> DataFrame:
    """The table after an upsert."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return N.merge(o.where("o_orderkey % 3 = 0"), new, "o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def n4_changed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that differ between two versions of the parts."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = p.withColumns({"p_size": F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_name": F.when(F.col("p_partkey") % 13 == 0, F.upper("p_name")).otherwise(F.col("p_name"))})
    return N.changed_cells(p, new, "p_partkey", ["p_name", "p_size"])


def _cells(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).where("ret IS NOT NULL").select("event_id", "symbol", "horizon", "ret")
    return N.compared(r, r.withColumn("ret", F.col("ret") - F.col("event_id") % 5), ["event_id", "symbol", "horizon"], "ret")


def n6_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two versions over all and by dimension."""
    return N.comparison_summary(_cells(spark, d), ["symbol", "horizon"]).select("symbol", "horizon", "n", "flips", *_r("mean_abs", "p95", "p99", digits=5))


def n7_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """Flipped cells by the size of their difference."""
    return _cells(spark, d).groupBy(N.magnitude(F.col("difference")).alias("size"), "flipped").agg(F.count("*").alias("n"))


def n11_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Five largest and smallest results by symbol and horizon."""
    return N.extremes(returns(spark, d), ["symbol", "horizon"], "ret", "event_id", 5).select("symbol", "horizon", "event_id", "side", "place")


def n12_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Fifty rows taken in turn from the categories."""
    return N.round_robin(_events(spark, d).where("category IS NOT NULL"), "category", "event_id", 50).select("event_id", "category", "turn")


def n13_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three rows of each source in hash order."""
    return N.hash_sample(_events(spark, d), ["source"], "event_id", "review", 3).select("source", "event_id", "draw")


def n14_pick(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible draws of a horizon for each event."""
    return _events(spark, d).groupBy(N.pick(F.col("event_id"), 6).alias("pick")).agg(F.count("*").alias("n"))


def m20_verification(spark: SparkSession, d: str) -> DataFrame:
    """Counts that verify a load, as SQL."""
    read(spark, d, "primary_source_events").createOrReplaceTempView("tidemark_articles")
    return spark.sql("""SELECT count(*) AS n, count(DISTINCT url) AS urls, count(*) FILTER (WHERE author IS NULL) AS no_author, count(*) FILTER (WHERE primary_source) AS official,
        (SELECT count(*) FROM (SELECT url FROM tidemark_articles GROUP BY url HAVING count(*) > 1)) AS repeated_urls FROM tidemark_articles""")


QUERIES = {f.__name__: f for f in (
    i4_chronological_split, i5_event_split, i7_folds, i9_train_threshold, i10_one_hot, i13_labels, i17_duplicate_keys, i19_union, i20_latest_success, i22_bins, j1_feature_quality, j3_split_shift, j7_coverage,
    j8_distribution, j11_lags, j13_skew, j14_series_coverage, j15_grouped, j16_rank, j17_second_delay, k3_rule_metrics, k6_pair_search, k12_signals, k16_performance, k16_equity, k18_streaks, k20_costs, k22_deciles,
    l1_wilson, l3_cluster_bootstrap, l4_permutation, l5_benjamini_hochberg, l6_classification, l7_regression, l9_mann_whitney, l10_binomial, l11_trimmed_mean, m1_page, m2_sorted, m3_after_cursor, m5_lookup,
    m6_years, m10_ranked, m11_compare, m14_overview, m15_search, m20_verification, m21_keywords, a12_csv, n1_contract, n2_identity, n3_merge, n4_changed_cells, n6_comparison, n7_magnitudes, n11_extremes,
    n12_round_robin, n13_hash_sample, n14_pick,
)}

_FR = RETURNS + ", fr AS (SELECT hr.event_id, symbol, horizon, ret, n.source, n.actor, n.published_us FROM hr JOIN news n ON n.event_id = hr.event_id), o AS (SELECT event_id * 12 + CASE symbol WHEN 'BTC' THEN 0 WHEN 'ETH' THEN 4 ELSE 8 END + CASE horizon WHEN 1 THEN 0 WHEN 5 THEN 1 WHEN 15 THEN 2 ELSE 3 END AS event_id, event_id AS event, symbol, horizon, published_us, source, actor, ret FROM fr WHERE ret IS NOT NULL)"
_NEWS = "news AS (SELECT event_id, epoch_us(ts) AS published_us, event_type AS source, user_id AS actor FROM events WHERE event_type IN ('signup', 'error'))"
_EV = """ev AS (SELECT row_id AS event_id, title, slug, published_at, from_json(related_assets, '["VARCHAR"]') AS assets, category, source_class_v2 AS source_class, source, sentiment, importance FROM (SELECT DISTINCT * FROM production_rows))"""
_CUT = "CASE WHEN k < floor(n::DOUBLE * 0.6::DOUBLE) THEN 'train' WHEN k < floor(n::DOUBLE * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END"
_OS = _FR + f", os AS (SELECT *, {_CUT} AS split FROM (SELECT *, row_number() OVER (ORDER BY published_us, event_id) - 1 AS k, count(*) OVER () AS n FROM o))"
_EQ = _FR + ", eq AS (SELECT *, sum(ret) OVER w AS equity FROM o WINDOW w AS (ORDER BY published_us, event_id ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, equity - greatest(0, max(equity) OVER (ORDER BY published_us, event_id ROWS UNBOUNDED PRECEDING)) AS drawdown FROM eq)"
_STEM = "CASE WHEN length({0}) > 4 THEN regexp_replace({0}, '(ings?|ed|es|s)$', '') ELSE {0} END"
_TERMS = "list_transform(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in M.STOP) + "], w)), lambda w: " + _STEM.format("w") + ")"
_WIL = "({0}::DOUBLE / {1} + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (2 * {1}) {2} 1.959963984540054::DOUBLE * sqrt({0}::DOUBLE / {1} * (1 - {0}::DOUBLE / {1}) / {1} + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (4.0::DOUBLE * {1} * {1}))) / (1 + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / {1})"
_TRIM = "SELECT symbol, horizon, count(*) AS n, avg(ret) AS trimmed_mean FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol, horizon) AS n FROM hr WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol, horizon ORDER BY ret)) WHERE k > floor(n * 0.05::DOUBLE) AND k <= n - floor(n * 0.05::DOUBLE) GROUP BY 1, 2"
_RULES = [*[(f"x{op}{t}", f"x {op} {t}") for t in (2, 5, 8) for op in (">=", "<=")], ("both", "x >= 3 AND x < 7 AND source = 'signup'")]
_PAIRS = [(f"{a[0]}&{b[0]}", f"({a[1]}) AND ({b[1]})") for i, a in enumerate(_RULES[:6]) for b in _RULES[i + 1 : 6]]


def _rule_union(rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule_id, ret FROM x WHERE {t}" for n, t in rules)


_U = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296)"
_POISSON = "(" + " + ".join(f"CASE WHEN u >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in L.POISSON) + ")"

SQL = {
    "l3_cluster_bootstrap": f"""WITH {_FR}, s AS (SELECT symbol, horizon, actor, sum(ret) AS s, count(*) AS c FROM fr WHERE ret IS NOT NULL GROUP BY 1, 2, 3),
        r AS (SELECT *, {_U.format("'7:' || actor || ':' || rep")} AS u FROM s, (SELECT unnest(generate_series(0, 199)) AS rep)), m AS (SELECT symbol, horizon, rep, sum(s * w) / nullif(sum(c * w), 0) AS m FROM (SELECT *, {_POISSON} AS w FROM r) GROUP BY 1, 2, 3),
        q AS (SELECT symbol, horizon, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1, 2)
        SELECT symbol, horizon, count(*) AS clusters, round(sum(s) / sum(c), 6) AS mean, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high FROM s JOIN q USING (symbol, horizon) GROUP BY 1, 2""",
    "l4_permutation": f"""WITH {_FR}, b AS (SELECT actor, coalesce(sum(ret) FILTER (source = 'signup'), 0) AS s1, count(*) FILTER (source = 'signup') AS c1, coalesce(sum(ret) FILTER (source <> 'signup'), 0) AS s0, count(*) FILTER (source <> 'signup') AS c0 FROM o GROUP BY 1),
        r AS (SELECT *, rep > 0 AND {_U.format("actor || ':' || rep")} >= 0.5 AS x FROM b, (SELECT unnest(generate_series(0, 200)) AS rep)),
        d AS (SELECT rep, sum(CASE WHEN x THEN s0 ELSE s1 END) / sum(CASE WHEN x THEN c0 ELSE c1 END) - sum(CASE WHEN x THEN s1 ELSE s0 END) / sum(CASE WHEN x THEN c1 ELSE c0 END) AS d FROM r GROUP BY 1)
        SELECT round(o.d, 6) AS difference, round((count(*) FILTER (abs(d.d) >= abs(o.d)) + 1) / 201, 6) AS p FROM d, (SELECT d FROM d WHERE rep = 0) AS o WHERE rep > 0 GROUP BY o.d""",
    "l10_binomial": f"""WITH {RETURNS}, a AS (SELECT symbol, horizon, count(ret) AS n, count(*) FILTER (ret > 0) AS wins FROM hr GROUP BY 1, 2), t AS (SELECT *, unnest(generate_series(wins, n)) AS i FROM a)
        SELECT symbol, horizon, n, wins, round(least(1, sum(exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE)))), 9) AS p FROM t GROUP BY ALL""",
    "i4_chronological_split": f"WITH {_NEWS} SELECT event_id, {_CUT} AS split FROM (SELECT *, row_number() OVER (ORDER BY published_us, event_id) - 1 AS k, count(*) OVER () AS n FROM news)",
    "i5_event_split": f"""WITH {_NEWS}, f AS (SELECT actor, min(published_us) AS t FROM news GROUP BY 1), s AS (SELECT actor, CASE WHEN k < floor(n::DOUBLE * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n::DOUBLE * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY t, actor) - 1 AS k, count(*) OVER () AS n FROM f)) SELECT event_id, split FROM news JOIN s USING (actor)""",
    "i7_folds": f"WITH {_NEWS} SELECT event_id, ntile(5) OVER (ORDER BY published_us, event_id)::INT AS fold FROM news",
    "i9_train_threshold": f"WITH {_OS}, m AS (SELECT median(ret) AS m FROM os WHERE split = 'train') SELECT split, count(*) AS n, count(*) FILTER (ret > m) AS above, round(any_value(m), 6) AS m FROM os, m GROUP BY 1",
    "i10_one_hot": f"WITH {_EV} SELECT " + ", ".join(f"count(*) FILTER (source_class = '{c}') AS source_class_{c}" for c in ("media", "exchange", "regulator")) + ", count(*) FILTER (importance IS NULL) AS importance_missing, count(*) FILTER (sentiment IS NULL) AS sentiment_missing FROM ev",
    "i13_labels": f"WITH {RETURNS} SELECT symbol, horizon, CASE WHEN ret > 10 THEN 'UP' WHEN ret < -10 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'NEUTRAL' END AS direction, abs(ret) > 50 AS strong, abs(ret) >= 50 AS strong_inclusive, count(*) AS n FROM hr GROUP BY ALL",
    "i17_duplicate_keys": "SELECT row_id, count(*) AS n FROM production_rows GROUP BY 1 HAVING count(*) > 1",
    "i19_union": "SELECT record_id AS id, title, author, NULL::VARCHAR AS category, 'A' AS family FROM primary_source_events UNION ALL SELECT row_id, title, NULL, category, 'B' FROM (SELECT DISTINCT * FROM production_rows)",
    "i20_latest_success": "SELECT canonical_event_id, reaction_id, ok FROM (SELECT *, json_extract_string(metrics_json, '$.return_1m') IS NOT NULL AS ok FROM (SELECT DISTINCT * FROM stage16c_market_reactions)) QUALIFY row_number() OVER (PARTITION BY canonical_event_id ORDER BY ok DESC, reaction_id DESC) = 1",
    "i22_bins": f"WITH {_EV} SELECT CASE WHEN importance > -1 AND importance <= 20 THEN 1 WHEN importance > 20 AND importance <= 40 THEN 2 WHEN importance > 40 AND importance <= 60 THEN 3 WHEN importance > 60 AND importance <= 80 THEN 4 WHEN importance > 80 AND importance <= 100 THEN 5 END AS bin, count(*) AS n FROM ev GROUP BY 1",
    "j1_feature_quality": """WITH x AS (SELECT * FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS same FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax, same))),
        q AS (SELECT feature, count(*) AS rows, count(value) AS n, count(DISTINCT value) AS "unique", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM x GROUP BY 1),
        t AS (SELECT feature, max(k) AS top FROM (SELECT feature, value, count(*) AS k FROM x GROUP BY 1, 2) GROUP BY 1), u AS (SELECT feature, count(*) FILTER (value < p01 OR value > p99) AS outliers FROM x JOIN q USING (feature) GROUP BY 1)
        SELECT feature, rows, n, "unique", round((rows - n) * 100 / rows, 4) AS missing_pct, round(mean, 4) AS mean, round(std, 4) AS std, round(least, 4) AS least, round(most, 4) AS most, round(p01, 4) AS p01, round(p50, 4) AS p50, round(p99, 4) AS p99, outliers,
        CASE WHEN (rows - n) * 100 / rows > 40 THEN 'missing' WHEN "unique" <= 1 THEN 'constant' WHEN top >= n * 0.999 THEN 'near_constant' END AS removal_reason FROM q JOIN t USING (feature) JOIN u USING (feature)""",
    "j3_split_shift": f"WITH {_OS}, a AS (SELECT split, count(*) AS n, avg((ret > 0)::INT) AS rate FROM os GROUP BY 1), t AS (SELECT rate AS r FROM a WHERE split = 'train') SELECT split, n, round(rate, 6) AS rate, round(rate - r, 6) AS shift, abs(rate - r) > 0.10 AS unstable FROM a, t",
    "j7_coverage": f"WITH {RETURNS} SELECT symbol, horizon, count(*) AS rows, count(ret) AS present FROM hr GROUP BY 1, 2",
    "j8_distribution": f"WITH {RETURNS} SELECT symbol, horizon, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, " + ", ".join(f"round(quantile_cont(ret, {p}), 6) AS p{n}" for p, n in ((0.05, "05"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.95, "95"))) + " FROM hr WHERE ret IS NOT NULL GROUP BY 1, 2",
    "j11_lags": """WITH m AS (SELECT source_type, (epoch_us(discovered_at) - epoch_us(published_at)) / 60000000 AS m FROM primary_source_events WHERE published_at IS NOT NULL AND discovered_at IS NOT NULL)
        SELECT source_type, count(*) AS known, count(*) FILTER (m < 0) AS negative, round(quantile_cont(m, 0.75) FILTER (m >= 0), 6) AS p75, round(quantile_cont(m, 0.9) FILTER (m >= 0), 6) AS p90, """ + ", ".join(f"round(count(*) FILTER (m > {x}) * 100 / nullif(count(*) FILTER (m >= 0), 0), 6) AS above_{x}" for x in (5, 15, 60)) + " FROM m GROUP BY 1",
    "j13_skew": f"WITH {RETURNS} SELECT symbol, round(skewness(ret), 5) AS skew FROM hr WHERE ret IS NOT NULL GROUP BY 1",
    "j14_series_coverage": "WITH m AS (SELECT symbol, CASE WHEN open_time >= 100000000000000 THEN open_time // 60000000 ELSE open_time // 60000 END AS m FROM archive_candles) SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT m) AS duplicates, round((1 - count(DISTINCT m) / (max(m) - min(m) + 1)) * 100, 6) AS missing_pct FROM m GROUP BY 1",
    "j15_grouped": f"WITH {_FR} SELECT source, symbol, count(*) AS n, round(median(ret), 6) AS median_ret FROM fr WHERE ret IS NOT NULL GROUP BY GROUPING SETS ((), (source), (symbol))",
    "j16_rank": "WITH a AS (SELECT source, round(avg((epoch_us(discovered_at) - epoch_us(published_at)) / 60000000), 4) AS mean_lag FROM primary_source_events WHERE published_at IS NOT NULL GROUP BY 1) SELECT *, rank() OVER (ORDER BY mean_lag) AS rank FROM a",
    "j17_second_delay": "WITH k AS (SELECT lower(trim(event_id)) AS event, epoch_us(published_at) AS t, row_number() OVER (PARTITION BY lower(trim(event_id)) ORDER BY published_at) AS k FROM (SELECT DISTINCT * FROM production_rows) WHERE published_at IS NOT NULL) SELECT event, max(t) - min(t) AS delay FROM k WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2",
    "k3_rule_metrics": f"""WITH {_FR}, x AS (SELECT *, (actor % 10)::DOUBLE AS x FROM o), t AS ({_rule_union(_RULES)}), a AS (SELECT rule_id, count(*) AS n, count(*) FILTER (ret > 0) AS wins, avg(ret) AS m, median(ret) AS md, avg(ret - 0.2::DOUBLE) AS mn, sum(ret - 0.2::DOUBLE) FILTER (ret - 0.2::DOUBLE > 0) / -sum(ret - 0.2::DOUBLE) FILTER (ret - 0.2::DOUBLE < 0) AS pf FROM t GROUP BY 1)
        SELECT rule_id, n, wins, round(m, 6) AS mean_return, round(md, 6) AS median_return, round(mn, 6) AS mean_net, round(pf, 6) AS profit_factor, round(wins / n, 6) AS win_rate, round({_WIL.format('wins', 'n', '-')}, 6) AS wilson_low, round({_WIL.format('wins', 'n', '+')}, 6) AS wilson_high FROM a""",
    "k6_pair_search": f"WITH {_FR}, x AS (SELECT *, (actor % 10)::DOUBLE AS x FROM o), t AS ({_rule_union(_PAIRS)}), a AS (SELECT rule_id, count(*) AS n, count(*) FILTER (ret > 0) AS wins FROM t GROUP BY 1 HAVING count(*) >= 50) SELECT rule_id, n, wins, round((wins / n - 0.5) * sqrt(n), 6) AS score FROM a ORDER BY round((wins / n - 0.5) * sqrt(n), 6) DESC, rule_id LIMIT 3",
    "k12_signals": f"""WITH {_FR}, s AS (SELECT ret, (actor % 100) / 100 AS u FROM o), g AS (SELECT ret, CASE WHEN greatest(u, 1 - u) < 0.6::DOUBLE THEN 'NO_SIGNAL' WHEN u >= 1 - u THEN 'LONG' ELSE 'SHORT' END AS signal FROM s)
        SELECT signal, count(*) AS n, round(avg(CASE signal WHEN 'LONG' THEN ret - 0.2::DOUBLE WHEN 'SHORT' THEN -ret - 0.2::DOUBLE END), 6) AS mean_net FROM g GROUP BY 1""",
    "k16_performance": f"""WITH {_EQ}, a AS (SELECT count(*) AS n, sum(ret) AS t, avg(ret) AS m, median(ret) AS md, avg((ret > 0)::INT) AS w, sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0) AS pf, min(drawdown) AS mdd, stddev_samp(ret) AS sd, sqrt(avg(least(ret, 0) ** 2)) AS ds, min(ret) AS lo, max(ret) AS hi, avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) AS po FROM dd),
        e AS (SELECT avg(ret) AS es FROM (SELECT ret, row_number() OVER (ORDER BY ret, event_id) AS k FROM o), a WHERE k <= greatest(1, ceil(n * 0.05::DOUBLE)))
        SELECT n, round(t, 4) AS total, round(m, 4) AS mean, round(md, 4) AS median, round(w, 4) AS win_rate, round(pf, 4) AS profit_factor, round(mdd, 4) AS max_drawdown, round(sd, 4) AS deviation, round(ds, 4) AS downside, round(lo, 4) AS worst, round(hi, 4) AS best, round(po, 4) AS payoff, round(es, 4) AS expected_shortfall,
        round(m / sd * sqrt(n), 4) AS sharpe_like, round(CASE WHEN mdd < 0 THEN t / -mdd END, 4) AS recovery FROM a, e""",
    "k16_equity": f"WITH {_EQ} SELECT event_id, round(equity, 2) AS equity, round(drawdown, 2) AS drawdown FROM dd",
    "k18_streaks": f"WITH {_FR}, k AS (SELECT ret > 0 AS won, row_number() OVER (ORDER BY published_us, event_id) - row_number() OVER (PARTITION BY ret > 0 ORDER BY published_us, event_id) AS s FROM o), c AS (SELECT won, s, count(*) AS c FROM k GROUP BY 1, 2) SELECT won, max(c) AS longest FROM c GROUP BY 1",
    "k20_costs": f"WITH {_FR}, c AS (SELECT unnest([0.0, 0.1, 0.2, 0.5, 1.0])::DOUBLE AS cost) SELECT cost, count(*) AS n, round(sum(ret - cost), 4) AS total, round(avg(ret - cost), 4) AS mean, round(avg((ret - cost > 0)::INT), 4) AS win_rate FROM o, c GROUP BY 1",
    "k22_deciles": "WITH k AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT greatest(1, ceil(10.0::DOUBLE * (r - 1) / (n - 1)))::INT AS decile, count(*) AS n, round(avg(v), 4) AS mean FROM k GROUP BY 1",
    "l1_wilson": f"WITH {RETURNS}, a AS (SELECT symbol, horizon, count(ret) AS n, count(*) FILTER (ret > 0) AS wins FROM hr GROUP BY 1, 2) SELECT symbol, horizon, n, wins, round({_WIL.format('wins', 'n', '-')}, 8) AS low, round({_WIL.format('wins', 'n', '+')}, 8) AS high FROM a",
    "l5_benjamini_hochberg": """WITH p AS (SELECT p_partkey, p_brand, (p_partkey * 7919 % 9973) / 9973 AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM p)
        SELECT p_partkey, p_brand, round(least(1, min(p * m / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""",
    "l6_classification": """WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS p FROM lineitem), l AS (SELECT unnest(['A', 'N', 'R']) AS c), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = p) AS h FROM x),
        s AS (SELECT c, (SELECT count(*) FROM x WHERE a = c AND p = c)::DOUBLE AS tp, (SELECT count(*) FROM x WHERE a = c)::DOUBLE AS r, (SELECT count(*) FROM x WHERE p = c)::DOUBLE AS k FROM l),
        f AS (SELECT coalesce(tp / nullif(r, 0), 0) AS rec, coalesce(tp / nullif(k, 0), 0) AS pre, r, k FROM s), g AS (SELECT avg(rec) AS ba, avg(pre) AS pm, avg(coalesce(2 * pre * rec / nullif(pre + rec, 0), 0)) AS f1, sum(r * k) AS cr, sum(r * r) AS r2, sum(k * k) AS k2 FROM f)
        SELECT n::BIGINT AS n, round(h / n, 8) AS accuracy, round(ba, 8) AS balanced_accuracy, round(pm, 8) AS precision_macro, round(f1, 8) AS f1_macro, round((h * n - cr) / sqrt((n * n - k2) * (n * n - r2)), 8) AS mcc, round((h / n - cr / (n * n)) / (1 - cr / (n * n)), 8) AS kappa FROM t, g""",
    "l7_regression": """WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS x FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx FROM x)
        SELECT count(*) AS n, round(avg(abs(y - x)), 5) AS mae, round(sqrt(avg((y - x) ** 2)), 5) AS rmse, round(1 - sum((y - x) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r""",
    "l9_mann_whitney": f"""WITH {_FR}, r AS (SELECT source = 'signup' AS g, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2 AS k FROM o), a AS (SELECT count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, sum(k) FILTER (g) AS s FROM r)
        SELECT n1, n2, s - n1 * (n1 + 1) / 2 AS u, round((s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM a""",
    "l11_trimmed_mean": f"WITH {RETURNS}, t AS ({_TRIM}) SELECT symbol, horizon, n, round(trimmed_mean, 6) AS trimmed_mean FROM t",
    "m1_page": f"WITH {_EV}, h AS (SELECT * FROM ev WHERE list_contains(assets, 'ETH') AND source_class = 'media' AND published_at >= '2021-06-01' AND published_at < '2024-06-01') SELECT event_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY published_at DESC, event_id DESC LIMIT 10 OFFSET 10",
    "m2_sorted": f"WITH {_EV}, h AS (SELECT * FROM ev WHERE category = 'etf') SELECT event_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY importance DESC NULLS LAST, published_at DESC NULLS LAST, event_id DESC LIMIT 15",
    "m3_after_cursor": f"WITH {_EV} SELECT event_id FROM ev WHERE list_contains(assets, 'BTC') AND (published_at < '2023-01-01' OR (published_at = '2023-01-01' AND event_id > 1)) ORDER BY published_at DESC, event_id LIMIT 21",
    "m5_lookup": f"WITH {_EV} SELECT event_id, title, slug FROM ev WHERE event_id = 77",
    "m6_years": f"WITH {_EV}, y AS (SELECT year(published_at) AS year, count(*) AS n FROM ev WHERE published_at IS NOT NULL GROUP BY 1), s AS (SELECT unnest(generate_series(min(year), max(year))) AS year FROM y) SELECT year, coalesce(n, 0) AS n FROM s LEFT JOIN y USING (year)",
    "m10_ranked": f"WITH {_FR} SELECT event_id, round(ret, 6) AS ret FROM o ORDER BY o.ret DESC, event_id LIMIT 10",
    "m11_compare": f"WITH {_FR}, a AS (SELECT avg(ret) FILTER (source = 'signup') AS x, avg(ret) FILTER (source = 'error') AS y, median(ret) FILTER (source = 'signup') AS mx, median(ret) FILTER (source = 'error') AS my, count(*) FILTER (source = 'signup') AS n_a, count(*) FILTER (source = 'error') AS n_b FROM o) SELECT n_a, n_b, round(x, 6) AS mean_a, round(mx, 6) AS median_a, round(y, 6) AS mean_b, round(my, 6) AS median_b, round(x - y, 6) AS difference FROM a",
    "m14_overview": f"""WITH {RETURNS}, t AS ({_TRIM}), a AS (SELECT symbol, horizon, count(*) AS n, avg(ret) AS m, median(ret) AS md, stddev_samp(ret) AS s, count(*) FILTER (ret > 0) AS positive, count(*) FILTER (ret < 0) AS negative FROM hr WHERE ret IS NOT NULL GROUP BY 1, 2)
        SELECT symbol, horizon, a.n, positive, negative, round(m, 6) AS mean, round(md, 6) AS median, round(s, 6) AS std, round(s / sqrt(a.n), 6) AS error, round(trimmed_mean, 6) AS trimmed_mean, round(positive * 100 / a.n, 6) AS positive_pct, round(greatest(0, {_WIL.format('positive', 'a.n', '-')} * 100), 6) AS low_pct, round(least(100, {_WIL.format('positive', 'a.n', '+')} * 100), 6) AS high_pct FROM a JOIN t USING (symbol, horizon)""",
    "m15_search": f"""WITH {_EV}, t AS (SELECT event_id, {_TERMS.format('title')} AS t, {_TERMS.format("concat_ws(' ', source, category)")} AS o FROM ev), w AS (SELECT *, list_concat(t, o) AS a, {_STEM.format("'upgrade'")} AS w1, {_STEM.format("'fork'")} AS w2, {_STEM.format("'facts'")} AS w3, {_STEM.format("'treasury'")} AS w4 FROM t)
        SELECT event_id, round(""" + " + ".join(f"CASE WHEN list_contains(t, w{k}) THEN 1.0 WHEN list_contains(a, w{k}) THEN 0.4 ELSE 0 END" for k in (1, 2, 3)) + ", 6)::DOUBLE AS rank FROM w WHERE (list_contains(a, w1) OR list_contains(a, w2)) AND list_contains(a, w3) AND NOT list_contains(a, w4)",
    "m20_verification": "SELECT count(*) AS n, count(DISTINCT url) AS urls, count(*) FILTER (author IS NULL) AS no_author, count(*) FILTER (primary_source) AS official, (SELECT count(*) FROM (SELECT url FROM primary_source_events GROUP BY url HAVING count(*) > 1)) AS repeated_urls FROM primary_source_events",
    "m21_keywords": f"WITH {_EV} SELECT event_id FROM ev WHERE contains(lower(title), 'facts') AND contains(lower(title), 'order book')",
    "a12_csv": f"""WITH {_EV}, c AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '="' || title ELSE title END AS title, array_to_string(assets, '|') AS assets, category FROM ev), s AS (SELECT event_id, """ + ", ".join(f"coalesce('\"' || replace(CASE WHEN regexp_matches({c}::VARCHAR, '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE {c}::VARCHAR END, '\"', '\"\"') || '\"', '') AS x{k}" for k, c in enumerate(("event_id", "title", "assets", "category"))) + ' FROM c) SELECT concat_ws(\',\', x0, x1, x2, x3) AS line FROM s',
    "n1_contract": """SELECT 'missing:event_id' AS "check", count(*) FILTER (event_id IS NULL) AS violations FROM production_rows UNION ALL SELECT 'missing:title', count(*) FILTER (title IS NULL) FROM production_rows UNION ALL SELECT 'missing:category', count(*) FILTER (category IS NULL) FROM production_rows
        UNION ALL SELECT 'range:importance', count(*) FILTER (importance < 0 OR importance > 95) FROM production_rows UNION ALL SELECT 'allowed:sentiment', count(*) FILTER (sentiment IS NOT NULL AND sentiment NOT IN ('bullish', 'bearish', 'neutral')) FROM production_rows UNION ALL SELECT 'key:row_id', (SELECT count(*) FROM (SELECT row_id FROM production_rows GROUP BY 1 HAVING count(*) > 1))""",
    "n2_identity": "WITH a AS (SELECT DISTINCT row_id FROM production_rows WHERE row_id % 10 <> 3), b AS (SELECT DISTINCT row_id FROM production_rows WHERE row_id % 7 <> 2) SELECT CASE WHEN a.row_id IS NULL THEN 'new' WHEN b.row_id IS NULL THEN 'missing' ELSE 'both' END AS status, count(*) AS n FROM a FULL JOIN b ON a.row_id = b.row_id GROUP BY 1",
    "n3_merge": "SELECT count(*) AS n, round(sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS total FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0",
    "n4_changed_cells": """SELECT p_partkey, 'p_size' AS "column", p_size::VARCHAR AS old_value, (p_size + 1)::VARCHAR AS new_value FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 'p_name', p_name, upper(p_name) FROM part WHERE p_partkey % 13 = 0 AND p_name <> upper(p_name)""",
    "n6_comparison": f"WITH {RETURNS}, c AS (SELECT symbol, horizon, ret, ret - event_id % 5 AS new FROM hr WHERE ret IS NOT NULL) SELECT symbol, horizon, count(*) AS n, count(*) FILTER (sign(ret) * sign(new) < 0) AS flips, round(avg(abs(new - ret)), 5) AS mean_abs, round(quantile_cont(abs(new - ret), 0.95), 5) AS p95, round(quantile_cont(abs(new - ret), 0.99), 5) AS p99 FROM c GROUP BY GROUPING SETS ((), (symbol), (horizon))",
    "n7_magnitudes": f"""WITH {RETURNS}, c AS (SELECT ret - event_id % 5 - ret AS d, sign(ret) * sign(ret - event_id % 5) < 0 AS flipped FROM hr WHERE ret IS NOT NULL) SELECT CASE WHEN abs(d) <= 0 THEN 'none' WHEN abs(d) <= 0.01 THEN 'up_to_0.01' WHEN abs(d) <= 0.1 THEN 'up_to_0.1' WHEN abs(d) <= 0.5 THEN 'up_to_0.5' WHEN abs(d) <= 1 THEN 'up_to_1' WHEN abs(d) <= 5 THEN 'up_to_5' ELSE 'above_5' END AS size, flipped, count(*) AS n FROM c GROUP BY 1, 2""",
    "n11_extremes": f"WITH {RETURNS}, t AS (SELECT symbol, horizon, event_id, row_number() OVER (PARTITION BY symbol, horizon ORDER BY ret DESC, event_id) AS a, row_number() OVER (PARTITION BY symbol, horizon ORDER BY ret, event_id) AS b FROM hr WHERE ret IS NOT NULL) SELECT symbol, horizon, event_id, 'top' AS side, a AS place FROM t WHERE a <= 5 UNION ALL SELECT symbol, horizon, event_id, 'bottom', b FROM t WHERE b <= 5",
    "n12_round_robin": f"WITH {_EV} SELECT event_id, category, row_number() OVER (PARTITION BY category ORDER BY event_id) AS turn FROM ev WHERE category IS NOT NULL ORDER BY turn, category LIMIT 50",
    "n13_hash_sample": f"WITH {_EV} SELECT source, event_id, row_number() OVER (PARTITION BY source ORDER BY sha256('review:' || event_id)) AS draw FROM ev QUALIFY draw <= 3",
    "n14_pick": f"WITH {_EV} SELECT ('0x' || left(sha256(event_id::VARCHAR), 8))::BIGINT % 6 AS pick, count(*) AS n FROM ev GROUP BY 1",
}
