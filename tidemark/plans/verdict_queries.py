"""Queries of verdicts, audits, gates, sensitivities, text evidence and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.functions import identity as I
from tidemark.functions import textrules as T
from tidemark.operators import candles as C
from tidemark.operators import context as X
from tidemark.operators import dataset as D
from tidemark.operators import reactions as R
from tidemark.operators import serving as M
from tidemark.operators import signals as K
from tidemark.operators import stats as L
from tidemark.operators import verdicts as V
from tidemark.plans.analysis_queries import _EV, _FR, _POISSON, _TERMS, _U, _events, _frame, _one
from tidemark.plans.candle_queries import _P, _parsed
from tidemark.plans.cut import read
from tidemark.plans.models import ASSETS, BAR_S, BARS, RETURNS, bars, epoch_us, event_assets, news, returns

#: Microseconds that part earlier from later results in these queries: 2024-01-12 and 2024-01-19.
_TRAIN, _TEST = 1_705_017_600_000_000, 1_705_622_400_000_000


def _r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def _split() -> F.Column:
    return F.when(F.col("published_us") < _TRAIN, "train").when(F.col("published_us") < _TEST, "validation").otherwise("test")


_SPLIT_SQL = f"CASE WHEN published_us < {_TRAIN} THEN 'train' WHEN published_us < {_TEST} THEN 'validation' ELSE 'test' END"


def b5_selected_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles that may be used for a reaction, by symbol."""
    return _parsed(spark, d).groupBy("symbol", V.selected_candle_ok().alias("ok")).agg(F.count("*").alias("n"))


def c8_coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Hours with all sixty minutes and hours with fewer, by year and symbol, with totals."""
    g = C.one_per_minute(_parsed(spark, d)).groupBy("symbol", F.floor(F.col("minute") / 60).alias("hour")).agg(F.count("*").alias("k"))
    y = g.withColumn("year", F.year(F.timestamp_seconds(F.col("hour") * 3600)))
    return y.groupingSets([[F.col("symbol"), F.col("year")], [F.col("symbol")], []], "symbol", "year").agg(F.count("*").alias("hours"), F.count_if(F.col("k") == 60).alias("whole"))


def d6_final_quality(spark: SparkSession, d: str) -> DataFrame:
    """Final quality of every reaction, with its reasons."""
    b = bars(spark, d)
    # Bars at a price of 0 or less are the unusable ones; a month has an archive if it has a bar.
    months = b.select("symbol", V.month_of(F.col("bar"), BAR_S).alias("month")).distinct()
    return V.final_quality(returns(spark, d), months, b.where("open <= 0"), BAR_S)


def d20_peak_lost(spark: SparkSession, d: str) -> DataFrame:
    """Share of the best excursion of a day that is lost by its twelfth bar, by symbol."""
    path = lambda e: R.price_path(e, bars(spark, d), 24)
    x = R.per_base(event_assets(spark, d), lambda e: R.excursions(path(e)).join(path(e).where("offset = 12").select("event_id", "symbol", F.col("open_ret").alias("late")), ["event_id", "symbol"]))
    lost = F.when(F.col("mfe") > 0, (F.col("mfe") - F.col("late")) / F.col("mfe"))
    return x.groupBy("symbol").agg(F.count(lost).alias("n"), F.round(F.avg(lost), 5).alias("mean_lost"), F.count_if(lost > 0.6).alias("reversed"))


def d21_six_classes(spark: SparkSession, d: str) -> DataFrame:
    """What became of the paths of a day, by six ordered rules."""
    path = lambda e: R.price_path(e, bars(spark, d), 24)
    x = R.per_base(event_assets(spark, d), lambda e: R.excursions(path(e)).join(path(e).where("offset = 12").select("event_id", "symbol", F.col("open_ret").alias("late")), ["event_id", "symbol"], "left"))
    return x.groupBy("symbol", V.six_path_classes(F.col("mfe"), F.col("mae"), F.col("mfe_at"), F.col("late"), 1.0).alias("path")).agg(F.count("*").alias("n"))


def d24_votes(spark: SparkSession, d: str) -> DataFrame:
    """Which horizon has the largest move, by symbol."""
    w = R.wide_returns(returns(spark, d), (1, 5, 15, 24)).dropna()
    top = F.array_max(F.array(*[F.struct(F.abs(f"ret_{h}").alias("v"), F.lit(-h).alias("h")) for h in (1, 5, 15, 24)]))
    bucket = F.when(-top["h"] < 4, "short").when(-top["h"] < 24, "hours").otherwise("days")
    return w.groupBy("symbol", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def g2_group_keys(spark: SparkSession, d: str) -> DataFrame:
    """Events of articles, those without an event being one of their own."""
    a = read(spark, d, "stage16c_market_reactions").distinct()
    key = E.group_key(F.when(F.col("reaction_id") % 2 == 0, F.col("canonical_event_id")), F.col("reaction_id"))
    return a.groupBy(key.alias("event_key")).agg(F.count("*").alias("n"))


def h6_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Articles within the window of each asset."""
    a = read(spark, d, "primary_source_events").select("published_at", F.explode(F.transform(F.from_json("assets_json", "array<string>"), F.upper)).alias("asset"))
    window = {"BTC": ("2021-01-01", "2024-01-01"), "ETH": ("2021-01-01", "2023-01-01"), "SOL": ("2022-03-16", "2025-01-01")}
    return a.groupBy("asset").agg(F.count("*").alias("n"), F.count_if(E.admitted(F.col("asset"), F.col("published_at"), window)).alias("admitted"))


def h9_official(spark: SparkSession, d: str) -> DataFrame:
    """Articles by whether their host is their source's own, by source."""
    a = read(spark, d, "primary_source_events")
    own = E.host(F.col("url")) == F.concat(F.regexp_replace("source", "_", "-"), F.lit(".example"))
    return a.groupBy("source", E.official(own, F.col("author"), F.lit(None).cast("string")).alias("official")).agg(F.count("*").alias("n"))


_NAMES = {"BTC": ["btc", "bitcoin"], "ETH": ["eth", "ether"], "SOL": ["sol", "solana"]}


def h11_classified(spark: SparkSession, d: str) -> DataFrame:
    """Assets of articles by evidence in the title, or in the body if the time is sure, and the primary one if there is one only."""
    a = read(spark, d, "primary_source_events")
    assets = E.classified_assets(F.col("title"), F.col("body"), _NAMES, F.col("time_confidence") >= 0.95)
    return a.select("record_id", F.array_join(assets, "|").alias("assets"), E.primary_asset(assets).alias("primary"))


def h19_entities(spark: SparkSession, d: str) -> DataFrame:
    """Organisations named in titles, counted."""
    found = E.entities(F.col("title"), ["Labs", "Exchange", "Capital", "Foundation", "Protocol", "Custody"])
    return read(spark, d, "primary_source_events").select(F.explode(found).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def h26_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What to do with articles without assets, by their evidence."""
    a = read(spark, d, "primary_source_events").where("assets_json IS NULL OR assets_json = '[]'")
    kind, action = E.repair(E.evidence(F.col("title"), _NAMES), E.evidence(F.col("body"), _NAMES), F.lower("title").rlike(r"\b(crypto|token|mempool|staking)\b"))
    return a.groupBy(kind.alias("kind"), action.alias("action")).agg(F.count("*").alias("n"))


def h27_horizons(spark: SparkSession, d: str) -> DataFrame:
    """Durations told in documents, by the horizon they name."""
    told = E.durations(F.col("text"))
    return read(spark, d, "documents").select(F.explode(told).alias("x")).groupBy(E.horizon_of(F.col("x.n"), F.col("x.unit")).alias("horizon"), "x.unit").agg(F.count("*").alias("n"))


def i3_event_records(spark: SparkSession, d: str) -> DataFrame:
    """Why events have no record, and how many have one."""
    e = news(spark, d).select("event_id", F.floor(F.col("published_us") / (BAR_S * 1_000_000)).alias("cutoff"))
    return V.event_records(e, bars(spark, d), ["BTC", "ETH"], 72, 4, 3).groupBy("reason").agg(F.count("*").alias("n"))


def i12_missing_token(spark: SparkSession, d: str) -> DataFrame:
    """Categories with a token for missing ones."""
    e = D.with_missing_token(_events(spark, d), ["category", "sentiment"])
    return e.groupBy("category", "sentiment").agg(F.count("*").alias("n"))


def i15_refused(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a leakage guard refuses."""
    names = ["pre_return_5m", "return_5m", "eth_reaction", "max_favorable_1h", "MFE_day", "target_up", "volume_shock_5m", "hour", "abnormal_return_1h", "post_event_vol", "future_x", "importance"]
    return spark.createDataFrame([(c,) for c in D.forbidden_features(names)], "column string")


def i16_variants(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each variant of a dataset."""
    e = R.wide_returns(returns(spark, d), (1, 5, 15, 24)).select(F.col("event_id").alias("metadata_event"), F.col("ret_1").alias("pre_ret"), F.col("ret_5").alias("ai_score"), F.col("ret_24").alias("target_ret"))
    v = D.variants(e, {"market": ["metadata_", "pre_"], "ai": ["metadata_", "ai_"], "both": ["metadata_", "pre_", "ai_"]})
    parts = [x.agg(F.lit(n).alias("variant"), F.lit(",".join(x.columns)).alias("columns"), F.count("*").alias("n")) for n, x in v.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def j6_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the article table."""
    return V.audit(read(spark, d, "primary_source_events"), F.lit("2025-06-01").cast("timestamp"), 500, 3000)


def j6_values(spark: SparkSession, d: str) -> DataFrame:
    """Missing and extreme results by symbol and horizon."""
    return V.value_audit(returns(spark, d), ["symbol", "horizon"], "ret", 50.0)


def j12_anchor_bias(spark: SparkSession, d: str) -> DataFrame:
    """Results counted from a bar earlier, against those counted from the article's bar."""
    e = event_assets(spark, d)
    early = R.horizon_returns(e.withColumn("base", F.col("base") - 1), bars(spark, d), (1, 5, 15, 24))
    return V.anchor_bias(returns(spark, d), early, ["event_id", "symbol", "horizon"], "ret", ["symbol", "horizon"]).select("symbol", "horizon", "n", *_r("mean_delta", "mean_abs_delta", digits=5), "flips")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    label = F.when(F.lower("sentiment") == "bullish", "positive").when(F.lower("sentiment") == "bearish", "negative").when(F.col("sentiment").isNull(), "not_applicable").otherwise(F.lower("sentiment"))
    score, how = V.repaired_score(label, (F.col("importance") - 50) / 50)
    return e.select("event_id", label.alias("label"), score.alias("score"), how.alias("how"), (F.col("importance") / 100).alias("importance"), (F.col("importance") / 80).alias("confidence"))


def j18_repaired(spark: SparkSession, d: str) -> DataFrame:
    """How scores were changed to follow their labels."""
    return _labelled(spark, d).groupBy("label", "how").agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("total"))


def j18_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the repaired scores still break."""
    return V.score_failures(_labelled(spark, d), "label", "score", "importance", "confidence")


def k8_subgroups(spark: SparkSession, d: str) -> DataFrame:
    """Named subgroups of the results against the rest."""
    x = _one(spark, d)
    named = {"signups": F.col("source") == "signup", "even_actors": F.col("actor") % 2 == 0, "bitcoin_day": (F.col("symbol") == "BTC") & (F.col("horizon") == 24), "nobody": F.col("actor") < 0}
    return V.subgroups(x, named, "ret").select("subgroup", "n", *_r("mean", "mean_rest", digits=5))


def k9_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Results at or above each threshold of a feature, by horizon and split."""
    x = _one(spark, d).withColumns({"x": (F.col("actor") % 10).cast("double"), "split": _split()})
    return V.threshold_grid(x, "x", [0, 2, 4, 6, 8], ["horizon", "split"], "ret", 0.25).select("horizon", "split", "threshold", "n", *_r("win_rate", "mean", digits=5))


def k10_sample_gates(spark: SparkSession, d: str) -> DataFrame:
    """How far the number of results of each actor bears conclusions."""
    a = _one(spark, d).groupBy("actor").agg(F.count("*").alias("n"))
    return a.groupBy(K.sample_gate(F.col("n")).alias("gate")).agg(F.count("*").alias("actors"))


def k11_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals from the bars before, counted."""
    w = R.wide_returns(returns(spark, d), (1, 5, 15, 24))
    s = V.momentum_signals(F.col("ret_1"), F.col("ret_5"), F.lit(0.5), F.col("ret_15"), F.col("ret_24"), F.col("ret_5"), F.col("event_id"))
    return w.agg(*[F.sum(c).alias(n) for n, c in s.items()])


def k15_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Following the sign of the last day over five bars, in proportion to size and less the cost, by symbol."""
    w = R.wide_returns(returns(spark, d), (5, 24)).dropna()
    size = F.least(F.lit(1.0), 50.0 / F.greatest(F.abs("ret_24"), F.lit(1.0)))
    pnl = F.signum("ret_24") * F.col("ret_5") * size - 0.2 * size
    return w.where("ret_24 <> 0").groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.sum(pnl), 4).alias("total"), F.round(F.avg((pnl > 0).cast("double")), 6).alias("win_rate"), F.round(F.avg(size), 6).alias("mean_size"))


def k22_top_lift(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the orders with the highest priority number against all."""
    o = read(spark, d, "orders")
    return D.top_lift(o, "o_orderdate", "o_orderkey", "o_totalprice", 0.1).select("n", *_r("top_mean", "lift"))


def k25_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of always buying each symbol at each horizon."""
    x = _one(spark, d).withColumn("net", F.col("ret") - 0.2)
    fold = x.withColumn("fold", F.col("event") % 5).groupBy("symbol", "horizon", "fold").agg(F.avg("net").alias("m")).groupBy("symbol", "horizon").agg(F.count_if(F.col("m") > 0).alias("good"), F.count_if(F.col("m") > 1).alias("above"))
    per = x.groupBy("symbol", "horizon", "source").agg(F.count("*").alias("k")).groupBy("symbol", "horizon").agg(F.count_if(F.col("k") >= 10).alias("sources"))
    a = x.groupBy("symbol", "horizon").agg(F.avg((F.col("net") > 0).cast("double")).alias("p"), F.avg(F.col("ret") - 0.3).alias("robust")).join(fold, ["symbol", "horizon"]).join(per, ["symbol", "horizon"])
    score, word = V.reliability({
        "profitable_folds": F.col("good"), "folds_above_baseline": F.col("above"), "positive_probability": F.col("p"), "year_share": F.lit(0.0), "regime_share": F.lit(0.5), "direction_share": F.lit(1.0),
        "robust": F.col("robust") > 0, "sources": F.col("sources"), "top_two_share": F.lit(0.5)})
    return a.select("symbol", "horizon", F.round(score, 5).alias("score"), word.alias("word"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    x = _one(spark, d).withColumn("split", _split())
    month = F.floor(F.col("published_us") / (7 * 86_400_000_000))
    return V.signal_metrics(x, ["symbol", "horizon"], F.col("split"), "ret", "source", month, 1)


def k29_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Why buying each symbol at each horizon is or is not shortlisted."""
    c = _candidates(spark, d).withColumn("reasons", V.candidate_gate(F.lit(0.5)))
    return c.select("symbol", "horizon", "train_signals", "signals", *_r("accuracy", "expectancy", "train_expectancy", "source_share", "month_share", digits=5), "reasons")


def k30_costs(spark: SparkSession, d: str) -> DataFrame:
    """Mean results after costs by latency and horizon, with the cost that leaves nothing."""
    r = R.latency_returns(event_assets(spark, d), bars(spark, d), (1, 5, 15), (0, 1, 3))
    return V.cost_sensitivity(r, ["latency", "horizon"], "ret", [0.0, 0.1, 0.3]).select("latency", "horizon", "cost", "n", *_r("mean_net", "break_even", digits=5))


def k30_holding(spark: SparkSession, d: str) -> DataFrame:
    """The best holding of each symbol on the earlier results, and what it gives on the later ones."""
    return V.best_holding(_one(spark, d), ["symbol"], "horizon", "ret", F.col("published_us") < _TRAIN).select("symbol", "horizon", *_r("train_mean", "test_mean", digits=5))


def k32_locked_test(spark: SparkSession, d: str) -> DataFrame:
    """A frozen shortlist evaluated once over three parts of the events in time."""
    short = _candidates(spark, d).where("train_expectancy > 0").select("symbol", "horizon")
    return V.locked_test(_one(spark, d), short, ["symbol", "horizon"], "published_us", "event", "ret").select("symbol", "horizon", "chunk", "n", *_r("mean_abs", digits=5), "digest")


def l2_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean result by symbol and horizon with an interval from resampled rows."""
    return L.bootstrap_mean(_one(spark, d), ["symbol", "horizon"], "event_id", "ret", 50).select("symbol", "horizon", "n", *_r("mean", "low", "high", digits=5))


def l9_group_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Results of two sources compared, with effect size and the rank sum test with ties."""
    return L.group_comparison(_one(spark, d), "ret", F.col("source") == "signup").select("n1", "n2", *_r("mean1", "mean2", "difference", "effect", digits=5), "u", *_r("p"))


def l12_error_difference(spark: SparkSession, d: str) -> DataFrame:
    """How much better one prediction of the results at five bars is than another, with intervals."""
    w = R.wide_returns(returns(spark, d), (1, 5, 15)).withColumn("id", F.concat("event_id", "symbol"))
    return L.bootstrap_errors(w, ["symbol"], "id", "ret_5", "ret_1", "ret_15", 50).select("symbol", "metric", *_r("estimate", "low", "high", digits=4), *_r("better"))


def l13_horizon_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates and sizes of the results by symbol and horizon."""
    return V.horizon_metrics(returns(spark, d), ["symbol", "horizon"], "ret", [0.5, 10.0]).select("symbol", "horizon", "n", *_r("mean", "mean_size", "positive_rate", "negative_rate", "strong_0_5", "strong_10_0", digits=5))


def l14_winsorised(spark: SparkSession, d: str) -> DataFrame:
    """Importance drawn in to its outer quantiles, missing ones replaced."""
    w = V.winsorised(_events(spark, d).withColumn("importance", F.col("importance").cast("double")), "importance", 0.005, 0.995)
    return w.agg(F.count("*").alias("n"), F.sum("importance_missing").alias("missing"), *[F.round(f("importance_w"), 5).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])


def l14_linear(spark: SparkSession, d: str) -> DataFrame:
    """A linear model of price by quantity, fitted by pyspark.ml."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("label")))
    m = LinearRegression(solver="normal").fit(x)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 2))], "slope double, intercept double")


def m4_topic_scan(spark: SparkSession, d: str) -> DataFrame:
    """Newest events whose title is of a topic."""
    e = _events(spark, d).where(T.has_word(F.col("title"), "treasury") | T.has_word(F.col("title"), "custody"))
    return e.orderBy(F.desc_nulls_last("published_at"), "event_id").limit(25).select("event_id", "title")


def m9_search_count(spark: SparkSession, d: str) -> DataFrame:
    """A page of a search by relevance, then the newest, with the number of all that match."""
    e = _events(spark, d)
    hits = M.search(e, "upgrade OR fork", "event_id", "title", ["source", "category"]).select("event_id", "rank").join(e.select("event_id", "published_at"), "event_id")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(F.desc(F.round("rank", 6)), F.desc_nulls_last("published_at"), "event_id").limit(20).crossJoin(F.broadcast(total)).select("event_id", F.round("rank", 6).alias("rank"), "total")  # total is one row


def f3_url_free_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of titles after casefolding and dropping urls, counted by length."""
    key = I.text_key(F.regexp_replace(F.lower(F.concat("title", F.lit(" "), "url")), r"https?://\S+", " "))
    return read(spark, d, "primary_source_events").groupBy(F.length(key).alias("length")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


def d10_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Mean excursions within a day by which ends of the window belong to it."""
    x = R.per_base(event_assets(spark, d), lambda e: V.bounded_excursions(R.price_path(e, bars(spark, d), 24), 24))
    return x.groupBy("symbol", "bounds").agg(F.count("*").alias("n"), F.round(F.avg("mfe"), 4).alias("mfe"), F.round(F.avg("mae"), 4).alias("mae"))


def e15_futures_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of crowding and squeezes, on figures made from the bars."""
    f = V.futures_flags((F.col("close") - F.col("open")) / 10_000, F.try_divide(F.col("high"), F.col("open")), F.col("close") - F.col("open"), F.col("volume") - 10)
    return bars(spark, d).groupBy("symbol").agg(*[F.sum(c).alias(n) for n, c in f.items()])


def k4_seven_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why rules are turned away, of seven reasons."""
    x = _one(spark, d).withColumn("x", (F.col("actor") % 10).cast("double"))
    rules = {"a": (F.col("x") >= 2, 1), "b": (F.col("x") >= 5, 1), "c": (F.col("x") > 100, 1), "d": (F.col("ret") > 0, 1), "e": ((F.col("ret") > 0) & (F.col("source") == "signup"), 2), "f": (F.col("ret") > 0, 5)}
    tagged = x.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule_id"), F.lit(k).alias("complexity"))) for n, (c, k) in rules.items()]))))
    net = F.col("ret") - 0.2
    m = tagged.groupBy("rule.rule_id", "rule.complexity").agg(
        F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg(net).alias("mean_net"), F.try_divide(F.sum(F.when(net > 0, net)), -F.sum(F.when(net < 0, net))).alias("profit_factor"),
        F.count_distinct("source").alias("source_count"), F.count_distinct(F.floor(F.col("published_us") / (7 * 86_400_000_000))).alias("month_count"))
    return m.select("rule_id", "n", V.seven_reasons().alias("reason"))


def k21_risk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Mean results at five bars by the way positions are sized by the move of the first."""
    w = R.wide_returns(returns(spark, d), (1, 5)).where("ret_5 IS NOT NULL").withColumn("risk", F.abs("ret_1"))
    s = V.risk_sizes(w, "risk", F.col("event_id") % 2 == 0)
    long = F.array(*[F.struct(F.lit(n).alias("sizing"), c.alias("size")) for n, c in s.items()])
    x = w.select("ret_5", F.explode(long).alias("s"))
    return x.groupBy("s.sizing").agg(F.count("*").alias("n"), F.round(F.avg("s.size"), 6).alias("mean_size"), F.round(F.avg(F.col("s.size") * F.col("ret_5")), 5).alias("mean_sized"))


def k23_guesses(spark: SparkSession, d: str) -> DataFrame:
    """How often simple guesses have the sign of the results at five bars."""
    w = R.wide_returns(returns(spark, d), (1, 5, 15)).withColumn("id", F.concat("event_id", "symbol"))
    return V.guess_baselines(w, ["symbol"], "ret_5", "ret_1", "ret_15", "id").select("symbol", "n", *_r("always_up", "always_down", "trend", "opposite", "random"))


def b3_named_codes(spark: SparkSession, d: str) -> DataFrame:
    """Candles of another symbol or interval than the one named, counted."""
    p = _parsed(spark, d).withColumn("interval", F.when(F.col("trade_count") % 7 == 0, "5m").otherwise("1m"))
    codes = C.candle_codes("BTCUSDT", "1m")
    return p.groupBy(codes.contains("symbol_mismatch").alias("symbol"), codes.contains("interval_mismatch").alias("interval")).agg(F.count("*").alias("n"))


def e10_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Span of the day before an event over its open, and the log return of that day."""
    x = R.per_base(event_assets(spark, d), lambda e: X.range_before(e, bars(spark, d), 24))
    return x.select("event_id", "symbol", *_r("range_share", "log_return"))


def e11_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Results at five bars by the size of the move at one, above or below the median of the earlier ones."""
    w = R.wide_returns(returns(spark, d), (1, 5)).withColumn("v", F.abs("ret_1"))
    return X.volatility_regime(w, "v", F.col("event_id") % 2 == 0).groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.round(F.avg("ret_5"), 5).alias("mean"))


def l4_cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the results of a third of the actors, with the labels of whole actors drawn at random."""
    return L.cluster_label_test(_one(spark, d), "actor", "ret", F.col("actor") % 3 == 0, 100).select(*_r("difference", "p", digits=5))


QUERIES = {f.__name__: f for f in (
    b5_selected_candles, c8_coverage_by_year, d6_final_quality, d20_peak_lost, d21_six_classes, d24_votes, f3_url_free_keys, g2_group_keys, h6_admitted, h9_official, h11_classified, h19_entities, h26_repairs, h27_horizons,
    i3_event_records, i12_missing_token, i15_refused, i16_variants, j6_audit, j6_values, j12_anchor_bias, j18_repaired, j18_failures, k8_subgroups, k9_threshold_grid, k10_sample_gates, k11_signals, k15_simulation,
    k22_top_lift, k25_reliability, k29_candidates, k30_costs, k30_holding, k32_locked_test, l2_bootstrap_mean, l9_group_comparison, l12_error_difference, l13_horizon_metrics, l14_winsorised, l14_linear, m4_topic_scan, m9_search_count,
    d10_bounds, e15_futures_flags, k4_seven_reasons, k21_risk_sizes, k23_guesses, b3_named_codes, e10_ranges, e11_volatility, l4_cluster_labels,
)}

_PE = "primary_source_events"
_WORD = "regexp_matches(lower({0}), '(^|[^a-z0-9])({1})($|[^a-z0-9])')"
_EVI = "list_filter([" + ", ".join(f"CASE WHEN {_WORD.format('{0}', '|'.join(v))} THEN '{k}' END" for k, v in _NAMES.items()) + "], lambda x: x IS NOT NULL)"
_DAY = f"""{BARS}, {ASSETS}, pth AS (SELECT event_id, ea.symbol, g.bar - base AS q, (g.open / b.open - 1) * 100 AS o, CASE WHEN g.high > 0 THEN (g.high / b.open - 1) * 100 END AS h, CASE WHEN g.low > 0 THEN (g.low / b.open - 1) * 100 END AS l, g.open AS go
    FROM ea JOIN bars b ON b.symbol = ea.symbol AND b.bar = base JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base AND base + 24 WHERE b.open > 0),
    ex AS (SELECT event_id, symbol, max(h) AS mfe, min(l) AS mae, arg_min(q, (-h, q)) AS peak FROM pth WHERE h IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2),
    lt AS (SELECT event_id, symbol, CASE WHEN go > 0 THEN o END AS late FROM pth WHERE q = 12)"""
_LAB = _EV + """, lb AS (SELECT event_id, importance / 100 AS importance, importance / 80 AS confidence, CASE WHEN lower(sentiment) = 'bullish' THEN 'positive' WHEN lower(sentiment) = 'bearish' THEN 'negative' WHEN sentiment IS NULL THEN 'not_applicable' ELSE lower(sentiment) END AS label, (importance - 50) / 50 AS raw FROM ev),
    rp AS (SELECT *, CASE WHEN label = 'not_applicable' THEN NULL WHEN label IN ('neutral', 'mixed') THEN 0.0 WHEN label = 'negative' AND raw >= 0 THEN -abs(raw) WHEN label = 'positive' AND raw <= 0 THEN abs(raw) ELSE raw END AS score,
        CASE WHEN (label = 'negative' AND raw >= 0) OR (label = 'positive' AND raw <= 0) THEN 'sign_from_label' WHEN label = 'mixed' THEN 'mixed_to_zero' ELSE 'none' END AS how FROM lb)"""
_WIDE = RETURNS + ", w AS (SELECT event_id, symbol, max(ret) FILTER (horizon = 1) AS r1, max(ret) FILTER (horizon = 5) AS r5, max(ret) FILTER (horizon = 15) AS r15, max(ret) FILTER (horizon = 24) AS r24 FROM hr GROUP BY 1, 2)"
_CAND = _FR + f""", x AS (SELECT *, {_SPLIT_SQL} AS split, published_us // 604800000000 AS m FROM o),
    a AS (SELECT symbol, horizon, count(*) FILTER (split = 'train') AS train_signals, count(*) FILTER (split = 'validation') AS signals, avg((ret > 0)::INT) FILTER (split = 'validation') AS accuracy, avg(ret) FILTER (split = 'validation') AS expectancy,
        avg(ret) FILTER (split = 'train') AS train_expectancy, count(*) AS total_rows FROM x WHERE split <> 'test' GROUP BY 1, 2),
    s AS (SELECT symbol, horizon, max(k) / sum(k) AS source_share FROM (SELECT symbol, horizon, source, count(*) AS k FROM x WHERE split = 'validation' GROUP BY 1, 2, 3) GROUP BY 1, 2),
    n AS (SELECT symbol, horizon, max(k) / sum(k) AS month_share FROM (SELECT symbol, horizon, m, count(*) AS k FROM x WHERE split = 'validation' GROUP BY 1, 2, 3) GROUP BY 1, 2),
    cd AS (SELECT * FROM a LEFT JOIN s USING (symbol, horizon) LEFT JOIN n USING (symbol, horizon))"""
_SIGN = "coalesce(sign({0}), 0)"
_ERF = "(0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * t * exp(-x * x)"
_REASON = """CASE WHEN nb AND m < f THEN 'asset_not_listed' WHEN m > l THEN 'event_after_market_cutoff' WHEN bad IS NOT NULL THEN 'invalid_candle' WHEN k IS NULL THEN 'market_archive_missing' ELSE 'endpoint_missing' END"""
_MONTH = "(year(make_timestamp({0} * 3600000000)) * 12 + month(make_timestamp({0} * 3600000000)) - 1)"
_EXTRACT = "regexp_extract_all(lower(text), '(?:after|took|over|in) ([0-9]{{1,6}}) (minute|hour|day)s?', {0})"

SQL = {
    "b5_selected_candles": f"""WITH {_P} SELECT symbol, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT isnan(open) AND NOT isnan(high) AND NOT isnan(low) AND NOT isnan(close) AND high >= greatest(open, close) AND low <= least(open, close)
        AND o2 BETWEEN 1483228800000000 AND 1893455999999999 AND c2 BETWEEN 1483228800000000 AND 1893455999999999 AND c2 // 1000 - o2 // 1000 >= 59999 AND c2 // 1000 - o2 // 1000 < 60000, false) AS ok, count(*) AS n FROM (SELECT *, open_us AS o2, close_us AS c2 FROM p) GROUP BY 1, 2""",
    "c8_coverage_by_year": f"""WITH {_P}, g AS (SELECT DISTINCT symbol, open_us // 60000000 AS minute FROM p WHERE symbol IS NOT NULL AND close IS NOT NULL AND open_us BETWEEN 1483228800000000 AND 1893455999999999 AND close_us BETWEEN 1483228800000000 AND 1893455999999999 AND NOT mixed
        AND open > 0 AND close > 0 AND high >= open AND high >= close AND low <= open AND low <= close AND high >= low AND volume >= 0 AND open_us % 60000000 = 0), h AS (SELECT symbol, minute // 60 AS hour, count(*) AS k FROM g GROUP BY 1, 2)
        SELECT symbol, year, count(*) AS hours, count(*) FILTER (k = 60) AS whole FROM (SELECT *, year(make_timestamp(hour * 3600000000)) AS year FROM h) GROUP BY GROUPING SETS ((symbol, year), (symbol), ())""",
    "d6_final_quality": f"""WITH {RETURNS}, mo AS (SELECT DISTINCT symbol, {_MONTH.format('bar')} AS m, 1 AS k FROM bars), bo AS (SELECT symbol, min(m) AS f, max(m) AS l FROM mo GROUP BY 1),
        r AS (SELECT *, coalesce(base_open <= 0, true) AS nb, CASE WHEN coalesce(base_open <= 0, true) THEN base ELSE base + horizon END AS bar FROM hr), z AS (SELECT r.*, {_MONTH.format('r.bar')} AS m FROM r),
        q AS (SELECT z.*, CASE WHEN ret IS NULL THEN {_REASON} END AS reason FROM z LEFT JOIN bo USING (symbol) LEFT JOIN mo USING (symbol, m) LEFT JOIN (SELECT symbol, bar, 1 AS bad FROM bars WHERE open <= 0) b USING (symbol, bar))
        SELECT event_id, symbol, CASE WHEN count(reason) = 0 THEN 'raw_verified_v2' WHEN bool_or(reason = 'invalid_candle') THEN 'excluded_invalid_candle' WHEN count(reason) = count(*) THEN 'missing_market_data' ELSE 'partial_raw_verified_v2' END AS quality,
        '{{' || string_agg('"' || horizon || '":"' || reason || '"', ',' ORDER BY horizon::VARCHAR) FILTER (reason IS NOT NULL) || '}}' AS reasons FROM q GROUP BY 1, 2""",
    "d20_peak_lost": f"WITH {_DAY}, z AS (SELECT symbol, CASE WHEN mfe > 0 THEN (mfe - late) / mfe END AS lost FROM ex JOIN lt USING (event_id, symbol)) SELECT symbol, count(lost) AS n, round(avg(lost), 5) AS mean_lost, count(*) FILTER (lost > 0.6) AS reversed FROM z GROUP BY 1",
    "d21_six_classes": f"""WITH {_DAY}, z AS (SELECT symbol, mfe, mae, peak, CASE WHEN mfe > 0 THEN (mfe - late) / mfe END AS lost, coalesce(CASE WHEN mfe > 0 THEN late / mfe END, 0) AS kept FROM ex LEFT JOIN lt USING (event_id, symbol))
        SELECT symbol, CASE WHEN mfe >= 0.5 AND lost > 0.6 THEN 'spike_then_reversal' WHEN mfe >= 0.5 AND peak <= 1 AND kept >= 0.4 THEN 'immediate_and_persistent' WHEN mfe >= 0.5 AND peak > 1 AND kept >= 0.4 THEN 'delayed_and_persistent' WHEN peak > 4 AND mfe >= 0.25 THEN 'gradual_move'
        WHEN mfe < 0.1 AND mae <= -0.25 THEN 'moved_against_signal' ELSE 'no_clear_reaction' END AS path, count(*) AS n FROM z GROUP BY 1, 2""",
    "d24_votes": f"WITH {_WIDE}, v AS (SELECT symbol, list_max([(abs(r1), -1), (abs(r5), -5), (abs(r15), -15), (abs(r24), -24)]) AS t FROM w WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND r15 IS NOT NULL AND r24 IS NOT NULL) SELECT symbol, CASE WHEN -t[2] < 4 THEN 'short' WHEN -t[2] < 24 THEN 'hours' ELSE 'days' END AS bucket, count(*) AS n FROM v GROUP BY 1, 2",
    "f3_url_free_keys": f"WITH k AS (SELECT trim(regexp_replace(regexp_replace(lower(title || ' ' || url), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM {_PE}) SELECT length(k) AS length, count(*) AS n, count(DISTINCT k) AS keys FROM k GROUP BY 1",
    "g2_group_keys": "SELECT coalesce(CASE WHEN reaction_id % 2 = 0 THEN canonical_event_id END, 'news-' || reaction_id) AS event_key, count(*) AS n FROM (SELECT DISTINCT * FROM stage16c_market_reactions) GROUP BY 1",
    "h6_admitted": f"""WITH a AS (SELECT published_at AS t, upper(unnest(from_json(assets_json, '["VARCHAR"]'))) AS asset FROM {_PE}) SELECT asset, count(*) AS n, count(*) FILTER ((asset = 'BTC' AND t >= '2021-01-01' AND t < '2024-01-01') OR (asset = 'ETH' AND t >= '2021-01-01' AND t < '2023-01-01') OR (asset = 'SOL' AND t >= '2022-03-16' AND t < '2025-01-01')) AS admitted FROM a GROUP BY 1""",
    "h9_official": f"SELECT source, coalesce(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) = replace(source, '_', '-') || '.example', false) AS official, count(*) AS n FROM {_PE} GROUP BY 1, 2",
    "h11_classified": f"""WITH x AS (SELECT record_id, {_EVI.format('title')} AS t, CASE WHEN time_confidence >= 0.95 THEN {_EVI.format('body')} ELSE [] END AS b FROM {_PE}), y AS (SELECT record_id, list_filter(['BTC', 'ETH', 'SOL'], lambda z: list_contains(coalesce(t, []), z) OR list_contains(coalesce(b, []), z)) AS a FROM x)
        SELECT record_id, array_to_string(a, '|') AS assets, CASE WHEN len(a) = 1 THEN a[1] END AS primary FROM y""",
    "h19_entities": f"SELECT entity, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(title, '\\b[A-Z][a-z]+ (?:Labs|Exchange|Capital|Foundation|Protocol|Custody)\\b'))) AS entity FROM {_PE}) GROUP BY 1",
    "h26_repairs": f"""WITH x AS (SELECT {_EVI.format('title')} AS t, {_EVI.format('body')} AS b, regexp_matches(lower(title), '\\b(crypto|token|mempool|staking)\\b') AS g FROM {_PE} WHERE assets_json IS NULL OR assets_json = '[]')
        SELECT CASE WHEN len(t) > 0 THEN 'classification_missed_asset' WHEN len(b) > 0 THEN 'needs_review' WHEN g THEN 'correctly_unassigned' ELSE 'not_crypto_enough' END AS kind, CASE WHEN len(t) > 0 THEN 'APPLY_EXPLICIT_TITLE_ASSETS' WHEN len(b) > 0 THEN 'REVIEW_BODY_EVIDENCE' ELSE 'KEEP_EMPTY' END AS action, count(*) AS n FROM x GROUP BY 1, 2""",
    "h27_horizons": f"""WITH x AS (SELECT unnest({_EXTRACT.format(1)})::BIGINT AS n, unnest({_EXTRACT.format(2)}) AS unit FROM documents)
        SELECT CASE WHEN unit = 'minute' AND n IN (1, 5, 15) THEN n || 'm' WHEN unit = 'hour' AND n IN (1, 4, 24) THEN n || 'h' WHEN unit = 'day' AND n = 1 THEN '24h' END AS horizon, unit, count(*) AS n FROM x GROUP BY 1, 2""",
    "i3_event_records": f"""WITH {BARS}, news AS (SELECT event_id, epoch_us(ts) // 3600000000 AS c FROM events WHERE event_type IN ('signup', 'error')), e AS (SELECT max(a) AS f, min(z) AS l FROM (SELECT symbol, min(bar) AS a, max(bar) AS z FROM bars WHERE symbol <> 'SOL' GROUP BY 1)),
        n AS (SELECT c, count(*) FILTER (bar <= c) AS p, count(*) FILTER (bar > c) AS u FROM (SELECT DISTINCT c FROM news) JOIN bars ON symbol <> 'SOL' AND bar BETWEEN c - 4 AND c + 4 GROUP BY 1)
        SELECT CASE WHEN c > l THEN 'published_after_candle_coverage' WHEN c < f THEN 'published_before_candle_coverage' WHEN c - 72 < f THEN 'insufficient_history' WHEN coalesce(p, 0) < 10 THEN 'insufficient_pre_news_candles_or_gap' WHEN coalesce(u, 0) < 8 THEN 'insufficient_future_candles_or_gap' END AS reason, count(*) AS n
        FROM news LEFT JOIN n USING (c), e GROUP BY 1""",
    "i12_missing_token": f"WITH {_EV} SELECT coalesce(category, '__missing__') AS category, coalesce(sentiment, '__missing__') AS sentiment, count(*) AS n FROM ev GROUP BY 1, 2",
    "i15_refused": """SELECT unnest(['return_5m', 'eth_reaction', 'max_favorable_1h', 'MFE_day', 'target_up', 'volume_shock_5m', 'abnormal_return_1h', 'post_event_vol', 'future_x']) AS "column" """,
    "i16_variants": f"WITH {_WIDE} SELECT variant, columns, (SELECT count(*) FROM w) AS n FROM (VALUES ('market', 'metadata_event,pre_ret'), ('ai', 'metadata_event,ai_score'), ('both', 'metadata_event,pre_ret,ai_score')) AS v(variant, columns)",
    "j6_audit": " UNION ALL ".join(f"""SELECT '{n}' AS "check", {e} AS violations FROM {_PE}""" for n, e in (
        ("repeated_key", "count(record_id) - count(DISTINCT record_id)"), ("repeated_url", "count(url) - count(DISTINCT url)"), ("invalid_url", "count(*) FILTER (NOT coalesce(regexp_matches(url, '^https?://[^/\\s]+'), false))"), ("no_time", "count(*) FILTER (published_at IS NULL)"),
        ("future_time", "count(*) FILTER (published_at > '2025-06-01')"), ("blank_title", "count(*) FILTER (coalesce(length(trim(title)), 0) = 0)"), ("blank_body", "count(*) FILTER (coalesce(length(trim(body)), 0) = 0)"),
        ("short_body", "count(*) FILTER (length(trim(body)) BETWEEN 1 AND 499)"), ("long_body", "count(*) FILTER (length(trim(body)) > 3000)"))),
    "j6_values": f"WITH {RETURNS} SELECT symbol, horizon, count(*) AS n, count(*) FILTER (ret IS NULL) AS missing, count(*) FILTER (NOT isfinite(ret)) AS not_finite, count(*) FILTER (isfinite(ret) AND abs(ret) > 50) AS extreme FROM hr GROUP BY 1, 2",
    "j12_anchor_bias": f"""WITH {RETURNS}, p AS (SELECT ea.event_id, ea.symbol, horizon, CASE WHEN e.open > 0 AND b.open > 0 THEN (e.open / b.open - 1) * 100 END AS p FROM ea CROSS JOIN hz LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base - 1 LEFT JOIN bars e ON e.symbol = ea.symbol AND e.bar = base - 1 + horizon)
        SELECT symbol, horizon, count(*) AS n, round(avg(ret - p), 5) AS mean_delta, round(avg(abs(ret - p)), 5) AS mean_abs_delta, count(*) FILTER (sign(ret) * sign(p) < 0) AS flips FROM hr JOIN p USING (event_id, symbol, horizon) WHERE ret IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2""",
    "j18_repaired": f"WITH {_LAB} SELECT label, how, count(*) AS n, round(sum(score), 5) AS total FROM rp GROUP BY 1, 2",
    "j18_failures": f"WITH {_LAB} " + " UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) FILTER ({e}) AS violations FROM rp""" for n, e in (
        ("importance_range", "NOT coalesce(importance BETWEEN 0 AND 1, false)"), ("confidence_range", "NOT coalesce(confidence BETWEEN 0 AND 1, false)"), ("positive_score_sign", "label = 'positive' AND NOT coalesce(score > 0, false)"), ("negative_score_sign", "label = 'negative' AND NOT coalesce(score < 0, false)"),
        ("neutral_score_zero", "label = 'neutral' AND NOT coalesce(score = 0, false)"), ("mixed_score_zero", "label = 'mixed' AND NOT coalesce(score = 0, false)"), ("not_applicable_null", "label = 'not_applicable' AND score IS NOT NULL"), ("required_null", "label IS NULL OR importance IS NULL OR confidence IS NULL"))),
    "k8_subgroups": f"WITH {_FR} " + " UNION ALL ".join(f"SELECT '{n}' AS subgroup, count(*) FILTER ({e}) AS n, round(avg(ret) FILTER ({e}), 5) AS mean, round(avg(ret) FILTER (NOT ({e})), 5) AS mean_rest FROM o" for n, e in (
        ("signups", "source = 'signup'"), ("even_actors", "actor % 2 = 0"), ("bitcoin_day", "symbol = 'BTC' AND horizon = 24"), ("nobody", "actor < 0"))),
    "k9_threshold_grid": f"WITH {_FR} SELECT horizon, {_SPLIT_SQL} AS split, threshold, count(*) AS n, round(avg((ret > 0.25)::INT), 5) AS win_rate, round(avg(ret), 5) AS mean FROM o, (SELECT unnest([0, 2, 4, 6, 8])::DOUBLE AS threshold) WHERE actor % 10 >= threshold GROUP BY 1, 2, 3",
    "k10_sample_gates": f"WITH {_FR}, a AS (SELECT actor, count(*) AS n FROM o GROUP BY 1) SELECT CASE WHEN n < 30 THEN 'descriptive' WHEN n < 100 THEN 'exploratory' WHEN n < 300 THEN 'candidate' ELSE 'strong' END AS gate, count(*) AS actors FROM a GROUP BY 1",
    "k11_signals": f"""WITH {_WIDE} SELECT sum({_SIGN.format('r1')})::BIGINT AS momentum, sum({_SIGN.format('r1 - 0.5 * r5')})::BIGINT AS adjusted, sum(CASE WHEN {_SIGN.format('r15')} = {_SIGN.format('r24')} THEN {_SIGN.format('r15')} ELSE 0 END)::BIGINT AS trend,
        sum(CASE WHEN coalesce(abs(r1) / nullif(r5, 0) >= 1, false) THEN {_SIGN.format('r1')} ELSE 0 END)::BIGINT AS breakout, sum(CASE WHEN {_U.format("'signal:' || event_id")} < 0.5 THEN -1 ELSE 1 END)::BIGINT AS random FROM w""",
    "k15_simulation": f"WITH {_WIDE}, s AS (SELECT symbol, r5, r24, least(1.0, 50.0 / greatest(abs(r24), 1.0)) AS z FROM w WHERE r5 IS NOT NULL AND r24 IS NOT NULL AND r24 <> 0), p AS (SELECT symbol, z, sign(r24) * r5 * z - 0.2::DOUBLE * z AS v FROM s) SELECT symbol, count(*) AS trades, round(sum(v), 4) AS total, round(avg((v > 0)::INT), 6) AS win_rate, round(avg(z), 6) AS mean_size FROM p GROUP BY 1",
    "k22_top_lift": "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT count(*) FILTER (k <= ceil(n * 0.1::DOUBLE)) AS n, round(avg(v) FILTER (k <= ceil(n * 0.1::DOUBLE)), 6) AS top_mean, round(avg(v) FILTER (k <= ceil(n * 0.1::DOUBLE)) / avg(v), 6) AS lift FROM r",
    "k25_reliability": f"""WITH {_FR}, f AS (SELECT symbol, horizon, count(*) FILTER (m > 0) AS good, count(*) FILTER (m > 1) AS above FROM (SELECT symbol, horizon, event % 5 AS fold, avg(ret - 0.2::DOUBLE) AS m FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2),
        p AS (SELECT symbol, horizon, count(*) FILTER (k >= 10) AS sources FROM (SELECT symbol, horizon, source, count(*) AS k FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2), a AS (SELECT symbol, horizon, avg((ret - 0.2::DOUBLE > 0)::INT) AS p, avg(ret - 0.3::DOUBLE) AS robust FROM o GROUP BY 1, 2),
        s AS (SELECT symbol, horizon, 20 * good / 5 + 15 * above / 5 + 15 * p + 5 + CASE WHEN robust > 0 THEN 10 ELSE 0 END + 5 * least(sources / 3, 1.0) + 2.5 AS score FROM a JOIN f USING (symbol, horizon) JOIN p USING (symbol, horizon))
        SELECT symbol, horizon, round(score, 5) AS score, CASE WHEN score >= 90 THEN 'very_strong' WHEN score >= 75 THEN 'strong' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'weak' ELSE 'unreliable' END AS word FROM s""",
    "k29_candidates": f"""WITH {_CAND} SELECT symbol, horizon, train_signals, signals, round(accuracy, 5) AS accuracy, round(expectancy, 5) AS expectancy, round(train_expectancy, 5) AS train_expectancy, round(source_share, 5) AS source_share, round(month_share, 5) AS month_share,
        concat_ws('|', CASE WHEN train_signals < 30 THEN 'train_signals_below_30' END, CASE WHEN signals < 20 THEN 'validation_signals_below_20' END, CASE WHEN signals / greatest(total_rows, 1) < 0.2 THEN 'coverage_below_20pct' END, CASE WHEN coalesce(accuracy, 0) <= 0.55 THEN 'accuracy_not_above_55pct' END,
        CASE WHEN coalesce(accuracy, 0) <= 0.5 THEN 'does_not_beat_strongest_baseline' END, CASE WHEN coalesce(expectancy, 0) <= 0 OR coalesce(train_expectancy, 0) <= 0 THEN 'expectancy_not_positive_both_splits' END, CASE WHEN coalesce(source_share, 1) > 0.8 THEN 'single_source_dependence' END,
        CASE WHEN coalesce(month_share, 1) > 0.8 THEN 'single_month_dependence' END) AS reasons FROM cd""",
    "k30_costs": f"""WITH {BARS}, {ASSETS}, r AS (SELECT latency, horizon, CASE WHEN e.open > 0 AND b.open > 0 THEN (e.open / b.open - 1) * 100 END AS ret FROM ea CROSS JOIN (SELECT unnest([0, 1, 3]) AS latency) CROSS JOIN (SELECT unnest([1, 5, 15]) AS horizon) LEFT JOIN bars b ON b.symbol = ea.symbol AND b.bar = base + latency LEFT JOIN bars e ON e.symbol = ea.symbol AND e.bar = base + latency + horizon)
        SELECT latency, horizon, cost, count(*) AS n, round(avg(ret) - cost, 5) AS mean_net, round(avg(ret), 5) AS break_even FROM r, (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS cost) WHERE ret IS NOT NULL GROUP BY 1, 2, 3""",
    "k30_holding": f"WITH {_FR}, a AS (SELECT symbol, horizon, avg(ret) FILTER (published_us < {_TRAIN}) AS a, avg(ret) FILTER (published_us >= {_TRAIN}) AS b FROM o GROUP BY 1, 2) SELECT symbol, horizon, round(a, 5) AS train_mean, round(b, 5) AS test_mean FROM a WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY a DESC, horizon) = 1",
    "k32_locked_test": f"""WITH {_CAND}, sl AS (SELECT symbol, horizon FROM cd WHERE train_expectancy > 0), dg AS (SELECT sha256(string_agg(symbol || ':' || horizon, '|' ORDER BY symbol || ':' || horizon)) AS digest FROM sl),
        e AS (SELECT event, ntile(3) OVER (ORDER BY t, event) AS chunk FROM (SELECT event, min(published_us) AS t FROM o GROUP BY 1)) SELECT symbol, horizon, chunk, count(*) AS n, round(avg(abs(ret)), 5) AS mean_abs, any_value(digest) AS digest FROM o JOIN sl USING (symbol, horizon) JOIN e USING (event), dg GROUP BY 1, 2, 3""",
    "l2_bootstrap_mean": f"""WITH {_FR}, r AS (SELECT symbol, horizon, ret, rep, {_U.format("'7:' || event_id || ':' || rep")} AS u FROM o, (SELECT unnest(generate_series(0, 49)) AS rep)), m AS (SELECT symbol, horizon, rep, sum(ret * w) / nullif(sum(w), 0) AS m FROM (SELECT *, {_POISSON} AS w FROM r) GROUP BY 1, 2, 3),
        q AS (SELECT symbol, horizon, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1, 2) SELECT symbol, horizon, count(*) AS n, round(avg(ret), 5) AS mean, round(any_value(lo), 5) AS low, round(any_value(hi), 5) AS high FROM o JOIN q USING (symbol, horizon) GROUP BY 1, 2""",
    "l9_group_comparison": f"""WITH {_FR}, r AS (SELECT ret AS v, source = 'signup' AS g, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2 AS k FROM o), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM o GROUP BY ret)),
        a AS (SELECT count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, avg(v) FILTER (g) AS m1, avg(v) FILTER (NOT g) AS m2, var_samp(v) FILTER (g) AS v1, var_samp(v) FILTER (NOT g) AS v2, sum(k) FILTER (g) AS s FROM r),
        b AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM a, t), c AS (SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) / sqrt(2.0::DOUBLE) AS x FROM b), d AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM c)
        SELECT n1, n2, round(m1, 5) AS mean1, round(m2, 5) AS mean2, round(m1 - m2, 5) AS difference, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n - 2)), 5) AS effect, u, round({_ERF}, 6) AS p FROM d""",
    "l12_error_difference": f"""WITH {_WIDE}, e AS (SELECT symbol, event_id || symbol AS id, r1 - r5 AS a, r15 - r5 AS b FROM w WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND r15 IS NOT NULL), r AS (SELECT symbol, rep, a, b, {_U.format("'7:' || id || ':' || rep")} AS u FROM e, (SELECT unnest(generate_series(-1, 49)) AS rep)),
        m AS (SELECT symbol, rep, sum(abs(a) * w) / nullif(sum(w), 0) - sum(abs(b) * w) / nullif(sum(w), 0) AS mae, sqrt(sum(a * a * w) / nullif(sum(w), 0)) - sqrt(sum(b * b * w) / nullif(sum(w), 0)) AS rmse FROM (SELECT *, CASE WHEN rep < 0 THEN 1 ELSE {_POISSON} END AS w FROM r) GROUP BY 1, 2),
        l AS (SELECT symbol, rep, 'mae' AS metric, mae AS v FROM m UNION ALL SELECT symbol, rep, 'rmse', rmse FROM m) SELECT symbol, metric, round(max(v) FILTER (rep < 0), 4) AS estimate, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 4) AS low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 4) AS high, round(avg((v > 0)::INT) FILTER (rep >= 0), 6) AS better FROM l GROUP BY 1, 2""",
    "l13_horizon_metrics": f"WITH {RETURNS} SELECT symbol, horizon, count(*) AS n, round(avg(ret), 5) AS mean, round(avg(abs(ret)), 5) AS mean_size, round(avg((ret > 0)::INT), 5) AS positive_rate, round(avg((ret < 0)::INT), 5) AS negative_rate, round(avg((abs(ret) >= 0.5)::INT), 5) AS strong_0_5, round(avg((abs(ret) >= 10)::INT), 5) AS strong_10_0 FROM hr WHERE ret IS NOT NULL GROUP BY 1, 2",
    "l14_winsorised": f"WITH {_EV}, q AS (SELECT quantile_cont(importance::DOUBLE, 0.005) AS a, quantile_cont(importance::DOUBLE, 0.995) AS b, quantile_cont(importance::DOUBLE, 0.5) AS m FROM ev), w AS (SELECT importance IS NULL AS x, greatest(least(coalesce(importance, m), b), a) AS v FROM ev, q) SELECT count(*) AS n, count(*) FILTER (x) AS missing, round(avg(v), 5) AS mean, round(min(v), 5) AS least, round(max(v), 5) AS most FROM w",
    "l14_linear": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem",
    "m4_topic_scan": f"WITH {_EV} SELECT event_id, title FROM ev WHERE {_WORD.format('title', 'treasury|custody')} ORDER BY published_at DESC NULLS LAST, event_id LIMIT 25",
    "m9_search_count": f"""WITH {_EV}, t AS (SELECT event_id, published_at, {_TERMS.format('title')} AS t, {_TERMS.format("concat_ws(' ', source, category)")} AS o FROM ev), h AS (SELECT event_id, published_at, round((CASE WHEN list_contains(t, 'upgrade') THEN 1.0 WHEN list_contains(o, 'upgrade') THEN 0.4 ELSE 0 END + CASE WHEN list_contains(t, 'fork') THEN 1.0 WHEN list_contains(o, 'fork') THEN 0.4 ELSE 0 END)::DOUBLE, 6) AS rank
        FROM t WHERE list_contains(list_concat(t, o), 'upgrade') OR list_contains(list_concat(t, o), 'fork')) SELECT event_id, rank, (SELECT count(*) FROM h) AS total FROM h ORDER BY rank DESC, published_at DESC NULLS LAST, event_id LIMIT 20""",
    "d10_bounds": f"""WITH {_DAY}, b AS (SELECT event_id, symbol, bounds, max(h) AS mfe, min(l) AS mae FROM pth, (VALUES ('[)'), ('[]'), ('(]')) AS v(bounds) WHERE h IS NOT NULL AND l IS NOT NULL AND CASE bounds WHEN '[)' THEN q < 24 WHEN '(]' THEN q > 0 ELSE true END GROUP BY 1, 2, 3)
        SELECT symbol, bounds, count(*) AS n, round(avg(mfe), 4) AS mfe, round(avg(mae), 4) AS mae FROM b GROUP BY 1, 2""",
    "e15_futures_flags": f"""WITH {BARS}, x AS (SELECT symbol, (close - open) / 10000 AS f, high / nullif(open, 0) AS r, coalesce(close - open > 0, false) AS up, coalesce(volume - 10 > 0, false) AS more FROM bars)
        SELECT symbol, count(*) FILTER (f > 0.0005::DOUBLE) AS funding_high, count(*) FILTER (f < -0.0005::DOUBLE) AS funding_low, count(*) FILTER (f > 0.0005::DOUBLE AND r > 1.2::DOUBLE) AS crowded_long, count(*) FILTER (f < -0.0005::DOUBLE AND r < 0.8::DOUBLE) AS crowded_short,
        count(*) FILTER (f < -0.0005::DOUBLE AND r < 0.8::DOUBLE AND up AND more) AS short_squeeze, count(*) FILTER (f > 0.0005::DOUBLE AND r > 1.2::DOUBLE AND NOT up AND more) AS long_squeeze FROM x GROUP BY 1""",
    "k4_seven_reasons": f"""WITH {_FR}, x AS (SELECT *, (actor % 10)::DOUBLE AS x FROM o), t AS (SELECT 'a' AS rule_id, 1 AS k, ret, source, published_us FROM x WHERE x >= 2 UNION ALL SELECT 'b', 1, ret, source, published_us FROM x WHERE x >= 5 UNION ALL SELECT 'd', 1, ret, source, published_us FROM x WHERE ret > 0
        UNION ALL SELECT 'e', 2, ret, source, published_us FROM x WHERE ret > 0 AND source = 'signup' UNION ALL SELECT 'f', 5, ret, source, published_us FROM x WHERE ret > 0),
        m AS (SELECT rule_id, k, count(*) AS n, avg((ret > 0)::INT) AS w, avg(ret - 0.2::DOUBLE) AS e, sum(ret - 0.2::DOUBLE) FILTER (ret - 0.2::DOUBLE > 0) / -sum(ret - 0.2::DOUBLE) FILTER (ret - 0.2::DOUBLE < 0) AS pf, count(DISTINCT source) AS s, count(DISTINCT published_us // 604800000000) AS c FROM t GROUP BY 1, 2)
        SELECT rule_id, n, CASE WHEN k > 4 THEN 'complexity_gt_4' WHEN n < 30 THEN 'low_sample' WHEN w < 0.55 THEN 'win_rate_below_55pct' WHEN e <= 0 THEN 'nonpositive_net_expectancy' WHEN pf <= 1 THEN 'profit_factor_le_1' WHEN s < 2 THEN 'single_source' WHEN c < 2 THEN 'single_month' END AS reason FROM m""",
    "k21_risk_sizes": f"""WITH {_WIDE}, x AS (SELECT event_id, r5, abs(r1) AS v FROM w WHERE r5 IS NOT NULL), b AS (SELECT quantile_cont(v, 0.1) AS f, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.9) AS c FROM x WHERE event_id % 2 = 0), y AS (SELECT r5, v, m, c, greatest(v, f, 1e-6::DOUBLE) AS r FROM x, b),
        z AS (SELECT r5, 'fixed' AS sizing, 1.0::DOUBLE AS z FROM y UNION ALL SELECT r5, 'inverse', CASE WHEN v IS NULL THEN 0 ELSE least(1.0, greatest(0.25, m / r)) END FROM y UNION ALL SELECT r5, 'capped', CASE WHEN v IS NULL THEN 0 ELSE least(1.0, greatest(0.5, m / least(r, c))) END FROM y
        UNION ALL SELECT r5, 'skip', CASE WHEN v < c THEN 1.0 ELSE 0.0 END FROM y UNION ALL SELECT r5, 'reduce', CASE WHEN v IS NULL THEN 0 WHEN v < c THEN 1.0 ELSE 0.5 END FROM y) SELECT sizing, count(*) AS n, round(avg(z), 6) AS mean_size, round(avg(z * r5), 5) AS mean_sized FROM z GROUP BY 1""",
    "k23_guesses": f"""WITH {_WIDE}, x AS (SELECT symbol, sign(r5) AS a, sign(r1) AS t, -sign(r15) AS o, CASE WHEN {_U.format("'coin:' || event_id || symbol")} < 0.5 THEN -1 ELSE 1 END AS c FROM w WHERE r5 IS NOT NULL AND r5 <> 0)
        SELECT symbol, count(*) AS n, round(avg((a = 1)::INT), 6) AS always_up, round(avg((a = -1)::INT), 6) AS always_down, round(avg(coalesce(a = t, false)::INT), 6) AS trend, round(avg(coalesce(a = o, false)::INT), 6) AS opposite, round(avg((a = c)::INT), 6) AS random FROM x GROUP BY 1""",
    "b3_named_codes": "SELECT coalesce(symbol <> 'BTCUSDT', false) AS symbol, coalesce(trade_count % 7 = 0, false) AS interval, count(*) AS n FROM archive_candles GROUP BY 1, 2",
    "e10_ranges": f"""WITH {BARS}, {ASSETS}, w AS (SELECT event_id, ea.symbol, g.bar - base AS q, g.* EXCLUDE (symbol, bar) FROM ea JOIN bars g ON g.symbol = ea.symbol AND g.bar BETWEEN base - 24 AND base),
        a AS (SELECT event_id, symbol, max(high) FILTER (q < 0) AS hi, min(low) FILTER (q < 0) AS lo, max(open) FILTER (q = 0) AS n, max(open) FILTER (q = -24) AS o FROM w GROUP BY 1, 2)
        SELECT event_id, symbol, round(CASE WHEN n > 0 THEN (hi - lo) / n END, 6) AS range_share, round(CASE WHEN n > 0 AND o > 0 THEN ln(n / o) END, 6) AS log_return FROM a""",
    "e11_volatility": f"WITH {_WIDE}, m AS (SELECT median(abs(r1)) AS m FROM w WHERE event_id % 2 = 0) SELECT symbol, CASE WHEN abs(r1) > m THEN 'high' WHEN r1 IS NOT NULL THEN 'low' END AS regime, count(*) AS n, round(avg(r5), 5) AS mean FROM w, m GROUP BY 1, 2",
    "l4_cluster_labels": f"""WITH {_FR}, s AS (SELECT actor AS b, sum(ret) AS s, count(*) AS c, max((actor % 3 = 0)::INT) AS g FROM o GROUP BY 1), r AS (SELECT s.*, rep, {_U.format("b || ':' || rep")} AS u FROM s, (SELECT unnest(generate_series(0, 100)) AS rep)),
        x AS (SELECT *, CASE WHEN rep = 0 THEN g = 1 ELSE row_number() OVER (PARTITION BY rep ORDER BY u, b) <= sum(g) OVER (PARTITION BY rep) END AS x FROM r), d AS (SELECT rep, sum(s) FILTER (x) / sum(c) FILTER (x) - sum(s) FILTER (NOT x) / sum(c) FILTER (NOT x) AS d FROM x GROUP BY 1)
        SELECT round(o.d, 5) AS difference, round((count(*) FILTER (abs(d.d) >= abs(o.d)) + 1) / 101, 5) AS p FROM d, (SELECT d FROM d WHERE rep = 0) AS o WHERE rep > 0 GROUP BY o.d""",
}
