"""Verdicts on stored results: final quality, event records, audits, anchors, repairs, gates and reliability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import global_rank, quantiles
from tidemark.operators.stats import hashed_uniform
from tidemark.plans.cut import small


def selected_candle_ok() -> Column:
    """Whether a parsed candle chosen for a reaction may be used: prices above 0 and numbers, extremes around open and close, and a length of one
    minute less at most a millisecond, the close taken down to whole milliseconds. NULL fields are not usable.
    """
    price = reduce(lambda a, b: a & b, [(F.col(c) > 0) & ~F.isnan(F.col(c)) for c in ("open", "high", "low", "close")])
    length = F.floor(F.col("close_us") / 1000) - F.floor(F.col("open_us") / 1000)
    return F.coalesce(price & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (length >= 59_999) & (length < 60_000), F.lit(False))


def month_of(bar: Column, bar_s: int) -> Column:
    """Months since year 0 of the month in which a bar starts."""
    t = F.timestamp_seconds(bar * bar_s)
    return F.year(t) * 12 + F.month(t) - 1


def final_quality(returns: DataFrame, months: DataFrame, invalid: DataFrame, bar_s: int) -> DataFrame:
    """(event_id, symbol, quality, reasons): why results are missing and what that makes of a reaction.

    returns: event_id, symbol, base, horizon, base_open, ret; months: symbol, month (as ``month_of``) of the archives there are; invalid: symbol,
    bar of unusable bars. A missing result is blamed on its base bar if that has no price, else on its end bar. The reason is the first that
    holds: before the archives begin (base only), after they end, an unusable bar, a month without archive, a missing bar. ``reasons`` is JSON by
    horizon in the order of text, NULL if nothing is missing. A symbol without archives has nothing but missing archives.
    Fixed values: the names of reasons and qualities.
    """
    bounds = months.groupBy("symbol").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    faulty = F.col("base_open").isNull() | (F.col("base_open") <= 0)
    r = returns.withColumn("no_base", faulty).withColumn("bar", F.when(faulty, F.col("base")).otherwise(F.col("base") + F.col("horizon"))).withColumn("month", month_of(F.col("bar"), bar_s))
    bad = invalid.select("symbol", "bar").distinct().withColumn("bad", F.lit(True))
    r = r.join(small(bounds), "symbol", "left").join(small(months.select("symbol", "month").distinct().withColumn("kept", F.lit(True))), ["symbol", "month"], "left").join(small(bad), ["symbol", "bar"], "left")
    reason = (
        F.when(F.col("no_base") & (F.col("month") < F.col("first")), "asset_not_listed").when(F.col("month") > F.col("last"), "event_after_market_cutoff").when(F.col("bad"), "invalid_candle")
        .when(F.col("kept").isNull(), "market_archive_missing").otherwise("endpoint_missing")
    )
    r = r.withColumn("reason", F.when(F.col("ret").isNull(), reason))
    entry = F.when(F.col("reason").isNotNull(), F.struct(F.col("horizon").cast("string").alias("h"), F.col("reason").alias("r")))
    a = r.groupBy("event_id", "symbol").agg(F.count("*").alias("n"), F.count("reason").alias("lost"), F.coalesce(F.bool_or(F.col("reason") == "invalid_candle"), F.lit(False)).alias("broken"), F.array_sort(F.collect_list(entry)).alias("e"))
    quality = F.when(F.col("lost") == 0, "raw_verified_v2").when(F.col("broken"), "excluded_invalid_candle").when(F.col("lost") == F.col("n"), "missing_market_data").otherwise("partial_raw_verified_v2")
    text = F.when(F.col("lost") > 0, F.to_json(F.map_from_entries("e")))
    return a.select("event_id", "symbol", quality.alias("quality"), text.alias("reasons"))


def six_path_classes(mfe: Column, mae: Column, mfe_at: Column, end: Column, hour: float = 60.0) -> Column:
    """What became of a signed path, by six ordered rules on its best and worst excursion in percent, the time of the best and the return at the
    end; ``hour`` is an hour in the units of ``mfe_at``. NULL excursions have no class. Fixed values: limits and names.
    """
    lost = F.when(mfe > 0, (mfe - end) / mfe)
    kept = F.coalesce(F.when(mfe > 0, end / mfe), F.lit(0.0))
    return (
        F.when(mfe.isNull() | mae.isNull(), None).when((mfe >= 0.5) & (lost > 0.6), "spike_then_reversal").when((mfe >= 0.5) & (mfe_at <= hour) & (kept >= 0.4), "immediate_and_persistent")
        .when((mfe >= 0.5) & (mfe_at > hour) & (kept >= 0.4), "delayed_and_persistent").when((mfe_at > 4 * hour) & (mfe >= 0.25), "gradual_move")
        .when((mfe < 0.1) & (mae <= -0.25), "moved_against_signal").otherwise("no_clear_reaction")
    )


def event_records(events: DataFrame, grid: DataFrame, symbols: list[str], history: int, before: int, after: int) -> DataFrame:
    """(event_id, cutoff, reason): one row for each event (event_id, cutoff bar), with why it has no record, NULL if it has one.

    grid: symbol, bar. Reasons, the first that holds over all of ``symbols``: published_after_candle_coverage, published_before_candle_coverage,
    insufficient_history (no bar ``history`` bars before), insufficient_pre_news_candles_or_gap (a bar from ``before`` bars before to the cutoff
    is missing), insufficient_future_candles_or_gap (one from the next bar to ``after`` bars later). Presence is counted by blocks of bars, so
    it is an equi-join with a filter. Fixed values: the names of reasons.
    """
    g = grid.where(F.col("symbol").isin(symbols)).select("symbol", "bar").distinct()
    ends = g.groupBy("symbol").agg(F.min("bar").alias("a"), F.max("bar").alias("z")).agg(F.max("a").alias("first"), F.min("z").alias("last"), F.count("*").alias("series"))
    bases = events.select("cutoff").distinct()
    block = max(before, after, 1) + 1
    asked = bases.withColumn("blk", F.explode(F.sequence(F.floor((F.col("cutoff") - before) / block), F.floor((F.col("cutoff") + 1 + after) / block))))
    met = asked.join(g.withColumn("blk", F.floor(F.col("bar") / block)), "blk").where(F.col("bar").between(F.col("cutoff") - before, F.col("cutoff") + 1 + after))
    n = met.groupBy("cutoff").agg(F.count_if(F.col("bar") <= F.col("cutoff")).alias("past"), F.count_if(F.col("bar") > F.col("cutoff")).alias("future"))
    k = len(symbols)
    reason = (
        F.when((F.col("series") < k) | (F.col("cutoff") > F.col("last")), "published_after_candle_coverage").when(F.col("cutoff") < F.col("first"), "published_before_candle_coverage")
        .when(F.col("cutoff") - history < F.col("first"), "insufficient_history").when(F.coalesce("past", F.lit(0)) < k * (before + 1), "insufficient_pre_news_candles_or_gap")
        .when(F.coalesce("future", F.lit(0)) < k * (after + 1), "insufficient_future_candles_or_gap")
    )
    known = bases.join(n, "cutoff", "left").crossJoin(F.broadcast(ends)).select("cutoff", reason.alias("reason"))  # ends is one row
    return events.select("event_id", "cutoff").join(known, "cutoff").select("event_id", "cutoff", "reason")


def audit(articles: DataFrame, now: Column, short: int, long: int) -> DataFrame:
    """Counters of an article table in one pass, in long form: (check, violations).

    articles: record_id, url, title, body, published_at; extra columns are ignored. Repeated keys and urls are rows beyond the first of each.
    """
    length = F.length(F.trim("body"))
    a = articles.agg(
        (F.count("record_id") - F.count_distinct("record_id")).alias("repeated_key"), (F.count("url") - F.count_distinct("url")).alias("repeated_url"),
        F.count_if(~F.coalesce(F.col("url").rlike(r"^https?://[^/\s]+"), F.lit(False))).alias("invalid_url"), F.count_if(F.col("published_at").isNull()).alias("no_time"),
        F.count_if(F.col("published_at") > now).alias("future_time"), F.count_if(F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0).alias("blank_title"),
        F.count_if(F.coalesce(length, F.lit(0)) == 0).alias("blank_body"), F.count_if(length.between(1, short - 1)).alias("short_body"), F.count_if(length > long).alias("long_body"),
    )
    return a.unpivot([], a.columns, "check", "violations")


def value_audit(rows: DataFrame, groups: list[str], value: str, extreme: float) -> DataFrame:
    """(groups, n, missing, not_finite, extreme): values that are missing, no finite numbers, or beyond ``extreme`` in size."""
    v = F.col(value)
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(v.isNotNull() & ~finite).alias("not_finite"), F.count_if(finite & (F.abs(v) > extreme)).alias("extreme"))


def anchor_bias(article: DataFrame, primary: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """(by..., n, mean_delta, mean_abs_delta, flips): how results change if they count from the primary announcement instead of the article."""
    j = article.select(*key, F.col(value).alias("_a")).join(primary.select(*key, F.col(value).alias("_p")), key).where("_a IS NOT NULL AND _p IS NOT NULL")
    d = F.col("_a") - F.col("_p")
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.count_if(F.signum("_a") * F.signum("_p") < 0).alias("flips"))


def repaired_score(label: Column, score: Column) -> tuple[Column, Column]:
    """A score whose sign follows its label, and how it was changed: positive and negative labels keep the size, neutral and mixed are 0, not
    applicable is NULL, any other label leaves the score."""
    wrong = ((label == "negative") & (score >= 0)) | ((label == "positive") & (score <= 0))
    fixed = (
        F.when(label == "not_applicable", None).when(label.isin("neutral", "mixed"), F.lit(0.0)).when((label == "negative") & (score >= 0), -F.abs(score))
        .when((label == "positive") & (score <= 0), F.abs(score)).otherwise(score)
    )
    return fixed, F.when(wrong, "sign_from_label").when(label == "mixed", "mixed_to_zero").otherwise("none")


def score_failures(rows: DataFrame, label: str, score: str, importance: str, confidence: str) -> DataFrame:
    """(check, violations) of labelled scores: ranges, signs, zeros, NULLs and required fields."""
    la, s = F.col(label), F.col(score)
    checks = {
        "importance_range": ~F.coalesce(F.col(importance).between(0, 1), F.lit(False)), "confidence_range": ~F.coalesce(F.col(confidence).between(0, 1), F.lit(False)),
        "positive_score_sign": (la == "positive") & ~F.coalesce(s > 0, F.lit(False)), "negative_score_sign": (la == "negative") & ~F.coalesce(s < 0, F.lit(False)),
        "neutral_score_zero": (la == "neutral") & ~F.coalesce(s == 0, F.lit(False)), "mixed_score_zero": (la == "mixed") & ~F.coalesce(s == 0, F.lit(False)),
        "not_applicable_null": (la == "not_applicable") & s.isNotNull(), "required_null": la.isNull() | F.col(importance).isNull() | F.col(confidence).isNull(),
    }
    a = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return a.unpivot([], list(checks), "check", "violations")


def signal_metrics(rows: DataFrame, group: list[str], split: Column, value: str, source: str, month: Column, direction: int) -> DataFrame:
    """Per group: signals, accuracy and gross expectancy of always taking one direction (1 long, -1 short) in training and validation, and the
    largest share of one source and one month in validation."""
    r = rows.where(F.col(value).isNotNull()).select(*group, split.alias("_s"), (F.lit(direction) * F.col(value)).alias("_g"), F.col(source).alias("_src"), month.alias("_m")).where("_s IN ('train', 'validation')")
    train, val = F.col("_s") == "train", F.col("_s") == "validation"
    a = r.groupBy(*group).agg(
        F.count_if(train).alias("train_signals"), F.count_if(val).alias("signals"), F.avg(F.when(val, (F.col("_g") > 0).cast("double"))).alias("accuracy"),
        F.avg(F.when(val, F.col("_g"))).alias("expectancy"), F.avg(F.when(train, F.col("_g"))).alias("train_expectancy"), F.count("*").alias("total_rows"),
    )
    for name, c in (("source_share", "_src"), ("month_share", "_m")):
        per = r.where(val).groupBy(*group, c).agg(F.count("*").alias("k")).groupBy(*group).agg((F.max("k") / F.sum("k")).alias(name))
        a = a.join(per, group, "left")
    return a


def candidate_gate(baseline: Column) -> Column:
    """The reasons, joined by '|', for which a candidate of ``signal_metrics`` is not shortlisted; empty if there are none. Fixed limits."""
    tests = [
        ("train_signals_below_30", F.col("train_signals") < 30), ("validation_signals_below_20", F.col("signals") < 20), ("coverage_below_20pct", F.col("signals") / F.greatest("total_rows", F.lit(1)) < 0.2),
        ("accuracy_not_above_55pct", F.coalesce("accuracy", F.lit(0.0)) <= 0.55), ("does_not_beat_strongest_baseline", F.coalesce("accuracy", F.lit(0.0)) <= F.coalesce(baseline, F.lit(0.0))),
        ("expectancy_not_positive_both_splits", (F.coalesce("expectancy", F.lit(0.0)) <= 0) | (F.coalesce("train_expectancy", F.lit(0.0)) <= 0)),
        ("single_source_dependence", F.coalesce("source_share", F.lit(1.0)) > 0.8), ("single_month_dependence", F.coalesce("month_share", F.lit(1.0)) > 0.8),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests])), "|")


def cost_sensitivity(rows: DataFrame, groups: list[str], value: str, costs: list[float]) -> DataFrame:
    """(groups, cost, n, mean_net, break_even): mean result after each cost, and the cost at which the mean is nothing; costs are exploded, not joined."""
    r = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(value).alias("break_even"))
    return r.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).select(*groups, "cost", "n", (F.col("break_even") - F.col("cost")).alias("mean_net"), "break_even")


def best_holding(rows: DataFrame, groups: list[str], horizon: str, value: str, train: Column) -> DataFrame:
    """(groups, horizon, train_mean, test_mean): the horizon with the best mean in training, the shorter on a tie, and its mean on the rest."""
    a = rows.where(F.col(value).isNotNull()).groupBy(*groups, horizon).agg(F.avg(F.when(train, F.col(value))).alias("train_mean"), F.avg(F.when(~train, F.col(value))).alias("test_mean"))
    best = F.max(F.struct(F.col("train_mean").alias("m"), (-F.col(horizon)).alias("h"), F.col("test_mean").alias("t")))
    return a.where("train_mean IS NOT NULL").groupBy(*groups).agg(best.alias("b")).select(*groups, (-F.col("b.h")).alias(horizon), F.col("b.m").alias("train_mean"), F.col("b.t").alias("test_mean"))


def locked_test(rows: DataFrame, shortlist: DataFrame, key: list[str], t: str, event: str, value: str, chunks: int = 3) -> DataFrame:
    """(key, chunk, n, mean_abs, digest): a frozen shortlist evaluated once over ``chunks`` equal parts of the events in time.

    ``digest`` is the SHA-256 of the shortlist's sorted keys, so a changed list is seen. The shortlist is bounded by what people review.
    """
    first = rows.groupBy(event).agg(F.min(t).alias("_t"))
    n = first.count()
    ranked = global_rank(first, F.floor(F.col("_t") / 86_400_000_000), [F.col("_t"), F.col(event)], "_k")
    # As numpy's array_split: the first n mod chunks parts are longer by one.
    long = n % chunks
    size = n // chunks
    k = F.col("_k") - 1
    chunk = F.when(k < long * (size + 1), F.floor(k / (size + 1))).otherwise(long + F.floor((k - long * (size + 1)) / max(size, 1))) + 1
    names = F.sort_array(F.collect_set(F.concat_ws(":", *[F.col(c).cast("string") for c in key])))
    digest = F.sha2(F.array_join(names, "|"), 256)
    listed = shortlist.select(*key).distinct()
    out = rows.where(F.col(value).isNotNull()).join(small(listed), key, "left_semi").join(ranked.select(event, chunk.alias("chunk")), event)
    a = out.groupBy(*key, "chunk").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(value))).alias("mean_abs"))
    return a.crossJoin(F.broadcast(listed.agg(digest.alias("digest"))))  # one row


def reliability(c: dict[str, Column]) -> tuple[Column, Column]:
    """Score from 0 to 100 and its word. c: profitable_folds and folds_above_baseline of 5, positive_probability, year_share, regime_share and
    direction_share as shares, robust (whether it bears the cost), sources with enough signals, top_two_share of the profit. Fixed weights.
    """
    score = (
        20 * c["profitable_folds"] / 5 + 15 * c["folds_above_baseline"] / 5 + 15 * c["positive_probability"] + 10 * c["year_share"] + 10 * c["regime_share"]
        + 10 * F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), c["direction_share"] - 0.5) / 0.5) + F.when(c["robust"], 10.0).otherwise(0.0) + 5 * F.least(c["sources"] / 3, F.lit(1.0))
        + F.when(c["top_two_share"] <= 0.35, 5.0).otherwise(F.greatest(F.lit(0.0), 5 * (1 - c["top_two_share"])))
    )
    return score, F.when(score >= 90, "very_strong").when(score >= 75, "strong").when(score >= 60, "moderate").when(score >= 40, "weak").otherwise("unreliable")


def horizon_metrics(rows: DataFrame, groups: list[str], value: str, strong: list[float]) -> DataFrame:
    """Mean, mean size, rates of rises and falls and of strong moves of the results of each group."""
    v = F.col(value)
    a = rows.where(v.isNotNull()).groupBy(*groups)
    rate = lambda c: F.avg(c.cast("double"))
    return a.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("mean_size"), rate(v > 0).alias("positive_rate"), rate(v < 0).alias("negative_rate"), *[rate(F.abs(v) >= x).alias(f"strong_{str(x).replace('.', '_')}") for x in strong])


def threshold_grid(rows: DataFrame, feature: str, thresholds: list[float], by: list[str], value: str, band: float) -> DataFrame:
    """(by..., threshold, n, win_rate, mean): results of the rows at or above each threshold, of which those beyond ``band`` count as won.

    A row is exploded only to the thresholds that it meets, and added up map-side.
    """
    met = F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: F.col(feature) >= x)
    r = rows.where(F.col(value).isNotNull()).withColumn("threshold", F.explode(met))
    return r.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.avg((F.col(value) > band).cast("double")).alias("win_rate"), F.avg(value).alias("mean"))


def subgroups(rows: DataFrame, predicates: dict[str, Column], value: str) -> DataFrame:
    """(subgroup, n, mean, mean_rest): every named predicate against the rest of the rows, in one pass; a row may be in several."""
    sums = rows.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("_n"), F.sum(value).alias("_s"), *[F.count_if(c).alias(f"{n}|n") for n, c in predicates.items()], *[F.sum(F.when(c, F.col(value))).alias(f"{n}|s") for n, c in predicates.items()])
    long = F.array(*[F.struct(F.lit(n).alias("subgroup"), F.col(f"`{n}|n`").alias("n"), F.col(f"`{n}|s`").alias("s")) for n in predicates])
    x = sums.select("_n", "_s", F.explode(long).alias("g"))
    return x.select("g.subgroup", "g.n", F.try_divide(F.col("g.s"), F.col("g.n")).alias("mean"), F.try_divide(F.col("_s") - F.coalesce("g.s", F.lit(0.0)), F.col("_n") - F.col("g.n")).alias("mean_rest"))


def momentum_signals(own: Column, bench: Column, beta: Column, distance: Column, slope: Column, volatility: Column, ident: Column) -> dict[str, Column]:
    """Signals -1, 0, 1: momentum, momentum beyond the benchmark's, trend (distance and slope agree), breakout (a step as large as the volatility)
    and a random one that follows from the id. NULL inputs give 0.
    """
    sign = lambda x: F.coalesce(F.signum(x), F.lit(0.0)).cast("int")
    return {
        "momentum": sign(own), "adjusted": sign(own - beta * bench), "trend": F.when(sign(distance) == sign(slope), sign(distance)).otherwise(0),
        "breakout": F.when(F.coalesce(F.try_divide(F.abs(own), volatility) >= 1, F.lit(False)), sign(own)).otherwise(0), "random": F.when(hashed_uniform(F.lit("signal"), ident) < 0.5, -1).otherwise(1),
    }


def winsorised(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Add ``<value>_w``, the value drawn in to its quantiles ``low`` and ``high``, a missing one replaced by the median, and ``<value>_missing``."""
    q = quantiles(rows, [], value, [low, high, 0.5], "_q")
    v = F.greatest(F.least(F.coalesce(F.col(value), F.col("_q")[2]), F.col("_q")[1]), F.col("_q")[0])
    return rows.crossJoin(F.broadcast(q)).withColumns({f"{value}_w": v, f"{value}_missing": F.col(value).isNull().cast("int")}).drop("_q")  # one row


def seven_reasons(least: int = 30) -> Column:
    """The first of seven reasons to turn a rule away, from its complexity, n, win_rate, mean_net, profit_factor (NULL without losses), source_count
    and month_count; NULL if it is kept. Fixed values: limits and names.
    """
    return (
        F.when(F.col("complexity") > 4, "complexity_gt_4").when(F.col("n") < least, "low_sample").when(F.col("win_rate") < 0.55, "win_rate_below_55pct").when(F.col("mean_net") <= 0, "nonpositive_net_expectancy")
        .when(F.coalesce("profit_factor", F.lit(float("inf"))) <= 1, "profit_factor_le_1").when(F.col("source_count") < 2, "single_source").when(F.col("month_count") < 2, "single_month")
    )


def futures_flags(funding: Column, ratio: Column, price_step: Column, interest_step: Column) -> dict[str, Column]:
    """Flags 0 or 1 of extreme funding, crowded sides, and squeezes; what is unknown sets no flag. The limits."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    high, low = funding > 0.0005, funding < -0.0005
    up, more = F.coalesce(price_step > 0, F.lit(False)), F.coalesce(interest_step > 0, F.lit(False))
    long, short = high & (ratio > 1.2), low & (ratio < 0.8)
    return {
        "funding_high": flag(high), "funding_low": flag(low), "crowded_long": flag(long), "crowded_short": flag(short), "short_squeeze": flag(short & up & more), "long_squeeze": flag(long & ~up & more),
    }


def risk_sizes(rows: DataFrame, risk: str, train: Column) -> dict[str, Column]:
    """Position sizes by a predicted risk, with the bounds fitted on training rows (10th, 50th and 90th percentile, three numbers): fixed, inverse,
    inverse with the risk capped, and without or with half of the riskiest decile. A NULL risk has the fixed size only, else 0.
    """
    found = quantiles(rows.where(train), [], risk, [0.1, 0.5, 0.9]).first()
    floor, middle, cap = found["q"] if found else (0.0, 0.0, 0.0)
    r, v = F.greatest(F.col(risk), F.lit(max(floor, 1e-6))), F.col(risk)
    zero = lambda c: F.when(v.isNotNull(), c).otherwise(0.0)
    return {
        "fixed": F.lit(1.0), "inverse": zero(F.least(F.lit(1.0), F.greatest(F.lit(0.25), middle / r))), "capped": zero(F.least(F.lit(1.0), F.greatest(F.lit(0.5), middle / F.least(r, F.lit(cap))))),
        "skip": zero(F.when(v < cap, 1.0).otherwise(0.0)), "reduce": zero(F.when(v < cap, 1.0).otherwise(0.5)),
    }


def guess_baselines(rows: DataFrame, groups: list[str], actual: str, trend: str, signal: str, ident: str) -> DataFrame:
    """(groups, n, always_up, always_down, trend, opposite, random): how often simple guesses have the sign of a result that isn't 0: the sign of a
    trend, the opposite of a signal, and a coin that follows from the id. NULL guesses are wrong."""
    a = F.signum(actual)
    hit = lambda c: F.avg(F.coalesce(c == a, F.lit(False)).cast("double"))
    coin = F.when(hashed_uniform(F.lit("coin"), F.col(ident)) < 0.5, -1.0).otherwise(1.0)
    return rows.where(F.col(actual).isNotNull() & (F.col(actual) != 0)).groupBy(*groups).agg(
        F.count("*").alias("n"), hit(F.lit(1.0)).alias("always_up"), hit(F.lit(-1.0)).alias("always_down"), hit(F.signum(trend)).alias("trend"), hit(-F.signum(signal)).alias("opposite"), hit(coin).alias("random"))


def bounded_excursions(path: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, bounds, mfe, mae): best and worst excursion within ``bars`` bars by whether the ends belong to the window: '[)', '[]' and
    '(]', the base being the left one. A window without bars gives no row."""
    o = F.col("offset")
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("[)", (o >= 0) & (o < bars)), ("[]", (o >= 0) & (o <= bars)), ("(]", (o > 0) & (o <= bars)))]))
    p = path.where(F.col("high_ret").isNotNull() & F.col("low_ret").isNotNull())
    return p.withColumn("bounds", F.explode(inside)).groupBy("event_id", "symbol", "bounds").agg(F.max("high_ret").alias("mfe"), F.min("low_ret").alias("mae"))
