"""Rules and signals: predicates as data, searches over rule tables, and what a sequence of results adds up to."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import global_rank, quantiles, running
from tidemark.operators.stats import wilson

_OPS = {
    "gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v, "eq": lambda c, v: c == v,
    "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v),
}


def rule_predicate(conditions: dict[str, dict[str, Any]], columns: list[str]) -> Column:
    """All conditions at once, {feature: {op: value}}; NULL fails. An unknown feature or operator raises ValueError."""
    tests = []
    for feature, ops in conditions.items():
        if feature not in columns:
            raise ValueError(f"unknown feature {feature}")
        for op, v in ops.items():
            if op not in _OPS:
                raise ValueError(f"unknown operator {op}")
            tests.append(F.coalesce(_OPS[op](F.col(feature), v), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def distinct_rules(rules: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The first of each (direction, horizon, conditions), whatever the order of the conditions' keys."""
    seen: dict[tuple, dict[str, Any]] = {}
    for r in rules:
        canon = tuple(sorted((f, tuple(sorted((o, repr(v)) for o, v in ops.items()))) for f, ops in r["conditions"].items()))
        seen.setdefault((r["direction"], r["target_horizon"], canon), r)
    return list(seen.values())


def rule_metrics(rows: DataFrame, rules: dict[str, Column], value: str, cost: float = 0.0) -> DataFrame:
    """One row per rule: cases, wins, their rate with its interval, means, median and profit factor after cost (NULL without losses).

    Every row is tagged with the rules it meets and all rules are aggregated in one pass, so a search over many rules reads the table once.
    """
    tagged = rows.withColumn("rule_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])))).where(F.col(value).isNotNull())
    net = F.col(value) - cost
    a = tagged.groupBy("rule_id").agg(
        F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("wins"), F.avg(value).alias("mean_return"), F.avg(net).alias("mean_net"),
        F.try_divide(F.sum(F.when(net > 0, net)), -F.sum(F.when(net < 0, net))).alias("profit_factor"),
    )
    low, high = wilson(F.col("wins"), F.col("n"))
    a = a.join(quantiles(tagged, ["rule_id"], value, [0.5]).select("rule_id", F.col("q")[0].alias("median_return")), "rule_id")
    return a.withColumns({"win_rate": F.col("wins") / F.col("n"), "wilson_low": low, "wilson_high": high})


def threshold_rules(features: dict[str, list[float]]) -> dict[str, Column]:
    """Rules feature >= t and feature <= t for every threshold."""
    return {f"{f}{op}{t:g}": (F.col(f) >= t if op == ">=" else F.col(f) <= t) for f, ts in features.items() for t in ts for op in (">=", "<=")}


def pair_rules(rules: dict[str, Column]) -> dict[str, Column]:
    """Both of each two rules."""
    return {f"{a}&{b}": rules[a] & rules[b] for a, b in combinations(rules, 2)}


def probability_signal(up: Column, down: Column, least: float) -> Column:
    """LONG or SHORT by the larger probability if it is at least ``least``, else NO_SIGNAL; a tie is LONG."""
    return F.when(F.greatest(up, down) < least, "NO_SIGNAL").when(up >= down, "LONG").otherwise("SHORT")


def signed(value: Column, signal: Column, cost: float = 0.0) -> Column:
    """Result of a signal after cost; NULL for none."""
    return F.when(signal == "LONG", value - cost).when(signal == "SHORT", -value - cost)


def equity(rows: DataFrame, t: str, ident: str, value: str) -> DataFrame:
    """Add the running result, its running peak (at least 0) and the fall from the peak, in the order of time and id (microseconds)."""
    day, order = F.floor(F.col(t) / 86_400_000_000), [F.asc(t), F.asc(ident)]
    r = running(rows.where(F.col(value).isNotNull()), day, order, value, "equity")
    r = running(r, day, order, "equity", "_peak", largest=True)
    return r.withColumn("peak", F.greatest(F.lit(0.0), "_peak")).withColumn("drawdown", F.col("equity") - F.greatest(F.lit(0.0), "_peak")).drop("_peak")


def performance(rows: DataFrame, t: str, ident: str, value: str) -> DataFrame:
    """What a sequence of results adds up to: sums, rates, profit factor, drawdown, deviations, payoff and expected shortfall of the worst 5 %."""
    e = equity(rows, t, ident, value)
    v = F.col(value)
    a = e.agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.avg((v > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))).alias("profit_factor"), F.min("drawdown").alias("max_drawdown"), F.stddev_samp(value).alias("deviation"),
        F.sqrt(F.avg(F.pow(F.least(v, F.lit(0.0)), F.lit(2.0)))).alias("downside"), F.min(value).alias("worst"), F.max(value).alias("best"),
        F.try_divide(F.avg(F.when(v > 0, v)), -F.avg(F.when(v < 0, v))).alias("payoff"),
    )
    ranked = global_rank(rows.where(v.isNotNull()), F.floor(v), [F.asc(value), F.asc(ident)], "_r")
    k = F.broadcast(a.select(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.05))).alias("_k")))
    tail = ranked.join(k).where("_r <= _k").agg(F.avg(value).alias("expected_shortfall"))
    sharpe = F.try_divide(F.col("mean"), F.col("deviation")) * F.sqrt("n")
    middle = quantiles(rows, [], value, [0.5]).agg(F.max(F.col("q")[0]).alias("median"))
    return a.join(F.broadcast(tail)).join(F.broadcast(middle)).withColumns({"sharpe_like": sharpe, "recovery": F.when(F.col("max_drawdown") < 0, F.col("total") / -F.col("max_drawdown"))})


def longest_streaks(rows: DataFrame, t: str, ident: str, won: Column) -> DataFrame:
    """(won, longest): longest runs of won and lost results in the order of time and id."""
    day, order = F.floor(F.col(t) / 86_400_000_000), [F.asc(t), F.asc(ident)]
    r = global_rank(rows.withColumn("_w", won), day, order, "_r")
    # Within a run, the position among all less that among its kind is the same.
    k = r.join(r.groupBy(day.alias("_d"), "_w").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_w").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("_w", "_w2"), (day == F.col("_d")) & (F.col("_w") == F.col("_w2")))
    k = k.withColumn("_s", F.col("_r") - F.col("_before") - F.row_number().over(Window.partitionBy("_d", "_w").orderBy(*order)))
    return k.groupBy("_w", "_s").agg(F.count("*").alias("_c")).groupBy(F.col("_w").alias("won")).agg(F.max("_c").alias("longest"))


def deciles(rows: DataFrame, score: str, ident: str, bucket: Column) -> DataFrame:
    """Add ``decile`` 1..10 by the rank r of a score: max(1, ceil(10 (r - 1) / (n - 1)))."""
    r = global_rank(rows, bucket, [F.asc(score), F.asc(ident)], "_r").join(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    d = F.greatest(F.lit(1), F.ceil(F.try_divide(F.lit(10.0) * (F.col("_r") - 1), F.col("_n") - 1)))
    return r.withColumn("decile", F.coalesce(d, F.lit(1)).cast("int")).drop("_r", "_n")


def cost_table(rows: DataFrame, value: str, costs: list[float]) -> DataFrame:
    """Total, mean and win rate after each cost."""
    c = rows.where(F.col(value).isNotNull()).select(value, F.explode(F.array(*[F.lit(x) for x in costs])).alias("cost")).withColumn("net", F.col(value) - F.col("cost"))
    return c.groupBy("cost").agg(F.count("*").alias("n"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


def directional_signals(momentum: Column, trend: Column, high: Column, low: Column, price: Column) -> dict[str, Column]:
    """Signals of -1, 0 or 1: of the momentum's sign, of trend and momentum agreeing, and of a price beyond the extremes before it."""
    return {
        "momentum": F.signum(momentum).cast("int"), "trend": F.when(F.signum(momentum) == F.signum(trend), F.signum(trend).cast("int")).otherwise(0),
        "breakout": F.when(price > high, 1).when(price < low, -1).otherwise(0),
    }


def position_size(volatility: Column, target: float) -> Column:
    """Size in inverse proportion to the volatility, between .25 and 1; 0 where it is unknown or not positive."""
    return F.when(volatility > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.25), target / F.when(volatility > 0, volatility)))).otherwise(0.0)


def sample_gate(n: Column) -> Column:
    """What a number of cases allows to say."""
    return F.when(n < 30, "descriptive").when(n < 100, "exploratory").when(n < 300, "candidate").otherwise("strong")


def baselines(rows: DataFrame, t: str, ident: str, actual: str) -> DataFrame:
    """Accuracy of guessing always UP, the most frequent direction, and the direction before, in the order of time and id."""
    day, order = F.floor(F.col(t) / 86_400_000_000), [F.asc(t), F.asc(ident)]
    r = global_rank(rows.where(F.col(actual).isNotNull()).select(t, ident, actual), day, order, "_r")
    before = r.select((F.col("_r") + 1).alias("_r"), F.col(actual).alias("_p"))
    j = r.join(before, "_r", "left")
    most = r.groupBy(actual).agg(F.count("*").alias("_n")).agg(F.max(F.struct("_n", actual))[actual].alias("_m"))
    a = j.join(F.broadcast(most)).agg(
        F.count("*").alias("n"), F.avg((F.col(actual) == "UP").cast("double")).alias("always_up"), F.avg((F.col(actual) == F.col("_m")).cast("double")).alias("majority"),
        F.avg((F.col(actual) == F.col("_p")).cast("double")).alias("previous"))
    return a


def reject_gate(metrics: DataFrame, least: int) -> DataFrame:
    """Add ``rejected``: the first reason why a rule isn't kept, or NULL."""
    reason = (
        F.when(F.col("n") < least, "low_sample").when(F.col("win_rate") < 0.55, "win_rate").when(F.col("mean_net") <= 0, "no_expectancy")
        .when(F.coalesce(F.col("profit_factor"), F.lit(float("inf"))) <= 1, "profit_factor")
    )
    return metrics.withColumn("rejected", reason)


def distinct_memberships(rows: DataFrame, rules: dict[str, Column], ident: str) -> DataFrame:
    """(rule_id, n) of the rules that no rule before them, by name, shares all its rows with.

    A rule's rows are folded into their number and two order-free hashes of their ids, so memberships are compared without being gathered.
    """
    tagged = rows.select(ident, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule_id"))
    m = tagged.groupBy("rule_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(ident)).alias("_x"), F.bit_xor(F.xxhash64(F.lit("b"), ident)).alias("_y"))
    return m.groupBy("n", "_x", "_y").agg(F.min("rule_id").alias("rule_id")).select("rule_id", "n")


def discovery_grid(rows: DataFrame, rules: dict[str, Column], values: dict[str, str], bands: list[float], train: Column, least: int) -> DataFrame:
    """(rule_id, horizon, band, direction, n, accuracy, mean): every rule at every horizon and band, its direction chosen on the training rows.

    The direction is that of the larger share of moves beyond the band, up on a tie; only combinations with ``least`` rows stay. All
    combinations are aggregated in one pass over the rows.
    """
    t = rows.where(train).withColumn("rule_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))))
    long = t.select("rule_id", *values.values()).unpivot(["rule_id"], list(values.values()), "_c", "v").where("v IS NOT NULL")
    horizon = F.create_map(*[F.lit(x) for h, c in values.items() for x in (c, h)])
    long = long.withColumn("horizon", F.element_at(horizon, F.col("_c"))).withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    a = long.groupBy("rule_id", "horizon", "band").agg(F.count("*").alias("n"), F.avg((F.col("v") > F.col("band")).cast("double")).alias("up"), F.avg((F.col("v") < -F.col("band")).cast("double")).alias("down"), F.avg("v").alias("m"))
    long_ = F.col("up") >= F.col("down")
    return a.where(F.col("n") >= least).select("rule_id", "horizon", "band", F.when(long_, "LONG").otherwise("SHORT").alias("direction"), "n", F.greatest("up", "down").alias("accuracy"), F.when(long_, F.col("m")).otherwise(-F.col("m")).alias("mean"))
