"""Market reactions of events: exact-time returns, excursions, volatility and abnormal returns.

Grids are (symbol, bar, open, high, low, close, volume), a bar being a whole number of time units; events are (event_id, symbol, base), base
being the bar from which the reaction counts. End points must exist exactly: nothing is filled, interpolated or taken from nearby. Windows of
bars join on (symbol, block of bars) with a filter, never on a bare range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bars in a block of the range join.
BLOCK = 1440


def base_bar(epoch_s: Column, seconds: int = 60, latency: int = 0) -> Column:
    """The bar after the one an instant falls into, also on an exact border, plus a latency in bars."""
    return (F.floor(epoch_s / seconds) + 1 + latency).cast("bigint")


def pct(end: Column, start: Column) -> Column:
    """Return in percent; NULL unless both prices are positive and finite."""
    ok = (start > 0) & (end > 0) & ~F.isnan(start) & ~F.isnan(end) & (start < float("inf")) & (end < float("inf"))
    return F.when(ok, (end / start - 1) * 100)


def horizon_returns(events: DataFrame, grid: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(event_id, symbol, base, horizon, base_open, end_open, ret): one row per event and horizon, ret NULL where an end is missing.

    The wanted (symbol, bar) keys are joined with the grid once; base and ends come from one aggregation by event, so the grid is shuffled once.
    """
    hs = F.array(F.lit(0), *[F.lit(h) for h in horizons])
    want = events.select("event_id", "symbol", "base", F.explode(hs).alias("horizon")).withColumn("bar", F.col("base") + F.col("horizon"))
    got = want.join(grid.select("symbol", "bar", "open"), ["symbol", "bar"], "left")
    base = F.max(F.when(F.col("horizon") == 0, F.col("open"))).over(Window.partitionBy("event_id", "symbol", "base"))
    return got.withColumn("base_open", base).where("horizon > 0").select("event_id", "symbol", "base", "horizon", "base_open", F.col("open").alias("end_open"), pct(F.col("open"), F.col("base_open")).alias("ret"))


def reaction_quality(returns: DataFrame) -> DataFrame:
    """(event_id, symbol, quality, reason) of horizon returns: 'complete', 'partial' with the missing horizons, or 'missing_reference'."""
    lacking = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ret").isNull(), F.col("horizon")))), lambda h: h.cast("string")), "|")
    r = returns.groupBy("event_id", "symbol").agg(F.max("base_open").alias("base_open"), F.count("ret").alias("n"), F.count("*").alias("all"), lacking.alias("lacking"))
    missing = ~F.coalesce(F.col("base_open") > 0, F.lit(False))
    quality = F.when(missing, "missing_reference").when(F.col("n") == F.col("all"), "complete").otherwise("partial")
    return r.select("event_id", "symbol", quality.alias("quality"), F.when(missing, "missing_reference").when(F.col("n") < F.col("all"), F.concat(F.lit("missing_market_data:"), "lacking")).alias("reason"))


def wide_returns(returns: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per event and symbol with a column for each horizon."""
    return returns.groupBy("event_id", "symbol").agg(*[F.max(F.when(F.col("horizon") == h, F.col("ret"))).alias(f"ret_{h}") for h in horizons])


def average_reaction(columns: Sequence[str], least: int = 3) -> Column:
    """Mean of the horizons that aren't NULL, if there are at least ``least``."""
    there = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(there) >= least, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def strongest_horizon(columns: dict[int, str]) -> Column:
    """The horizon of the largest absolute return, the shortest on a tie; NULL if there is none."""
    best = F.array_max(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)).alias("a"), F.lit(-h).alias("h"))) for h, c in columns.items()])))
    return -best["h"]


def abnormal(asset: Column, benchmark: Column, beta: Column | float, is_benchmark: Column) -> Column:
    """Return beyond beta times the benchmark's; the benchmark's own return is raw."""
    return F.when(is_benchmark, asset).otherwise(asset - (beta if isinstance(beta, Column) else F.lit(beta)) * benchmark)


def window_bars(events: DataFrame, grid: DataFrame, first: int, last: int, block: int = BLOCK) -> DataFrame:
    """Every event with each present bar from base + first to base + last, both included, with ``offset`` from the base.

    Each window is cut into the blocks it touches, at most (last - first) / block + 2, and joined on (symbol, block). A hot symbol is spread over
    its blocks.
    """
    e = events.withColumn("blk", F.explode(F.sequence(F.floor((F.col("base") + first) / block), F.floor((F.col("base") + last) / block))))
    g = grid.withColumn("blk", F.floor(F.col("bar") / block))
    return e.join(g, ["symbol", "blk"]).where(F.col("bar").between(F.col("base") + first, F.col("base") + last)).withColumn("offset", F.col("bar") - F.col("base")).drop("blk")


def per_base(events: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``compute`` makes of events (event_id, symbol, base), done once for each distinct symbol and base and joined back to all events.

    Many events share a base; the windows then cost what the bars cost, not the events.
    """
    keys = events.select("symbol", "base").dropna().distinct().withColumn("event_id", F.col("base"))
    done = compute(keys).withColumnRenamed("event_id", "base")
    return events.select("event_id", "symbol", "base").join(done, ["symbol", "base"]).drop("base")


def price_path(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, offset, open_ret, high_ret, low_ret) from the base to ``bars`` later, for events whose base exists with a positive open."""
    w = window_bars(events, grid, 0, bars)
    base = F.max(F.when(F.col("offset") == 0, F.col("open"))).over(Window.partitionBy("event_id", "symbol"))
    return w.withColumn("base_open", base).where("base_open > 0").select("event_id", "symbol", "offset", "open", "volume", *[pct(F.col(c), F.col("base_open")).alias(f"{c}_ret") for c in ("open", "high", "low")])


def excursions(path: DataFrame, short: bool = False) -> DataFrame:
    """(event_id, symbol, mfe, mae, mfe_at, mae_at): best and worst excursion and the first offset of each; mirrored for a short position."""
    up, down = ("low_ret", "high_ret") if short else ("high_ret", "low_ret")
    sign = -1.0 if short else 1.0
    best = F.max(F.struct((F.lit(sign) * F.col(up)).alias("v"), (-F.col("offset")).alias("o")))
    worst = F.min(F.struct((F.lit(sign) * F.col(down)).alias("v"), F.col("offset").alias("o")))
    p = path.where(F.col("high_ret").isNotNull() & F.col("low_ret").isNotNull())
    return p.groupBy("event_id", "symbol").agg(best.alias("b"), worst.alias("w")).select("event_id", "symbol", (F.col("b.v") + 0.0).alias("mfe"), (F.col("w.v") + 0.0).alias("mae"), (-F.col("b.o")).alias("mfe_at"), F.col("w.o").alias("mae_at"))


def first_passage(path: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """First offset at which the open return reaches +t or falls to -t, for each t."""
    cols = [c for t in thresholds for c in (F.min(F.when(F.col("open_ret") >= t, F.col("offset"))).alias(f"up_{str(t).replace('.', '_')}"), F.min(F.when(F.col("open_ret") <= -t, F.col("offset"))).alias(f"down_{str(t).replace('.', '_')}"))]
    return path.groupBy("event_id", "symbol").agg(*cols)


def returned_to_entry(path: DataFrame, peaks: DataFrame) -> DataFrame:
    """(event_id, symbol, returned): whether the open return is at or below zero at or after the offset of the best excursion."""
    j = path.join(peaks.select("event_id", "symbol", "mfe_at"), ["event_id", "symbol"])
    return j.groupBy("event_id", "symbol").agg(F.coalesce(F.bool_or((F.col("offset") >= F.col("mfe_at")) & (F.col("open_ret") <= 0)), F.lit(False)).alias("returned"))


def retention(value: Column, mfe: Column) -> tuple[Column, Column]:
    """Share of the best excursion that is kept, and what is given back."""
    return F.try_divide(value, mfe), mfe - value


def path_volatility(path: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, volatility, n): root of the summed squared log steps of the opens, in percent, over steps between adjacent present bars."""
    w = Window.partitionBy("event_id", "symbol").orderBy("offset")
    prev, at = F.lag("open").over(w), F.lag("offset").over(w)
    step = F.when((F.col("offset") - at == 1) & (prev > 0) & (F.col("open") > 0), F.ln(F.when(prev > 0, F.col("open") / prev)))
    s = path.where(F.col("offset") <= bars).withColumn("step", step)
    return s.groupBy("event_id", "symbol").agg((F.sqrt(F.sum(F.col("step") * F.col("step"))) * 100).alias("volatility"), F.count("step").alias("n"))


def hour_reaction(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """Highest and lowest return and mean volume against the base over (base, base + bars], the base excluded."""
    w = window_bars(events, grid, 0, bars)
    after = F.col("offset") > 0
    a = w.groupBy("event_id", "symbol").agg(
        F.max(F.when(F.col("offset") == 0, F.col("open"))).alias("p0"), F.max(F.when(F.col("offset") == 0, F.col("volume"))).alias("v0"),
        F.max(F.when(after, F.col("high"))).alias("hi"), F.min(F.when(after, F.col("low"))).alias("lo"), F.avg(F.when(after, F.col("volume"))).alias("v"),
    ).where("p0 IS NOT NULL")
    return a.select("event_id", "symbol", pct(F.col("hi"), F.col("p0")).alias("max_ret"), pct(F.col("lo"), F.col("p0")).alias("min_ret"), pct(F.col("v"), F.col("v0")).alias("volume_change"))


def volume_ratio(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """Mean volume of the ``bars`` bars from the base on over that of as many before, its logarithm, and whether it is a shock (2 or more)."""
    w = window_bars(events, grid, -bars, bars - 1)
    a = w.groupBy("event_id", "symbol").agg(F.avg(F.when(F.col("offset") >= 0, F.col("volume"))).alias("post"), F.avg(F.when(F.col("offset") < 0, F.col("volume"))).alias("pre"))
    r = F.try_divide(F.col("post"), F.col("pre"))
    return a.select("event_id", "symbol", r.alias("ratio"), F.when(r > 0, F.ln(F.when(r > 0, r))).alias("log_ratio"), (r >= 2).alias("shock"))


def reaction_class(pre: Column, post: Column, threshold: float) -> Column:
    """Whether the market moved before, after, both or neither."""
    a, b = F.abs(pre) >= threshold, F.abs(post) >= threshold
    return F.when(pre.isNull() | post.isNull(), None).when(a & b, "both").when(a, "pre").when(b, "post").otherwise("none")


def fallback(columns: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The first value that isn't NULL, and the names of all providers that have one, joined by '+'."""
    return F.coalesce(*[F.col(c) for c, _ in columns]), F.concat_ws("+", *[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in columns])


def window_ranges(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, n, step_std, range_share, true_range): over the ``bars`` bars from the base on, the sample deviation of the steps of the
    open in percent, the span of extremes over the first open, and the mean span of a bar over its open."""
    w = window_bars(events, grid, 0, bars - 1)
    at = Window.partitionBy("event_id", "symbol").orderBy("offset")
    step = F.when(F.col("offset") - F.lag("offset").over(at) == 1, pct(F.col("open"), F.lag("open").over(at)))
    a = w.withColumn("step", step).groupBy("event_id", "symbol").agg(
        F.count("*").alias("n"), F.stddev_samp("step").alias("step_std"), F.max("high").alias("hi"), F.min("low").alias("lo"), F.min_by("open", "offset").alias("o"),
        F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("open"))).alias("true_range"))
    return a.select("event_id", "symbol", "n", "step_std", F.try_divide(F.col("hi") - F.col("lo"), F.col("o")).alias("range_share"), "true_range")


def volume_shock(events: DataFrame, grid: DataFrame, bars: int, history: int) -> DataFrame:
    """(event_id, symbol, shock): volume of the ``bars`` bars from the base on over what the ``history`` bars before let expect."""
    w = window_bars(events, grid, -history, bars - 1)
    a = w.groupBy("event_id", "symbol").agg(F.sum(F.when(F.col("offset") >= 0, F.col("volume"))).alias("post"), F.avg(F.when(F.col("offset") < 0, F.col("volume"))).alias("pre"))
    return a.select("event_id", "symbol", F.try_divide(F.col("post"), F.col("pre") * bars).alias("shock"))


def contiguous(events: DataFrame, grid: DataFrame, before: int, after: int) -> DataFrame:
    """(event_id, symbol, whole): whether every bar from base - before to base + after is there."""
    w = window_bars(events, grid, -before, after).groupBy("event_id", "symbol").agg(F.count_distinct("bar").alias("n"))
    return events.select("event_id", "symbol").join(w, ["event_id", "symbol"], "left").select("event_id", "symbol", (F.coalesce("n", F.lit(0)) == before + after + 1).alias("whole"))


def latency_returns(events: DataFrame, grid: DataFrame, horizons: Sequence[int], latencies: Sequence[int]) -> DataFrame:
    """Horizon returns from every latency after the base: (event_id, symbol, latency, horizon, ret)."""
    e = events.select("event_id", "symbol", F.col("base").alias("b"), F.explode(F.array(*[F.lit(x) for x in latencies])).alias("latency"))
    key = F.struct("event_id", "latency")
    r = horizon_returns(e.select(key.alias("event_id"), "symbol", (F.col("b") + F.col("latency")).alias("base")), grid, horizons)
    return r.select("event_id.event_id", "symbol", "event_id.latency", "horizon", "ret")


def path_class(early: Column, late: Column, band: float) -> Column:
    """What became of a move: none, delayed, kept, faded, grown or reversed, from an early and a late return."""
    a, b = F.abs(early), F.abs(late)
    return (
        F.when(early.isNull() | late.isNull(), None).when((a < band) & (b < band), "none").when(a < band, "delayed").when(early * late < 0, "reversed")
        .when(b >= a * 1.5, "grown").when(b <= a * 0.5, "faded").otherwise("kept")
    )


def provider_conflicts(one: DataFrame, two: DataFrame, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, one, two): results that two providers both have and tell differently, by more than ``tolerance``."""
    a, b = one.select(*key, F.col(value).alias("one")), two.select(*key, F.col(value).alias("two"))
    return a.join(b, key).where(F.abs(F.col("one") - F.col("two")) > tolerance)
