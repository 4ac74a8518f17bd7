"""Candle store: parsing, validation, duplicates, gaps, coverage and larger bars.

A candle is keyed by (symbol, minute), minute being whole minutes since 1970. All operators are declarative; the windows are partitioned by
symbol and day or by key, so no symbol's history has to fit into one task unless its docstring says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Epoch numbers from here on are microseconds, below milliseconds.
MICROS_FROM = 100_000_000_000_000
#: Allowed calendar range, in microseconds: 2017-01-01 to 2030-01-01.
EARLIEST_US, LATEST_US = 1_483_228_800_000_000, 1_893_456_000_000_000


def epoch_us(raw: Column) -> Column:
    """Microseconds of an epoch number in milliseconds or microseconds, told apart by size; NULL outside the allowed calendar range."""
    us = F.when(F.abs(raw) >= MICROS_FROM, raw).otherwise(raw * 1000)
    return F.when((us >= EARLIEST_US) & (us < LATEST_US), us)


def parse_candles(raw: DataFrame) -> DataFrame:
    """Add open_us, close_us, minute and ``error``: 'timestamp_out_of_range', 'precision_mismatch', 'missing_field' or NULL.

    A row with an error keeps its columns, so that errors can be ledgered; repeated rows stay.
    """
    o, c = epoch_us(F.col("open_time")), epoch_us(F.col("close_time"))
    mixed = (F.abs("open_time") >= MICROS_FROM) != (F.abs("close_time") >= MICROS_FROM)
    need = [F.col(x).isNull() for x in ("symbol", "open_time", "close_time", "open", "high", "low", "close", "volume")]
    error = F.when(reduce(lambda a, b: a | b, need), "missing_field").when(o.isNull() | c.isNull(), "timestamp_out_of_range").when(mixed, "precision_mismatch")
    return raw.withColumns({"open_us": o, "close_us": c, "minute": F.floor(o / 60_000_000).cast("bigint"), "error": error})


def candle_codes(symbol: str | None = None, interval: str | None = None) -> Column:
    """All faults of a parsed candle, joined with '|' in a fixed order; empty if there are none. Symbol and interval are checked where they are named."""
    checks: list[tuple[str, Column]] = []
    if symbol is not None:
        checks.append(("symbol_mismatch", F.col("symbol") != symbol))
    if interval is not None:
        checks.append(("interval_mismatch", F.col("interval") != interval))
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    checks += [(f"{x}_not_positive", F.col(x) <= 0) for x in ("open", "high", "low", "close")]
    checks += [("high_below_open", h < o), ("high_below_close", h < c), ("low_above_open", lo > o), ("low_above_close", lo > c), ("high_below_low", h < lo)]
    checks += [(f"{x}_negative", F.col(x) < 0) for x in ("volume", "quote_volume", "taker_buy_base", "taker_buy_quote", "trade_count")]
    length = F.col("close_us") - F.col("open_us")
    checks += [
        ("open_time_not_minute_aligned", F.col("open_us") % 60_000_000 != 0), ("close_time_not_after_open", length <= 0),
        ("close_time_not_1m", (length < 59_999_000) | (length >= 60_000_000)),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks])), "|")


def sound_candle() -> Column:
    """Whether a candle can be used: positive open and close, ordered extremes, volume not negative, aligned to the minute."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ok = (o > 0) & (c > 0) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c) & (h >= lo) & (F.col("volume") >= 0) & (F.col("open_us") % 60_000_000 == 0)
    return F.coalesce(ok, F.lit(False))


def first_of_each(df: DataFrame, key: list[str], order: list[str], rank: str = "copy_no") -> DataFrame:
    """Number the rows of each key in order; 1 is the one to keep. Ties in the order are numbered arbitrarily."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def one_per_minute(parsed: DataFrame) -> DataFrame:
    """The sound candles, one for each symbol and minute: of repeated ones the smallest by its values, chosen by map-side aggregation."""
    fields = ["open", "high", "low", "close", "volume"]
    best = parsed.where(F.col("error").isNull() & sound_candle()).groupBy("symbol", "minute").agg(F.min(F.struct(*fields)).alias("c"))
    return best.select("symbol", "minute", *[F.col(f"c.{x}").alias(x) for x in fields])


def conflicts(new: DataFrame, stored: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """New rows whose key is stored with another value; NULLs are equal to each other."""
    other = stored.select(*key, *[F.col(v).alias(f"stored_{v}") for v in values])
    differs = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"stored_{v}")) for v in values])
    return new.join(other, key).where(differs)


def insert_new(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows and the new ones whose key isn't stored; stored rows never change."""
    return stored.unionByName(new.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns joined by commas; NULL counts as empty."""
    return F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def gaps(grid: DataFrame) -> DataFrame:
    """(symbol, gap_start, gap_end, missing) between present minutes of each symbol.

    The window runs over a symbol's days, of which only the first and last minute travel, and within each day; so no task holds more than
    one symbol's days or one day's minutes.
    """
    g = grid.select("symbol", "minute").distinct().withColumn("day", F.floor(F.col("minute") / 1440))
    inside = g.withColumn("before", F.lag("minute").over(Window.partitionBy("symbol", "day").orderBy("minute")))
    edges = g.groupBy("symbol", "day").agg(F.min("minute").alias("minute"), F.max("minute").alias("last"))
    across = edges.withColumn("before", F.lag("last").over(Window.partitionBy("symbol").orderBy("day")))
    both = inside.select("symbol", "before", "minute").unionByName(across.select("symbol", "before", "minute"))
    return both.where("minute - before > 1").select("symbol", (F.col("before") + 1).alias("gap_start"), (F.col("minute") - 1).alias("gap_end"), (F.col("minute") - F.col("before") - 1).alias("missing"))


def missing_minutes(grid: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, symbol, minute) that each span (id, symbol, start, stop, both included) expects and the grid lacks."""
    wanted = spans.select("id", "symbol", F.explode(F.sequence("start", "stop")).alias("minute"))
    return wanted.join(grid.select("symbol", "minute").distinct(), ["symbol", "minute"], "left_anti").select("id", "symbol", "minute")


def resume_points(grid: DataFrame, start: int) -> DataFrame:
    """(symbol, resume_minute): the first minute from ``start`` on that is missing; ``start`` itself if the history begins later."""
    g = grid.where(F.col("minute") >= start).select("symbol", "minute").distinct()
    follows = g.select("symbol", (F.col("minute") - 1).alias("minute"))
    open_ends = g.join(follows, ["symbol", "minute"], "left_anti").groupBy("symbol").agg((F.min("minute") + 1).alias("hole"))
    first = g.groupBy("symbol").agg(F.min("minute").alias("first"))
    return first.join(open_ends, "symbol").select("symbol", F.when(F.col("first") > start, F.lit(start)).otherwise(F.col("hole")).cast("bigint").alias("resume_minute"))


def availability(grid: DataFrame) -> DataFrame:
    """First and last minute and number of distinct minutes of each symbol."""
    return grid.groupBy("symbol").agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count_distinct("minute").alias("minutes"))


def window_coverage(spans: DataFrame, grid: DataFrame, benchmark: str) -> DataFrame:
    """(id, symbol, own, bench, status) for spans (id, symbol, start, stop): minutes present for the symbol and the benchmark, and the verdict.

    Verdicts, the first that holds: fully_covered, pre_listing, candle_gap_overlap, missing_context. Each span is cut at day borders, so the
    range join is an equi-join on (symbol, day) with a filter.
    """
    g = grid.select("symbol", "minute").distinct().withColumn("day", F.floor(F.col("minute") / 1440))
    s = spans.select("id", F.col("symbol").alias("own_symbol"), "start", "stop").withColumn("day", F.explode(F.sequence(F.floor(F.col("start") / 1440), F.floor(F.col("stop") / 1440))))
    s = s.withColumn("symbol", F.explode(F.array_distinct(F.array("own_symbol", F.lit(benchmark)))))
    hit = s.join(g, ["symbol", "day"], "left").where(F.col("minute").isNull() | F.col("minute").between(F.col("start"), F.col("stop")))
    seen = hit.groupBy("id").agg(
        F.count(F.when(F.col("symbol") == F.col("own_symbol"), F.col("minute"))).alias("own"), F.count(F.when(F.col("symbol") == benchmark, F.col("minute"))).alias("bench"))
    first = availability(grid).select("symbol", "first_minute")
    need = F.col("stop") - F.col("start") + 1
    own, bench = F.coalesce("own", F.lit(0)), F.coalesce("bench", F.lit(0))
    status = (
        F.when((own == need) & (bench == need), "fully_covered").when(F.col("first_minute").isNull() | (F.col("start") < F.col("first_minute")), "pre_listing")
        .when((own > 0) & (bench > 0), "candle_gap_overlap").otherwise("missing_context")
    )
    return spans.join(seen, "id", "left").join(first, "symbol", "left").select("id", "symbol", own.alias("own"), bench.alias("bench"), status.alias("status"))


def bars(grid: DataFrame, minutes: int = 1440) -> DataFrame:
    """Candles of ``minutes`` minutes: first open, highest high, lowest low, last close, volume and the number of minutes present."""
    return grid.groupBy("symbol", F.floor(F.col("minute") / minutes).alias("bar")).agg(
        F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )


def period_metrics(daily: DataFrame, periods_a_year: float = 365.0) -> DataFrame:
    """Return, deepest fall from a running peak, largest rise from a running low, annualised volatility and a label, in percent, for each symbol.

    Takes bars, of which a symbol has few; each symbol's bars go through one window.
    """
    w = Window.partitionBy("symbol").orderBy("bar")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = daily.withColumns({
        "peak": F.max("close").over(run), "trough": F.min("close").over(run), "step": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1,
        "first_close": F.first("close").over(run),
    })
    out = d.groupBy("symbol").agg(
        ((F.max_by("close", "bar") / F.min_by("close", "bar") - 1) * 100).alias("return_pct"), (F.min(F.try_divide(F.col("close"), F.col("peak")) - 1) * 100).alias("max_drawdown_pct"),
        (F.max(F.try_divide(F.col("close"), F.col("trough")) - 1) * 100).alias("max_rise_pct"), (F.stddev_samp("step") * F.sqrt(F.lit(periods_a_year)) * 100).alias("volatility_pct"),
    )
    label = F.when(F.col("volatility_pct") >= 80, "volatile").when(F.col("return_pct") >= 10, "up").when(F.col("return_pct") <= -10, "down").otherwise("flat")
    return out.withColumn("regime", label)


def step_correlation(grid: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of the steps of two symbols' closes over the bars that both have and that directly follow one both have."""
    wide = grid.where(F.col("symbol").isin(a, b)).groupBy("bar").agg(F.max(F.when(F.col("symbol") == a, F.col("close"))).alias("x"), F.max(F.when(F.col("symbol") == b, F.col("close"))).alias("y")).dropna()
    before = wide.select((F.col("bar") + 1).alias("bar"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    steps = wide.join(before, "bar").select((F.try_divide(F.col("x"), F.col("x0")) - 1).alias("dx"), (F.try_divide(F.col("y"), F.col("y0")) - 1).alias("dy"))
    return steps.agg(F.count(F.when(F.col("dx").isNotNull() & F.col("dy").isNotNull(), 1)).alias("n"), F.corr("dx", "dy").alias("correlation"))


def archive_months(grid: DataFrame) -> DataFrame:
    """(symbol, month, expected, present, missing): minutes of every calendar month from a symbol's first to its last, and how many are there."""
    t = F.timestamp_seconds(F.col("minute") * 60)
    have = grid.select("symbol", "minute").distinct().groupBy("symbol", F.to_date(F.date_trunc("month", t)).alias("month")).agg(F.count("*").alias("present"))
    span = have.groupBy("symbol").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    expected = (F.day(F.last_day("month")) * 1440).cast("bigint")
    return span.join(have, ["symbol", "month"], "left").select("symbol", "month", expected.alias("expected"), F.coalesce("present", F.lit(0)).alias("present"), (expected - F.coalesce("present", F.lit(0))).alias("missing"))


def span_status(spans: DataFrame, grid: DataFrame, before: int, after: int) -> DataFrame:
    """(id, symbol, status): whether a symbol's history reaches from ``before`` minutes before to ``after`` after a point (id, symbol, at)."""
    a = availability(grid).select("symbol", "first_minute", "last_minute")
    j = spans.join(a, "symbol", "left")
    lo, hi = F.col("at") - before >= F.col("first_minute"), F.col("at") + after <= F.col("last_minute")
    status = F.when(F.col("first_minute").isNull(), "no_history").when(lo & hi, "covered").when(~lo & ~hi, "too_short").when(~lo, "starts_late").otherwise("ends_early")
    return j.select("id", "symbol", status.alias("status"))


def invalid_impact(parsed: DataFrame, used: DataFrame) -> DataFrame:
    """(use, n): unsound candle keys that serve as a reaction's reference, as its end point, or not at all; used: symbol, minute, role."""
    bad = parsed.where(F.col("error").isNull() & ~sound_candle()).select("symbol", "minute").distinct()
    roles = used.groupBy("symbol", "minute").agg(F.max((F.col("role") == "reference").cast("int")).alias("ref"))
    return bad.join(roles, ["symbol", "minute"], "left").groupBy(F.when(F.col("ref") == 1, "reference").when(F.col("ref") == 0, "endpoint").otherwise("unused").alias("use")).agg(F.count("*").alias("n"))
