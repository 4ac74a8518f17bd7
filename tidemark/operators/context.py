"""What was known before an event: returns, volatility, beta, averages, volume and calendar, from bars strictly before the base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import global_rank, previous, quantiles
from tidemark.operators.reactions import window_bars

#: Microseconds of a minute.
MINUTE_US = 60_000_000


def log_steps(grid: DataFrame, step: int = 1) -> DataFrame:
    """(symbol, bar, r): logarithmic step of the open from exactly ``step`` bars before, both positive."""
    g = grid.select("symbol", "bar", "open").where("open > 0")
    before = g.select("symbol", (F.col("bar") + step).alias("bar"), F.col("open").alias("prev"))
    return g.join(before, ["symbol", "bar"]).select("symbol", "bar", F.ln(F.col("open") / F.col("prev")).alias("r"))


def beta_before(events: DataFrame, grid: DataFrame, benchmark: str, bars: int, least: int, step: int = 1) -> DataFrame:
    """(event_id, symbol, n, beta, correlation, used, fell_back): slope of the symbol's steps on the benchmark's over the bars before the base.

    NULL with fewer than ``least`` common steps or a benchmark that doesn't move; ``used`` is then 1.
    """
    r = log_steps(grid, step)
    mine = r.withColumnRenamed("r", "y").join(r.where(F.col("symbol") == benchmark).select("bar", F.col("r").alias("x")), "bar")
    e = events.select("event_id", "symbol", "base")
    w = window_bars(e, mine, -bars + step, -1)
    a = w.groupBy("event_id", "symbol").agg(F.count("*").alias("n"), F.covar_samp("y", "x").alias("c"), F.var_samp("x").alias("v"), F.corr("y", "x").alias("rho"))
    out = e.join(a, ["event_id", "symbol"], "left")
    beta = F.when((F.col("n") >= least) & (F.col("v") > 1e-16), F.col("c") / F.when(F.col("v") > 1e-16, F.col("v")))
    return out.select("event_id", "symbol", F.coalesce("n", F.lit(0)).alias("n"), beta.alias("beta"), F.when(F.col("n") >= 20, F.nanvl("rho", F.lit(None))).alias("correlation"), F.coalesce(beta, F.lit(1.0)).alias("used"), beta.isNull().alias("fell_back"))


def averages_before(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """Mean close of the last ``bars`` bars, the last close's distance from it, the slope against as many bars before, range and volume score.

    The volume score compares the last bar with the others of the window, sample deviation.
    """
    w = window_bars(events.select("event_id", "symbol", "base"), grid, -2 * bars, -1)
    near = F.col("offset") >= -bars
    a = w.groupBy("event_id", "symbol").agg(
        F.avg(F.when(near, F.col("close"))).alias("sma"), F.avg(F.when(~near, F.col("close"))).alias("sma0"), F.max(F.when(F.col("offset") == -1, F.col("close"))).alias("last"),
        F.max(F.when(near, F.col("high"))).alias("hi"), F.min(F.when(near, F.col("low"))).alias("lo"), F.max(F.when(F.col("offset") == -1, F.col("volume"))).alias("v"),
        F.avg(F.when(near & (F.col("offset") < -1), F.col("volume"))).alias("vm"), F.stddev_samp(F.when(near & (F.col("offset") < -1), F.col("volume"))).alias("vs"), F.count(F.when(near, 1)).alias("n"),
    )
    return a.select(
        "event_id", "symbol", "n", (F.try_divide(F.col("last"), F.col("sma")) - 1).alias("sma_distance"), ((F.try_divide(F.col("sma"), F.col("sma0")) - 1) / bars).alias("sma_slope"),
        F.try_divide(F.col("hi") - F.col("lo"), F.col("last")).alias("range_share"), F.try_divide(F.col("v") - F.col("vm"), F.col("vs")).alias("volume_score"), F.try_divide(F.col("v"), F.col("vm")).alias("volume_ratio"),
    )


def ema_before(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, n, ema): exponential average of the closes of the last ``bars`` bars, begun with the first of them.

    In closed form: the weight of the k-th of n values is a(1-a)^(n-k), of the first (1-a)^(n-1). Only bars that are present count.
    """
    a = 2.0 / (bars + 1.0)
    w = window_bars(events.select("event_id", "symbol", "base"), grid, -bars, -1)
    win = Window.partitionBy("event_id", "symbol")
    ranked = w.withColumn("k", F.row_number().over(win.orderBy("offset"))).withColumn("n", F.count("*").over(win))
    weight = F.when(F.col("k") == 1, F.pow(F.lit(1 - a), F.col("n") - 1)).otherwise(a * F.pow(F.lit(1 - a), F.col("n") - F.col("k")))
    return ranked.groupBy("event_id", "symbol").agg(F.max("n").alias("n"), F.sum(weight * F.col("close")).alias("ema"))


def calendar(t: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0), weekend, month, sessions and second of an instant, in the session's zone, UTC."""
    h, d = F.hour(t), F.weekday(t)
    return {
        "hour": h, "weekday": d, "weekend": (d >= 5).cast("int"), "month": F.month(t), "us_session": h.between(13, 21).cast("int"), "eu_session": h.between(7, 15).cast("int"),
        "asia_session": h.between(0, 8).cast("int"), "second": F.second(t),
    }


def as_of(left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str], tolerance_us: int | None = None) -> DataFrame:
    """``left`` with the values of the last right row at or before its time with the same key; NULL if it is older than the tolerance.

    Times are microseconds. Both sides go through one window per key and day, after the last right row of every earlier day was carried over; so
    a key's history is spread over its days. Right rows of equal time count in the order of their values.
    """
    day = F.floor(F.col(t) / 86_400_000_000)
    r = right.select(*key, F.col(t), F.struct(F.col(t).alias("_t"), *values).alias("_v")).withColumn("_day", day)
    last = r.groupBy(*key, "_day").agg(F.max("_v").alias("_last"))
    marks = last.select(*key, "_day", "_last").unionByName(left.select(*key, day.alias("_day")).distinct().withColumn("_last", F.lit(None).cast(r.schema["_v"].dataType)))
    marks = marks.groupBy(*key, "_day").agg(F.max("_last").alias("_last"))
    carried = marks.withColumn("_old", F.last("_last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).select(*key, "_day", "_old")
    names = left.columns
    both = left.withColumns({"_day": day, "_v": F.lit(None).cast(r.schema["_v"].dataType), "_side": F.lit(1)}).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key, "_day").orderBy(t, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").join(carried, [*key, "_day"], "left").withColumn("_hit", F.coalesce("_hit", "_old"))
    ok = F.lit(True) if tolerance_us is None else F.col(t) - F.col("_hit._t") <= tolerance_us
    return found.select(*names, *[F.when(ok, F.col(f"_hit.{v}")).alias(v) for v in values])


def _blocks(df: DataFrame, key: list[str], order: str, rows: int, bucket: int) -> DataFrame:
    """``df`` numbered by key (``_r``) and cut into blocks (``_at``) of so many rows, each with the last ``rows - 1`` rows of the block before (``_blk``)."""
    size = max(rows, bucket)
    numbered = global_rank(df, F.floor(F.col(order) / bucket), [F.asc(order)], "_r", by=key).withColumn("_blk", F.floor((F.col("_r") - 1) / size))
    last = F.col("_r") > (F.col("_blk") + 1) * size - (rows - 1)
    return numbered.withColumn("_at", F.explode(F.when(last, F.array(F.col("_blk"), F.col("_blk") + 1)).otherwise(F.array("_blk"))))


def rolling_score(df: DataFrame, key: list[str], order: str, value: str, rows: int, least: int, bucket: int = 4096) -> DataFrame:
    """Add ``score``: how many sample deviations a value lies from the mean of the last ``rows`` rows, itself included; NULL below ``least`` rows.

    ``order`` is a number, distinct within a key. A key's rows are numbered by buckets of the order and cut into blocks of so many rows; the last
    rows of a block are carried into the next, so a hot key is many tasks.
    """
    w = Window.partitionBy(*key, "_at").orderBy("_r").rowsBetween(-(rows - 1), 0)
    n, m, s = F.count(value).over(w), F.avg(value).over(w), F.stddev_samp(value).over(w)
    return _blocks(df, key, order, rows, bucket).withColumn("score", F.when(n >= least, F.try_divide(F.col(value) - m, s))).where("_at = _blk").drop("_r", "_blk", "_at")


def rolling_change(df: DataFrame, key: list[str], order: str, value: str, rows: int, back: int, bucket: int = 4096) -> DataFrame:
    """Add ``rolling_mean``, of the last ``rows`` rows with the row itself (NULL before there are so many), and ``change``, the relative change
    from the value ``back`` rows before; cut into blocks as in ``rolling_score``.
    """
    w = Window.partitionBy(*key, "_at").orderBy("_r")
    over = w.rowsBetween(-(rows - 1), 0)
    mean = F.when(F.col("_r") >= rows, F.avg(value).over(over))
    old = F.lag(value, back).over(w)
    both = _blocks(df, key, order, max(rows, back + 1), bucket).withColumns({"rolling_mean": mean, "change": F.try_divide(F.col(value) - old, old)})
    return both.where("_at = _blk").drop("_r", "_blk", "_at")


def next_event(events: DataFrame, key: str, t: str, horizon: int) -> DataFrame:
    """Add ``to_next``, the distance to the key's next later event, and ``within``, the number of its events in (t, t + horizon].

    Times are whole numbers. A key is cut into blocks of the horizon; a block also sees the times of the next one, so a hot key is many tasks.
    """
    blk = F.floor(F.col(t) / horizon)
    times = events.where(F.col(t).isNotNull()).groupBy(key, F.col(t).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_blk", F.floor(F.col("_t") / horizon))
    later = previous(times, F.col("_blk"), ["_t"], [key], "_next", forward=True).select(key, "_t", (F.col("_next._t") - F.col("_t")).alias("to_next"))
    seen = times.withColumn("_at", F.explode(F.array(F.col("_blk"), F.col("_blk") - 1)))
    w = Window.partitionBy(key, "_at").orderBy("_t").rangeBetween(1, horizon)
    counted = seen.withColumn("within", F.coalesce(F.sum("_n").over(w), F.lit(0))).where("_at = _blk").select(key, "_t", "within")
    facts = counted.join(later, [key, "_t"]).withColumnRenamed("_t", t)
    return events.join(facts, [key, t], "left")


def tercile_labels(df: DataFrame, value: str, train: Column) -> DataFrame:
    """Add ``tercile`` (low, middle, high) by the .33 and .67 quantiles of the training rows."""
    q = quantiles(df.where(train), [], value, [0.33, 0.67])
    v = F.col(value)
    return df.join(F.broadcast(q)).withColumn("tercile", F.when(v <= F.col("q")[0], "low").when(v >= F.col("q")[1], "high").when(v.isNotNull(), "middle")).drop("q")


def inclusive_scores(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, sample, population): score of the last bar's volume among the last ``bars`` bars, itself included, by either deviation."""
    w = window_bars(events.select("event_id", "symbol", "base"), grid, -bars, -1)
    v = F.col("volume")
    a = w.groupBy("event_id", "symbol").agg(F.max(F.when(F.col("offset") == -1, v)).alias("v"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.stddev_pop(v).alias("p"))
    return a.select("event_id", "symbol", F.try_divide(F.col("v") - F.col("m"), F.col("s")).alias("sample"), F.try_divide(F.col("v") - F.col("m"), F.col("p")).alias("population"))


def prior_price(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """Add ``prior_open``: the open exactly ``bars`` bars before the base, NULL if that bar is missing."""
    prior = grid.select("symbol", (F.col("bar") + bars).alias("base"), F.col("open").alias("prior_open"))
    return events.join(prior, ["symbol", "base"], "left")


def range_before(events: DataFrame, grid: DataFrame, bars: int) -> DataFrame:
    """(event_id, symbol, range_share, log_return): span of the extremes of the ``bars`` bars before the base over the base's open, and the log of the
    base's open over the open ``bars`` bars before; NULL without the base bar or a positive open."""
    w = window_bars(events.select("event_id", "symbol", "base"), grid, -bars, 0)
    o = F.col("offset")
    a = w.groupBy("event_id", "symbol").agg(
        F.max(F.when(o < 0, F.col("high"))).alias("hi"), F.min(F.when(o < 0, F.col("low"))).alias("lo"), F.max(F.when(o == 0, F.col("open"))).alias("now"), F.max(F.when(o == -bars, F.col("open"))).alias("old"))
    positive = (F.col("now") > 0) & (F.col("old") > 0)
    return a.select("event_id", "symbol", F.when(F.col("now") > 0, (F.col("hi") - F.col("lo")) / F.col("now")).alias("range_share"), F.when(positive, F.ln(F.when(positive, F.col("now") / F.col("old")))).alias("log_return"))


def volatility_regime(rows: DataFrame, value: str, train: Column) -> DataFrame:
    """Add ``regime``: high or low by the median of the training rows; NULL where the value is."""
    m = quantiles(rows.where(train), [], value, [0.5]).select(F.col("q")[0].alias("_m"))
    return rows.join(F.broadcast(m), how="left").withColumn("regime", F.when(F.col(value) > F.col("_m"), "high").when(F.col(value).isNotNull(), "low")).drop("_m")  # one row


def regime(value: Column, band: float, names: tuple[str, str, str] = ("down", "flat", "up")) -> Column:
    """Name of a value below, within or above a band around zero; the border belongs to the middle."""
    return F.when(value < -band, names[0]).when(value > band, names[2]).when(value.isNotNull(), names[1])


def crowding(price_step: Column, interest_step: Column, ratio: Column, high: float = 1.2, low: float = 0.8) -> dict[str, Column]:
    """Flags of one-sided positions: the quadrant of price and interest, and a ratio beyond its limits; NULL where an input is."""
    return {
        "quadrant": F.concat(F.when(price_step >= 0, "up").otherwise("down"), F.lit("_"), F.when(interest_step >= 0, "building").otherwise("leaving")),
        "crowded_long": ratio > high, "crowded_short": ratio < low,
    }
