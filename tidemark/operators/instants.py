"""Written publication times to UTC instants, with zones estimated from ingestion times.

Method: a local time without a zone is aligned with the time the row was ingested. Every candidate zone gives each day an
offset, so a zone is an offset history; the history with the fewest and smallest violations (times after ingestion, or long before it)
is the site's, over all its time and, where a period clearly differs, within the period. A declared zone is the prior and is only overturned
by clear evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import from_micros, read_clock, to_micros, wall_to_utc
from tidemark.plans.cut import cut, small

#: Zones tried for a site, beside those declared for any site; one for each usual offset history.
CANDIDATES = (
    "UTC", "America/Los_Angeles", "America/Denver", "America/Chicago", "America/New_York", "America/Halifax", "America/Sao_Paulo", "Europe/London",
    "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Dubai", "Asia/Karachi", "Asia/Kolkata", "Asia/Dhaka", "Asia/Bangkok", "Asia/Singapore",
    "Asia/Tokyo", "Australia/Adelaide", "Australia/Sydney", "Pacific/Auckland", "Pacific/Honolulu",
)

#: Days of a period for which a site without a declared zone may have a zone of its own, and the hours a row by which it must be cheaper.
PERIOD_DAYS, PERIOD_MARGIN_H = 91, 2.0
#: Quarter hours beyond which lags are not told apart.
FAR_QUARTERS = 200
#: Hours a violation costs, and the most that a long wait for ingestion costs.
VIOLATION_H, WAIT_H = 24.0, 24.0
#: A declared zone is given up when another costs this many hours less a row, over at least so many rows.
MARGIN_H, MARGIN_ROWS = 1.0, 50


def period_of(day: Column) -> Column:
    """Number of the period that holds a day."""
    return F.floor(F.unix_date(day) / PERIOD_DAYS).cast("int")


def hours_east(zone: Column, day: Column) -> Column:
    """Hours that a zone is ahead of UTC at noon of a day."""
    noon = day.cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    return (F.unix_date(day).cast("bigint") * 86_400_000_000 + 43_200_000_000 - to_micros(F.convert_timezone(zone, F.lit("UTC"), noon))) / F.lit(3_600_000_000.0)


def offset_history_cost(lag_quarters: Column, east: Column) -> Column:
    """Hours that one row costs. lag_quarters: quarter hours from the wall time, taken as UTC, to ingestion; east: the zone's hours on that day."""
    lag = lag_quarters / F.lit(4.0) + east
    return F.when(lag < 0, F.lit(VIOLATION_H)).otherwise(F.least(lag, F.lit(WAIT_H)))


def _cheapest(costs: DataFrame, keys: list[str], prior: str, margin: float = MARGIN_H) -> DataFrame:
    """(keys, prior, found, cost, rows): the zone with the least cost of each key; the prior stands unless another costs ``margin`` less a row over
    at least ``MARGIN_ROWS`` rows. Ties: UTC, then the earlier name.
    """
    per = costs.groupBy(*keys, prior, "zone").agg((F.sum("cost") / F.sum("n")).alias("cost"), F.sum("n").alias("rows"))
    best = per.groupBy(*keys, prior).agg(
        F.min(F.struct("cost", (F.col("zone") != "UTC").alias("far"), "zone")).alias("b"), F.max("rows").alias("rows"), F.min(F.when(F.col("zone") == F.col(prior), F.col("cost"))).alias("own"))
    keep = F.col("own").isNotNull() & ((F.col("own") - F.col("b.cost") <= margin) | (F.col("rows") < MARGIN_ROWS))
    return best.select(*keys, prior, F.when(keep, F.col(prior)).otherwise(F.col("b.zone")).alias("found"), F.when(keep, F.col("own")).otherwise(F.col("b.cost")).alias("cost"), "rows")


def estimate_zones(walls: DataFrame, declared: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """The offset history of each site: (site, period, zone, declared_zone, cost, rows); period NULL holds wherever no other row does.

    walls: (site, wall TIMESTAMP_NTZ, fetched TIMESTAMP_NTZ in UTC), declared: (site, home_zone). Rows are first counted by site, day and
    quarter hours of lag, so what is tried against the candidates grows with sites and days, not with rows. The zone of a site over all its time
    has the declared zone as its prior. A declared zone is that of all times; of a site without one, a period of ``PERIOD_DAYS`` days has the zone
    over all time as its prior and a row of its own only where another zone is clearly cheaper, as when the site has moved. Ties: the prior, then UTC, then the earlier candidate by name. Sites
    without rows keep the declared zone; sites with neither get UTC.
    """
    lag = F.floor((to_micros(F.col("fetched")) - to_micros(F.col("wall"))) / F.lit(900_000_000)).cast("int")
    # Beyond 50 hours a row costs the same in every zone, whatever its day, so it counts on the day it was ingested: days are days of ingestion.
    counted = (
        walls.where(F.col("wall").isNotNull() & F.col("fetched").isNotNull() & F.col("site").isNotNull())
        .select("site", F.to_date(F.when(F.abs(lag) < FAR_QUARTERS, F.col("wall")).otherwise(F.col("fetched"))).alias("day"), F.greatest(F.lit(-FAR_QUARTERS), F.least(F.lit(FAR_QUARTERS), lag)).alias("lag"))
        .groupBy("site", "day", "lag").agg(F.count("*").alias("n"))
    )
    known = declared.where(F.col("home_zone").isNotNull()).groupBy("site").agg(F.min("home_zone").alias("declared_zone"))
    counted = cut(counted)
    # The offset history of every candidate, by day. There are some hundreds of zone names, however many sites declare them.
    zones = sorted({*candidates, *(r["declared_zone"] for r in known.select("declared_zone").distinct().collect())})
    history = counted.select("day").distinct().select("day", F.explode(F.array(*[F.lit(z) for z in zones])).alias("zone"))
    history = cut(history.select("day", "zone", hours_east(F.col("zone"), F.col("day")).alias("east")))
    tried = counted.join(small(history), "day").join(small(known), "site", "left")
    cost = F.sum(offset_history_cost(F.col("lag"), F.col("east")) * F.col("n"))
    costs = cut(tried.groupBy("site", "declared_zone", period_of(F.col("day")).alias("period"), "zone").agg(cost.alias("cost"), F.sum("n").alias("n")))
    always = known.join(_cheapest(costs, ["site"], "declared_zone").drop("declared_zone"), "site", "full")
    always = cut(always.select("site", F.lit(None).cast("int").alias("period"), F.coalesce("found", "declared_zone").alias("zone"), "declared_zone", "cost", "rows"))
    open_ = costs.where("declared_zone IS NULL").join(small(always.select("site", F.col("zone").alias("usual"))), "site")
    within = _cheapest(open_, ["site", "period", "declared_zone"], "usual", PERIOD_MARGIN_H).where("found <> usual")
    return always.unionByName(within.select("site", "period", F.col("found").alias("zone"), "declared_zone", "cost", "rows"))


_READ = "time_id bigint, site string, fetched_us bigint, kind string, value bigint, offset int"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        said = [read_clock(r, bool(f) if f is not None and f == f else False, h) for r, f, h in zip(b["raw"], b["day_first"], b["home_zone"], strict=True)]
        hit = [x is not None for x in said]
        said = [x for x in said if x is not None]
        out = b.loc[hit, ["time_id", "site", "fetched_us"]]
        yield out.assign(
            kind=pd.array([x[0] for x in said], dtype=object), value=pd.array([x[1] for x in said], dtype="Int64"), offset=pd.array([x[2] for x in said], dtype="Int32"))


def resolve_instants(times: DataFrame, sites: DataFrame) -> DataFrame:
    """(time_id, utc_micros) for every row whose ``raw`` denotes an instant not later than ``fetched_at``; rows are distinct.

    times: time_id, site, raw, fetched_at; sites: site, home_zone, day_first; other columns are ignored. NULL or empty ``raw`` and texts
    without a possible time give no row. A row without ``fetched_at`` gives no row for a told distance and is not held against it otherwise.
    A site that is not in ``sites`` gets its estimated zone and month-first dates. Repeated rows give one row; a time_id whose rows differ
    gives one row for each instant.
    """
    dim = sites.groupBy("site").agg(F.min("home_zone").alias("home_zone"), F.min("day_first").alias("day_first"))
    t = times.select("time_id", "site", "raw", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us")).where(F.col("raw").isNotNull())
    read = cut(t.join(small(dim), "site", "left").mapInPandas(_read, _READ))
    local = read.where((F.col("kind") == "wall") & F.col("offset").isNull())
    zones = cut(estimate_zones(local.select("site", from_micros(F.col("value")).alias("wall"), from_micros(F.col("fetched_us")).alias("fetched")), dim).select("site", "period", "zone"))
    usual = small(zones.where("period IS NULL").select("site", "zone"))
    moved = small(zones.where("period IS NOT NULL").select("site", F.col("period").alias("_period"), F.col("zone").alias("_zone")))
    # A column of its own, so that the two conversions of a wall time are made once.
    told = read.withColumn("_period", F.when(F.col("kind") == "wall", period_of(F.to_date(from_micros(F.col("value"))))))
    placed = told.join(usual, "site", "left").join(moved, ["site", "_period"], "left").withColumn("utc", F.when(
        (F.col("kind") == "wall") & F.col("offset").isNull(), wall_to_utc(from_micros(F.col("value")), F.coalesce("_zone", "zone", F.lit("UTC")))))
    wall = F.coalesce(to_micros(F.col("utc")), F.col("value") - F.col("offset").cast("bigint") * 60_000_000)
    micros = F.when(F.col("kind") == "unix", F.col("value")).when(F.col("kind") == "ago", F.col("fetched_us") - F.col("value") * 1_000_000).otherwise(wall)
    return (
        placed.select("time_id", micros.alias("utc_micros"), "fetched_us")
        .where(F.col("utc_micros").isNotNull() & (F.col("fetched_us").isNull() | (F.col("utc_micros") <= F.col("fetched_us"))))
        .select("time_id", "utc_micros").distinct()
    )
