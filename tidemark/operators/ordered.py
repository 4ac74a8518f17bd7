"""Order without a single task: ranks, running sums, running extremes and neighbours by buckets, over all rows or within keys.

Most operators take a ``bucket`` that follows the order (for times, the day). Buckets are summed up first; only their totals, of which there
are as many as buckets, pass through one window for each key, and rows are ordered within their key and bucket. So neither the whole table nor
a hot key is ordered in one task. Name a finer bucket if one holds too many rows. Keys may be NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _before(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _join(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """The totals at every row of their key and bucket; NULL keys meet NULL keys."""
    t = totals.select(F.col("_b").alias("_b2"), *[F.col(c).alias(f"_2{k}") for k, c in enumerate(by)], *[c for c in totals.columns if c not in (*by, "_b")])
    same = reduce(lambda a, c: a & c, [df[c].eqNullSafe(t[f"_2{k}"]) for k, c in enumerate(by)], df["_b"].eqNullSafe(t["_b2"]))
    return df.join(t, same).drop("_b2", *[f"_2{k}" for k in range(len(by))])


def global_rank(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Add the 1-based position of each row in the order bucket, then ``order``, which should be total."""
    by = by or []
    d = df.withColumn("_b", bucket)
    ahead = d.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(_before(by)), F.lit(0))).drop("_n")
    return _join(d, ahead, by).withColumn(name, F.col("_ahead") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))).drop("_b", "_ahead")


def running(df: DataFrame, bucket: Column, order: list[Column], value: str, name: str, largest: bool = False, by: list[str] | None = None) -> DataFrame:
    """Add the running sum of a value in the order, or its running maximum; NULL counts as nothing."""
    by = by or []
    whole = F.max if largest else F.sum
    d = df.withColumn("_b", bucket)
    ahead = d.groupBy(*by, "_b").agg(whole(value).alias("_v")).withColumn("_ahead", whole("_v").over(_before(by))).drop("_v")
    here = whole(value).over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = _join(d, ahead, by)
    both = F.greatest(here, F.col("_ahead")) if largest else F.coalesce(here, F.lit(0)) + F.coalesce("_ahead", F.lit(0))
    return j.withColumn(name, both).drop("_b", "_ahead")


def previous(df: DataFrame, bucket: Column, order: list[str], by: list[str], name: str, forward: bool = False) -> DataFrame:
    """Add the struct of the ``order`` columns of the row before (or after) in the ascending order of these columns; NULL at the end."""
    d = df.withColumns({"_b": bucket, "_o": F.struct(*order)})
    ends = d.groupBy(*by, "_b").agg((F.min if forward else F.max)("_o").alias("_e"))
    far = (F.lead if forward else F.lag)("_e").over(Window.partitionBy(*by).orderBy("_b"))
    near = (F.lead if forward else F.lag)("_o").over(Window.partitionBy(*by, "_b").orderBy("_o"))
    return _join(d, ends.withColumn("_far", far).drop("_e"), by).withColumn(name, F.coalesce(near, "_far")).drop("_b", "_o", "_far")


def beside(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """The facts of its key at every row; NULL keys meet NULL keys, and without a key there is one row of facts."""
    if not by:
        return df.crossJoin(F.broadcast(facts))  # one row
    return _join(df.withColumn("_b", F.lit(0)), facts.withColumn("_b", F.lit(0)), by)


#: Rows whose quantiles one aggregation may hold; more go by buckets. Both ways give the same numbers.
DIRECT_ROWS = 500_000


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q", buckets: int = 256, direct: int = DIRECT_ROWS) -> DataFrame:
    """(by..., name): the exact quantiles of a value in each group, as an array of doubles, interpolated between neighbours; NULL values are left out.

    Up to ``direct`` rows are aggregated at once. Of more, equal values are counted first. Approximate quantiles then cut each group into buckets of about as many rows; only the totals of the
    buckets are ordered together, and only the buckets that hold a wanted position are ordered within. So no task holds the values of a group.
    """
    there = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if there.count() <= direct:
        found = there.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in shares])).alias(name), F.count("*").alias("_n"))
        return found.where("_n > 0").drop("_n")
    counts = there.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    cuts = F.percentile_approx("_v", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(20 * buckets))
    groups = there.groupBy(*by).agg(cuts.alias("_cuts"), F.count("*").alias("_n"))
    placed = beside(counts, groups, by).select(*by, "_v", "_c", "_n", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))).alias("_b"))
    totals = placed.groupBy(*by, "_b").agg(F.sum("_c").alias("_t"), F.max("_n").alias("_m"))
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_t").over(_before(by)), F.lit(0)))
    at = [F.lit(float(p)) * (F.col("_m") - 1) for p in shares]
    wanted = reduce(lambda a, c: a | c, [(F.ceil(x) >= F.col("_ahead")) & (F.floor(x) < F.col("_ahead") + F.col("_t")) for x in at])
    near = _join(placed, totals.where(wanted).drop("_t"), by) if by else placed.join(totals.where(wanted).drop("_t"), "_b")
    # _join takes the bucket away; the position before the bucket stands for it.
    up_to = F.col("_ahead") + F.sum("_c").over(Window.partitionBy(*by, "_ahead").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("_up", up_to).withColumn("_low", F.col("_up") - F.col("_c"))
    pick = lambda x: F.max(F.when((x >= F.col("_low")) & (x < F.col("_up")), F.col("_v")))
    ends = [pick(f(x)).alias(f"_{e}{k}") for k, x in enumerate(at) for e, f in (("f", F.floor), ("c", F.ceil))]
    found = near.groupBy(*by).agg(F.max("_n").alias("_m"), *ends)
    part = [x - F.floor(x) for x in at]
    return found.select(*by, F.array(*[F.col(f"_f{k}") * (1 - part[k]) + F.col(f"_c{k}") * part[k] for k in range(len(shares))]).alias(name))
