"""Profiles and checks of tables: features, distributions, shifts, lags and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import beside, quantiles


def long_form(rows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value): the named columns as DOUBLE rows."""
    return rows.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep or [], columns, "feature", "value")


def feature_quality(rows: DataFrame, columns: list[str], most_missing: float = 40.0) -> DataFrame:
    """One row per feature: counts, moments, quantiles, outliers beyond the 1st and 99th percentile, and the reason to remove it, if any.

    NaN counts as missing. All features go through one aggregation; outliers need a second pass against the broadcast percentiles.
    Percentiles come from ranks by buckets, so no task holds all values of a feature.
    """
    x = long_form(rows, columns).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    a = x.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.count_distinct("value").alias("unique"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    ).join(quantiles(x, ["feature"], "value", [0.01, 0.5, 0.99]), "feature", "left")
    top = x.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("k")).groupBy("feature").agg(F.max("k").alias("top"))
    j = x.join(F.broadcast(a.select("feature", "q")), "feature").groupBy("feature").agg(F.count_if((F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[2])).alias("outliers"))
    missing = (F.col("rows") - F.col("n")) * 100 / F.col("rows")
    reason = F.when(missing > most_missing, "missing").when(F.col("unique") <= 1, "constant").when(F.col("top") >= F.col("n") * 0.999, "near_constant")
    out = a.join(top, "feature", "left").join(j, "feature")
    return out.select("feature", "rows", "n", missing.alias("missing_pct"), "unique", "mean", "std", "least", "most", *[F.col("q")[k].alias(f"p{p}") for k, p in enumerate(("01", "50", "99"))], "outliers", reason.alias("removal_reason"))


def correlated_features(rows: DataFrame, columns: list[str], above: float = 0.9999) -> list[str]:
    """Features to drop, the right one of each pair whose correlation is above the limit, in the order of ``columns``; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else None
    drop: list[str] = []
    for a, b in pairs:
        v = r[f"{a}|{b}"]
        if v is not None and v == v and abs(v) > above and a not in drop and b not in drop:
            drop.append(b)
    return drop


def distribution(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Count, mean, median, deviation and outer percentiles of a value by groups."""
    a = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return beside(a, quantiles(rows, groups, value, [0.05, 0.25, 0.5, 0.75, 0.95]), groups).select(*groups, "n", "mean", "std", *[F.col("q")[k].alias(f"p{p}") for k, p in enumerate(("05", "25", "50", "75", "95"))])


def split_shift(rows: DataFrame, split: str, flag: Column, limit: float = 0.10) -> DataFrame:
    """Rate of a flag in each split, its distance from the training rate, and whether that is above the limit."""
    a = rows.groupBy(split).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))
    train = a.where(F.col(split) == "train").select(F.col("rate").alias("train_rate"))
    return a.join(F.broadcast(train)).select(split, "n", "rate", (F.col("rate") - F.col("train_rate")).alias("shift"), (F.abs(F.col("rate") - F.col("train_rate")) > limit).alias("unstable"))


def lag_audit(rows: DataFrame, group: str, minutes: Column) -> DataFrame:
    """Lags in minutes by group: known, negative, and of the others the 75th and 90th percentile and the share above 5, 15 and 60."""
    r = rows.select(group, minutes.alias("m")).where("m IS NOT NULL")
    ok = F.when(F.col("m") >= 0, F.col("m"))
    q = quantiles(r.where("m >= 0"), [group], "m", [0.75, 0.9])
    a = r.groupBy(group).agg(
        F.count("*").alias("known"), F.count_if(F.col("m") < 0).alias("negative"),
        *[(F.count_if(F.col("m") > x) * 100 / F.nullif(F.count(ok), F.lit(0))).alias(f"above_{x}") for x in (5, 15, 60)],
    )
    j = a.join(q.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left")
    return j.select(group, "known", "negative", F.col("q")[0].alias("p75"), F.col("q")[1].alias("p90"), *[f"above_{x}" for x in (5, 15, 60)])


def corrected_skew(value: str) -> Column:
    """Skewness with the small-sample correction; NULL below 3 values."""
    n = F.count(value).cast("double")
    return F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def nth_delay(rows: DataFrame, group: str, t: str, nth: int = 2) -> DataFrame:
    """Time from the first to the nth row of each group that has so many."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(t)))
    a = ranked.where(F.col("_k") <= nth).groupBy(group).agg(F.min(t).alias("a"), F.max(F.when(F.col("_k") == nth, F.col(t))).alias("b"))
    return a.where("b IS NOT NULL").select(group, (F.col("b") - F.col("a")).alias("delay"))


def series_coverage(rows: DataFrame, key: str, t: str, step: int) -> DataFrame:
    """Rows, duplicates and share of missing steps of each series between its first and last time."""
    a = rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(t).alias("times"), ((F.max(t) - F.min(t)) / step + 1).alias("expected"))
    return a.select(key, "rows", (F.col("rows") - F.col("times")).alias("duplicates"), ((1 - F.col("times") / F.floor("expected")) * 100).alias("missing_pct"))


def class_shares(rows: DataFrame, split: str, label: str, rare: float = 0.05) -> DataFrame:
    """(split, label, n, share, rare): how large each class is in each split, and whether it is rarer than ``rare``; NULL labels are none."""
    per = rows.where(F.col(label).isNotNull()).groupBy(split, label).agg(F.count("*").alias("n"))
    total = per.groupBy(F.col(split).alias("_s")).agg(F.sum("n").alias("_t"))
    share = F.col("n") / F.col("_t")
    return per.join(total, F.col(split).eqNullSafe(F.col("_s"))).select(split, label, "n", share.alias("share"), (share < rare).alias("rare"))
