"""Statistics: intervals, tests, corrections and metrics of classification and regression."""

from __future__ import annotations

import math
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidemark.operators.ordered import beside, global_rank, running

Z = 1.959963984540054


def wilson(wins: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval of a rate; NULL for no cases."""
    n = F.when(n > 0, n.cast("double"))
    p = wins / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    margin = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return centre - margin, centre + margin


def benjamini_hochberg(rows: DataFrame, p: str, ident: str, family: list[str] | None = None) -> DataFrame:
    """Add ``q``: p values adjusted for the false discovery rate within each family; NULL stays out. Ties by the id.

    Hypotheses are ordered by buckets of p, by size from 1/1024 on and by magnitude below, so neither a family nor the table is one task.
    """
    fam = family or []
    there = rows.where(F.col(p).isNotNull())
    bucket = F.when(F.col(p) >= 2.0**-10, F.floor(F.col(p) * 1024)).otherwise(F.floor(F.log2(F.greatest(F.col(p), F.lit(1e-300))) * 8))
    ranked = beside(global_rank(there, bucket, [F.asc(p), F.asc(ident)], "_k", by=fam), there.groupBy(*fam).agg(F.count("*").alias("_m")), fam)
    down = running(ranked.withColumn("_q", -F.col(p) * F.col("_m") / F.col("_k")), -bucket, [F.desc("_k")], "_q", "_best", largest=True, by=fam)
    return down.withColumn("q", F.least(F.lit(1.0), -F.col("_best"))).drop("_q", "_k", "_m", "_best")


def classification_metrics(rows: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro precision and F1, Matthews correlation and kappa, from one confusion count."""
    cell = {(a, p): F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).cast("double") for a in labels for p in labels}
    c = rows.agg(*[v.alias(f"{a}_{p}") for (a, p), v in cell.items()])
    at = lambda a, p: F.col(f"{a}_{p}")
    total = sum((at(a, p) for a in labels for p in labels), F.lit(0.0))
    hit = sum((at(a, a) for a in labels), F.lit(0.0))
    row = {a: sum((at(a, p) for p in labels), F.lit(0.0)) for a in labels}
    col = {p: sum((at(a, p) for a in labels), F.lit(0.0)) for p in labels}
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rec = {a: zero(F.try_divide(at(a, a), row[a])) for a in labels}
    pre = {a: zero(F.try_divide(at(a, a), col[a])) for a in labels}
    f1 = {a: zero(F.try_divide(2 * pre[a] * rec[a], pre[a] + rec[a])) for a in labels}
    mean = lambda d: sum(d.values(), F.lit(0.0)) / len(labels)
    cross = sum((row[a] * col[a] for a in labels), F.lit(0.0))
    r2, c2 = (sum((d[a] * d[a] for a in labels), F.lit(0.0)) for d in (row, col))
    mcc = zero(F.try_divide(hit * total - cross, F.sqrt((total * total - c2) * (total * total - r2))))
    expected = F.try_divide(cross, total * total)
    return c.select(
        total.cast("bigint").alias("n"), zero(F.try_divide(hit, total)).alias("accuracy"), mean(rec).alias("balanced_accuracy"), mean(pre).alias("precision_macro"), mean(f1).alias("f1_macro"),
        mcc.alias("mcc"), zero(F.try_divide(F.try_divide(hit, total) - expected, 1 - expected)).alias("kappa"),
    )


def average_ranks(rows: DataFrame, value: str, name: str, buckets: int = 4096) -> DataFrame:
    """Add the rank of a value, ties sharing their mean rank. Distinct values are counted first and ordered within equally wide buckets."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    counts = rows.groupBy(value).agg(F.count("*").alias("_c")).join(F.broadcast(ends))
    bucket = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets), F.lit(0))
    ranked = running(counts, bucket, [F.asc(value)], "_c", "_top").select(value, (F.col("_top") - (F.col("_c") - 1) / 2).alias(name))
    return rows.join(ranked, value)


def regression_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R squared, Pearson and Spearman correlation."""
    r = rows.select(F.col(actual).alias("y"), F.col(predicted).alias("x")).dropna()
    r = average_ranks(average_ranks(r, "y", "ry"), "x", "rx")
    e = F.col("y") - F.col("x")
    a = r.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), F.var_pop("y").alias("v"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    return a.select("n", "mae", "rmse", (1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"), "pearson", "spearman")


def normal_tail(z: Column) -> Column:
    """Two-sided chance of a standard normal number beyond |z|, by a rational approximation of the error function good to 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """(n1, n2, u, z): rank sum test of two groups, normal approximation without tie correction."""
    r = average_ranks(rows.select(F.col(value).alias("v"), first.alias("g")).where("v IS NOT NULL"), "v", "k")
    a = r.agg(F.count_if("g").cast("double").alias("n1"), F.count_if(~F.col("g")).cast("double").alias("n2"), F.sum(F.when(F.col("g"), F.col("k"))).alias("s"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    return a.select("n1", "n2", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)).alias("z"))


def group_comparison(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """(n1, n2, mean1, mean2, difference, effect, u, p): two groups compared: difference of means, the same in pooled deviations, and the two-sided
    rank sum test with correction for ties and continuity. One row; NULL values are left out.
    """
    r = average_ranks(rows.select(F.col(value).cast("double").alias("v"), first.alias("g")).where("v IS NOT NULL AND g IS NOT NULL"), "v", "k")
    ties = r.groupBy("v").agg(F.count("*").cast("double").alias("c")).agg(F.coalesce(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")), F.lit(0.0)).alias("ties"))
    in_, out = F.col("g"), ~F.col("g")
    a = r.agg(
        F.count_if(in_).cast("double").alias("n1"), F.count_if(out).cast("double").alias("n2"), F.avg(F.when(in_, F.col("v"))).alias("mean1"), F.avg(F.when(out, F.col("v"))).alias("mean2"),
        F.var_samp(F.when(in_, F.col("v"))).alias("v1"), F.var_samp(F.when(out, F.col("v"))).alias("v2"), F.sum(F.when(in_, F.col("k"))).alias("s"),
    ).crossJoin(ties)  # fmt: skip  (one row and one row)
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("s") - n1 * (n1 + 1) / 2
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), n - 2))
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread)
    return a.select("n1", "n2", "mean1", "mean2", (F.col("mean1") - F.col("mean2")).alias("difference"), F.try_divide(F.col("mean1") - F.col("mean2"), pooled).alias("effect"), u.alias("u"), normal_tail(z).alias("p"))


def trimmed_mean(rows: DataFrame, groups: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Mean without the floor(share * n) smallest and largest values of each group."""
    there = rows.where(F.col(value).isNotNull())
    # Groups are few and large here: each is ordered by buckets of its value, not in one task.
    n = there.groupBy(*groups).agg(F.count("*").alias("_n"))
    r = global_rank(there, F.floor(value), [F.asc(value)], "_k", by=groups).join(n, groups)
    t = F.floor(F.col("_n") * F.lit(share))
    return r.where((F.col("_k") > t) & (F.col("_k") <= F.col("_n") - t)).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(value).alias("trimmed_mean"))


@F.pandas_udf(DoubleType())
def binomial_greater(wins: pd.Series, n: pd.Series) -> pd.Series:
    """Exact chance of at least so many wins in n fair trials; 1 for none."""

    def tail(w: int, k: int) -> float:
        if k <= 0:
            return 1.0
        i = np.arange(w, k + 1)
        logs = np.array([lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) - k * log(2) for x in i])
        return float(min(1.0, np.exp(logs).sum()))

    return pd.Series([tail(int(w), int(k)) for w, k in zip(wins, n, strict=True)])


def hashed_uniform(*parts: Column) -> Column:
    """A number from 0 up to 1 that follows from the parts alone: 32 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(u: Column) -> Column:
    """How often a Poisson draw with mean 1 takes a row whose uniform number is ``u``: 0 to 7."""
    return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0)).cast("double")


#: Chances that a Poisson number with mean 1 is at most 0, 1, ... 6.
POISSON = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(7)]


def _interval(reps: DataFrame, group: list[str], value: str) -> DataFrame:
    return reps.groupBy(*group).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_q")).select(*group, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def cluster_bootstrap(rows: DataFrame, group: list[str], cluster: str, value: str, repeats: int = 500, seed: int = 7) -> DataFrame:
    """Mean of a value by group with a 95 % interval from resampling whole clusters.

    Clusters are summed up first. Instead of drawing clusters n times, each gets a Poisson(1) weight in every repeat from the hash of the
    seed, its id and the repeat; so repeats add up map-side, no group is gathered into one task, and the result can be told in SQL.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*group, cluster).agg(F.sum(value).cast("double").alias("_s"), F.count("*").cast("double").alias("_c"))
    drawn = sums.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_w", poisson_weight(hashed_uniform(F.lit(seed), F.col(cluster), F.col("_rep"))))
    reps = drawn.groupBy(*group, "_rep").agg(F.try_divide(F.sum(F.col("_s") * F.col("_w")), F.sum(F.col("_c") * F.col("_w"))).alias("_m"))
    return sums.groupBy(*group).agg((F.sum("_s") / F.sum("_c")).alias("mean"), F.count("*").alias("clusters")).join(_interval(reps, group, "_m"), group)


def bootstrap_mean(rows: DataFrame, group: list[str], ident: str, value: str, repeats: int = 500, seed: int = 7) -> DataFrame:
    """Mean of a value by group with a 95 % interval from resampling rows."""
    return cluster_bootstrap(rows, group, ident, value, repeats, seed).withColumnRenamed("clusters", "n")


def bootstrap_errors(rows: DataFrame, group: list[str], ident: str, actual: str, one: str, two: str, repeats: int = 500, seed: int = 7) -> DataFrame:
    """(group..., metric, estimate, low, high, better): how much smaller the mean absolute and root mean squared error of prediction ``two`` are
    than those of ``one``, with the interval over resampled rows and the share of repeats in which they are smaller.
    """
    e = rows.select(*group, F.col(ident).alias("_i"), *[(F.col(p) - F.col(actual)).alias(n) for p, n in ((one, "_a"), (two, "_b"))]).dropna(subset=["_a", "_b"])
    every = e.withColumn("_rep", F.explode(F.sequence(F.lit(-1), F.lit(repeats - 1))))
    w = F.when(F.col("_rep") < 0, F.lit(1.0)).otherwise(poisson_weight(hashed_uniform(F.lit(seed), F.col("_i"), F.col("_rep"))))
    total = lambda x: F.sum(x * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))
    a, b = F.col("_a"), F.col("_b")
    reps = every.withColumn("_w", w).groupBy(*group, "_rep").agg((total(F.abs(a)) - total(F.abs(b))).alias("mae"), (F.sqrt(total(a * a)) - F.sqrt(total(b * b))).alias("rmse"))
    long = reps.unpivot([*group, "_rep"], ["mae", "rmse"], "metric", "_v")
    drawn = long.where("_rep >= 0")
    seen = long.where("_rep < 0").select(*group, "metric", F.col("_v").alias("estimate"))
    better = drawn.groupBy(*group, "metric").agg(F.avg((F.col("_v") > 0).cast("double")).alias("better"))
    return seen.join(_interval(drawn, [*group, "metric"], "_v"), [*group, "metric"]).join(better, [*group, "metric"])


def permutation_difference(rows: DataFrame, block: str, value: str, first: Column, repeats: int = 500) -> DataFrame:
    """(difference, p): difference of means between two groups and its two-sided chance when whole blocks swap groups at random.

    In every repeat a block's label is kept or swapped by the hash of its id and the repeat; blocks are summed up first.
    """
    r = rows.select(F.col(block).alias("b"), F.col(value).cast("double").alias("v"), first.alias("g")).dropna()
    s = r.groupBy("b").agg(*[f(F.when(c, F.col("v"))).alias(n) for n, c, f in (("s1", F.col("g"), F.sum), ("c1", F.col("g"), F.count), ("s0", ~F.col("g"), F.sum), ("c0", ~F.col("g"), F.count))]).fillna(0.0)
    reps = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    swap = (F.col("rep") > 0) & (hashed_uniform(F.col("b"), F.col("rep")) >= 0.5)
    pick = lambda a, b: F.sum(F.when(swap, F.col(b)).otherwise(F.col(a)))
    d = reps.groupBy("rep").agg((F.try_divide(pick("s1", "s0"), pick("c1", "c0")) - F.try_divide(pick("s0", "s1"), pick("c0", "c1"))).alias("d"))
    seen = d.where("rep = 0").select(F.col("d").alias("difference"))
    return d.where("rep > 0").join(F.broadcast(seen)).groupBy("difference").agg(((F.count_if(F.abs("d") >= F.abs("difference")) + 1) / F.lit(repeats + 1.0)).alias("p"))


def cluster_label_test(rows: DataFrame, cluster: str, value: str, label: Column, repeats: int = 200) -> DataFrame:
    """(difference, p): difference of the means of labelled and other rows, and its two-sided chance when as many whole clusters are labelled at random.

    A cluster is labelled if one of its rows is. In every repeat clusters are ordered by the hash of their id and the repeat, and the first ones
    get the labels; clusters are summed up first, and a repeat is ordered in one task of one row a cluster.
    """
    s = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("b")).agg(F.sum(value).cast("double").alias("s"), F.count("*").cast("double").alias("c"), F.max(F.coalesce(label, F.lit(False)).cast("int")).alias("g"))
    reps = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    turn = F.row_number().over(Window.partitionBy("rep").orderBy(hashed_uniform(F.col("b"), F.col("rep")), "b"))
    few = F.sum("g").over(Window.partitionBy("rep"))
    drawn = reps.withColumn("x", F.when(F.col("rep") == 0, F.col("g") == 1).otherwise(turn <= few))
    side = lambda c: F.try_divide(F.sum(F.when(c, F.col("s"))), F.sum(F.when(c, F.col("c"))))
    d = drawn.groupBy("rep").agg((side(F.col("x")) - side(~F.col("x"))).alias("d"))
    seen = d.where("rep = 0").select(F.col("d").alias("difference"))
    return d.where("rep > 0").join(F.broadcast(seen)).groupBy("difference").agg(((F.count_if(F.abs("d") >= F.abs("difference")) + 1) / F.lit(repeats + 1.0)).alias("p"))  # one row
