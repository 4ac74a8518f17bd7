"""Releasing a table: contracts, merges, comparisons of versions and samples for review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import beside, quantiles


def contract_violations(rows: DataFrame, key: list[str], required: list[str], ranges: dict[str, tuple[float | None, float | None]], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """(check, violations): repeated keys, missing values, values out of range or not allowed; all row checks in one aggregation."""
    checks = {f"missing:{c}": F.col(c).isNull() for c in required}
    for c, (low, high) in ranges.items():
        bad = F.lit(False) if low is None else F.col(c) < low
        checks[f"range:{c}"] = bad if high is None else bad | (F.col(c) > high)
    checks |= {f"allowed:{c}": F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in (allowed or {}).items()}
    counted = rows.agg(*[F.count_if(t).alias(n) for n, t in checks.items()]).unpivot([], list(checks), "check", "violations")
    repeated = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("key:" + ",".join(key)).alias("check"), F.count("*").alias("violations"))
    return counted.unionByName(repeated)


def identity_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(status, n): keys in both tables, only in the old and only in the new."""
    j = old.select(F.col(key).alias("k"), F.lit(True).alias("o")).distinct().join(new.select(F.col(key).alias("k"), F.lit(True).alias("n")).distinct(), "k", "full")
    return j.groupBy(F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "missing").otherwise("both").alias("status")).agg(F.count("*").alias("n"))


def merge(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored table after an upsert by key: new rows win."""
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def differs(a: Column, b: Column, numeric: bool, tolerance: float = 1e-12) -> Column:
    """Whether two values differ; NULL equals NULL, numbers may differ by the tolerance, relative or absolute."""
    if not numeric:
        return ~a.eqNullSafe(b)
    close = F.abs(a - b) <= F.greatest(F.lit(tolerance), F.greatest(F.abs(a), F.abs(b)) * tolerance)
    return ~F.coalesce(close, a.isNull() & b.isNull())


def changed_cells(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old_value, new_value) of the cells that differ between two versions, for keys in both."""
    kinds = dict(old.dtypes)
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    cells = F.array_compact(F.array(*[
        F.when(differs(F.col(c), F.col(f"_n_{c}"), kinds[c] in ("double", "float")), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old_value"), F.col(f"_n_{c}").cast("string").alias("new_value"))) for c in columns
    ]))
    return old.select(key, *columns).join(n, key).select(key, F.explode(cells).alias("c")).select(key, "c.*")


def compared(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both versions of a long table by key, their difference, and whether the sign flipped."""
    j = old.select(*key, F.col(value).alias("old_value")).join(new.select(*key, F.col(value).alias("new_value")), key)
    d = F.col("new_value") - F.col("old_value")
    return j.withColumns({"difference": d, "flipped": F.coalesce(F.signum("old_value") * F.signum("new_value") < 0, F.lit(False))})


def magnitude(value: Column) -> Column:
    """Bucket of an absolute difference in percent."""
    a = F.abs(value)
    steps = [(0.0, "none"), (0.01, "up_to_0.01"), (0.1, "up_to_0.1"), (0.5, "up_to_0.5"), (1.0, "up_to_1"), (5.0, "up_to_5")]
    return reduce(lambda acc, s: F.when(a <= s[0], s[1]).otherwise(acc), reversed(steps), F.when(a.isNotNull(), "above_5"))


def comparison_summary(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Number, flips, mean, 95th and 99th percentile of the absolute difference: over all and by each dimension. Rows are exploded to the sets that
    they belong to, so that percentiles come from ranks by buckets."""
    kinds = dict(cells.dtypes)
    none = lambda d: F.lit(None).cast(kinds[d]).alias(d)
    sets = [F.struct(F.lit(k).alias("_set"), *[F.col(d).alias(d) if d == only else none(d) for d in dimensions]) for k, only in enumerate([None, *dimensions])]
    x = cells.select(F.explode(F.array(*sets)).alias("s"), F.abs("difference").alias("a"), "flipped").select("s.*", "a", "flipped")
    by = ["_set", *dimensions]
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("flipped").alias("flips"), F.avg("a").alias("mean_abs"))
    return beside(g, quantiles(x, by, "a", [0.95, 0.99]), by).select(*dimensions, "n", "flips", "mean_abs", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))


def extremes(rows: DataFrame, groups: list[str], value: str, ident: str, k: int) -> DataFrame:
    """The k largest and k smallest values of each group, with ``side`` and ``place``; ids ascending on a tie."""
    r = rows.where(F.col(value).isNotNull())
    parts = []
    for side, order in (("top", F.desc(value)), ("bottom", F.asc(value))):
        w = Window.partitionBy(*groups).orderBy(order, F.asc(ident))
        parts.append(r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])


def hash_order(ident: Column, salt: str) -> Column:
    """Order of a reproducible draw: hash of a salt and the id."""
    return F.sha2(F.concat(F.lit(salt + ":"), ident.cast("string")), 256)


def hash_sample(rows: DataFrame, strata: list[str], ident: str, salt: str, k: int) -> DataFrame:
    """The k first rows of each stratum in hash order: a sampling operator."""
    w = Window.partitionBy(*strata).orderBy(hash_order(F.col(ident), salt))
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= k)


def round_robin(rows: DataFrame, stratum: str, ident: str, k: int) -> DataFrame:
    """k rows taken in turn from each stratum, by id within it: the first of every stratum, then the second, and so on."""
    r = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(ident))).where(F.col("turn") <= k)
    return r.orderBy("turn", stratum).limit(k)


def pick(ident: Column, k: int) -> Column:
    """A reproducible number below k for an id."""
    return F.conv(F.substring(F.sha2(ident.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % k
