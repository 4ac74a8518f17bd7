"""Datasets without leakage: chronological splits, thresholds fitted on training rows, flags, labels and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import global_rank, quantiles

# Beginnings and parts of column names that may not be features.
FORBIDDEN_PREFIXES = ("return_", "abnormal_return_", "max_favorable", "max_adverse", "max_absolute", "realized_vol_", "volume_shock_", "target_", "future_", "post_")
FORBIDDEN_PARTS = ("future", "post_event", "reaction", "target", "mfe", "mae", "return_after", "outcome", "label")


def chronological_split(rows: DataFrame, t: str, ident: str, shares: list[tuple[str, float]]) -> DataFrame:
    """Add ``split``: rows in the order of time and id cut at floor(share * n), shares cumulated in floating point."""
    ranked = global_rank(rows, F.floor(F.col(t) / 86_400_000_000), [F.asc(t), F.asc(ident)], "_r").withColumn("_r", F.col("_r") - 1)
    n = rows.agg(F.count("*").alias("_n"))
    at, split = 0.0, F.lit(shares[-1][0])
    cuts = []
    for name, share in shares[:-1]:
        at += share
        cuts.append((name, at))
    for name, x in reversed(cuts):
        split = F.when(F.col("_r") < F.floor(F.col("_n").cast("double") * F.lit(x)), name).otherwise(split)
    return ranked.join(F.broadcast(n)).withColumn("split", split).drop("_r", "_n")


def event_split(rows: DataFrame, event: str, t: str, shares: list[tuple[str, float]]) -> DataFrame:
    """Add ``split`` by whole events, each at its earliest row's time."""
    firsts = rows.groupBy(event).agg(F.min(t).alias("_t"))
    s = chronological_split(firsts, "_t", event, shares).select(event, "split")
    return rows.join(s, event)


def folds(rows: DataFrame, t: str, ident: str, k: int) -> DataFrame:
    """Add ``fold`` 1..k in the order of time: parts of equal size, the first ones larger by one where n isn't divisible."""
    ranked = global_rank(rows, F.floor(F.col(t) / 86_400_000_000), [F.asc(t), F.asc(ident)], "_r")
    n = rows.agg(F.count("*").alias("_n"))
    q, m, r = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_r") - 1
    big = m * (q + 1)
    fold = F.when(r < big, F.floor(F.try_divide(r, q + 1))).otherwise(m + F.floor(F.try_divide(r - big, q))) + 1
    return ranked.join(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_r", "_n")


def train_quantile(rows: DataFrame, value: str, train: Column, q: float, name: str) -> DataFrame:
    """Add a quantile of the training rows to all rows."""
    found = quantiles(rows.where(train), [], value, [q]).select(F.col("q")[0].alias(name))
    # One row, or none without training rows.
    return rows.join(F.broadcast(found), how="left")


def one_hot(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Add a 0/1 column for each value; NULL has zeros throughout."""
    return rows.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def missing_flags(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_missing`` as 0/1; NaN is missing too."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({f"{c}_missing": (F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))).cast("int") for c in columns})


def direction(value: Column, band: float) -> Column:
    """UP above the band, DOWN below its negative, else NEUTRAL; NULL stays NULL."""
    return F.when(value > band, "UP").when(value < -band, "DOWN").when(value.isNotNull(), "NEUTRAL")


def strong(value: Column, threshold: float, inclusive: bool) -> Column:
    """Whether a move is strong; both conventions for a value on the threshold."""
    return F.abs(value) >= threshold if inclusive else F.abs(value) > threshold


def forbidden_features(columns: list[str]) -> list[str]:
    """Names among ``columns`` that would leak what comes after the event."""
    return [c for c in columns if c.lower().startswith(FORBIDDEN_PREFIXES) or any(p in c.lower() for p in FORBIDDEN_PARTS)]


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many they have; empty if a merge on the key is one to one."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def latest_success(rows: DataFrame, group: str, success: Column, ident: str) -> DataFrame:
    """One row per group: a successful one if there is any, of those the one with the largest id."""
    w = Window.partitionBy(group).orderBy(success.desc(), F.desc(ident))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def union_families(families: list[tuple[str, DataFrame]], schema: dict[str, str]) -> DataFrame:
    """Tables of different columns brought to one schema; missing columns are NULL, ``family`` names the origin."""
    parts = [df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()], F.lit(name).alias("family")) for name, df in families]
    return reduce(DataFrame.unionByName, parts)


def bucketed(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed interval between the edges that holds a value, from 1; NULL outside."""
    return reduce(lambda acc, k: F.when((value > edges[k]) & (value <= edges[k + 1]), k + 1).otherwise(acc), range(len(edges) - 1), F.lit(None).cast("int"))


def nested_folds(rows: DataFrame, t: str, ident: str, k: int = 5, first: float = 0.4, step: float = 0.1) -> DataFrame:
    """Rows once for each fold they take part in, with ``fold`` and ``part``: in fold j all before first + step * j train, the next step
    validates and the one after that evaluates."""
    ranked = global_rank(rows, F.floor(F.col(t) / 86_400_000_000), [F.asc(t), F.asc(ident)], "_r").join(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    at = (F.col("_r") - 1) / F.col("_n")
    f = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    edge = F.lit(first) + F.lit(step) * F.col("fold")
    part = F.when(at < edge, "train").when(at < edge + step, "validate").when(at < edge + 2 * step, "evaluate")
    return f.withColumn("part", part).where("part IS NOT NULL").drop("_r", "_n")


def missing_report(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, column, missing, n) of the named columns, in one aggregation."""
    a = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return a.unpivot([by, "n"], columns, "column", "missing")


def with_missing_token(rows: DataFrame, columns: list[str], token: str = "__missing__") -> DataFrame:
    """``rows`` with a token of its own for missing categories, so that encoders see them."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(token)) for c in columns})


def variants(rows: DataFrame, prefixes: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The projections of a dataset that hold the columns with any of the prefixes of a variant, in the order of the dataset."""
    return {name: rows.select(*[c for c in rows.columns if c.startswith(tuple(p))]) for name, p in prefixes.items()}


def top_lift(rows: DataFrame, score: str, ident: str, value: str, share: float) -> DataFrame:
    """(n, top_mean, lift): mean of the values of the best share of the rows by score (ties by the id), and its ratio to the mean of all."""
    there = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    day = -F.unix_date(F.col(score).cast("date")) if dict(rows.dtypes)[score] in ("date", "timestamp", "timestamp_ntz") else -F.floor(F.col(score))
    ranked = global_rank(there, day, [F.desc(score), F.asc(ident)], "_r")
    total = there.agg(F.ceil(F.count("*") * F.lit(share)).alias("_k"), F.avg(value).alias("_m"))
    top = ranked.crossJoin(F.broadcast(total)).where("_r <= _k")  # total is one row
    return top.agg(F.count("*").alias("n"), F.avg(value).alias("top_mean"), (F.avg(value) / F.first("_m")).alias("lift"))
