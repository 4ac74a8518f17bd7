"""Rows of neighbouring blocks brought together in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.cut import cut, small

#: Rows of a cell, about: a block of more is cut into several by the hash of the id.
CELL = 8192


def meetings(rows: DataFrame, ident: str, t: str, within: int, sided: bool = False, most: int = CELL) -> DataFrame:
    """Rows with ``blk``, ``p`` and ``cell``, partitioned by blk and p and sorted by all three, such that any two rows that are at most ``within``
    apart in time meet in exactly one (blk, p).

    Time is cut into blocks of ``within``, blocks into cells of about ``most`` rows. Cell 0 of (blk, p) is the cell itself, the others are the later
    cells of its block and all cells of the next one. With ``sided``, cell 0 has the rows of side 'a' only and the others are those of side 'b' of
    the block and of both blocks beside it; each side has cells of its own, so all that a row of side 'a' meets comes in one (blk, p). As long as
    no block has more than ``most`` rows (of side 'a'), a row is sent twice (three times on side 'b').
    """
    r = rows.withColumn("blk", F.floor(F.col(t) / max(within, 1)).cast("bigint"))
    first = F.col("side") == "a" if sided else F.lit(True)

    def cells(of: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(of) / most), F.lit(1)).cast("int")

    hot = cut(r.groupBy("blk").agg(cells(first).alias("n"), cells(~first).alias("m")).where("n > 1 OR m > 1"))
    hot = None if hot.isEmpty() else small(hot)

    def parts(x: DataFrame, beside: int) -> tuple[DataFrame, str]:
        name = f"_n{beside + 1}"
        if hot is None:
            return x.withColumn(name, F.lit(1)), name
        there = hot.select((F.col("blk") - beside).alias("blk"), F.col("n").alias(name))
        return x.join(there, "blk", "left").withColumn(name, F.coalesce(name, F.lit(1))), name

    r, n = parts(r, 0)
    if hot is None:
        r = r.withColumn("_p", F.lit(0))
    else:
        of = F.when(first, F.col(n)).otherwise(F.coalesce("_m", F.lit(1)))
        r = cut(r.join(hot.select("blk", F.col("m").alias("_m")), "blk", "left").withColumn("_p", F.pmod(F.xxhash64(ident), of).cast("int")).drop("_m"))

    def to(beside: int, p: Column, cell: Column) -> Column:
        return F.struct((F.col("blk") + beside).alias("blk"), p.cast("int").alias("p"), cell.cast("int").alias("cell"))

    def every(beside: int, n: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda p: to(beside, p, 2 + beside + 3 * F.col("_p")))

    none = F.array().cast("array<struct<blk: bigint, p: int, cell: int>>")
    self_ = F.array(to(0, F.col("_p"), F.lit(0)))
    r, before = parts(r, -1)
    if sided:
        r, after = parts(r, 1)
        sent = F.when(F.col("side") == "a", self_).otherwise(F.concat(every(-1, before), every(0, n), every(1, after)))
    else:
        later = F.when(F.col("_p") > 0, F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda p: to(0, p, 2 + 3 * F.col("_p")))).otherwise(none)
        sent = F.concat(self_, later, every(-1, before))
    out = r.withColumn("_to", F.explode(sent)).select("_to.*", *rows.columns)
    return out.repartition("blk", "p").sortWithinPartitions("blk", "p", "cell")


def met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | None]]:
    """What meets in a partition of ``meetings``: each cell alone (with None), then with each of the others."""
    own, at = None, None
    for blk, p, cell, b in runs(batches, ["blk", "p", "cell"]):
        if cell == 0:
            own, at = b, (blk, p)
            yield own, None
        elif at == (blk, p):
            yield own, b


def expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): all places start, start + 1, ... of each range, and which range they belong to."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]


def slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a sum of weights of about ``most``, one row at least."""
    ends = np.flatnonzero(np.diff(np.cumsum(weights) // most, append=-1)) + 1
    yield from zip([0, *ends[:-1].tolist()] if len(ends) else [], ends.tolist(), strict=True)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple]:
    """(key values..., rows) of each run of equal keys; rows come sorted by the keys, and a run may go over several batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        new = np.append(True, np.logical_or.reduce([b[c].to_numpy()[1:] != b[c].to_numpy()[:-1] for c in keys]))
        bounds = np.append(np.flatnonzero(new), len(b))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            part = b.iloc[s:e]
            if held and any(held[0][c].iloc[0] != part[c].iloc[0] for c in keys):
                yield *(held[0][c].iloc[0] for c in keys), pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield *(held[0][c].iloc[0] for c in keys), pd.concat(held)
