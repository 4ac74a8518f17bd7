"""Pairing records of two tables by nearest time for the same entity.

Method: the rows of both sides, in the order of entity and time, are cut into shards of bounded size. A shard holds a piecewise-linear learned
index from time to position with a proven error bound; a probe is looked up by predicting its position and searching only within the
bound. Shards overlap at their edges by one record on either side, so a probe needs exactly one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.cut import cut

#: Largest distance between predicted and true position in an index.
ERROR = 32
#: Rows of both sides that one shard should hold.
SHARD_ROWS = 50_000


def fit_segments(times: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy piecewise-linear fit of position over sorted distinct ``times``: (first time, slope, first position) of each segment.

    Shrinking cone: a segment grows while one slope through its first point keeps every point within ``error`` positions. The growth is
    tested in doubling steps, so the fit takes vectorised passes instead of a Python step for each row.
    """
    n, start = len(times), 0
    keys, slopes, firsts = [], [], []
    while start < n:
        size, low, high, end = 256, -np.inf, np.inf, start + 1
        while end < n:
            stop = min(n, end + size)
            dx = (times[end:stop] - times[start]).astype(np.float64)
            dy = np.arange(end - start, stop - start, dtype=np.float64)
            lo = np.maximum.accumulate(np.maximum((dy - error) / dx, low))
            hi = np.minimum.accumulate(np.minimum((dy + error) / dx, high))
            bad = np.flatnonzero(lo > hi)
            k = int(bad[0]) if len(bad) else stop - end
            if k:
                low, high = lo[k - 1], hi[k - 1]
            end += k
            if len(bad):
                break
            size *= 2
        keys.append(times[start])
        slopes.append(0.0 if end == start + 1 else (max(low, 0.0) + min(high, 1e18)) / 2)
        firsts.append(start)
        start = end
    return np.array(keys, dtype=np.int64), np.array(slopes), np.array(firsts, dtype=np.int64)


def positions(probes: np.ndarray, times: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray], error: int = ERROR) -> np.ndarray:
    """For each probe the number of ``times`` less than or equal to it: predicted, then settled by binary search within the bound."""
    keys, slopes, firsts = index
    n = len(times)
    if not n:
        return np.zeros(len(probes), dtype=np.int64)
    seg = np.searchsorted(keys, probes, side="right") - 1
    at = np.maximum(seg, 0)
    ends = np.append(firsts[1:], n)
    guess = np.clip(firsts[at] + slopes[at] * (probes - keys[at]).astype(np.float64), firsts[at], ends[at]).astype(np.int64)
    lo = np.maximum(guess - error - 2, firsts[at])
    hi = np.minimum(guess + error + 2, ends[at])
    while np.any(open_ := lo < hi):  # all probes halve their own window at once
        mid = (lo + hi) // 2
        right = open_ & (times[np.minimum(mid, n - 1)] <= probes)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return np.where(seg < 0, 0, lo)


class Shard:
    """The right rows of a shard with the learned index over their times. times and ids come sorted by (time, id); of equal times only the
    first, with the smallest id, is kept."""

    def __init__(self, times: np.ndarray, ids: np.ndarray) -> None:
        first = np.append(True, times[1:] != times[:-1])[: len(times)]
        self.times, self.ids = times[first], ids[first]
        self.index = fit_segments(self.times)

    def nearest(self, probes: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
        """Which probes have a time within ``tolerance``, and the ids of the nearest ones; ties go to the smaller id."""
        t, i = self.times, self.ids
        if not len(t):
            return np.zeros(len(probes), dtype=bool), i[:0]
        p = positions(probes, t, self.index)
        before, after = np.maximum(p - 1, 0), np.minimum(p, len(t) - 1)
        far = np.iinfo(np.int64).max
        db = np.where(p > 0, probes - t[before], far)
        da = np.where(p < len(t), t[after] - probes, far)
        take_after = (da < db) | ((da == db) & (i[after] < i[before]))
        hit = np.minimum(da, db) <= tolerance
        return hit, i[np.where(take_after, after, before)][hit]


def nearest_time_join(left: DataFrame, right: DataFrame, tolerance_us: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(left_id, right_id) of the nearest right record for every left record that has one within the tolerance, bounds included.

    left: left_id, entity, t (microseconds); right: right_id, entity, t; other columns are ignored. Ties go to the smaller right_id.
    NULL ids, entities or times match nothing. Repeated left rows give one row for each distinct (left_id, entity, t).

    The rows of both sides together are cut by ranges of (entity, t, side, id) into shards of about ``shard_rows``, so a hot entity, a burst of
    records or of probes, or very many probes of one instant become many shards, and small entities share one. Each entity of a shard
    also gets the last instant before the shard and the first after it, which are all that a probe in it can need from outside.
    """
    keep = ["entity", "t"]
    l = left.select("left_id", *keep).dropna().distinct()  # noqa: E741
    # One row an instant and entity: pre-aggregated before the shuffle, and no entity's copies of an instant can pile up.
    r = right.select("right_id", *keep).dropna().groupBy("entity", "t").agg(F.min("right_id").alias("right_id"))
    both = cut(l.select("entity", "t", F.lit(1).alias("side"), F.col("left_id").alias("id")).unionByName(r.select("entity", "t", F.lit(0).alias("side"), F.col("right_id").alias("id"))))
    shards = max(1, -(-both.count() // shard_rows))
    # The number of the range is written down, so it stays the same however often the shards are read.
    placed = cut(both.repartitionByRange(shards, "entity", "t", "side", "id").withColumn("shard", F.spark_partition_id()))
    instant = F.when(F.col("side") == 0, F.struct("t", "id"))
    ends = placed.groupBy("entity", "shard").agg(F.min(instant).alias("a"), F.max(instant).alias("z"))
    along = Window.partitionBy("entity").orderBy("shard")  # one row for each shard of an entity
    before = F.last("z", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("a", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    edges = ends.withColumns({"before": before, "after": after}).select("entity", "shard", F.explode(F.array("before", "after")).alias("e")).where("e IS NOT NULL")
    whole = placed.unionByName(edges.select("entity", "e.t", F.lit(0).alias("side"), "e.id", "shard"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times, ids, ready = None, [], [], None  # the right rows of the open entity and shard, in order; its left rows follow them
        for b in batches:
            if not len(b):
                continue
            entity, shard, side, t, i = (b[c].to_numpy() for c in ("entity", "shard", "side", "t", "id"))
            new = np.append(True, (entity[1:] != entity[:-1]) | (shard[1:] != shard[:-1]))
            bounds = np.append(np.flatnonzero(new), len(b))
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if key != (entity[s], shard[s]):
                    key, times, ids, ready = (entity[s], shard[s]), [], [], None
                turn = s + int((side[s:e] == 0).sum())
                if turn > s:
                    times.append(t[s:turn])
                    ids.append(i[s:turn])
                if turn < e and times:
                    ready = ready or Shard(np.concatenate(times), np.concatenate(ids))
                    hit, found = ready.nearest(t[turn:e], tolerance_us)
                    out.append(pd.DataFrame({"left_id": i[turn:e][hit], "right_id": found}))
            if out:
                yield pd.concat(out)

    return whole.repartition("shard").sortWithinPartitions("shard", "entity", "side", "t", "id").mapInPandas(probe, "left_id bigint, right_id bigint")
