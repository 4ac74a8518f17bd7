"""Connected components and leak-free splits.

Method: many seeds expand concurrently, breadth first, over hash-partitioned adjacency rows. Where the regions of two seeds touch, their
labels collide; the collisions form a smaller graph, which is merged in one task if its size allows, else expanded the same way again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.cut import BROADCAST_ROWS, cut

#: Breadth-first steps of every seed before colliding labels are merged.
HOPS = 2
#: Neighbours of a node beyond which its adjacency row is split over tasks.
HUB = 100_000
#: Collisions that one task merges by union-find; a larger graph of collisions is expanded again from its own seeds.
SMALL_GRAPH = 200_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, label) of a graph of bounded size; label is the smallest node."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    edges = pd.concat(parts, ignore_index=True)
    nodes, ids = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(ids[: len(edges)].tolist(), ids[len(edges) :].tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": nodes, "label": nodes[[root(x) for x in range(len(nodes))]]})


def _rank(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("h"), x.alias("v"))


def _joined(nodes: DataFrame, edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``nodes`` (node, ...) with their edges (a, b). The adjacency row of a hub lies in parts by the hash of the neighbour, each of which meets the hub."""
    if hubs is None:
        return nodes.join(edges, nodes.node == edges.a)
    parts = F.broadcast(hubs)
    laid = edges.join(parts.withColumnRenamed("hub", "a"), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)))
    met = nodes.join(parts.withColumnRenamed("hub", "node"), "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)))
    return met.drop("parts").join(laid.drop("parts").withColumnRenamed("part", "_part"), (F.col("node") == F.col("a")) & (F.col("part") == F.col("_part"))).drop("part", "_part")


def components(edges: DataFrame, hops: int = HOPS, hub: int = HUB) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is one of the nodes.

    Direction, repeated edges and loops don't matter; a row with a NULL end is ignored. A node that occurs only in a loop is its own
    component. Each pass costs a fixed number of shuffles and at least halves the nodes of every component, so passes grow with the
    logarithm of the largest one. A node of any degree is aggregated map-side and never gathered; a node with more than ``hub`` neighbours
    is joined with them in parts.
    """
    settled = partial(cut, estimates=False)
    both = edges.select("a", "b").dropna()
    both = settled(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total, current = None, both.where("a <> b")
    while True:
        near = settled(current.groupBy("a").agg(F.min(_rank(F.col("b"))).alias("least"), F.count("*").alias("n")))
        hubs = near.where(F.col("n") > hub).select(F.col("a").alias("hub"), F.ceil(F.col("n") / hub).alias("parts"))
        found = hubs.limit(BROADCAST_ROWS + 1).count()
        # So many hubs that they can't be broadcast have hub * BROADCAST_ROWS edges together; then none of them is a large share.
        hubs = hubs if 0 < found <= BROADCAST_ROWS else None
        # Seeds are the nodes whose hash is below those of all neighbours; the first hop is known from the same aggregation.
        reached = near.select(F.col("a").alias("node"), F.when(_rank(F.col("a")) < F.col("least"), F.col("a")).alias("label"))
        frontier = reached.where("label IS NOT NULL")
        for _ in range(hops):
            step = _joined(frontier, current, hubs).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("new"))
            merged = reached.join(step, "node", "left")
            merged = settled(merged.select("node", F.coalesce("label", "new").alias("label"), (F.col("label").isNull() & F.col("new").isNotNull()).alias("fresh")))
            frontier, reached = merged.where("fresh").select("node", "label"), merged.select("node", "label")
        # What no seed reached yet takes its least neighbour's side later, as a seed of the smaller graph.
        labels = reached.select("node", F.coalesce("label", "node").alias("label"))
        ends = _joined(labels, current.where("a < b"), hubs).select("b", F.col("label").alias("la"))
        ends = _joined(labels, ends.select(F.col("b").alias("a"), F.col("la").alias("b")).distinct(), hubs).select(F.col("b").alias("la"), F.col("label").alias("lb"))
        collided = settled(ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        small_graph = collided.count() <= SMALL_GRAPH
        if total is None:
            total = labels.select("node", F.col("label").alias("component"))
        else:
            total = settled(total.join(labels.withColumnsRenamed({"node": "component"}), "component", "left").select("node", F.coalesce("label", "component").alias("component")))
        if small_graph:
            kind = both.schema["a"].dataType.simpleString()
            merged = collided.coalesce(1).mapInPandas(_union_find, f"node {kind}, label {kind}")
            total = settled(total.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("label", "component").alias("component")))
            break
        current = settled(collided.union(collided.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    alone = both.where("a = b").select(F.col("a").alias("node")).distinct().join(total, "node", "left_anti")
    return total.unionByName(alone.withColumn("component", F.col("node")))


def plain_handle(handle: Column) -> Column:
    """A handle without outer blanks, leading ``@`` and case; NULL if that says nothing."""
    h = F.lower(F.trim(F.regexp_replace(F.trim(handle), r"^@", "")))
    return F.when((h != "") & (h != "n/a"), h)


def plain_key(key: Column) -> Column:
    """A key without outer blanks and case; NULL if blank."""
    k = F.lower(F.trim(key))
    return F.when(k != "", k)


def _numbered(keys: DataFrame) -> Column:
    """How to name a node by its key: by a hash of 64 bits, or by the key itself in case that two of ``keys`` (k) share a hash."""
    twice = keys.groupBy(F.xxhash64("k").alias("h")).agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y")
    return F.col("k") if twice.limit(1).count() else F.xxhash64("k")


def tied_rows(rows: DataFrame) -> DataFrame:
    """(row_id, component, event, author) of every row; rows tied by event or author, directly or through others, share the component.

    rows: row_id, event_id, author_handle; other columns are ignored; repeated rows count once. A row whose event and author both say
    nothing is a component of its own, which is NULL. Rows with a NULL row_id are dropped.
    """
    r = cut(rows.select("row_id", plain_key(F.col("event_id")).alias("event"), plain_handle(F.col("author_handle")).alias("author")).where("row_id IS NOT NULL").distinct())
    event, author = F.concat(F.lit("e:"), F.col("event")), F.concat(F.lit("a:"), F.col("author"))
    # A key that stands alone in its rows still needs a node, hence the loops.
    pairs = r.select(F.coalesce(event, author).alias("x"), F.coalesce(author, event).alias("y")).where("x IS NOT NULL")
    name = _numbered(pairs.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("k")))
    edges = pairs.withColumn("k", F.col("x")).withColumn("a", name).withColumn("k", F.col("y")).select("a", name.alias("b"))
    found = components(edges)
    keyed = r.withColumn("k", F.coalesce(event, author)).withColumn("node", F.when(F.col("k").isNotNull(), name)).drop("k")
    return keyed.join(found, "node", "left").select("row_id", "component", "event", "author")


def groups(rows: DataFrame) -> DataFrame:
    """(row_id, group_key) of the rows in groups of at least two row_ids; group_key: the smallest author of the group, else its event."""
    t = cut(tied_rows(rows).where("component IS NOT NULL"))
    named = t.groupBy("component").agg(F.coalesce(F.min("author"), F.min("event")).alias("group_key"), F.min("row_id").alias("x"), F.max("row_id").alias("y"))
    return t.select("component", "row_id").distinct().join(named.where("x <> y"), "component").select("row_id", "group_key")


#: Components above this share of all rows are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.001
#: Buckets of the hash order; their sizes are summed over in one task.
BUCKETS = 4096


def splits(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(row_id, split): every row in one of the splits named in ``shares``, in about those proportions, no component in two.

    Large components, of which there can be only ``1 / LARGE``, go one after another to the split that lacks most rows. The others follow
    in the order of their hash, and each split takes the stretch of that order which fills what it still lacks. The result depends only on
    the rows, not on partitioning. An empty table gives no rows.
    """
    lone = F.concat(F.lit("r:"), F.col("row_id"))
    t = cut(tied_rows(rows).select("row_id", F.coalesce(F.col("component").cast("string"), lone).alias("component")).distinct())
    sizes = cut(t.groupBy("component").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    whole = sum(shares.values())
    lack = {s: total * w / whole for s, w in shares.items()}
    placed = {}
    # Bounded: components above the share LARGE number at most 1 / LARGE.
    for r in sizes.where(F.col("n") > total * LARGE).orderBy(F.desc("n"), "component").collect():
        best = max(lack, key=lambda s: (lack[s], s))
        placed[r["component"]] = best
        lack[best] -= r["n"]
    rest = sum(max(x, 0.0) for x in lack.values()) or 1.0
    smalls = sizes.where(F.col("n") <= total * LARGE).withColumn("h", F.xxhash64("component")).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)))
    heads = smalls.groupBy("bucket").agg(F.sum("n").alias("m")).withColumn("head", F.sum("m").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    small_total = smalls.agg(F.sum("n")).first()[0] or 1
    run = Window.partitionBy("bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = smalls.join(F.broadcast(heads.select("bucket", F.coalesce("head", F.lit(0)).alias("head"))), "bucket").withColumn("mid", F.col("head") + F.sum("n").over(run) - F.col("n") / 2)
    edge, pick = 0.0, F.lit(max(lack, key=lambda s: (lack[s], s)))
    bounds = []
    for s, x in lack.items():
        edge += max(x, 0.0) / rest * small_total
        bounds.append((edge, s))
    for e, s in reversed(bounds):
        pick = F.when(F.col("mid") < e, F.lit(s)).otherwise(pick)
    chosen = at.select("component", pick.alias("split"))
    if placed:
        large = t.sparkSession.createDataFrame(list(placed.items()), "component string, split string")
        chosen = chosen.unionByName(large)
    return t.join(chosen, "component").select("row_id", "split").distinct()
