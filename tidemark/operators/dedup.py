"""Duplicates, grouping and selection of articles and events."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import previous, running
from tidemark.operators.windowed import expanded, meetings, met, runs, slices
from tidemark.plans.cut import cut, small

#: Microseconds of a day, the bucket of times.
DAY_US = 86_400_000_000


def earliest_of_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order, with ``group_size`` and ``reason`` ('only' or 'earliest')."""
    # The first of each group is cut before the shuffle (a group limit), and sizes are counted map-side, so a hot group costs no task its rows.
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_k = 1").drop("_k")
    sizes = rows.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.count("*").alias("group_size"))
    same = reduce(lambda x, y: x & y, [first[g].eqNullSafe(sizes[f"_g{k}"]) for k, g in enumerate(group)])
    j = first.join(sizes, same).drop(*[f"_g{k}" for k in range(len(group))])
    return j.withColumn("reason", F.when(F.col("group_size") == 1, "only").otherwise("earliest"))


def pairs_by_key(members: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """(a, b, reason): for each value of each key its smallest member with every other one; empty and NULL values tie nothing.

    A star, not all pairs: a value with n members gives n - 1 rows, found with one map-side minimum and an equi-join.
    """
    parts = []
    for k in keys:
        m = members.select(F.col(ident).alias("b"), F.col(k).alias("v")).where("v IS NOT NULL AND v <> ''")
        first = m.groupBy("v").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("v", "a")
        parts.append(m.join(first, "v").where("a <> b").select("a", "b", F.lit(k).alias("reason")))
    return reduce(DataFrame.unionByName, parts).distinct()


def chained_pairs(members: DataFrame, ident: str, key: str, t: str, within: int) -> DataFrame:
    """(a, b) of neighbours in time with the same key that are at most ``within`` apart."""
    m = members.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key, F.col(t).alias("t"), F.col(ident).alias("b"))
    p = previous(m, F.floor(F.col("t") / DAY_US), ["t", "b"], [key], "_p")
    return p.where(F.col("t") - F.col("_p.t") <= within).select(F.col("_p.b").alias("a"), "b")


def islands(members: DataFrame, key: str, t: str, ident: str, within: int) -> DataFrame:
    """Add ``island``: rows of a key numbered by runs without a pause longer than ``within``."""
    day, order = F.floor(F.col(t) / DAY_US), [F.asc(t), F.asc(ident)]
    p = previous(members, day, [t, ident], [key], "_p").withColumn("_j", F.coalesce((F.col(t) - F.col(f"_p.{t}") > within).cast("int"), F.lit(0)))
    return running(p, day, order, "_j", "island", by=[key]).drop("_j", "_p")


def min_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): connected components by the smallest node, by passing on smallest labels and jumping along them.

    Each round is one aggregation with map-side minimum and one join, written to the checkpoint folder; jumping makes the rounds grow with the
    logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna().distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        stepped = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = stepped.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(stepped.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New rows none of whose keys is stored; NULL matches nothing."""
    for k in keys:
        new = new.join(stored.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti").select(*new.columns)
    return new


def first_by_any_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key's value, one key after another, as a list of seen values would if each key were checked in turn."""
    for k in keys:
        there = rows.where(F.col(k).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(k).orderBy(*order))).where("_k = 1").drop("_k")
        rows = there.unionByName(rows.where(F.col(k).isNull()))  # rows without the key are no group and need no order
    return rows


def upsert_changed(stored: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """All keys with the new row where it is new or its digest differs, else the stored one, and ``action``: insert, update or keep."""
    cols = [c for c in stored.columns if c != key]
    s = stored.select(key, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_s"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_n"))
    j = s.join(n, key, "full")
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_n").isNotNull() & ~F.col(f"_s_{digest}").eqNullSafe(F.col(f"_n_{digest}")), "update").otherwise("keep")
    return j.withColumn("action", action).select(key, *[F.when(F.col("action") == "keep", F.col(f"_s_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in cols], "action")


def history_similarity(rows: DataFrame, ident: str, t: str, tokens: str, days: int = 30, near_days: int = 7) -> DataFrame:
    """(id, max_near, similar_near, similar_all): likeness of each row's tokens to those of earlier rows.

    Token Jaccard against rows of the ``days`` before; the largest within ``near_days``, and how many reach 0.5 within either. Rows travel once
    with the hashes of their tokens to the cells of their time (``meetings``), where common tokens are counted; of pairs nothing but each
    row's figures leaves a task. An id has one row.
    """
    reach, near = days * DAY_US, near_days * DAY_US
    r = cut(rows.select(F.col(ident).alias("id"), F.col(t).alias("t"), F.array_distinct(tokens).alias("w")).where("t IS NOT NULL"))
    hashed = F.transform(F.filter("w", lambda x: x.isNotNull()), lambda x: F.xxhash64(x))
    x = r.where(F.size("w") > 0).select("id", "t", F.size("w").alias("n"), hashed.alias("w"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for left, right in met(batches):
            if right is None:
                here, index = left, _token_index(left["w"])
            yield _history(here, index, here if right is None else right, right is None, reach, near)

    kind = dict(r.dtypes)["id"]
    s = meetings(x, "id", "t", reach).mapInPandas(told, f"id {kind}, m double, k7 bigint, k30 bigint")
    g = s.groupBy("id").agg(F.max("m").alias("m"), F.sum("k7").alias("k7"), F.sum("k30").alias("k30"))
    zero = F.lit(0).cast("bigint")
    return r.select("id").join(g, "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("max_near"), F.coalesce("k7", zero).alias("similar_near"), F.coalesce("k30", zero).alias("similar_all"))


def _tokens(w: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of all rows' tokens."""
    count = np.array([len(x) for x in w], dtype=np.int64)
    return np.repeat(np.arange(len(count)), count), np.concatenate(w.tolist()).astype(np.int64)


def _token_index(w: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some rows in order, where the rows of each begin and how many they are, and the rows."""
    row, token = _tokens(w)
    known, which = np.unique(token, return_inverse=True)
    count = np.bincount(which, minlength=len(known))
    return known, np.cumsum(count) - count, count, row[np.argsort(which, kind="stable")]


def _history(a: pd.DataFrame, index: tuple, b: pd.DataFrame, same: bool, reach: int, near: int) -> pd.DataFrame:
    """(id, m, k7, k30) of the later row of each two of ``a`` (indexed) and ``b`` that share a token, over all of these."""
    known, start, count, rows = index
    row, token = _tokens(b["w"])
    at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
    hit = known[at] == token if len(known) else np.zeros(len(token), dtype=bool)
    row, at = row[hit], at[hit]
    first = np.searchsorted(row, np.arange(len(b) + 1))
    (ia, ta, na), (ib, tb, nb) = ([x[c].to_numpy() for c in ("id", "t", "n")] for x in (a, b))
    size = len(a)
    m, k7, k30 = (np.zeros((2, max(size, len(b))), dtype=k) for k in (np.float64, np.int64, np.int64))  # those of a, those of b
    for s, e in slices(size + np.bincount(row, count[at], len(b)).astype(np.int64), 4_000_000):
        part = slice(first[s], first[e])
        which, place = expanded(start[at[part]], count[at[part]])
        common = np.bincount((row[part] - s)[which] * size + rows[place], minlength=(e - s) * size)
        pair = np.flatnonzero(common)
        y, x = np.divmod(pair, size)
        y += s
        age = ta[x] - tb[y]
        ok = np.abs(age) <= reach
        if same:
            ok &= ia[x] < ib[y]
        pair, x, y, age = pair[ok], x[ok], y[ok], age[ok]
        c = common[pair]
        j = c / (na[x] + nb[y] - c)
        of_a = (age > 0) | ((age == 0) & (ib[y] < ia[x]))
        for k, (who, later) in enumerate(((x, of_a), (y, ~of_a))):
            if same and k:
                k = 0
            who, jj, close = who[later], j[later], np.abs(age[later]) <= near
            np.maximum.at(m[k], who[close], jj[close])
            k7[k] += np.bincount(who[close & (jj >= 0.5)], minlength=m.shape[1])
            k30[k] += np.bincount(who[jj >= 0.5], minlength=m.shape[1])
    sides = [(0, ia)] if same else [(0, ia), (1, ib)]
    out = [pd.DataFrame({"id": i, "m": m[k, : len(i)], "k7": k7[k, : len(i)], "k30": k30[k, : len(i)]}) for k, i in sides]
    out = pd.concat(out)
    return out[(out["m"] > 0) | (out["k30"] > 0)]


def alike_titles(rows: DataFrame, ident: str, tokens: str, least: float) -> DataFrame:
    """(a, b, j): pairs of rows whose distinct tokens have a Jaccard of at least ``least``, by prefix filter. An id has one row.

    Tokens are put in the order of their rarity. Of two sets of which at least c tokens must be common, both have the first two common ones
    among their first n - c + 2, so they are joined on these two; where one common token may be enough, on the first of n - c + 1. A pair
    meets under all that it shares but is kept only under its first, and is verified where it meets, so no pairs are shuffled.
    """
    r = rows.select(F.col(ident).alias("id"), F.array_distinct(tokens).alias("w")).where(F.size("w") > 0)
    x = r.select("id", F.explode("w").alias("w"))
    rarity = cut(x.groupBy("w").agg(F.count("*").alias("df")))
    ordered = x.join(small(rarity), "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("w").alias("w")))).alias("s")).select("id", F.transform("s", lambda y: y["w"]).alias("w"))
    n, alone = F.size("w"), F.lit(0).cast("bigint")
    must = F.greatest(F.ceil(n * F.lit(least) - 1e-9).cast("int"), F.lit(1))
    two = F.slice("w", 1, F.least(n, n - must + 2))
    pairs = F.flatten(F.transform(two, lambda p, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda q: F.xxhash64(p, q))))
    one = F.when(must == 1, F.transform("w", lambda p: F.xxhash64(p, alone))).otherwise(F.array().cast("array<bigint>"))
    keyed = ordered.select("id", "w", F.explode(F.array_distinct(F.concat(pairs, one))).alias("key")).repartition("key")
    a, b = (keyed.select(F.col("id").alias(k), F.col("w").alias(f"w{k}"), "key") for k in ("a", "b"))
    na, nb, common = F.size("wa"), F.size("wb"), F.array_intersect("wa", "wb")
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.least(na, nb) >= F.greatest(na, nb) * F.lit(least) - 1e-9)).withColumn("common", common)
    c = F.size("common")
    under = F.xxhash64(F.col("common")[0], F.when(c > 1, F.try_element_at("common", F.lit(2))).otherwise(alone))
    return near.where(F.col("key") == under).select("a", "b", (c / (na + nb - c)).alias("j")).where(F.col("j") >= least)


def ledger(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``status``: 'stored:<key>' for the first key that is stored, else 'batch:<key>' for the first key whose value an earlier new row of the
    batch has, else 'new'. NULL and empty values match nothing; rows that are turned away turn nothing away themselves.

    ``order`` names columns, ascending; ties are settled by the rows' content. Which rows are new is found in rounds over all rows at once: a
    row that is the earliest undecided one with each of its values is new, the others with any of its values are turned away. Rounds grow with
    the longest chain of rows that hang on one another by different keys, usually a few.
    """
    settled = partial(cut, estimates=False)
    out = batch.withColumn("_id", F.monotonically_increasing_id())
    status = F.lit(None).cast("string")
    for k in reversed(keys):
        status = F.when(F.col(f"_s_{k}"), f"stored:{k}").otherwise(status)
    for k in keys:
        out = out.join(stored.select(F.col(k)).where(F.col(k).isNotNull() & (F.col(k) != "")).distinct().withColumn(f"_s_{k}", F.lit(True)), k, "left")
    rows = cut(out.select(*batch.columns, "_id", F.struct(*order, F.xxhash64(*batch.columns).alias("_h"), F.col("_id").alias("_i")).alias("_o"), status.alias("_status")))
    values = F.filter(F.array(*[F.struct(F.lit(j).alias("k"), F.col(k).cast("string").alias("v")) for j, k in enumerate(keys)]), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    every = settled(rows.where("_status IS NULL").select("_id", "_o", F.explode(values).alias("x")).select("_id", "_o", "x.k", "x.v"))
    open_, new = every, None
    while open_.limit(1).count():
        first = open_.groupBy("k", "v").agg(F.min("_o").alias("_m"))
        taken = open_.join(first, ["k", "v"]).groupBy("_id").agg(F.bool_and(F.col("_o") == F.col("_m")).alias("ok")).where("ok").select("_id")
        held = settled(open_.join(taken, "_id", "left_semi").select("k", "v", F.col("_o").alias("_by")))
        # A value is held by one new row, so this names every row that is decided now, new ones included.
        decided = open_.join(held.select("k", "v"), ["k", "v"], "left_semi").select("_id").distinct()
        open_, new = settled(open_.join(decided, "_id", "left_anti")), held if new is None else new.unionByName(held)
    if new is None:
        return rows.select(*batch.columns, F.coalesce("_status", F.lit("new")).alias("status"))
    away = every.join(new, ["k", "v"]).where(F.col("_by") < F.col("_o")).groupBy("_id").agg(F.min("k").alias("_k"))
    named = F.element_at(F.array(*[F.lit(f"batch:{k}") for k in keys]), F.col("_k") + 1)
    return rows.join(away, "_id", "left").select(*batch.columns, F.coalesce("_status", F.when(F.col("_k").isNotNull(), named), F.lit("new")).alias("status"))


def greedy_groups(rows: DataFrame, key: str, ident: str, t: str, tokens: str, within: int, least: float) -> DataFrame:
    """(key, id, group): rows of a key in the order of time join the first open group all of whose members are within ``within`` and have a
    token overlap (of the smaller set) of at least ``least`` with them; else they open one, named by its first id.

    The rule depends on order, so a key's rows stream through one task in order; only groups whose first member is still within reach are held.
    """
    r = rows.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(t).alias("t"), F.array_distinct(tokens).alias("w")).where("k IS NOT NULL AND t IS NOT NULL")
    sorted_rows = r.repartition("k").sortWithinPartitions("k", "t", "i")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, groups = None, []
        for b in batches:
            out = []
            for k, i, at, w in zip(b["k"], b["i"], b["t"], b["w"], strict=True):
                if k != now:
                    now, groups = k, []
                groups = [g for g in groups if at - g[1] <= within]
                mine = set(w)
                for g in groups:
                    if all(m and mine and len(mine & m) >= least * min(len(mine), len(m)) for m in g[2]):
                        g[2].append(mine)
                        break
                else:
                    g = (i, at, [mine])
                    groups.append(g)
                out.append((k, i, g[0]))
            yield pd.DataFrame(out, columns=["k", "i", "g"])

    kinds = dict(sorted_rows.dtypes)
    return sorted_rows.mapInPandas(assign, f"k {kinds['k']}, i {kinds['i']}, g {kinds['i']}").toDF(key, ident, "group")


def concentration(rows: DataFrame, group: str, entity: str) -> DataFrame:
    """(group, n, top_entity, share, warning): share of the most frequent entity of each group, the smaller name on a tie; warning above half."""
    per = rows.where(F.col(entity).isNotNull()).groupBy(group, entity).agg(F.count("*").alias("n"))
    top = per.groupBy(group).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.min(F.struct((-F.col("n")).alias("k"), F.col(entity).alias("e"))).alias("t"))
    return top.select(group, F.col("all").alias("n"), F.col("t.e").alias("top_entity"), (F.col("most") / F.col("all")).alias("share"), (F.col("most") * 2 > F.col("all")).alias("warning"))


def varying(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, column, values) of columns that should be the same within a group and aren't; NULL is a value."""
    aggs = [(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    wide = rows.groupBy(group).agg(*aggs)
    return wide.unpivot([group], columns, "column", "values").where("values > 1")


def _exits(t: np.ndarray, hold: int) -> np.ndarray:
    """For each of some sorted times, when the next one may come after the last that is accepted if this one is."""
    after = np.searchsorted(t, t + hold)
    out = t + hold
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            out[i] = out[after[i]]
    return out


def non_overlapping(rows: DataFrame, key: str, ident: str, t: str, hold: int, holds: int = 1000) -> DataFrame:
    """(key, id) accepted greedily in time: the next row of a key counts from ``hold`` after the last accepted one.

    Times are whole numbers; ties by the id; NULLs are left out. A key's time is cut into blocks of ``holds`` holds. A block is entered at one of
    its rows within the first hold or the first row after it, and for each of these it is worked out where the block is left; only those,
    about a thousandth of the rows, are followed key by key from block to block. Then each block accepts its rows by itself.
    """
    hold = max(hold, 1)
    block = F.floor(F.col("t") / (hold * holds)).cast("bigint")
    r = rows.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(t).alias("t")).dropna().withColumn("blk", block)
    r = cut(r.repartition("k", "blk").sortWithinPartitions("k", "blk", "t", "i"))
    kinds = dict(r.dtypes)

    def doors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, blk, b in runs(batches, ["k", "blk"]):
            times = np.unique(b["t"].to_numpy())
            first = np.searchsorted(times, blk * hold * holds + hold) + 1  # rows within the first hold, and the first after it
            yield pd.DataFrame({"k": k, "blk": blk, "t": times[:first], "leave": _exits(times, hold)[:first]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, free, entered = None, None, None, False
        for b in batches:
            out = []
            for k, blk, x, leave in zip(b["k"], b["blk"], b["t"], b["leave"], strict=True):
                if k != now:
                    now, at, free, entered = k, None, None, False
                if blk != at:
                    at, entered = blk, False
                if not entered and (free is None or x >= free):
                    out.append((k, blk, x))
                    free, entered = leave, True
            yield pd.DataFrame(out, columns=["k", "blk", "t"])

    entry = r.mapInPandas(doors, f"k {kinds['k']}, blk bigint, t bigint, leave bigint")
    entry = entry.repartition("k").sortWithinPartitions("k", "blk", "t").mapInPandas(follow, f"k {kinds['k']}, blk bigint, t bigint")
    # The row at which a block is entered comes with its rows, marked, so a block that is never entered accepts none.
    both = r.withColumn("door", F.lit(1)).unionByName(entry.select("k", F.lit(None).cast(kinds["i"]).alias("i"), F.col("t").cast(kinds["t"]), "blk", F.lit(0).alias("door")))

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, b in runs(batches, ["k", "blk"]):
            door = b["door"].to_numpy() == 0
            if not door.any():
                continue
            free, b = b["t"].to_numpy()[door][0], b[~door]
            times, keep, at = b["t"].to_numpy(), [], 0
            while (at := int(np.searchsorted(times, free))) < len(times):
                keep.append(at)
                free = times[at] + hold
            yield b.iloc[keep][["k", "i"]]

    done = both.repartition("k", "blk").sortWithinPartitions("k", "blk", "door", "t", "i").mapInPandas(accept, f"k {kinds['k']}, i {kinds['i']}")
    return done.toDF(key, ident)


def mapping_conflicts(rows: DataFrame, member: list[str], target: Column) -> DataFrame:
    """(member..., targets): members that map to more than one target; NULL targets are none."""
    return rows.groupBy(*member).agg(F.count_distinct(target).alias("targets")).where("targets > 1")


def stars(rows: DataFrame, ident: str, key: Column) -> DataFrame:
    """(a, b): links from the smallest id of each key to its other ids; NULL and empty keys link nothing."""
    keyed = rows.select(F.col(ident).alias("b"), key.alias("_k")).where("_k IS NOT NULL AND _k <> ''")
    return keyed.join(keyed.groupBy("_k").agg(F.min("b").alias("a"), F.count("*").alias("_n")).where("_n > 1"), "_k").where("a <> b").select("a", "b").distinct()
