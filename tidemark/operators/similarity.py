"""TF-IDF likeness of short texts: vectors, lossless candidate search, nearest neighbours and ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.identity import text_key
from tidemark.operators.windowed import CELL, expanded, meetings, met, slices
from tidemark.plans.cut import cut


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of a text's key, with a blank before and behind."""
    t = F.concat(F.lit(" "), text_key(text), F.lit(" "))

    def of_length(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, every).otherwise(F.array().cast("array<string>"))

    parts = [of_length(n) for n in range(low, high + 1)]
    return F.concat(*parts)


def word_grams(text: Column) -> Column:
    """Words and pairs of neighbouring words of a text's key."""
    w = F.filter(F.split(text_key(text), " "), lambda x: x != "")
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def tfidf(rows: DataFrame, ident: str, grams: Column) -> DataFrame:
    """(id, gram, w, idf): unit vectors with weights tf * (ln((1 + n) / (1 + df)) + 1). Texts without grams have none."""
    tf = cut(rows.select(F.col(ident).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf")))
    n = F.broadcast(tf.agg(F.count_distinct("id").alias("n")))
    idf = tf.groupBy("gram").agg(F.count("*").alias("df")).join(n).select("gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"), "idf")


def alike_pairs(vectors: DataFrame, times: DataFrame, least: float, within_us: int, sides: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine): pairs of ids with a cosine of at least ``least`` whose times are at most ``within_us`` apart; a < b, or a and b on the
    sides 'a' and 'b' of ``sides`` (id, side).

    Grams are put in the order of their rarity. A vector's prefix ends where the rest is shorter than ``least``; the first gram that an alike
    pair shares lies in both prefixes, so only prefixes are joined, by gram and block of time, and no pair is lost. Candidates are then
    computed on whole vectors.
    """
    w = Window.partitionBy("id").orderBy(F.asc("idf"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.coalesce(F.sum(F.col("w") * F.col("w")).over(w), F.lit(0.0))
    # Counted from the most frequent gram on: a gram is in the prefix if what comes after it, itself included, could still be enough.
    prefix = vectors.withColumn("rest", rest).where(F.sqrt(F.col("rest") + F.col("w") * F.col("w")) >= least - 1e-9).select("id", "gram")
    p = cut(prefix.join(times.select("id", "t"), "id").withColumn("blk", F.floor(F.col("t") / max(within_us, 1))))
    if sides is not None:
        p = p.join(sides, "id")
    one = p if sides is None else p.where("side = 'a'")
    two = p if sides is None else p.where("side = 'b'")
    a = one.select(F.col("id").alias("a"), F.col("t").alias("ta"), "gram", F.explode(F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1)).alias("blk"))
    b = two.select(F.col("id").alias("b"), F.col("t").alias("tb"), "gram", "blk")
    order = F.col("a") < F.col("b") if sides is None else F.lit(True)
    met = a.join(b, ["gram", "blk"]).where(order & (F.abs(F.col("ta") - F.col("tb")) <= within_us)).select("a", "b").distinct()
    va, vb = (vectors.select(F.col("id").alias(k), "gram", F.col("w").alias(f"w{k}")) for k in ("a", "b"))
    dots = met.join(va, "a").join(vb, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return dots.where(F.col("cosine") >= least)


#: Grams of a text: the rows they stand in and their codes.
Codes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def char_codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``char_grams`` of text keys as (row, code); a gram of 37 letters is told exactly by its code."""
    size = np.array([len(k) + 2 if k else 0 for k in keys], dtype=np.int64)
    raw = np.frombuffer("".join(f" {k} " for k in keys if k).encode(), dtype=np.uint8).astype(np.int64)
    letter = np.where(raw == 32, 0, np.where(raw >= 97, raw - 96, raw - 21))  # blank, a-z, 0-9
    row, left = np.repeat(np.arange(len(keys)), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    rows, codes, base = [], [], 0
    for n in range(3, 6):
        code = np.zeros(max(len(letter) - n + 1, 0), dtype=np.int64)
        for k in range(n):
            code = code * 37 + letter[k : k + len(code)]
        whole = left[: len(code)] >= n
        rows.append(row[: len(code)][whole])
        codes.append(code[whole] + base)
        base += 37**n
    return np.concatenate(rows), np.concatenate(codes)


def word_codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_grams`` of text keys as (row, code), a hash of 64 bits."""
    words = [k.split() for k in keys]
    row = np.repeat(np.arange(len(keys)), [len(w) for w in words])
    h = pd.util.hash_array(np.array([x for w in words for x in w], dtype=object), categorize=False).view(np.uint64)
    pair = np.flatnonzero(row[1:] == row[:-1])
    x = h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([row, row[pair]]), np.concatenate([h, x ^ (x >> np.uint64(32))]).view(np.int64)


class _Vectors:
    """Unit vectors of some texts as entries (row, gram, w), by row and from the most frequent gram on; grams of one text only count for its length."""

    def __init__(self, texts: list[str], grams: Codes, vocabulary: tuple[np.ndarray, np.ndarray, np.ndarray], total: int) -> None:
        known, rank, idf = vocabulary
        rows, ranks, weights = [], [], []
        for s in range(0, len(texts), 2000):
            row, code = grams(texts[s : s + 2000])
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            listed = known[at] == code if len(known) else np.zeros(len(code), dtype=bool)
            x, tf = np.unique(row[listed] * max(len(known), 1) + rank[at[listed]], return_counts=True)
            r, g = np.divmod(x, max(len(known), 1))
            w = tf * idf[g]
            one, which = np.unique(code[~listed], return_inverse=True)
            x, tf = np.unique(row[~listed] * max(len(one), 1) + which, return_counts=True)
            lone = tf * (np.log((1 + total) / 2) + 1)
            n = len(texts[s : s + 2000])
            norm = np.sqrt(np.bincount(r, w * w, n) + np.bincount(x // max(len(one), 1), lone * lone, n))
            rows.append(r + s)
            ranks.append(g)
            weights.append(w / norm[r])
        self.row, self.gram, self.w = (np.concatenate(x) for x in (rows, ranks, weights))
        self.count = np.bincount(self.row, minlength=len(texts))
        self.start = np.cumsum(self.count) - self.count
        self.grams = len(known)

    def index(self, rest: float) -> None:
        """Postings of the rarest grams of each row, as many as leave a rest shorter than ``rest``; notes how long the rest is."""
        square = self.w * self.w
        before = np.cumsum(square) - square
        before = np.maximum(before - np.repeat(before[np.minimum(self.start, len(before) - 1)], self.count), 0) if len(before) else before
        prefix = np.sqrt(before + square) >= rest
        self.rest = np.sqrt(np.bincount(self.row[~prefix], square[~prefix], len(self.count)))
        order = np.argsort(self.gram[prefix], kind="stable")
        self.p_row, self.p_w = self.row[prefix][order], self.w[prefix][order]
        self.p_count = np.bincount(self.gram[prefix], minlength=self.grams)
        self.p_start = np.cumsum(self.p_count) - self.p_count
        self.entry = self.row * self.grams + self.gram

    def dots(self, own: np.ndarray, other: _Vectors, others: np.ndarray) -> np.ndarray:
        """Whole products of pairs of rows, here and in ``other``."""
        out = np.zeros(len(own))
        for s, e in slices(other.count[others], 2_000_000):
            which, at = expanded(other.start[others[s:e]], other.count[others[s:e]])
            want = own[s:e][which] * self.grams + other.gram[at]
            there = np.minimum(np.searchsorted(self.entry, want), len(self.entry) - 1)
            hit = self.entry[there] == want
            out[s:e] = np.bincount(which[hit], self.w[there[hit]] * other.w[at[hit]], e - s)
        return out

    def alike(self, other: _Vectors, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows here, rows of ``other``) of which the product may be ``least``: the product with the prefix, and at most the length of the rest."""
        n = len(self.count)
        need = least - 1e-9 - self.rest
        met_ = self.p_count[other.gram]
        cost = n + np.bincount(other.row, met_, len(other.count)).astype(np.int64)
        for s, e in slices(cost, 4_000_000):
            a, b = other.start[s], other.start[e - 1] + other.count[e - 1]
            which, at = expanded(self.p_start[other.gram[a:b]], met_[a:b])
            sums = np.bincount((other.row[a:b] - s)[which] * n + self.p_row[at], other.w[a:b][which] * self.p_w[at], (e - s) * n).reshape(e - s, n)
            there, here = np.nonzero(sums >= need)
            yield here, there + s


def _best(a: np.ndarray, cosine: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each a those that may be first in ``nearest``: as far as cosines differ by rounding only, the smallest b of each cosine."""
    order = np.lexsort((b, -cosine, a))
    a, cosine, b = a[order], cosine[order], b[order]
    new = np.append(True, a[1:] != a[:-1])[: len(a)]
    top = cosine[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))] if len(a) else cosine
    keep = (new | np.append(True, cosine[1:] != cosine[:-1])[: len(a)]) & (cosine >= top - 2e-9)
    return a[keep], cosine[keep], b[keep]


def alike_texts(rows: DataFrame, grams: Codes, least: float, within_us: int, sided: bool = False, cell: int = CELL, best: bool = False) -> DataFrame:
    """(a, b, cosine): ids of ``rows`` (id, t, text key ``k``) whose TF-IDF vectors have a cosine of at least ``least`` and whose times are at most
    ``within_us`` apart; a < b, or a and b on the sides 'a' and 'b' of the column ``side`` (NULL: on none). An id has one row.

    What ``tfidf`` and ``alike_pairs`` tell, without a table of all grams of all texts: texts travel as they are to the cells of their time
    (``meetings``), where their vectors are made. There the rarest grams of a text, without which the rest is too short, are looked up in the
    others; a pair is computed whole if that and the length of the rest could be enough, so no pair is lost. The frequencies of the grams that
    several texts have are held by each task; character n-grams are a bounded number, others as many as the language has.

    best, with sided: only what ``nearest`` needs for the best partner of each a. All partners of an a come to one task, which keeps no others.
    """
    if best and not sided:
        raise ValueError("best needs sides")
    rows = rows.distinct()
    spark = rows.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 2000):
                row, code = grams(b["k"].iloc[s : s + 2000].tolist())
                known, which = np.unique(code, return_inverse=True)
                once = np.unique(row * max(len(known), 1) + which) % max(len(known), 1)
                yield pd.DataFrame({"code": known, "n": np.bincount(once, minlength=len(known))})

    filled = rows.where("k <> ''")
    total = filled.count()
    often = filled.select("k").mapInPandas(counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    known, n = (often[c].to_numpy(dtype=np.int64) for c in ("code", "n"))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), dtype=np.int64)
    rank[order] = np.arange(len(n))
    by_code = np.argsort(known)
    vocabulary = spark.sparkContext.broadcast((known[by_code], rank[by_code], np.log((1 + total) / (1 + n[order])) + 1))

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, own = None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _best(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for left, right in met(batches):
            if right is None:
                if held:
                    yield pd.DataFrame(dict(zip(("a", "cosine", "b"), kept(), strict=True)))[["a", "b", "cosine"]]
                    held, size = [], 0
                here, own = left, _Vectors(left["k"].tolist(), grams, vocabulary.value, total)
                own.index(least / 2)
                if sided:
                    continue
            there, other = (here, own) if right is None else (right, _Vectors(right["k"].tolist(), grams, vocabulary.value, total))
            ia, ib, ta, tb = here["id"].to_numpy(), there["id"].to_numpy(), here["t"].to_numpy(), there["t"].to_numpy()
            for x, y in own.alike(other, least):
                near = np.abs(ta[x] - tb[y]) <= within_us
                near &= ia[x] < ib[y] if right is None else True
                x, y = x[near], y[near]
                cosine = own.dots(x, other, y)
                enough = cosine >= least
                a, b = ia[x[enough]], ib[y[enough]]
                if best:
                    held.append((a, cosine[enough], b))
                    size += len(a)
                    if size > 1_000_000:
                        held = [kept()]
                        size = 0
                    continue
                if not sided:
                    a, b = np.minimum(a, b), np.maximum(a, b)
                yield pd.DataFrame({"a": a, "b": b, "cosine": cosine[enough]})
        if held:
            yield pd.DataFrame(dict(zip(("a", "cosine", "b"), kept(), strict=True)))[["a", "b", "cosine"]]

    kind = dict(rows.dtypes)["id"]
    if sided:
        filled = filled.where("side IS NOT NULL")
    return meetings(filled, "id", "t", within_us, sided, cell).mapInPandas(paired, f"a {kind}, b {kind}, cosine double")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best partners of each a, the smaller id on a tie."""
    w = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), F.asc("b"))
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rank_texts(vectors: DataFrame, queries: DataFrame, grams: Column, top: int = 10) -> DataFrame:
    """(query_id, id, score, place): the texts most alike to each query (query_id, text), scored with the texts' idf; top is a report's length."""
    idf = vectors.groupBy("gram").agg(F.max("idf").alias("idf"))
    q = queries.select("query_id", F.explode(grams).alias("gram")).groupBy("query_id", "gram").agg(F.count("*").alias("tf")).join(idf, "gram").withColumn("q", F.col("tf") * F.col("idf"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    s = q.join(norm, "query_id").join(vectors.select("id", "gram", "w"), "gram").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("w") / F.col("norm")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("id"))
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
