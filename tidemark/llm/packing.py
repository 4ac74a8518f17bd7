"""Laying texts into containers of fixed capacity.

Method: exact-complement hashing on the histogram of lengths. For the largest length left, single lengths, pairs and triples whose sum is
exactly the gap are looked up and consumed as often as availability allows; where none exists the largest length that fits is added and
the smaller gap tried again (best fit). Lengths are at most the capacity, so the histogram is small at any scale; texts are then assigned
by their rank among the texts of equal length.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.cut import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary splits text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII = re.compile(r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""")
#: Distinct pieces of text whose token counts a worker remembers.
CACHE = 500_000


class TokenCounter(dict):
    """Counts tokens of whole texts: pieces of text never share a token, so the counts of distinct pieces are remembered and summed."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < CACHE:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        pieces = _ASCII.findall(text) if text.isascii() else self.pattern.findall(text)
        return sum(map(self.__getitem__, pieces))


def lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every non-NULL text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.fromiter((counter.count(t) for t in b["text"]), dtype=np.int64, count=len(b))})

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(count, "doc_id bigint, tokens bigint")


def _exact(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths with exactly the sum ``gap``, larger ones first; None if there are none."""
    if have[gap]:
        return (gap,)
    if gap < 2:
        return None
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    ok = (have[a] > 0) & (have[gap - a] > 0) & ((a != gap - a) | (have[a] > 1))
    if ok.any():
        big = int(a[np.argmax(ok)])
        return big, gap - big
    for big in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if not have[big]:
            continue
        rest = gap - big
        b = np.arange(min(big, rest - 1), (rest - 1) // 2, -1)
        c = rest - b
        need_b = 1 + (b == big)
        need_c = 1 + (c == b) + (c == big)
        ok = (have[b] >= need_b) & (have[c] >= need_c)
        if ok.any():
            mid = int(b[np.argmax(ok)])
            return big, mid, rest - mid
    return None


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers) that together use up ``counts``."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        have[n] = k
    out = []
    top = capacity
    while True:
        while top > 0 and not have[top]:
            top -= 1
        if top == 0:
            return out
        inside, gap = [top], capacity - top
        have[top] -= 1
        while gap:
            if exact := _exact(gap, have):
                inside += exact
                for x in exact:
                    have[x] -= 1
                break
            fits = np.flatnonzero(have[1 : gap + 1])
            if not len(fits):
                break
            x = int(fits[-1]) + 1
            inside.append(x)
            have[x] -= 1
            gap -= x
        use = Counter(inside)
        more = min(int(have[x]) // k for x, k in use.items())
        for x, k in use.items():
            have[x] -= more * k
        out.append((tuple(inside), more + 1))


#: Parts into which the texts of one length are ranked, so that a common length isn't ranked in one task.
RANK_PARTS = 256


def containers(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container): every text, or piece of a text longer than ``capacity``, in one container.

    docs: doc_id, text; other columns are ignored. A text is cut only if it is longer than the capacity, then into full pieces and a rest.
    NULL texts and texts without tokens need no container and give no row; repeated rows are repeated items. The driver sees only the
    histogram of lengths, at most ``capacity`` rows. Equal input gives equal container contents up to the choice among equal lengths.
    """
    n = F.col("tokens")
    full = F.floor(n / capacity)
    sized = lengths(docs, tokenizer).where("tokens > 0")
    items = cut(
        sized.select("doc_id", "tokens", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / capacity) - 1)).alias("piece", "k"))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("k") * capacity).alias("first_token"), F.when(F.col("k") < full, F.lit(capacity).cast("bigint")).otherwise(n - F.col("k") * capacity).alias("tokens"))
    )
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    starts: dict[int, list[tuple[int, int, int]]] = {}
    seen: Counter = Counter()
    base = 0
    for inside, times in fill(histogram, capacity):
        for x in inside:  # the next `times` texts of length x go into containers base, base + 1, ...
            starts.setdefault(x, []).append((seen[x], base, times))
            seen[x] += times
        base += times
    plan = {x: (np.array([s for s, _, _ in v]), np.array([b for _, b, _ in v])) for x, v in starts.items()}
    held = items.sparkSession.sparkContext.broadcast(plan)

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int")
    parted = items.withColumn("part", part)
    # At most capacity * RANK_PARTS rows, whatever the number of texts.
    before = parted.groupBy("tokens", "part").agg(F.count("*").alias("m")).withColumn(
        "before", F.coalesce(F.sum("m").over(Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parted.join(before.select("tokens", "part", "before"), ["tokens", "part"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("tokens", "part").orderBy("doc_id", "piece")) - 1)

    @F.pandas_udf("bigint")
    def place(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        t, r, out = tokens.to_numpy(), rank.to_numpy(), np.zeros(len(tokens), dtype=np.int64)
        for x in np.unique(t):
            at = np.flatnonzero(t == x)
            s, b = held.value[int(x)]
            k = np.searchsorted(s, r[at], side="right") - 1
            out[at] = b[k] + r[at] - s[k]
        return pd.Series(out)

    return ranked.select("doc_id", "piece", "first_token", "tokens", place("tokens", "rank").alias("container"))
