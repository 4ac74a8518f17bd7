"""Groups of near-copies: records linked, directly or through others, by sharing word sequences.

Method: Golay-code fuzzy hashing. A record has one fingerprint segment in each of several tables. A table picks one five-word sequence of the
record (its minhash) as an anchor; 23 one-bit minhashes of the words around the anchor are the segment, which is decoded to the indices of the
Golay codewords within reach, one or six keys, so that segments at most two bits apart meet under a key. An edit spoils the anchors and
segments near it and leaves the others whole: by the pigeonhole principle records with e errors over T segments have one with at most e / T,
and it is enough that one table has the anchor in common and at most two errors beside it. Nothing depends on what else is in the collection,
so a pair is as likely to meet in a large one, or within a text that a third of all records tell. Records that meet are compared by sketches
of their three-word sequences and then verified on the sequences themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm.components import components
from tidemark.plans.cut import cut, small

#: Tables, words of an anchor, and words on either side of it that the segment tells.
TABLES, ANCHOR, AROUND = 12, 5, 12
#: One-bit minhashes of the word sequences: all of them, and those carried along with the keys (64 in each number).
SKETCH, CARRIED = 256, 128
#: Bits that may differ. Two texts just linked (half of the sequences in common) differ in a quarter of the bits on average, 32 of 128 with a
#: deviation of 4.9, 64 of 256 with 6.9: they are lost here in 3 cases of 100,000 and 1 of a million.
FAR_CARRIED, FAR = 51, 97
#: Records whose links in one bucket are all looked for at once; a larger bucket goes through its first record first.
BUCKET = 4096
#: Rows up to which such a bucket is then compared by blocks at once; in a larger one records that meet in a second table come first.
BLOCKS = 16 * BUCKET
#: Records of an anchor beyond which its buckets are split over tasks.
HOT = 50_000
_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(23)
_ODD = _rng.integers(1, 2**32, (TABLES + 1, max(SKETCH, golay.N + 1)), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, _ODD.shape, dtype=np.uint64).astype(np.uint32)
_SHINGLE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """Numbers words as they come; ``hashes`` has their hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.values: list[int] = []
        self.hashes = np.zeros(0, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.values)
        self.values.append(xxhash.xxh64_intdigest(word))
        return n

    def take(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.hashes) < len(self.values):
            self.hashes = np.concatenate([self.hashes, np.array(self.values[len(self.hashes) :], dtype=np.uint64)])
        return self.hashes[numbers]

    def trim(self) -> None:
        if len(self) > 1_000_000:
            self.__init__()
            self.clear()


def word_arrays(titles: pd.Series, bodies: pd.Series, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all records of a batch, in order, and how many each record has."""
    known.trim()
    get, parts = known.__getitem__, []
    for t, b in zip(titles, bodies, strict=True):
        found = _WORD.findall(((t or "") + "\n" + (b or "")).lower())
        parts.append(np.fromiter(map(get, found), dtype=np.int64, count=len(found)))
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return known.take(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), sizes


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


def _sequences(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words from each word on (0 beyond the record's end), and whether a sequence starts there; a shorter record has one."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    h = np.zeros(len(words), dtype=np.uint32)
    for j in range(n):
        later = np.where(place + j < size, np.append(words[j:], np.zeros(min(j, len(words)), dtype=np.uint32)), np.uint32(0))
        h = _mix32(h * np.uint32(31) + later)
    return h, place <= np.maximum(size - n, 0)


def shingle_sets(words: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-word sequences of each record; a shorter record has none."""
    h = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for j in range(n):
        h += words[j : j + len(h)] * _SHINGLE[j]
    h, out, at = _mix(h), [], 0
    for size in sizes.tolist():
        out.append(np.unique(h[at : at + size - n + 1]) if size >= n else h[:0])
        at += size
    return out


def _minhash(h: np.ndarray, starts: np.ndarray, table: int, k: int, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values of one hash function and their least for each record."""
    v = (h ^ _XOR[table, k]) * _ODD[table, k]
    if ok is not None:
        v[~ok] = 2**32 - 1
    return v, np.minimum.reduceat(v, starts)


def signatures(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each record its anchor (32 bits) and segment (23 bits) in each table, in one number, and the sketch of its n-word sequences as
    numbers of 64 bits. Records need at least one word.
    """
    w = (words >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    signs, sketch = np.zeros((len(sizes), TABLES), dtype=np.int64), np.zeros((len(sizes), SKETCH // 64), dtype=np.uint64)
    h, ok = _sequences(w, sizes, ANCHOR)
    for t in range(TABLES):
        v, least = _minhash(h, starts, t, golay.N, ok)
        at = np.flatnonzero(v == np.repeat(least, sizes))
        at = at[np.searchsorted(at, starts)]  # the first place of the anchor
        lo, hi = np.maximum(at - AROUND, starts), np.minimum(at + ANCHOR + AROUND, ends)
        inner = np.cumsum(hi - lo) - (hi - lo)
        near = w[np.repeat(lo - inner, hi - lo) + np.arange(int((hi - lo).sum()))]
        signs[:, t] = _mix32(least).astype(np.int64) << golay.N
        for b in range(golay.N):
            signs[:, t] |= (_mix32(_minhash(near, inner, t, b)[1]) & np.uint32(1)).astype(np.int64) << b
    h, ok = _sequences(w, sizes, n)
    h, of = h[ok], np.repeat(np.arange(len(sizes)), sizes)[ok]
    first = np.searchsorted(of, np.arange(len(sizes)))
    for k in range(SKETCH):
        sketch[:, k // 64] |= (_mix32(_minhash(h, first, TABLES, k)[1]) & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
    return signs, sketch.view(np.int64)


#: Candidates whose word sequences are fetched by broadcasting their ids (8 bytes each); more are joined by shuffle.
FETCH = 1_000_000


def _slices(batches: Iterator[pd.DataFrame], rows: int = 1000, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Batches cut to so many rows and, where there are bodies, about so many characters."""
    for b in batches:
        part = np.arange(len(b)) // rows
        if "body" in b:
            part = part + np.cumsum(b["body"].str.len().fillna(0).to_numpy(dtype=np.int64)) // chars
        for _, x in b.groupby(part, sort=False):
            yield x


def table_keys(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of records: table, anchor and codeword index in 48 bits."""
    codes, count = golay.keys((signs & ((1 << golay.N) - 1)).ravel())
    row = np.repeat(np.arange(signs.size), count)
    anchor = (signs >> golay.N).ravel()[row]
    return row // TABLES, (row % TABLES) << 44 | anchor << golay.K | codes[np.arange(6)[None, :] < count[:, None]]


def _differ(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """In how many bits two rows of numbers differ."""
    return sum(np.bitwise_count((u ^ v).view(np.uint64)).astype(np.int64) for u, v in zip(x, y, strict=True))


def _ordered(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "large": False}).drop_duplicates()


#: Bits of a key below the number of the part of a split bucket.
_KEY_BITS = 48


def _pairs_in_buckets(batches: Iterator[pd.DataFrame], bucket: int = BUCKET) -> Iterator[pd.DataFrame]:
    """(a, b, large): pairs of ids that meet under a key and whose carried bits agree. Rows come sorted by key and id.

    Of a bucket's rows the first ``bucket`` are paired with each other, each later one with the bucket's first and a few rows before it; the
    key of such a bucket, and of one that is split into parts, comes out as ``a`` with ``large``. No more than ``bucket`` rows of the open
    bucket are held. Rows of one group, where groups are given, are not paired.
    """
    gathered = _gathered(batches)
    held = None  # key, id, checks, group and position of the last rows of the open bucket, and the same of its first row
    for b in gathered:
        key, ident, c0, c1 = (b[c].to_numpy() for c in ("key", "id", "c0", "c1"))
        group = b["group_id"].to_numpy() if "group_id" in b else ident
        start = np.append(True, key[1:] != key[:-1])
        begin = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
        rows = [key, ident, c0, c1, group, np.arange(len(key)) - begin, *(x[begin] for x in (ident, c0, c1, group))]
        old = 0
        if held is not None and held[0][0] == key[0]:
            old, same = len(held[0]), key == key[0]
            rows[5][same] += held[5][-1] + 1
            for k in range(6, 10):
                rows[k][same] = held[k][0]
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        key, ident, c0, c1, group, pos, lead, l0, l1, leading = rows
        at, d, found = np.arange(old, len(key)), 1, [(ident[:0], ident[:0])]
        while len(at := at[(at >= d) & ((pos[at] < bucket) | (d <= 4))]):
            at = at[key[at] == key[at - d]]
            hit = at[(group[at] != group[at - d]) & (_differ((c0[at], c1[at]), (c0[at - d], c1[at - d])) <= FAR_CARRIED)]
            found.append((ident[hit], ident[hit - d]))
            d += 1
        late = np.arange(old, len(key))
        more = late[(pos[late] == bucket) | ((pos[late] == 1) & (key[late] >> _KEY_BITS > 0))]
        if len(more):
            yield pd.DataFrame({"a": key[more] & ((1 << _KEY_BITS) - 1), "b": 0, "large": True})
        late = late[pos[late] >= bucket]
        if len(late):
            hit = late[(group[late] != leading[late]) & (_differ((c0[late], c1[late]), (l0[late], l1[late])) <= FAR_CARRIED)]
            found.append((ident[hit], lead[hit]))
        yield _ordered(*(np.concatenate(x) for x in zip(*found, strict=True)))
        last = max(int(np.flatnonzero(key == key[-1])[0]), len(key) - bucket)
        held = [x[last:] for x in rows]


def _gathered(batches: Iterator[pd.DataFrame], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Batches joined until they have so many rows."""
    open_, size = [], 0
    for b in batches:
        open_.append(b)
        size += len(b)
        if size >= rows:
            yield pd.concat(open_, ignore_index=True)
            open_, size = [], 0
    if size:
        yield pd.concat(open_, ignore_index=True)


def _pairs_across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of ids of different groups within a block. Rows come sorted by block; a block holds two parts of a bucket."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b])
        ends = (b["key"].ne(b["key"].shift()) | b["i"].ne(b["i"].shift()) | b["j"].ne(b["j"].shift())).cumsum()
        whole, rest = b[ends < ends.iloc[-1]], b[ends == ends.iloc[-1]]
        yield from _across(whole)
    if rest is not None:
        yield from _across(rest)


def _across(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, g in b.groupby(["key", "i", "j"], sort=False):
        ident, c0, c1, group = (g[c].to_numpy() for c in ("id", "c0", "c1", "group_id"))
        found = [(ident[:0], ident[:0])]
        for k in range(len(g) - 1):
            far = _differ((c0[k + 1 :], c1[k + 1 :]), (c0[k : k + 1], c1[k : k + 1]))
            hit = np.flatnonzero((group[k + 1 :] != group[k]) & (far <= FAR_CARRIED)) + k + 1
            found.append((ident[hit], np.full(len(hit), ident[k])))
        yield _ordered(*(np.concatenate(x) for x in zip(*found, strict=True))).drop(columns="large")


def _close(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose whole sketches are close."""
    names = [f"c{k}" for k in range(SKETCH // 64)]
    x = texts.select(F.col("id").alias("a"), *[F.col(c).alias(f"x{c}") for c in names])
    y = texts.select(F.col("id").alias("b"), *[F.col(c).alias(f"y{c}") for c in names])
    far = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in names[1:]), F.bit_count(F.col("xc0").bitwiseXOR(F.col("yc0"))))
    return pairs.join(x, "a").join(y, "b").where(far <= FAR).select("a", "b")


def _verified(pairs: DataFrame, narrow: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts share enough of their word sequences."""
    need = cut(pairs.select(F.col("a").alias("record_id")).union(pairs.select("b")).distinct())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in _slices(batches):
            words, sizes = word_arrays(b["title"], b["body"], known)
            # 32 bits of each hash suffice within one pair: two texts of 1,000 sequences have a false one in common in 1 pair of 4,000.
            yield pd.DataFrame({"id": b["record_id"], "s": [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in shingle_sets(words, sizes, n)]})

    texts = cut(narrow.join(small(need, FETCH), "record_id", "left_semi").mapInPandas(sets, "id bigint, s binary").dropDuplicates(["id"]))
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(texts.withColumnsRenamed({"id": "b", "s": "sb"}), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                u, v = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                common = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(common >= least * (len(u) + len(v) - common))
            yield b.loc[ok, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(check, "a bigint, b bigint")


def near_copy_groups(records: DataFrame, n: int = 3, least: float = 0.5, bucket: int = BUCKET, blocks: int = BLOCKS, hot_rows: int = HOT) -> DataFrame:
    """(record_id, text_id, group_id): one row per record; text_id is the smallest record with exactly the same word sequences, group_id the
    smallest text_id of the group of linked texts.

    records: record_id, title, body; other columns are ignored. Words are longest runs of letters or digits, lower-cased; two texts are linked
    if the distinct n-word sequences found in both are at least ``least`` of those found in either. A record with fewer than n words has no
    sequences and stays alone. NULL titles and bodies count as empty. Of repeated rows of a record the one with the smallest text hash counts.
    Exact copies are collapsed first, so a group of copies of any size is one text. Buckets of anchors that very many records have are split
    over tasks and joined by their first record. A bucket of more than ``bucket`` texts is linked through its first text; those of its
    texts that are then still in different groups are compared by blocks; in a bucket of more than ``blocks`` first those that meet in a
    second table as well, then what this leaves in different groups.
    """
    narrow = records.select("record_id", "title", "body").where("record_id IS NOT NULL")
    numbers = [f"c{k}" for k in range(SKETCH // 64)]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in _slices(batches):
            w, sizes = word_arrays(b["title"], b["body"], known)
            long = sizes >= n
            w, b, sizes = w[np.repeat(long, sizes)], b[long], sizes[long]
            if not len(b):
                continue
            signs, sketch = signatures(w, sizes, n)
            text = [xxhash.xxh64_intdigest(x.tobytes()) for x in shingle_sets(w, sizes, n)]
            yield pd.DataFrame({
                "record_id": b["record_id"], "text": np.array(text, dtype=np.uint64).view(np.int64), "signs": [x.tobytes() for x in signs],
                **{c: sketch[:, k] for k, c in enumerate(numbers)},
            })
            # Anchors of several records of a slice; the records of any other anchor are at most two of a thousand.
            anchor, count = np.unique((np.arange(TABLES) << 32 | signs >> golay.N).ravel(), return_counts=True)
            often = count > 2
            yield pd.DataFrame({"text": anchor[often], "record_id": pd.NA, "signs": None, **dict.fromkeys(numbers, 0), "c0": count[often]}).astype({"record_id": "Int64"})

    schema = "record_id bigint, text bigint, signs binary, " + ", ".join(f"{c} bigint" for c in numbers)
    signed = cut(narrow.mapInPandas(sign, schema))
    hot = signed.where("record_id IS NULL").groupBy(F.col("text").alias("anchor")).agg(F.sum("c0").alias("n")).where(F.col("n") > hot_rows)
    hot = cut(hot.select("anchor", F.least(F.ceil(F.col("n") / hot_rows), F.lit(2**14)).alias("parts")))
    # Equal word sequences: one text. The signature of any of its records will do.
    member = signed.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min("text").alias("text"))
    texts = cut(signed.where("record_id IS NOT NULL").groupBy("text").agg(F.min("record_id").alias("id"), F.max("signs").alias("signs"), *[F.max(c).alias(c) for c in numbers]))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches, 2000):
            row, key = table_keys(np.frombuffer(b"".join(b["signs"]), dtype=np.int64).reshape(len(b), TABLES))
            yield pd.DataFrame({"key": key, **{c: b[c].to_numpy()[row] for c in ("id", "c0", "c1")}})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches, 2000):
            row, key = table_keys(np.frombuffer(b"".join(b["signs"]), dtype=np.int64).reshape(len(b), TABLES))
            first = b["key"].to_numpy()[row]
            row, key, first = (x[key >> 44 != first >> 44] for x in (row, key, first))
            both = _mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key.astype(np.uint64)) >> np.uint64(64 - _KEY_BITS)
            yield pd.DataFrame({"key": both.astype(np.int64), **{c: b[c].to_numpy()[row] for c in ("id", "c0", "c1", "group_id")}})

    row_schema = "key bigint, id bigint, c0 bigint, c1 bigint"
    rows = texts.select("id", "signs", "c0", "c1").mapInPandas(explode, row_schema)
    spread = rows
    if not hot.isEmpty():
        split = rows.withColumn("anchor", F.shiftright("key", golay.K)).join(small(hot), "anchor", "left")
        part = F.coalesce(F.pmod(F.xxhash64("id"), "parts") + 1, F.lit(0))
        # The first text of a split bucket stands in each of its parts, so what is like it is joined over all parts.
        lead = split.where("parts IS NOT NULL").groupBy("key", "parts").agg(F.min(F.struct("id", "c0", "c1")).alias("l")).select("key", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("p"), "l.*")
        whole = split.select("key", part.alias("p"), "id", "c0", "c1").unionByName(lead)
        spread = whole.select((F.shiftleft("p", _KEY_BITS).bitwiseOR(F.col("key"))).alias("key"), "id", "c0", "c1")

    def meet(x: DataFrame) -> DataFrame:
        return cut(x.repartition("key").sortWithinPartitions("key", "id").mapInPandas(lambda it: _pairs_in_buckets(it, bucket), "a bigint, b bigint, large boolean").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        return _verified(cut(_close(pairs, texts)), narrow, n, least)

    def unsettled(x: DataFrame, large: DataFrame) -> DataFrame:
        """The rows of large buckets whose texts are not yet in one group, with the size of the bucket."""
        here = x.drop("group_id").join(small(large.select(F.col("a").alias("key")).distinct()), "key").join(groups, "id", "left")
        here = cut(here.select("key", "id", "c0", "c1", F.coalesce("group_id", "id").alias("group_id")).distinct())
        mixed = here.groupBy("key").agg(F.count("*").alias("n"), F.min("group_id").alias("g0"), F.max("group_id").alias("g1")).where("g0 <> g1")
        return here.join(small(mixed.select("key", "n")), "key")

    def across(x: DataFrame) -> DataFrame:
        parts = F.ceil(F.col("n") / bucket).cast("int")
        pieces = x.withColumn("p", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
        pieces = pieces.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "id", "c0", "c1", "group_id")
        return pieces.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_pairs_across, "a bigint, b bigint").distinct()

    met = meet(spread)
    links = cut(linked(met.where("NOT large").select("a", "b")))
    groups = components(links).withColumnsRenamed({"node": "id", "component": "group_id"})
    large = met.where("large")
    if not large.isEmpty():
        rest = cut(unsettled(rows, large))
        more = across(rest.where(F.col("n") <= blocks))
        huge = rest.where(F.col("n") > blocks)
        if not huge.isEmpty():
            finer = huge.join(texts.select("id", "signs"), "id").mapInPandas(again, row_schema + ", group_id bigint")
            met = meet(finer)
            more = more.union(met.where("NOT large").select("a", "b"))
            large = met.where("large")
            if not large.isEmpty():
                links = cut(links.union(linked(cut(more.distinct()))).distinct())
                groups = components(links).withColumnsRenamed({"node": "id", "component": "group_id"})
                more = across(unsettled(finer, large))
            # Not all that is alike meets in a second table: what is in different groups even now is compared by blocks as well.
            links = cut(links.union(linked(cut(more.distinct()))).distinct())
            groups = components(links).withColumnsRenamed({"node": "id", "component": "group_id"})
            more = across(unsettled(rows, huge.select(F.col("key").alias("a"))))
        links = cut(links.union(linked(cut(more.distinct()))).distinct())
        groups = components(links).withColumnsRenamed({"node": "id", "component": "group_id"})
    least_id = groups.groupBy("group_id").agg(F.min("id").alias("least"))
    named = groups.join(least_id, "group_id").select("id", F.col("least").alias("group_id"))
    found = member.join(texts.select("text", "id"), "text").join(named, "id", "left").select("record_id", F.col("id").alias("text_id"), F.coalesce("group_id", "id").alias("group_id"))
    return narrow.select("record_id").distinct().join(found, "record_id", "left").select("record_id", F.coalesce("text_id", "record_id").alias("text_id"), F.coalesce("group_id", "record_id").alias("group_id"))


#: Records of a group in one part of its pairs.
PAIR_PART = 1000


def group_pairs(groups: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b), smaller first: all pairs of records in the same group.

    A group is cut into parts of about ``PAIR_PART`` records and each pair of parts is a task's share, so no task gets a whole large group.
    """
    several = cut(groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").join(groups, "group_id").select("group_id", "record_id", F.ceil(F.col("n") / PAIR_PART).alias("parts")))
    own, every = F.pmod(F.xxhash64("record_id"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    a = several.select("group_id", own.alias("i"), every.alias("j"), F.col("record_id").alias("record_id_a"))
    b = several.select("group_id", every.alias("i"), own.alias("j"), F.col("record_id").alias("record_id_b"))
    return a.join(b, ["group_id", "i", "j"]).where("record_id_a < record_id_b").select("record_id_a", "record_id_b")
