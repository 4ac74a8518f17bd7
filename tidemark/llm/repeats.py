"""Lines repeated across the records of one source.

Method: content-defined chunking. A gear hash rolls over the letters of each text; where its top bits are zero a chunk ends, wherever the
text stands, and a line end closes a chunk too, since what is asked for are lines and most are shorter than the rolling window. Documents
are counted per (source, chunk); only lines all of whose chunks are frequent can be frequent, and those are then counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.cut import cut

#: Records of a source in which a line must stand.
MIN_RECORDS = 8
#: Letters under the rolling hash, and bits of it that must be zero at a cut: a chunk has about 2 ** BITS letters.
WINDOW, BITS = 16, 6
#: Frequent chunks that are broadcast at most (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_CHUNKS = 4_000_000
#: Frequent lines that are broadcast at most; beyond, they are joined by shuffle, in so many parts each, as one line may stand in every record.
BROADCAST_LINES, LINE_PARTS = 500_000, 32

_rng = np.random.default_rng(20240611)
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_DROP = bytes(c for c in range(128) if not (97 <= c <= 122 or c == 10))


def letters(text: str) -> bytes:
    """The lower-cased letters and the line breaks of a text, as UTF-8."""
    t = text.lower()
    if not t.isascii():
        t = _NOT_ASCII.sub(lambda m: m[0] if m[0].isalpha() else "", t)
    return t.encode("utf-8", "surrogatepass").translate(None, _DROP)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    up, down = _powers(1 << max(20, int(len(raw)).bit_length()))
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=prefix[1:])
    return _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Chunked:
    """The lines and chunks of some texts: for each line with letters its text, number, hash and chunks."""

    def __init__(self, texts: list[str]) -> None:
        parts = [letters(t) for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        line_end = np.flatnonzero(raw == 10)
        line_start = np.append(0, line_end[:-1] + 1)
        lines_of = np.array([p.count(b"\n") + 1 for p in parts], dtype=np.int64)
        text_of = np.repeat(np.arange(len(parts)), lines_of)
        number = np.arange(len(line_end)) - np.repeat(np.cumsum(lines_of) - lines_of, lines_of) + 1
        h = _GEAR[raw]
        step = 1
        while step < WINDOW:  # doubling the window: the hash of 2 * step letters from two of step letters
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
        anchor = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0)
        anchor = anchor[raw[anchor] != 10]
        line_of = np.searchsorted(line_end, anchor)
        anchor = anchor[anchor - line_start[line_of] >= WINDOW - 1]  # the window must lie within the line
        ends = np.union1d(anchor + 1, line_end)
        starts = np.append(0, ends[:-1])
        starts = starts + (raw[starts] == 10) * (starts > 0)  # step over the line break itself
        ok = ends > starts
        starts, ends = starts[ok], ends[ok]
        self.chunk = span_hashes(raw, starts, ends)
        of = np.searchsorted(line_end, starts)
        full = line_end > line_start
        kept = np.cumsum(full) - 1
        self.chunk_line = kept[of]
        self.text, self.number = text_of[full], number[full]
        self.line = span_hashes(raw, line_start[full], line_end[full])


def source_key(source: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest("" if source is None else "s" + source))


def _chunked(b: pd.DataFrame) -> tuple[Chunked, np.ndarray]:
    """The chunks of a batch, and the key of the source of each of its texts; a chunk hash xor its source's key is a chunk of that source."""
    keys = {s: source_key(s) for s in b["source"].unique()}
    return Chunked(b["body"].tolist()), np.array([keys[s] for s in b["source"]], dtype=np.uint64)


def _slices(batches: Iterator[pd.DataFrame], chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Batches cut so that each holds about so many characters, or one text."""
    for b in batches:
        sizes = b["body"].str.len().to_numpy()
        group = np.cumsum(sizes) // chars
        for _, part in b.groupby(group, sort=False):
            yield part


def chunk_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _slices(batches):
        c, keys = _chunked(b)
        text = c.text[c.chunk_line]
        both = c.chunk ^ keys[text]
        order = np.lexsort((both, text))
        t, k = text[order], both[order]
        new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])) if len(t) else np.zeros(0, dtype=bool)
        key, n = np.unique(k[new], return_counts=True)
        yield pd.DataFrame({"key": key.view(np.int64), "n": n})


def repeated_lines(records: DataFrame, min_records: int = MIN_RECORDS, broadcast_chunks: int = BROADCAST_CHUNKS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(record_id, line_no) of every occurrence of a line found in at least ``min_records`` different records of its source.

    records: record_id, source, body; other columns are ignored. Lines lie between line feeds, are numbered from 1, and are equal if equal
    after lower-casing and dropping all but letters; lines without letters don't count. Records without source are one source together.
    NULL and empty bodies have no lines; repeated rows of a record count once. A hot source or line is only ever counted with map-side
    aggregation, and its occurrences are found by broadcast or in parts.
    """
    narrow = records.select("record_id", "source", "body").where("body IS NOT NULL AND record_id IS NOT NULL")
    frequent = cut(narrow.mapInPandas(chunk_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_records).select("key"))
    schema = "record_id bigint, line_no bigint, line bigint"
    if frequent.count() <= broadcast_chunks:
        keys = np.sort(np.array(frequent.toPandas()["key"], dtype=np.int64).view(np.uint64))
        held = records.sparkSession.sparkContext.broadcast(keys)

        def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = held.value
            for b in _slices(batches):
                c, src = _chunked(b)
                both = c.chunk ^ src[c.text[c.chunk_line]]
                at = np.minimum(np.searchsorted(known, both), max(len(known) - 1, 0))
                miss = known[at] != both if len(known) else np.ones(len(both), dtype=bool)
                whole = np.bincount(c.chunk_line, weights=miss, minlength=len(c.line)) == 0
                yield pd.DataFrame({"record_id": b["record_id"].to_numpy()[c.text[whole]], "line_no": c.number[whole], "line": (c.line[whole] ^ src[c.text[whole]]).view(np.int64)})

        candidates = narrow.mapInPandas(lines, schema)
    else:

        def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _slices(batches):
                c, src = _chunked(b)
                k = c.chunk_line
                t = c.text[k]
                yield pd.DataFrame({"record_id": b["record_id"].to_numpy()[t], "line_no": c.number[k], "line": (c.line[k] ^ src[t]).view(np.int64), "key": (c.chunk ^ src[t]).view(np.int64)})

        rows = narrow.mapInPandas(exploded, schema + ", key bigint").join(frequent.withColumn("hit", F.lit(1)), "key", "left")
        candidates = rows.groupBy("record_id", "line_no", "line").agg(F.count("*").alias("n"), F.count("hit").alias("m")).where("n = m").select("record_id", "line_no", "line")
    candidates = cut(candidates)
    exact = cut(candidates.select("line", "record_id").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_records).select("line"))
    if exact.count() <= broadcast_lines:
        found = candidates.join(F.broadcast(exact), "line", "left_semi")
    else:
        parts = exact.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(LINE_PARTS - 1))))
        found = candidates.withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(LINE_PARTS)).cast("int")).join(parts, ["line", "part"], "left_semi")
    return found.select("record_id", "line_no").distinct()


def without_lines(records: DataFrame, found: DataFrame) -> DataFrame:
    """``records`` with the found (record_id, line_no) cut from each body; all other columns and records stay as they are."""
    per = found.groupBy(F.col("record_id").alias("_id")).agg(F.collect_set("line_no").alias("_cut"))
    lines = F.split("body", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.coalesce(F.array_contains(F.col("_cut"), (i + 1).cast("bigint")), F.lit(False)), x)), lambda x: x.isNotNull())
    joined = records.join(per, records["record_id"] == per["_id"], "left")
    return joined.select(*[F.array_join(kept, "\n").alias("body") if c == "body" else records[c] for c in records.columns])
