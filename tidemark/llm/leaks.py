"""Evaluation texts leaking into training text.

Method: the word n-grams of the evaluation items form a broadcast hash set; every window of every document is looked up in it, hits are
verified word by word, and spans or documents are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that must stand in a row.
NGRAM = 12
#: Most words of evaluation items held in one broadcast; more items are taken in blocks, each scanned against all documents.
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_MIX = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_MIX, k, 2**64) for k in range(n)], dtype=np.uint64)


def window_hashes(ids: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """A hash of each window of n ids, the same wherever it stands."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(len(x) - n + 1, dtype=np.uint64)
    for k, p in enumerate(_powers(n)):
        out += x[k : len(x) - n + 1 + k] * p
    return out


class NgramSet:
    """The n-grams of some items: a vocabulary, sorted hashes, and for each hash the (item, position) pairs that have it."""

    def __init__(self, items: list[tuple[int, str]], n: int = NGRAM) -> None:
        self.n, self.vocabulary, self.items = n, {}, {}
        hashes, owners, places = [], [], []
        for item_id, text in items:
            words = _WORD.findall((text or "").lower())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int32)
            if len(ids) >= n:
                self.items[item_id] = ids
                h = window_hashes(ids, n)
                hashes.append(h)
                owners.append(np.full(len(h), item_id, dtype=np.int64))
                places.append(np.arange(len(h)))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate(owners)[order] if hashes else np.zeros(0, dtype=np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.zeros(0, dtype=np.int64)

    def hits(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item with a passage in the text, the (first word, words) of its passages there, merged and in order."""
        get, n = self.vocabulary.get, self.n
        ids = np.fromiter((get(w, -1) for w in _WORD.findall(text.lower())), dtype=np.int32)
        if len(ids) < n or not len(self.hashes):
            return {}
        known = ids >= 0
        full = np.convolve(known, np.ones(n, dtype=np.int32), "valid") == n  # windows of words that all occur in some item
        starts = np.flatnonzero(full)
        if not len(starts):
            return {}
        h = window_hashes(ids, n)[starts]
        lo = np.searchsorted(self.hashes, h, "left")
        hi = np.searchsorted(self.hashes, h, "right")
        out: dict[int, list[tuple[int, int]]] = {}
        for s, a, b in zip(starts[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for item, place in {(int(self.owners[k]), int(self.places[k])) for k in range(a, b)}:
                if np.array_equal(self.items[item][place : place + n], ids[s : s + n]):
                    spans = out.setdefault(item, [])
                    if spans and s <= spans[-1][0] + spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], s + n - spans[-1][0]))
                    else:
                        spans.append((s, n))
        return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The evaluation items in blocks of bounded size, streamed to the driver partition by partition."""
    block, size = [], 0
    for r in items.select("item_id", "text").dropna().distinct().toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = NGRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, words): each passage of at least n consecutive words of an item found in a document.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A word is a longest run of letters or digits, lower-cased.
    NULL or short texts hold nothing; repeated rows give repeated rows; empty tables give no rows. Documents are only scanned, never
    shuffled, so a hot source or a very long text costs what its length costs.
    """
    sc, schema, found = docs.sparkSession.sparkContext, "doc_id bigint, item_id bigint, first_word int, words int", None
    narrow = docs.select("doc_id", "text").dropna()
    for block in _blocks(items, block_words):
        held = sc.broadcast(NgramSet(block, n))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            grams = held.value
            for b in batches:
                rows = [(d, i, s, w) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, spans in grams.hits(t).items() for s, w in spans]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "words"])

        part = narrow.mapInPandas(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of every leaked span, and what stands between them, cut from the text; other columns and documents stay as they
    are. Spans that overlap or follow one another directly are one, so what is left is the text without the union of all spans.
    """
    ranges = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set(F.struct("first_word", "words"))).alias("_spans"))

    @F.pandas_udf("string")
    def drop(text: pd.Series, spans_: pd.Series) -> pd.Series:
        out = []
        for t, sp in zip(text, spans_, strict=True):
            if t is not None and sp is not None and len(sp):
                places = [(m.start(), m.end()) for m in _WORD.finditer(t)]
                kept, at, last = [], 0, -1  # characters up to ``at`` and words up to ``last`` are dealt with
                for s in sorted(sp, key=lambda s: s["first_word"]):
                    if s["first_word"] > last + 1 or not kept:
                        kept.append(t[at : places[s["first_word"]][0]])
                    last = max(last, s["first_word"] + s["words"] - 1)
                    at = places[last][1]
                t = "".join(kept) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = docs.join(ranges, docs[id_col] == ranges["_doc"], "left")
    return joined.select(*[drop(F.col(text_col), F.col("_spans")).alias(c) if c == text_col else docs[c] for c in docs.columns])
