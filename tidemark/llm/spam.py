"""Keyword-stuffed and link-list pages.

Method: bagged decision trees over content and link features are trained from weak labels on a bounded sample, score every page, and the scores
are smoothed by the spam rate of the page's host. What is asked for is a share of a page, so the trees judge its segments (sentences or lines)
and a page's score is the share of its characters in piled-up segments that is to be expected. The weak labels are of whole pages and come from evidence that
no feature tells: how much of the page is links, hashtags, word pairs said again and again or lines built alike. Pages that mostly run in
sentences are the other class, with all their headings, tables and references; pages that are neither have no label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.cut import cut, small

#: Labelled pages on which the trees are trained at most, taken in the order of the hash of their id. A documented bound on the classifier's sample only.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAF = 15, 6, 64, 20
#: Share of a page from which evidence or sentences label it; words of a sentence and lines of one build, at least.
MUCH, SENTENCE, ALIKE = 0.6, 9, 4
#: Weight and largest effect (in log odds) of a host's spam rate, and the pages of average rate added to each host.
HOST_WEIGHT, HOST_MOST, HOST_PRIOR = 0.5, 2.0, 10

# Function words of English, German, Spanish and French.
FUNCTION_WORDS = frozenset(
    "the a an of and or to by from was were is are be been has have had at on as it its that this than could would will said how why what who which "
    "not no but if until after before while then also into over under about more other we you our their they he she once both neither nor still since when because say says "
    "der die das und den von zu mit für auf im ist sind ein eine einen einem einer des dem nicht als auch nach bei über sich wird wurde "
    "el la los las de del y en que un una por con para se su según al es fue más le les du et dans pour sur au aux est sont qui ce cette selon à in for with".split()
)

FEATURES = ["function", "words", "lower_start", "ended", "capital", "letters", "numbers", "marks", "bare", "glued"]

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_URL = re.compile(r"\]?\(?(?:https?://|www\.)\S+")
_TAG = re.compile(r"(?:^|\s)#\w+")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_MARK = re.compile(r"[|;/#,•·\[\]()]| - ")


def segments(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, characters) of the sentences and lines of a whole text that have words; features in the order of FEATURES."""
    rows, lengths = [], []
    function = FUNCTION_WORDS.__contains__
    for line in text.split("\n"):
        for s in _SENTENCE.split(line):
            s = s.strip()
            w = _WORD.findall(s)
            if not w:
                continue
            n, tokens = len(w), len(s.split())
            low = [x.lower() for x in w]
            rows.append((
                sum(map(function, low)) / n, min(n, 60), s[0].islower(), s[-1] in ".!?\"”…", sum(x[0].isupper() for x in w) / n, sum(map(len, w)) / n,
                sum(x[0].isdigit() for x in w) / n, len(_MARK.findall(s)) / n, s[0] in "*-•#[(" or s[0].isdigit(), n / tokens,
            ))
            lengths.append(len(s))
    return np.array(rows, dtype=np.float32).reshape(-1, len(FEATURES)), np.array(lengths, dtype=np.int32)


def evidence(text: str) -> tuple[float, float]:
    """How much of a whole text is links, tags, word pairs said again and again or lines built alike, whichever is most; and how much is sentences."""
    words = _WORD.findall(text.lower())
    total, n = max(1, len(text)), max(1, len(words))
    pairs = Counter(zip(words, words[1:], strict=False))
    built = [(_DIGITS.sub("9", _LETTERS.sub("w", line)), len(line)) for line in text.split("\n") if not line.isspace()]
    alike = Counter(x for x, _ in built)
    shares = (
        sum(map(len, _URL.findall(text))) / total, sum(map(len, _TAG.findall(text))) / total, sum(k for k in pairs.values() if k >= 3) / n,
        sum(k for x, k in built if alike[x] >= ALIKE) / total,
    )
    said = (s for line in text.split("\n") for s in _SENTENCE.split(line.strip()))
    return max(shares), sum(len(s) for s in said if s[:1].isupper() and s[-1:] in ".!?" and s.count(" ") >= SENTENCE - 1) / total


class Tree:
    """A binary decision tree over binned features, grown by Gini gain."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int = DEPTH) -> None:
        self.nodes: list[tuple] = []
        self._grow(x, y, weight, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0, (w @ y + 0.5) / (w.sum() + 1.0)))
        best = (1e-9, -1, 0)
        if depth and 0 < w @ y < w.sum():
            pos, all_ = w @ y, w.sum()
            parent = pos * (all_ - pos) / all_
            for f in range(x.shape[1]):
                n = np.cumsum(np.bincount(x[:, f], w, BINS))[:-1]
                p = np.cumsum(np.bincount(x[:, f], w * y, BINS))[:-1]
                m, q = all_ - n, pos - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = parent - p * (n - p) / n - q * (m - q) / m
                gain[(n < LEAF) | (m < LEAF)] = -1
                tied = np.flatnonzero(gain >= gain.max() - 1e-9)
                k = int(tied[len(tied) // 2])  # the middle of a gap between the classes
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], w[left], depth - 1)
            b = self._grow(x[~left], y[~left], w[~left], depth - 1)
            self.nodes[at] = (best[1], best[2], self.nodes[at][2], a, b)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(at: int, rows: np.ndarray) -> None:
            node = self.nodes[at]
            if node[0] < 0:
                out[rows] = node[2]
            else:
                left = x[rows, node[0]] <= node[1]
                walk(node[3], rows[left])
                walk(node[4], rows[~left])

        walk(0, np.arange(len(x)))
        return out


class BaggedTrees:
    """Trees on bootstrap samples over quantile bins; the score is their mean. Without two classes it is about the rate of the labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        # Half of the bins hold equally many pages, half are equally wide, as most features are far from uniform.
        half = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
        self.edges = [np.unique(np.append(np.quantile(x[:, f], half), x[:, f].min() + half * np.ptp(x[:, f]))) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
        binned, rng = self._bin(x), np.random.default_rng(seed)
        self.trees = [Tree(binned, y, np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)) for _ in range(TREES)] if len(y) else []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(FEATURES)), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return np.mean([t.score(b) for t in self.trees], axis=0) if self.trees else np.zeros(len(x))


def scored_pages(docs: DataFrame, sample: int = SAMPLE, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """(doc_id, host, score, smoothed) of every page, both between 0 and 1; spam is what has ``smoothed`` above 0.5.

    docs: doc_id, text, url, source; other columns are ignored. ``score`` is the share of the page's characters in piled-up segments that
    the trees expect. The host is that of the url, else the source, else unknown. NULL and empty texts score 0. The trees are fitted on at most
    ``sample`` labelled pages (those first by the hash of their id); features, scores and host rates cover all pages and whole texts.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)), F.lit(""))
    # Only pages that may come into the sample need a label; about a tenth of them gets none.
    share = min(1.0, 1.5 * sample / max(1, docs.count()))
    picked = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1, F.lit(False))
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(host != "", host).otherwise(F.coalesce("source", F.lit(""))).alias("host"), picked.alias("picked"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told, labels = [segments(t) for t in b["text"]], []
            for t, p in zip(b["text"], b["picked"], strict=True):
                much, said = evidence(t) if p else (0.0, 0.0)
                labels.append(0.0 if said >= MUCH else 1.0 if much >= MUCH else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "label": pd.array(labels, dtype="Float64"), "features": [x.tobytes() for x, _ in told], "sizes": [n.tobytes() for _, n in told]})

    seen = cut(named.mapInPandas(describe, "doc_id bigint, host string, label double, features binary, sizes binary"))
    # Of a text as long as a book the first segments are enough to learn from; it is judged whole.
    some = seen.where("label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("label", F.substring("features", 1, 100 * 4 * len(FEATURES)).alias("features")).toPandas()
    parts = [np.frombuffer(x, dtype=np.float32).reshape(-1, len(FEATURES)) for x in some["features"]]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), dtype=np.float32)
    held = docs.sparkSession.sparkContext.broadcast(BaggedTrees(x.astype(float), np.repeat(some["label"].to_numpy(dtype=float), [len(p) for p in parts])))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.frombuffer(b"".join(b["features"]), dtype=np.float32).reshape(-1, len(FEATURES))
            size = np.frombuffer(b"".join(b["sizes"]), dtype=np.int32)
            page = np.repeat(np.arange(len(b)), b["sizes"].str.len().to_numpy(dtype=np.int64) // 4)
            piled = held.value.score(x.astype(float))
            whole = np.bincount(page, size, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "score": np.bincount(page, size * piled, len(b)) / np.maximum(whole, 1)})

    scores = cut(seen.mapInPandas(judge, "doc_id bigint, host string, score double"))
    # The host's rate is drawn towards the rate of all pages by some pages' worth of it.
    rates = cut(scores.groupBy("host").agg(F.sum((F.col("score") > 0.5).cast("double")).alias("spam"), F.count("*").alias("pages")))
    overall = rates.agg(F.coalesce((F.sum("spam") + 0.5) / (F.sum("pages") + 1), F.lit(0.5))).first()[0]
    rate = (F.col("spam") + HOST_PRIOR * overall) / (F.col("pages") + HOST_PRIOR)
    lift = F.greatest(F.lit(-HOST_MOST), F.least(F.lit(HOST_MOST), host_weight * (F.ln(rate / (1 - rate)) - float(np.log(overall / (1 - overall))))))
    odds = F.ln(F.greatest(F.col("score"), F.lit(1e-6)) / F.greatest(1 - F.col("score"), F.lit(1e-6))) + F.coalesce("lift", F.lit(0.0))
    return scores.join(small(rates.select("host", lift.alias("lift"))), "host", "left").select("doc_id", "host", "score", (1 / (1 + F.exp(-odds))).alias("smoothed"))


def spam_pages(docs: DataFrame) -> DataFrame:
    """(doc_id) of the pages of which more than half is piled-up keywords, links, hashtags or product tags."""
    return scored_pages(docs).where("smoothed > 0.5").select("doc_id").distinct()
