"""Rules over text: assets, amounts, relevance, lexicon and drift, as column expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Names of the assets.
ASSET_NAMES = {"BTC": ["bitcoin", "btc"], "ETH": ["ethereum", "ether", "eth"], "SOL": ["solana", "sol"]}

# Words that say a text is about digital assets, and what happened.
GENERAL_TERMS = ["token", "exchange", "protocol", "validator", "stablecoin", "custody", "ledger"]
POSITIVE = ["approved", "expanded", "upgraded", "funded", "listed", "extended", "simplified"]
NEGATIVE = ["rejected", "suspended", "delisted", "cancelled", "challenged", "delayed", "withdrew"]

#: Fixed rate at which euro amounts are taken as dollars.
EUR_USD = 1.08


def has_word(text: Column, word: str) -> Column:
    """Whether a word stands in a text by itself, not as a part of another word nor behind a dollar sign, case ignored."""
    return F.coalesce(F.lower(text).rlike(rf"(^|[^a-z0-9_$]){word}($|[^a-z0-9_])"), F.lit(False))


def assets_in(title: Column, body: Column) -> Column:
    """The assets named in the title or body, sorted and joined by '|'; with confidence .95 for the title and .75 for the body."""
    found = []
    for asset, names in ASSET_NAMES.items():
        t = reduce(lambda a, b: a | b, [has_word(title, n) for n in names])
        b = reduce(lambda a, b: a | b, [has_word(body, n) for n in names])
        found.append(F.when(t, F.lit(f"{asset}:0.95")).when(b, F.lit(f"{asset}:0.75")))
    return F.array_join(F.array_compact(F.array(*found)), "|")


def relevance(text: Column) -> Column:
    """Score from 0 to 1: .30 if a general term occurs and .45 for each asset."""
    general = reduce(lambda a, b: a | b, [has_word(text, w) for w in GENERAL_TERMS])
    assets = sum((reduce(lambda a, b: a | b, [has_word(text, n) for n in names]).cast("double") for names in ASSET_NAMES.values()), F.lit(0.0))
    return F.least(F.lit(1.0), general.cast("double") * 0.30 + assets * 0.45)


def amount_usd(text: Column) -> Column:
    """The first amount in millions or billions of dollars or euros, in dollars; NULL if there is none."""
    p = r"(?i)(\$|usd|€|eur)\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(billion|million|bn|m|b)\b"
    cur, num, unit = (F.regexp_extract(text, p, k) for k in (1, 2, 3))
    value = F.replace(num, F.lit(","), F.lit("")).try_cast("double")
    scaled = value * F.when(F.lower(unit).startswith("b"), 1e9).otherwise(1e6)
    return F.when(F.lower(cur).rlike("€|eur"), scaled * EUR_USD).otherwise(scaled)


def lexicon_score(title: Column) -> Column:
    """Number of positive less number of negative words in a title."""
    def count(ws: list[str]) -> Column:
        return sum((has_word(title, w).cast("int") for w in ws), F.lit(0))

    return count(POSITIVE) - count(NEGATIVE)


def ladder(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern occurs in the lower-cased text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda acc, r: F.when(t.rlike(r[1]), r[0]).otherwise(acc), reversed(rules), F.lit(default))


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; NULL if none does. A condition that is NULL doesn't hold."""
    return reduce(lambda acc, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(acc), reversed(rules), F.lit(None).cast("string"))


def scaled(value: Column, divisor: float, low: float, high: float) -> tuple[Column, Column]:
    """A value divided by its declared divisor, and whether that is out of range; nothing is clipped."""
    v = value / divisor
    return v, F.coalesce((v < low) | (v > high), F.lit(False))


def page_text(html: Column) -> tuple[Column, Column, Column]:
    """(canonical url, title, text) of an HTML page; scripts, styles and tags are dropped."""
    canonical = F.regexp_extract(html, r"""(?is)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)""", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return canonical, title, F.trim(F.regexp_replace(text, r"\s+", " "))


def best_candidate(candidates: list[tuple[Column, float, str]], now: Column) -> Column:
    """struct(value, confidence, source) of the first candidate time that is there and not in the future."""
    picks = [F.when(c.isNotNull() & (c <= now), F.struct(c.alias("value"), F.lit(conf).alias("confidence"), F.lit(name).alias("source"))) for c, conf, name in candidates]
    return F.coalesce(*picks)


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition of a text (NFKC)."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching runs of two texts, from 0 to 1; NULL if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def drift(a: Column, b: Column, token_likeness: Column, ratio: Column) -> Column:
    """How far a title moved: exact, minor (likeness .90 or more), material, or unverified without one of them."""
    likeness = F.greatest(token_likeness, ratio)
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), "unverified").when(a == b, "exact").when(likeness >= 0.90, "minor").otherwise("material")
