"""Answers over a wide event table: filters, pages, ranks, comparisons, overviews and search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import text_key
from tidemark.operators.ordered import quantiles
from tidemark.operators.stats import trimmed_mean, wilson


@dataclass(frozen=True)
class EventQuery:
    """A closed query over events; None filters nothing. Dates are days (YYYY-MM-DD), both included."""

    asset: str | None = None
    source: str | None = None
    source_class: str | None = None
    category: str | None = None
    sentiment: str | None = None
    year: int | None = None
    date_from: str | None = None
    date_to: str | None = None

    def __post_init__(self) -> None:
        for d in (self.date_from, self.date_to):
            if d is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
                raise ValueError(f"not a day: {d}")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")

    def predicate(self) -> Column:
        """The filter: simple comparisons that reach the scan, and membership of the asset list."""
        t, p = F.col("published_at"), F.lit(True)
        for c, v in (("source", self.source), ("source_class", self.source_class), ("category", self.category)):
            p = p if v is None else p & (F.col(c) == v)
        if self.sentiment is not None:
            p = p & (F.lower("sentiment") == self.sentiment.lower())
        if self.asset is not None:
            p = p & F.array_contains("assets", self.asset)
        if self.year is not None:
            p = p & (t >= F.to_timestamp(F.lit(f"{self.year}-01-01"))) & (t < F.to_timestamp(F.lit(f"{self.year + 1}-01-01")))
        if self.date_from is not None:
            p = p & (t >= F.to_timestamp(F.lit(self.date_from)))
        return p if self.date_to is None else p & (t < F.date_add(F.lit(self.date_to), 1).cast("timestamp"))


def page(events: DataFrame, query: EventQuery, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """One page of the events that a query lets through, with ``total``, their exact number; a limit is what a page is."""
    hit = events.where(query.predicate())
    return hit.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(hit.agg(F.count("*").alias("total"))))


def after_cursor(events: DataFrame, query: EventQuery, t: str | None, ident: str | None, size: int) -> DataFrame:
    """The next events after a cursor, newest first, ids ascending on a tie; one more than a page, to tell whether there are more."""
    hit = events.where(query.predicate())
    if t is not None:
        c = F.to_timestamp(F.lit(t))
        hit = hit.where((F.col("published_at") < c) | ((F.col("published_at") == c) & (F.col("event_id") > ident)))
    return hit.orderBy(F.desc("published_at"), F.asc("event_id")).limit(size + 1)


def ranked(events: DataFrame, value: str, top: int, losers: bool = False) -> DataFrame:
    """The events with the largest (or smallest) value, ids ascending on a tie; NULL left out."""
    return events.where(F.col(value).isNotNull()).orderBy(F.asc(value) if losers else F.desc(value), F.asc("event_id")).limit(top)


def year_counts(events: DataFrame, t: str) -> DataFrame:
    """Events of every year from the first to the last, years without any included."""
    y = events.where(F.col(t).isNotNull()).groupBy(F.year(t).alias("year")).agg(F.count("*").alias("n"))
    every = y.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return every.join(y, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def overview(long: DataFrame, groups: list[str], value: str) -> DataFrame:
    """By groups: number, mean, median, deviation, standard error, trimmed mean, and the positive share in percent with its interval."""
    v = F.col(value)
    a = long.where(v.isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))
    low, high = wilson(F.col("positive"), F.col("n"))
    a = a.withColumns({"error": F.col("std") / F.sqrt("n"), "positive_pct": F.col("positive") * 100 / F.col("n"), "low_pct": F.greatest(F.lit(0.0), low * 100), "high_pct": F.least(F.lit(100.0), high * 100)})
    middle = quantiles(long, groups, value, [0.5]).select(*groups, F.col("q")[0].alias("median"))
    return a.join(trimmed_mean(long, groups, value).drop("n"), groups).join(middle, groups)


def compare(rows: DataFrame, side: str, a: str, b: str, value: str) -> DataFrame:
    """Mean and median of two sides in one row, and the difference of the means."""
    on = lambda x: F.when(F.col(side) == x, F.col(value))
    r = rows.agg(F.count(on(a)).alias("n_a"), F.avg(on(a)).alias("mean_a"), F.count(on(b)).alias("n_b"), F.avg(on(b)).alias("mean_b"))
    middle = quantiles(rows.where(F.col(side).isin(a, b)), [side], value, [0.5])
    middle = middle.agg(*[F.max(F.when(F.col(side) == x, F.col("q")[0])).alias(f"median_{n}") for n, x in (("a", a), ("b", b))])
    r = r.crossJoin(F.broadcast(middle))  # one row and one row
    return r.withColumn("difference", F.col("mean_a") - F.col("mean_b"))


# Words too frequent to search for.
STOP = ["the", "a", "an", "of", "and", "or", "in", "on", "to", "for", "by", "at", "as", "is", "its", "it"]


def stem(word: Column) -> Column:
    """A light stem: plural and verb endings off words of more than four letters."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, "(ings?|ed|es|s)$", "")).otherwise(word)


def search_terms(text: Column) -> Column:
    """Distinct stems of a text's words, without stop words."""
    w = F.filter(F.split(text_key(text), " "), lambda x: (x != "") & ~x.isin(STOP))
    return F.array_distinct(F.transform(w, stem))


def parse_search(text: str) -> list[tuple[str, str]]:
    """Terms of a web search: ('all' | 'phrase' | 'not' | 'or', words). 'or' terms belong to the term before."""
    out: list[tuple[str, str]] = []
    either = False
    for m in re.finditer(r'(-?)"([^"]+)"|(\S+)', text):
        if m[2]:
            out.append(("not" if m[1] else "phrase", m[2].lower()))
        elif m[3].lower() == "or" and out:
            either = True
            continue
        elif m[3].startswith("-") and len(m[3]) > 1:
            out.append(("not", m[3][1:].lower()))
        else:
            out.append(("or" if either else "all", m[3].lower()))
        either = False
    return out


def search(events: DataFrame, text: str, ident: str, title: str, others: list[str]) -> DataFrame:
    """(id, rank) of the events that a web search finds: all words, "phrases", a OR b, -without.

    Words are compared by stems over the title (weight 1) and the other columns (weight .4); rank is the sum of the best weights of the words.
    """
    t, o = search_terms(F.col(title)), search_terms(F.concat_ws(" ", *others))
    whole = F.concat(F.lit(" "), text_key(F.concat_ws(" ", title, *others)), F.lit(" "))
    groups: list[list[Column]] = []
    keep, rank = F.lit(True), F.lit(0.0)
    for kind, words in parse_search(text):
        plain = re.sub(r"[^a-z0-9]+", " ", words).strip()
        if not plain or plain in STOP:
            continue
        if kind == "phrase":
            groups.append([F.contains(whole, F.lit(f" {plain} "))])
            rank = rank + F.when(groups[-1][0], 1.0).otherwise(0.0)
            continue
        s = stem(F.lit(plain))
        hit = F.arrays_overlap(F.array(s), F.array_union(t, o)) if " " not in plain else F.contains(whole, F.lit(f" {plain} "))
        if kind == "not":
            keep = keep & ~hit
            continue
        rank = rank + F.when(F.arrays_overlap(F.array(s), t), 1.0).when(hit, 0.4).otherwise(0.0)
        if kind == "or" and groups:
            groups[-1].append(hit)
        else:
            groups.append([hit])
    for g in groups:
        one = g[0]
        for x in g[1:]:
            one = one | x
        keep = keep & one
    return events.select(ident, keep.alias("_k"), rank.alias("rank")).where("_k").drop("_k")


def csv_cell(value: Column) -> Column:
    """A cell for a spreadsheet: quoted, quotes doubled, and text that would be a formula made harmless; NULL is empty."""
    text = value.cast("string")
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One column ``line`` with each row's cells joined by commas; lists are joined by '|'."""
    kinds = dict(rows.dtypes)
    return rows.select(F.concat_ws(",", *[csv_cell(F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c)) for c in columns]).alias("line"))
