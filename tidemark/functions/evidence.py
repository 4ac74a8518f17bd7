"""Evidence in articles: assets named in titles and bodies, official sources, entities, durations and admission windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_key(group: Column, ident: Column, prefix: str = "news-") -> Column:
    """The event of an article, or a key of its own if it has none."""
    return F.coalesce(group, F.concat(F.lit(prefix), ident.cast("string")))


def admitted(asset: Column, t: Column, windows: dict[str, tuple[str, str]]) -> Column:
    """Whether a time lies in the window (first day included, last excluded, UTC) of its asset; unknown assets and NULL times don't."""
    ok = F.lit(False)
    for name, (first, end) in windows.items():
        ok = ok | ((asset == name) & (t >= F.lit(f"{first} 00:00:00+00:00").cast("timestamp")) & (t < F.lit(f"{end} 00:00:00+00:00").cast("timestamp")))
    return F.coalesce(ok, F.lit(False))


def host(url: Column) -> Column:
    """The lower-cased host of a url; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def official(own_host: Column, handle: Column, expected: Column) -> Column:
    """Whether an article comes from its source itself: from its host and, where one is expected, under its handle (case and ``@`` ignored)."""
    same = F.lower(F.regexp_replace(F.coalesce(handle, F.lit("")), "^@+", "")) == F.lower(expected)
    return F.coalesce(own_host & (expected.isNull() | same), F.lit(False))


def evidence(text: Column, names: dict[str, list[str]]) -> Column:
    """The assets one of whose names stands in a text as a word of its own, in the order of ``names``; none for NULL."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(t.rlike(rf"(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])"), F.lit(k)) for k, words in names.items()]))


def classified_assets(title: Column, body: Column, names: dict[str, list[str]], body_counts: Column) -> Column:
    """The assets with evidence in the title, or in the body where that counts."""
    b = F.when(body_counts, evidence(body, names)).otherwise(F.array().cast("array<string>"))
    both = F.array_union(evidence(title, names), b)
    return F.filter(F.array(*[F.lit(k) for k in names]), lambda x: F.array_contains(both, x))


def primary_asset(assets: Column) -> Column:
    """The asset of an article with only one."""
    return F.when(F.size(assets) == 1, F.element_at(assets, 1))


def entities(text: Column, suffixes: list[str]) -> Column:
    """The distinct names of two words that end in one of the suffixes."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b[A-Z][a-z]+ (?:{'|'.join(suffixes)})\b"), F.lit(0)))


def repair(title: Column, body: Column, generic: Column) -> tuple[Column, Column]:
    """What an article without assets is, and what to do with it. The names of kinds and actions."""
    t, b = F.size(title) > 0, F.size(body) > 0
    kind = F.when(t, "classification_missed_asset").when(b, "needs_review").when(generic, "correctly_unassigned").otherwise("not_crypto_enough")
    return kind, F.when(t, "APPLY_EXPLICIT_TITLE_ASSETS").when(b, "REVIEW_BODY_EVIDENCE").otherwise("KEEP_EMPTY")


def durations(text: Column) -> Column:
    """The durations told in a text after 'after', 'took', 'over' or 'in', as structs (n, unit)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    rule = r"(?:after|took|over|in) ([0-9]{1,6}) (minute|hour|day)s?"
    n, unit = (F.regexp_extract_all(t, F.lit(rule), F.lit(k)) for k in (1, 2))
    return F.zip_with(n, unit, lambda x, y: F.struct(x.cast("bigint").alias("n"), y.alias("unit")))


def horizon_of(n: Column, unit: Column) -> Column:
    """The horizon that a duration names; NULL if there is none."""
    known = ((unit == "minute") & n.isin(1, 5, 15)) | ((unit == "hour") & n.isin(1, 4, 24))
    return F.when(known, F.concat(n.cast("string"), F.substring(unit, 1, 1))).when((unit == "day") & (n == 1), "24h")
