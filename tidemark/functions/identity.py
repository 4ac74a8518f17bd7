"""Normal forms, fingerprints and ids of urls, titles and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["ref", "source", "fbclid", "gclid"]

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšşťūůűźžż"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorssstuuuzzz"


def text_key(text: Column) -> Column:
    """Lower case, all but a-z and 0-9 to single blanks, outer blanks off; NULL counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def squeezed(text: Column) -> Column:
    """White space squeezed to single blanks, outer blanks off; NULL counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def url_key(url: Column, keep: str = "clean") -> Column:
    """Normal form of a url: lower-case scheme (https if none) and host without www., single slashes, no slash at the end, no fragment.

    keep: 'clean' keeps the query without tracking parameters, sorted; 'none' drops it and keeps www.; 'all' keeps it as it is. Percent codes
    stay as written. NULL and blank give an empty string.
    """
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    if keep == "clean":
        host = F.regexp_replace(host, r"^www\.", "")
        name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
        query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(TRACKING) & ~name(p).startswith("utm_"))), "&")
    elif keep == "none":
        query = F.lit("")
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    return F.when(u == "", "").otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def text_fingerprint(title: Column, body: Column, chars: int = 4000) -> Column:
    """SHA-256 of the title's and body's keys, the body's cut at ``chars`` characters as the format demands; empty if both are."""
    t, b = text_key(title), F.substring(text_key(body), 1, chars)
    return F.when((t == "") & (b == ""), "").otherwise(F.sha2(F.concat(t, F.lit("\n"), b), 256))


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the title's key and the whole squeezed body."""
    return F.sha2(F.concat(text_key(title), F.lit("\n"), squeezed(body)), 256)


def official_id(url: Column, external: Column | None = None) -> Column:
    """Id that an official url names (a filing's accession number, a repository's item), or the external id's key; else empty.

    The path counts as it is written, so a filing is only found under a path in small letters, as the results to match have it.
    """
    u = url_key(url)
    filing = F.regexp_extract(u, r"/archives/edgar/data/\d+/([0-9-]+)", 1)
    repo, item = (F.regexp_extract(u, r"github\.com/([^/]+/[^/]+)/(?:pull|issues|commit|releases/tag)/([^/?#]+)", k) for k in (1, 2))
    found = F.when(filing != "", F.concat(F.lit("sec:"), F.replace(filing, F.lit("-"), F.lit("")))).when(repo != "", F.lower(F.concat(F.lit("github:"), repo, F.lit(":"), item))).otherwise("")
    return found if external is None else F.when(F.coalesce(external, F.lit("")) != "", text_key(external)).otherwise(found)


def slug(title: Column, published: Column, event_id: Column, suffix: int = 8, most: int = 180) -> Column:
    """Readable id: the title in plain letters with dashes, the year and the event's suffix, at most ``most`` characters."""
    folded = F.regexp_replace(F.translate(F.lower(F.coalesce(title, F.lit(""))), ACCENTED, PLAIN), "[^\\x00-\\x7F]", "")
    words = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", "")
    words = F.when(words == "", "event").otherwise(words)
    token = F.regexp_replace(F.regexp_replace(F.lower(event_id), "[^a-z0-9]", ""), "^evt18", "")
    token = F.when(token == "", F.sha2(event_id, 256)).otherwise(token)
    tail = F.concat(F.lit("-"), F.year(published).cast("string"), F.lit("-"), F.substring(token, 1, suffix))
    return F.concat(F.regexp_replace(F.left(words, F.lit(most) - F.length(tail)), "-+$", ""), tail)


def set_id(members: Column, prefix: str, digits: int = 20) -> Column:
    """Id of a set of strings: hash of the sorted distinct members."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "|"), 256), 1, digits))


def daily_signature(published: Column, assets: Column, title: Column, tokens: int = 12) -> Column:
    """Grouping key: the day, the sorted assets and the first sorted distinct tokens of the title."""
    first = F.slice(F.array_sort(F.array_distinct(F.split(F.lower(squeezed(title)), " "))), 1, tokens)
    return F.substring(F.sha2(F.concat_ws("|", F.date_format(published, "yyyy-MM-dd"), F.array_join(F.array_sort(assets), "|"), F.array_join(first, " ")), 256), 1, 32)


def monthly_signature(asset: Column, title: Column, published: Column) -> Column:
    """Grouping key: the asset, the title's key and the month."""
    return F.substring(F.sha2(F.concat_ws("|", asset, F.substring(text_key(title), 1, 100), F.date_format(published, "yyyy-MM")), 256), 1, 16)


def words(text: Column, least: int = 1) -> Column:
    """Distinct words of a-z and 0-9 with at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(text_key(text), " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)
