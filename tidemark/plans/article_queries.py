"""Queries of identity, duplicates and text rules over articles and production rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity as I
from tidemark.functions import textrules as T
from tidemark.operators import dedup as G
from tidemark.plans.cut import read
from tidemark.plans.models import epoch_us


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "primary_source_events")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "production_rows").distinct()


def f1_urls(spark: SparkSession, d: str) -> DataFrame:
    """Three normal forms of the urls, dressed with what they have to lose."""
    dressed = F.concat(F.regexp_replace("url", "^https://", "HTTPS://www."), F.lit("//?b=2&utm_x=1&a=1&ref=q#top"))
    return _articles(spark, d).select("record_id", I.url_key(F.col("url")).alias("plain"), I.url_key(dressed).alias("clean"), I.url_key(dressed, "none").alias("bare"), I.url_key(dressed, "all").alias("full"))


def f3_title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Title keys and how many articles share them."""
    return _articles(spark, d).groupBy(I.text_key(F.col("title")).alias("title_key")).agg(F.count("*").alias("n"))


def f4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and content hash of each article."""
    return _articles(spark, d).select("record_id", I.text_fingerprint(F.col("title"), F.col("body")).alias("fingerprint"), I.content_hash(F.col("title"), F.col("body")).alias("digest"))


def f7_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slug of each production row, longer where short ones collide between events."""
    t = _rows(spark, d).where("title IS NOT NULL AND published_at IS NOT NULL").select("row_id", "title", "published_at", F.lower(F.trim("event_id")).alias("event_id"))
    return t.select("row_id", I.slug(F.col("title"), F.col("published_at").cast("timestamp"), F.col("event_id")).alias("slug"), I.slug(F.col("title"), F.col("published_at").cast("timestamp"), F.col("event_id"), 12).alias("longer"))


def f8_event_ids(spark: SparkSession, d: str) -> DataFrame:
    """Id of each event from its rows."""
    r = _rows(spark, d).select(F.lower(F.trim("event_id")).alias("event"), F.col("row_id").cast("string").alias("m"))
    return r.groupBy("event").agg(I.set_id(F.collect_set("m"), "evt-").alias("set_id"), F.count_distinct("m").alias("n"))


def f9_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Daily and monthly grouping keys of the articles."""
    a = _articles(spark, d).where("published_at IS NOT NULL")
    assets = F.transform(F.from_json("assets_json", "array<string>"), lambda x: F.upper(x))
    p = F.col("published_at").cast("timestamp")
    return a.select("record_id", I.daily_signature(p, F.coalesce(assets, F.array().cast("array<string>")), F.col("title")).alias("daily"), I.monthly_signature(F.coalesce(F.element_at(F.array_sort(assets), 1), F.lit("")), F.col("title"), p).alias("monthly"))


def f11_frame_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a table that doesn't depend on the order of rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), F.coalesce("source", F.lit("")), F.coalesce("title", F.lit(""))), 256), 1, 12), 16, 10).cast("bigint")
    return _articles(spark, d).agg(F.count("*").alias("n"), F.sum(h % 1_000_003).alias("digest"), F.bit_xor(h).alias("folded"))


def g1_earliest(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each event: earliest, then most important, then smallest id."""
    r = _rows(spark, d).where("published_at IS NOT NULL").withColumn("event", F.lower(F.trim("event_id")))
    g = G.earliest_of_group(r, ["event"], [F.asc("published_at"), F.desc_nulls_last("importance"), F.asc("row_id")])
    return g.select("event", "row_id", "group_size", "reason")


def g3_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Articles that share a canonical url or a content hash with an earlier one."""
    a = _articles(spark, d).select("record_id", I.url_key(F.col("canonical_url")).alias("url_key"), "content_hash")
    return G.pairs_by_key(a, "record_id", ["url_key", "content_hash"])


def g4_same_title(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring articles of one title within two days."""
    a = _articles(spark, d).where("published_at IS NOT NULL").select("record_id", I.text_key(F.col("title")).alias("k"), epoch_us("published_at").alias("t"))
    return G.chained_pairs(a, "record_id", "k", "t", 2 * 86_400_000_000)


def g4_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each author's rows without a pause of more than 30 days."""
    r = _rows(spark, d).where("published_at IS NOT NULL AND source IS NOT NULL").select("row_id", "source", epoch_us("published_at").alias("t"))
    return G.islands(r, "source", "t", "row_id", 2 * 3_600_000_000).groupBy("source", "island").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def g5_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of articles tied by url or hash."""
    return G.min_labels(g3_duplicate_pairs(spark, d))


def g6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical row of each event and asset by source priority, time and id."""
    prio = F.when(F.col("source_class_v2") == "regulator", 0).when(F.col("source_class_v2") == "exchange", 1).when(F.col("source_class_v2") == "project_blog", 2).otherwise(3)
    r = _rows(spark, d).where("primary_asset IS NOT NULL").withColumn("event", F.lower(F.trim("event_id")))
    return G.earliest_of_group(r, ["event", "primary_asset"], [prio.asc(), F.asc_nulls_last("published_at"), F.asc("row_id")]).select("event", "primary_asset", "row_id", "group_size")


def g8_first_by_any_key(spark: SparkSession, d: str) -> DataFrame:
    """Articles left after dropping repeated urls, then repeated hashes."""
    a = _articles(spark, d).select("record_id", "url", "content_hash")
    return G.first_by_any_key(a, ["url", "content_hash"], [F.asc("record_id")]).select("record_id")


def g9_not_stored(spark: SparkSession, d: str) -> DataFrame:
    """Articles of odd ids whose url, canonical url and hash no even one has."""
    a = _articles(spark, d).select("record_id", "url", "canonical_url", "content_hash")
    return G.not_stored(a.where("record_id % 2 = 1"), a.where("record_id % 2 = 0"), ["url", "canonical_url", "content_hash"]).select("record_id")


def g10_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What happens to each url when later records meet earlier ones."""
    a = _articles(spark, d).select("url", "record_id", "content_hash")
    first = a.groupBy("url").agg(F.min_by("record_id", "record_id").alias("record_id"), F.min_by("content_hash", "record_id").alias("content_hash"))
    last = a.groupBy("url").agg(F.max_by("record_id", "record_id").alias("record_id"), F.max_by("content_hash", "record_id").alias("content_hash")).where("record_id % 3 > 0")
    return G.upsert_changed(first, last, "url", "content_hash")


def g12_history(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each production row's title to the titles of the 30 days before."""
    r = _rows(spark, d).where("published_at IS NOT NULL AND title IS NOT NULL").select("row_id", epoch_us("published_at").alias("t"), I.words(F.col("title"), 5).alias("w"))
    s = G.history_similarity(r, "row_id", "t", "w")
    return s.select(F.col("id").alias("row_id"), F.round("max_near", 6).alias("max_near"), "similar_near", "similar_all")


def g13_alike_titles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles whose title words have a Jaccard of .85 or more, exact title keys once."""
    a = _articles(spark, d).groupBy(I.text_key(F.col("title")).alias("k")).agg(F.min("record_id").alias("record_id"))
    return G.alike_titles(a.withColumn("w", I.words(F.col("k"))), "record_id", "w", 0.85).select("a", "b", F.round("j", 6).alias("j"))


def g18_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Share of the most frequent author of each category."""
    h = F.lower(F.regexp_replace(F.trim("author_handle"), "^@", ""))
    return G.concentration(_rows(spark, d).where("category IS NOT NULL").withColumn("author", h), "category", "author").withColumn("share", F.round("share", 6))


def g19_exploded(spark: SparkSession, d: str) -> DataFrame:
    """Assets of the production rows, exploded from JSON."""
    r = _rows(spark, d).select("row_id", F.explode(F.from_json("related_assets", "array<string>")).alias("asset"))
    return r.groupBy("asset").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("rows"))


def g20_varying(spark: SparkSession, d: str) -> DataFrame:
    """Events whose category or sentiment isn't the same in all rows."""
    r = _rows(spark, d).withColumn("event", F.lower(F.trim("event_id"))).select("event", "category", "sentiment")
    return G.varying(r, "event", ["category", "sentiment"])


def g23_longest(spark: SparkSession, d: str) -> DataFrame:
    """Longest body of each canonical url, the smaller id on a tie."""
    a = _articles(spark, d).where("canonical_url IS NOT NULL AND body IS NOT NULL")
    return a.groupBy("canonical_url").agg(F.max(F.struct(F.length("body").alias("n"), (-F.col("record_id")).alias("i"))).alias("m")).select("canonical_url", (-F.col("m.i")).alias("record_id"), F.col("m.n").alias("n"))


def g21_earliest_verified(spark: SparkSession, d: str) -> DataFrame:
    """Earliest article of each source with a time confidence of at least .9, the more certain on a tie."""
    a = _articles(spark, d).where("time_confidence >= 0.9 AND published_at IS NOT NULL")
    k = F.struct(epoch_us("published_at").alias("t"), (-F.col("time_confidence")).alias("c"), F.col("record_id").alias("i"))
    return a.groupBy("source").agg(F.min(k).alias("m")).select("source", F.col("m.i").alias("record_id"))


def k14_non_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each primary asset accepted greedily, a day apart."""
    r = _rows(spark, d).where("primary_asset IS NOT NULL AND published_at IS NOT NULL").select("row_id", "primary_asset", epoch_us("published_at").alias("t"))
    return G.non_overlapping(r, "primary_asset", "row_id", "t", 86_400_000_000)


def h1_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets named in each article."""
    return _articles(spark, d).select("record_id", T.assets_in(F.col("title"), F.col("body")).alias("assets"))


def h2_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Relevance score of each article's whole text."""
    return _articles(spark, d).select("record_id", F.round(T.relevance(F.concat_ws(" ", "title", "body")), 6).alias("score"))


def h5_event_type(spark: SparkSession, d: str) -> DataFrame:
    """Event type by an ordered ladder of patterns."""
    rules = [("security", "vulnerability|slashing|incident"), ("regulation", "licensing|enforcement|court|tax"), ("market", "order book|spread|volatility|liquidity"), ("network", "fork|validator|upgrade|testnet")]
    return _articles(spark, d).groupBy(T.ladder(F.col("title"), rules, "other").alias("event_type")).agg(F.count("*").alias("n"))


def h10_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why articles would be turned away, by the first failing rule."""
    rules = [("title", F.length(F.trim("title")) == 0), ("body", F.length("body") < 1000), ("time", F.col("published_at").isNull()), ("confidence", F.col("time_confidence") < 0.9), ("assets", F.col("assets_json").isNull())]
    return _articles(spark, d).groupBy("source_type", T.reject_reason(rules).alias("reason")).agg(F.count("*").alias("n"))


def h13_amounts(spark: SparkSession, d: str) -> DataFrame:
    """First amount in dollars of numbers written into sentences."""
    s = F.concat(F.lit("raised "), F.when(F.col("row_id") % 2 == 0, "$").otherwise("€"), (F.col("row_id") % 900 + 1).cast("string"), F.lit(".5 "), F.when(F.col("row_id") % 3 == 0, "billion").otherwise("m"), F.lit(" today"))
    return _rows(spark, d).select("row_id", F.round(T.amount_usd(s), 2).alias("usd"))


def h20_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Importance brought to 0..1, with the number of values out of range."""
    v, bad = T.scaled(F.col("importance"), 90.0, 0.0, 1.0)
    return _rows(spark, d).agg(F.count("importance").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.count_if(bad).alias("violations"))


def h21_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon score of the titles."""
    return _articles(spark, d).groupBy(T.lexicon_score(F.col("title")).cast("int").alias("score")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    f1_urls, f3_title_keys, f4_fingerprints, f7_slugs, f8_event_ids, f9_signatures, f11_frame_digest, g1_earliest, g3_duplicate_pairs, g4_same_title, g4_islands, g5_components, g6_canonical,
    g8_first_by_any_key, g9_not_stored, g10_upsert, g12_history, g13_alike_titles, g18_concentration, g19_exploded, g20_varying, g21_earliest_verified, g23_longest, k14_non_overlap, h1_assets, h2_relevance,
    h5_event_type, h10_reject_reasons, h13_amounts, h20_scaled, h21_lexicon,
)}


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _word(x: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches(lower({x}), '(^|[^a-z0-9_$]){n}($|[^a-z0-9_])'), false)" for n in names) + ")"


def _url(x: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace(trim({x}), '^https://www\\.', 'https://'), '/$', ''), '')"


_R = "r AS (SELECT DISTINCT * FROM production_rows)"
_PAIRS = f"""k AS (SELECT record_id, {_url('canonical_url')} AS v, 'url_key' AS reason FROM primary_source_events UNION ALL SELECT record_id, content_hash, 'content_hash' FROM primary_source_events),
    f AS (SELECT reason, v, min(record_id) AS a FROM k WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2 HAVING count(*) > 1), pr AS (SELECT DISTINCT f.a, k.record_id AS b, k.reason FROM k JOIN f USING (reason, v) WHERE f.a <> k.record_id)"""
_SLUG = """CASE WHEN w = '' THEN 'event' ELSE w END"""

SQL = {
    "f1_urls": "SELECT record_id, url AS plain, url || '?a=1&b=2' AS clean, regexp_replace(url, '^https://', 'https://www.') AS bare, regexp_replace(url, '^https://', 'https://www.') || '?b=2&utm_x=1&a=1&ref=q' AS full FROM primary_source_events",
    "f3_title_keys": f"SELECT {_key('title')} AS title_key, count(*) AS n FROM primary_source_events GROUP BY 1",
    "f4_fingerprints": f"""WITH t AS (SELECT record_id, {_key('title')} AS t, {_key('body')} AS b, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) AS c FROM primary_source_events)
        SELECT record_id, CASE WHEN t = '' AND b = '' THEN '' ELSE sha256(t || chr(10) || left(b, 4000)) END AS fingerprint, sha256(t || chr(10) || c) AS digest FROM t""",
    "f7_slugs": f"""WITH {_R}, t AS (SELECT row_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS w, year(published_at) AS y, regexp_replace(regexp_replace(lower(trim(event_id)), '[^a-z0-9]', '', 'g'), '^evt18', '') AS k FROM r WHERE title IS NOT NULL AND published_at IS NOT NULL)
        SELECT row_id, regexp_replace(left({_SLUG}, 180 - length('-' || y || '-' || left(k, 8))), '-+$', '') || '-' || y || '-' || left(k, 8) AS slug, regexp_replace(left({_SLUG}, 180 - length('-' || y || '-' || left(k, 12))), '-+$', '') || '-' || y || '-' || left(k, 12) AS longer FROM t""",
    "f8_event_ids": f"WITH {_R} SELECT lower(trim(event_id)) AS event, 'evt-' || left(sha256(string_agg(DISTINCT row_id::VARCHAR, '|' ORDER BY row_id::VARCHAR)), 20) AS set_id, count(DISTINCT row_id) AS n FROM r GROUP BY 1",
    "f9_signatures": f"""WITH a AS (SELECT record_id, published_at, title, list_sort(list_transform(from_json(coalesce(assets_json, '[]'), '["VARCHAR"]'), lambda x: upper(x))) AS s FROM primary_source_events WHERE published_at IS NOT NULL)
        SELECT record_id, left(sha256(concat_ws('|', strftime(published_at, '%Y-%m-%d'), array_to_string(s, '|'), array_to_string(list_slice(list_sort(list_distinct(string_split(lower(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))), ' '))), 1, 12), ' '))), 32) AS daily,
        left(sha256(concat_ws('|', coalesce(s[1], ''), left({_key('title')}, 100), strftime(published_at, '%Y-%m'))), 16) AS monthly FROM a""",
    "f11_frame_digest": "WITH h AS (SELECT ('0x' || left(sha256(concat_ws('|', record_id::VARCHAR, coalesce(source, ''), coalesce(title, ''))), 12))::BIGINT AS h FROM primary_source_events) SELECT count(*) AS n, sum(h % 1000003)::BIGINT AS digest, bit_xor(h) AS folded FROM h",
    "g1_earliest": f"""WITH {_R}, k AS (SELECT lower(trim(event_id)) AS event, row_id, row_number() OVER (PARTITION BY lower(trim(event_id)) ORDER BY published_at, importance DESC NULLS LAST, row_id) AS k, count(*) OVER (PARTITION BY lower(trim(event_id))) AS group_size FROM r WHERE published_at IS NOT NULL)
        SELECT event, row_id, group_size, CASE WHEN group_size = 1 THEN 'only' ELSE 'earliest' END AS reason FROM k WHERE k = 1""",
    "g3_duplicate_pairs": f"WITH {_PAIRS} SELECT * FROM pr",
    "g4_same_title": f"""WITH l AS (SELECT record_id AS b, lag(record_id) OVER w AS a, epoch_us(published_at) - lag(epoch_us(published_at)) OVER w AS gap FROM primary_source_events WHERE published_at IS NOT NULL AND {_key('title')} <> '' WINDOW w AS (PARTITION BY {_key('title')} ORDER BY published_at, record_id))
        SELECT a, b FROM l WHERE a IS NOT NULL AND gap <= 172800000000""",
    "g4_islands": f"""WITH {_R}, l AS (SELECT row_id, source, epoch_us(published_at) AS t, epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY source ORDER BY published_at, row_id) > 7200000000 AS j FROM r WHERE published_at IS NOT NULL AND source IS NOT NULL),
        i AS (SELECT *, sum(coalesce(j, false)::INT) OVER (PARTITION BY source ORDER BY t, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM l) SELECT source, island, count(*) AS n, min(row_id) AS first_row FROM i GROUP BY 1, 2""",
    "g5_components": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), c(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b OR c.root = e.b)
        SELECT node, min(root) AS component FROM c GROUP BY 1""",
    "g6_canonical": f"""WITH {_R}, k AS (SELECT lower(trim(event_id)) AS event, primary_asset, row_id, row_number() OVER (PARTITION BY lower(trim(event_id)), primary_asset ORDER BY CASE source_class_v2 WHEN 'regulator' THEN 0 WHEN 'exchange' THEN 1 WHEN 'project_blog' THEN 2 ELSE 3 END, published_at NULLS LAST, row_id) AS k,
        count(*) OVER (PARTITION BY lower(trim(event_id)), primary_asset) AS group_size FROM r WHERE primary_asset IS NOT NULL) SELECT event, primary_asset, row_id, group_size FROM k WHERE k = 1""",
    "g8_first_by_any_key": """WITH u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY record_id) AS k FROM primary_source_events), v AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY record_id) AS m FROM u WHERE k = 1 OR url IS NULL) SELECT record_id FROM v WHERE m = 1 OR content_hash IS NULL""",
    "g9_not_stored": """WITH s AS (SELECT * FROM primary_source_events WHERE record_id % 2 = 0) SELECT record_id FROM primary_source_events n WHERE record_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.url = n.url) AND NOT EXISTS (SELECT 1 FROM s WHERE s.canonical_url = n.canonical_url) AND NOT EXISTS (SELECT 1 FROM s WHERE s.content_hash = n.content_hash)""",
    "g10_upsert": """WITH f AS (SELECT url, min(record_id) AS r, arg_min(content_hash, record_id) AS h FROM primary_source_events GROUP BY 1), l AS (SELECT url, max(record_id) AS r, arg_max(content_hash, record_id) AS h FROM primary_source_events GROUP BY 1 HAVING max(record_id) % 3 > 0)
        SELECT url, CASE WHEN l.url IS NOT NULL AND f.h IS DISTINCT FROM l.h THEN l.r ELSE f.r END AS record_id, CASE WHEN l.url IS NOT NULL AND f.h IS DISTINCT FROM l.h THEN l.h ELSE f.h END AS content_hash, CASE WHEN l.url IS NOT NULL AND f.h IS DISTINCT FROM l.h THEN 'update' ELSE 'keep' END AS action FROM f LEFT JOIN l USING (url)""",
    "g12_history": f"""WITH {_R}, t AS (SELECT row_id, epoch_us(published_at) AS t, list_distinct(list_filter(string_split({_key('title')}, ' '), lambda w: length(w) >= 5)) AS w FROM r WHERE published_at IS NOT NULL AND title IS NOT NULL),
        x AS (SELECT row_id, t, len(w) AS n, unnest(w) AS w FROM t), m AS (SELECT a.row_id, a.t - b.t AS age, count(*) / (a.n + b.n - count(*)) AS j FROM x a JOIN x b ON a.w = b.w AND b.t BETWEEN a.t - 2592000000000 AND a.t AND (b.t < a.t OR b.row_id < a.row_id) GROUP BY a.row_id, b.row_id, a.t, b.t, a.n, b.n)
        SELECT t.row_id, round(coalesce(max(j) FILTER (age <= 604800000000), 0), 6) AS max_near, count(*) FILTER (j >= 0.5 AND age <= 604800000000) AS similar_near, count(*) FILTER (j >= 0.5) AS similar_all FROM t LEFT JOIN m USING (row_id) GROUP BY 1""",
    "g13_alike_titles": f"""WITH t AS (SELECT min(record_id) AS id, list_distinct(string_split({_key('title')}, ' ')) AS w FROM primary_source_events GROUP BY {_key('title')}), x AS (SELECT id, len(w) AS n, unnest(w) AS w FROM t),
        m AS (SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS j FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n) SELECT a, b, round(j, 6) AS j FROM m WHERE j >= 0.85""",
    "g18_concentration": f"""WITH {_R}, p AS (SELECT category, lower(regexp_replace(trim(author_handle), '^@', '')) AS e, count(*) AS n FROM r WHERE category IS NOT NULL AND author_handle IS NOT NULL GROUP BY 1, 2)
        SELECT category, sum(n)::BIGINT AS n, arg_min(e, struct_pack(a := -n, b := e)) AS top_entity, round(max(n) / sum(n), 6) AS share, max(n) * 2 > sum(n) AS warning FROM p GROUP BY 1""",
    "g19_exploded": f"""WITH {_R}, x AS (SELECT row_id, unnest(from_json(related_assets, '["VARCHAR"]')) AS asset FROM r WHERE related_assets IS NOT NULL) SELECT asset, count(*) AS n, count(DISTINCT row_id) AS rows FROM x GROUP BY 1""",
    "g20_varying": f"""WITH {_R}, v AS (SELECT lower(trim(event_id)) AS event, count(DISTINCT category) + max((category IS NULL)::INT) AS c, count(DISTINCT sentiment) + max((sentiment IS NULL)::INT) AS s FROM r GROUP BY 1)
        SELECT event, 'category' AS "column", c AS "values" FROM v WHERE c > 1 UNION ALL SELECT event, 'sentiment', s FROM v WHERE s > 1""",
    "g21_earliest_verified": "SELECT source, arg_min(record_id, struct_pack(a := published_at, b := -time_confidence, c := record_id)) AS record_id FROM primary_source_events WHERE time_confidence >= 0.9 AND published_at IS NOT NULL GROUP BY 1",
    "g23_longest": "SELECT canonical_url, arg_min(record_id, struct_pack(a := -length(body), b := record_id)) AS record_id, max(length(body)) AS n FROM primary_source_events WHERE canonical_url IS NOT NULL AND body IS NOT NULL GROUP BY 1",
    "k14_non_overlap": f"""WITH RECURSIVE {_R}, s AS (SELECT primary_asset, row_id, epoch_us(published_at) AS t FROM r WHERE primary_asset IS NOT NULL AND published_at IS NOT NULL),
        a(primary_asset, row_id, t) AS (SELECT primary_asset, arg_min(row_id, struct_pack(a := t, b := row_id)), min(t) FROM s GROUP BY 1 UNION ALL
        (SELECT s.primary_asset, arg_min(s.row_id, struct_pack(a := s.t, b := s.row_id)), min(s.t) FROM a JOIN s ON s.primary_asset = a.primary_asset AND s.t >= a.t + 86400000000 GROUP BY s.primary_asset, a.t)) SELECT primary_asset, row_id FROM a""",
    "h1_assets": "SELECT record_id, concat_ws('|', " + ", ".join(f"CASE WHEN {_word('title', n)} THEN '{a}:0.95' WHEN {_word('body', n)} THEN '{a}:0.75' END" for a, n in T.ASSET_NAMES.items()) + ") AS assets FROM primary_source_events",
    "h2_relevance": "WITH t AS (SELECT record_id, concat_ws(' ', title, body) AS x FROM primary_source_events) SELECT record_id, round(least(1.0, " + _word("x", T.GENERAL_TERMS) + "::INT * 0.30 + (" + " + ".join(_word("x", n) + "::INT" for n in T.ASSET_NAMES.values()) + ") * 0.45), 6) AS score FROM t",
    "h5_event_type": """SELECT CASE WHEN regexp_matches(lower(title), 'vulnerability|slashing|incident') THEN 'security' WHEN regexp_matches(lower(title), 'licensing|enforcement|court|tax') THEN 'regulation' WHEN regexp_matches(lower(title), 'order book|spread|volatility|liquidity') THEN 'market'
        WHEN regexp_matches(lower(title), 'fork|validator|upgrade|testnet') THEN 'network' ELSE 'other' END AS event_type, count(*) AS n FROM primary_source_events GROUP BY 1""",
    "h10_reject_reasons": """SELECT source_type, CASE WHEN length(trim(title)) = 0 THEN 'title' WHEN length(body) < 1000 THEN 'body' WHEN published_at IS NULL THEN 'time' WHEN time_confidence < 0.9 THEN 'confidence' WHEN assets_json IS NULL THEN 'assets' END AS reason, count(*) AS n FROM primary_source_events GROUP BY 1, 2""",
    "h13_amounts": f"WITH {_R} SELECT row_id, round((row_id % 900 + 1.5) * CASE WHEN row_id % 3 = 0 THEN 1e9 ELSE 1e6 END * CASE WHEN row_id % 2 = 0 THEN 1.0 ELSE 1.08 END, 2) AS usd FROM r",
    "h20_scaled": f"WITH {_R} SELECT count(importance) AS n, round(avg(importance / 90.0), 6) AS mean, count(*) FILTER (importance / 90.0 < 0 OR importance / 90.0 > 1) AS violations FROM r",
    "h21_lexicon": "SELECT (" + " + ".join(_word("title", [w]) + "::INT" for w in T.POSITIVE) + " - " + " - ".join(_word("title", [w]) + "::INT" for w in T.NEGATIVE) + ")::INT AS score, count(*) AS n FROM primary_source_events GROUP BY 1",
}
