"""Queries of stories, pages of a search, rolling figures, conflicts, pages and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity as I
from tidemark.functions import textrules as T
from tidemark.operators import context as X
from tidemark.operators import dedup as G
from tidemark.operators import quality as Q
from tidemark.operators import reactions as R
from tidemark.operators import serving as M
from tidemark.operators import signals as K
from tidemark.operators import similarity as Y
from tidemark.operators.ordered import quantiles
from tidemark.plans.analysis_queries import _EV, _FR, _TERMS, _events, _one
from tidemark.plans.cut import checkpoint_dir, cut, read
from tidemark.plans.models import BARS, RETURNS, bars, epoch_us, returns
from tidemark.plans.similarity_queries import _CHAR, _DAY, _PAIR, _T, _V, _keys, _titles
from tidemark.sources import tables as S
from tidemark.streaming import windows as W

_TRAIN = 1_705_017_600_000_000


def _assets(spark: SparkSession, d: str) -> DataFrame:
    listed = F.transform(F.from_json("assets_json", "array<string>"), F.upper)
    return read(spark, d, "primary_source_events").select("record_id", F.coalesce(listed, F.array().cast("array<string>")).alias("assets"))


def g22_story_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles that may tell one story: among the seven most alike titles of either within 72 hours, with an asset in common or one
    without assets, and whether they merge by themselves."""
    t = _titles(spark, d)
    p = cut(Y.alike_texts(_keys(t), Y.char_codes, 0.84, 3 * _DAY))
    near = Y.nearest(p.select("a", "b", "cosine").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")), 7)
    kept = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").dropDuplicates(["a", "b"])
    s, when = _assets(spark, d), t.select("id", "t")
    for k in ("a", "b"):
        kept = kept.join(s.select(F.col("record_id").alias(k), F.col("assets").alias(f"s{k}")), k).join(when.select(F.col("id").alias(k), F.col("t").alias(f"t{k}")), k)
    shared = F.arrays_overlap("sa", "sb") | (F.size("sa") == 0) | (F.size("sb") == 0)
    merge = (F.col("cosine") >= 0.965) & (F.abs(F.col("ta") - F.col("tb")) <= 36 * 3_600_000_000)
    return kept.where(shared).select("a", "b", F.round("cosine", 6).alias("cosine"), F.when(merge, "MERGE_STORY").otherwise("REVIEW").alias("action"))


def g14_stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories: articles with the same url or title, and those among each other's three most alike titles with a cosine of .965 within 48 hours."""
    p = cut(Y.alike_texts(_keys(_titles(spark, d)), Y.char_codes, 0.965, 2 * _DAY))
    near = Y.nearest(p.select("a", "b", "cosine").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")), 3).select("a", "b")
    a = read(spark, d, "primary_source_events").where("published_at IS NOT NULL")
    return G.min_labels(near.union(G.stars(a, "record_id", F.lower("url"))).union(G.stars(a, "record_id", I.text_key(F.col("title")))))


def g19_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Titles of an asset that stand under several events."""
    r = read(spark, d, "production_rows").distinct()
    return G.mapping_conflicts(r.where("primary_asset IS NOT NULL"), ["title", "primary_asset"], F.lower(F.trim("event_id")))


def d25_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Results that two providers tell differently, by symbol."""
    r = returns(spark, d).select("event_id", "symbol", "horizon", "ret")
    c = R.provider_conflicts(r, r.withColumn("ret", F.col("ret") + F.when(F.col("event_id") % 5 == 0, 0.001).otherwise(0.0)), ["event_id", "symbol", "horizon"], "ret")
    return c.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("one") - F.col("two"))), 6).alias("most"))


def e14_rolling_change(spark: SparkSession, d: str) -> DataFrame:
    """Rolling mean and relative change of the closes of each symbol."""
    return X.rolling_change(bars(spark, d), ["symbol"], "bar", "close", 8, 3).select("symbol", "bar", F.round("rolling_mean", 6).alias("rolling_mean"), F.round("change", 6).alias("change"))


def f6_official_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that official urls name, on urls of filings and repositories made from the records."""
    r = F.col("record_id")
    url = (
        F.when(r % 3 == 0, F.concat(F.lit("https://www.sec.gov/archives/edgar/data/77/"), F.lpad(r.cast("string"), 10, "0"), F.lit("-21-000001/x.htm")))
        .when(r % 3 == 1, F.concat(F.lit("https://github.com/Org/Repo/pull/"), r.cast("string"))).otherwise(F.col("url"))
    )
    return read(spark, d, "primary_source_events").select("record_id", I.official_id(url).alias("official_id"))


def f12_pages(spark: SparkSession, d: str) -> DataFrame:
    """Canonical url, title and length of the text of pages made from the records."""
    page = F.concat(
        F.lit("<html><head><title> "), F.col("title"), F.lit(" </title><link rel=\"canonical\" href=\""), F.col("url"), F.lit("\"><style>p {x}</style></head><body><p>"),
        F.translate(F.coalesce("body", F.lit("")), "<>", "  "), F.lit("</p><script>var a = '<b>';</script></body></html>"))
    canonical, title, text = T.page_text(page)
    return read(spark, d, "primary_source_events").select("record_id", canonical.alias("canonical"), title.alias("title"), F.md5(text).alias("text_hash"))


def f13_times(spark: SparkSession, d: str) -> DataFrame:
    """Which of the times of an article counts, by source."""
    now = F.lit("2024-01-01 00:00:00+00:00").cast("timestamp")
    first = F.when(F.col("record_id") % 3 == 0, F.col("published_at").cast("timestamp"))
    best = T.best_candidate([(first, 1.0, "json_ld"), (F.col("modified_at").cast("timestamp"), 0.95, "meta_tag"), (F.col("discovered_at").cast("timestamp"), 0.9, "html_time")], now)
    return read(spark, d, "primary_source_events").groupBy(best["source"].alias("time_source"), best["confidence"].alias("confidence")).agg(F.count("*").alias("n"), F.max(F.unix_micros(best["value"])).alias("latest"))


def h25_drift(spark: SparkSession, d: str) -> DataFrame:
    """How far titles of one event moved from its first title."""
    r = read(spark, d, "production_rows").distinct().select("row_id", F.lower(F.trim("event_id")).alias("event"), "title")
    first = r.groupBy("event").agg(F.min_by("title", "row_id").alias("first_title"), F.min("row_id").alias("first_id"))
    j = r.join(first, "event").where("row_id <> first_id")
    like = I.jaccard(I.words(F.col("title")), I.words(F.col("first_title")))
    return j.groupBy(T.drift(F.col("first_title"), F.col("title"), like, F.lit(0.0)).alias("drift")).agg(F.count("*").alias("n"))


def j3_class_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the sentiments before and after a day, with the rare ones."""
    e = _events(spark, d).withColumns({"split": F.when(F.col("published_at") < F.lit("2023-01-01").cast("timestamp"), "train").otherwise("test"), "label": F.lower("sentiment")})
    return Q.class_shares(e, "split", "label", 0.2).select("split", "label", "n", F.round("share", 6).alias("share"), "rare")


def j7_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Fields that articles have, by year and source type."""
    a = read(spark, d, "primary_source_events").withColumn("year", F.year(F.col("published_at").cast("timestamp")))
    return a.groupBy("year", "source_type").agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in ("author", "canonical_url", "modified_at", "assets_json")])


def k5_quantile_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules at the quartiles of a feature over the earlier results, measured on all of them."""
    x = _one(spark, d).withColumn("x", (F.col("actor") % 97).cast("double"))
    q = quantiles(x.where(F.col("published_us") < _TRAIN), [], "x", [0.25, 0.5, 0.75]).first()
    m = K.rule_metrics(x, {f"q{k}": F.col("x") >= v for k, v in enumerate(q["q"] if q else [])}, "ret")
    return m.select("rule_id", "n", "wins", F.round("mean_return", 5).alias("mean_return"), F.round("median_return", 5).alias("median_return"))


def m1_search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the newest ETH events found by a search, with the number of all."""
    e = _events(spark, d)
    hits = e.join(M.search(e, "upgrade OR fork OR treasury", "event_id", "title", ["source", "category"]).select("event_id"), "event_id")
    return M.page(hits, M.EventQuery(asset="ETH", date_from="2021-06-01", date_to="2024-05-31"), [F.desc("published_at"), F.desc("event_id")], 10, 2).select("event_id", "total")


def a2_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Orders written by status and year into the shared folder, once for a signature, and read back."""
    o = read(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    path = f"{checkpoint_dir(spark)}/a2_{abs(hash(d))}"
    S.write_partitioned(o, path, ["o_orderstatus", "year"], f"orders:{o.count()}")
    back = spark.read.parquet(path)
    return back.groupBy("o_orderstatus", "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def stream_resume_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Where polling of each type of event goes on."""
    e = read(spark, d, "events").select("event_type", F.timestamp_micros(epoch_us("ts")).alias("t"))
    return W.resume_cursor(e, "event_type", "t", "1 HOUR").select("event_type", F.unix_micros("next").alias("next_us"))


def stream_request_pages(spark: SparkSession, d: str) -> DataFrame:
    """The windows of at most 24 hours that are still to be asked for until a day."""
    e = read(spark, d, "events").select("event_type", F.date_trunc("hour", F.timestamp_micros(epoch_us("ts"))).alias("t"))
    p = W.request_pages(W.resume_cursor(e, "event_type", "t", "1 HOUR"), "event_type", "2024-03-05 00:00:00", "1 HOUR", 24)
    return p.select("event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"))


QUERIES = {f.__name__: f for f in (
    g22_story_candidates, g14_stories, g19_conflicts, d25_conflicts, e14_rolling_change, f6_official_ids, f12_pages, f13_times, h25_drift, j3_class_shares, j7_by_year, k5_quantile_rules, m1_search_page, a2_partitioned,
    stream_resume_cursors, stream_request_pages,
)}

_PE = "primary_source_events"
_NEAR = "bo AS (SELECT a, b, cosine FROM pr UNION ALL SELECT b, a, cosine FROM pr), nr AS (SELECT a, b, cosine FROM bo QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) <= {0})"
_KEYS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"

SQL = {
    "g22_story_candidates": f"""WITH {_T}, {_CHAR}, {_V}, {_PAIR.format('x.id < y.id', 3 * _DAY, 0.84)}, {_NEAR.format(7)}, k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM nr),
        s AS (SELECT record_id, coalesce(list_transform(from_json(assets_json, '["VARCHAR"]'), lambda x: upper(x)), []) AS l, epoch_us(published_at) AS t FROM {_PE})
        SELECT k.a, k.b, round(cosine, 6) AS cosine, CASE WHEN cosine >= 0.965 AND abs(x.t - y.t) <= 129600000000 THEN 'MERGE_STORY' ELSE 'REVIEW' END AS action FROM k JOIN pr ON pr.a = k.a AND pr.b = k.b JOIN s x ON x.record_id = k.a JOIN s y ON y.record_id = k.b WHERE list_has_any(x.l, y.l) OR len(x.l) = 0 OR len(y.l) = 0""",
    "g14_stories": f"""WITH RECURSIVE {_T}, {_CHAR}, {_V}, {_PAIR.format('x.id < y.id', 2 * _DAY, 0.965)}, {_NEAR.format(3)}, u AS (SELECT record_id AS id, lower(url) AS k FROM {_PE} WHERE published_at IS NOT NULL UNION ALL SELECT id, k FROM t WHERE k <> ''),
        st AS (SELECT min(id) OVER (PARTITION BY k) AS a, id AS b FROM u WHERE k IS NOT NULL), e0 AS (SELECT a, b FROM nr UNION SELECT a, b FROM st WHERE a <> b), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
        c(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root <= e.b) SELECT node, min(root) AS component FROM c GROUP BY 1""",
    "g19_conflicts": "SELECT title, primary_asset, count(DISTINCT lower(trim(event_id))) AS targets FROM production_rows WHERE primary_asset IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(event_id))) > 1",
    "d25_conflicts": f"WITH {RETURNS} SELECT symbol, count(*) AS n, round(0.001::DOUBLE, 6) AS most FROM hr WHERE ret IS NOT NULL AND event_id % 5 = 0 GROUP BY 1",
    "e14_rolling_change": f"WITH {BARS}, w AS (SELECT symbol, bar, close, row_number() OVER k AS r, avg(close) OVER (k ROWS 7 PRECEDING) AS m, lag(close, 3) OVER k AS o FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY bar)) SELECT symbol, bar, round(CASE WHEN r >= 8 THEN m END, 6) AS rolling_mean, round((close - o) / nullif(o, 0), 6) AS change FROM w",
    "f6_official_ids": f"SELECT record_id, CASE record_id % 3 WHEN 0 THEN 'sec:' || lpad(record_id::VARCHAR, 10, '0') || '21000001' WHEN 1 THEN 'github:org/repo:' || record_id ELSE '' END AS official_id FROM {_PE}",
    "f12_pages": f"SELECT record_id, url AS canonical, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, md5(trim(regexp_replace(translate(coalesce(body, ''), '<>', '  '), '\\s+', ' ', 'g'))) AS text_hash FROM {_PE}",
    "f13_times": f"""WITH x AS (SELECT CASE WHEN record_id % 3 = 0 AND published_at <= '2024-01-01' THEN 1 WHEN modified_at <= '2024-01-01' THEN 2 WHEN discovered_at <= '2024-01-01' THEN 3 END AS k, published_at, modified_at, discovered_at FROM {_PE})
        SELECT CASE k WHEN 1 THEN 'json_ld' WHEN 2 THEN 'meta_tag' WHEN 3 THEN 'html_time' END AS time_source, CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 END::DOUBLE AS confidence, count(*) AS n, max(epoch_us(CASE k WHEN 1 THEN published_at WHEN 2 THEN modified_at WHEN 3 THEN discovered_at END)) AS latest FROM x GROUP BY 1, 2""",
    "h25_drift": f"""WITH r AS (SELECT DISTINCT row_id, lower(trim(event_id)) AS event, title FROM production_rows), f AS (SELECT event, arg_min(title, row_id) AS ft, min(row_id) AS fi FROM r GROUP BY 1),
        j AS (SELECT title, ft, {_KEYS.format('title')} AS a, {_KEYS.format('ft')} AS b FROM r JOIN f USING (event) WHERE row_id <> fi) SELECT CASE WHEN title IS NULL OR ft IS NULL OR title = '' OR ft = '' THEN 'unverified' WHEN title = ft THEN 'exact' WHEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.9 THEN 'minor' ELSE 'material' END AS drift, count(*) AS n FROM j GROUP BY 1""",
    "j3_class_shares": f"WITH {_EV}, c AS (SELECT CASE WHEN published_at < '2023-01-01' THEN 'train' ELSE 'test' END AS split, lower(sentiment) AS label, count(*) AS n FROM ev WHERE sentiment IS NOT NULL GROUP BY 1, 2) SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share, n / sum(n) OVER (PARTITION BY split) < 0.2 AS rare FROM c",
    "j7_by_year": f"SELECT year(published_at) AS year, source_type, count(*) AS rows, count(author) AS author, count(canonical_url) AS canonical_url, count(modified_at) AS modified_at, count(assets_json) AS assets_json FROM {_PE} GROUP BY 1, 2",
    "k5_quantile_rules": f"""WITH {_FR}, x AS (SELECT ret, (actor % 97)::DOUBLE AS x, published_us FROM o), q AS (SELECT unnest([0, 1, 2]) AS k, unnest([quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)]) AS v FROM x WHERE published_us < {_TRAIN})
        SELECT 'q' || k AS rule_id, count(*) AS n, count(*) FILTER (ret > 0) AS wins, round(avg(ret), 5) AS mean_return, round(median(ret), 5) AS median_return FROM x JOIN q ON x >= v GROUP BY k""",
    "m1_search_page": f"""WITH {_EV}, t AS (SELECT *, {_TERMS.format('title')} AS tt, {_TERMS.format("concat_ws(' ', source, category)")} AS oo FROM ev), h AS (SELECT event_id, published_at FROM t WHERE list_has_any(list_concat(tt, oo), ['upgrade', 'fork', 'treasury']) AND list_contains(assets, 'ETH') AND published_at >= '2021-06-01' AND published_at < '2024-06-01')
        SELECT event_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY published_at DESC, event_id DESC LIMIT 10 OFFSET 10""",
    "a2_partitioned": "SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
    "stream_resume_cursors": "SELECT event_type, max(epoch_us(ts)) + 3600000000 AS next_us FROM events GROUP BY 1",
    "stream_request_pages": """WITH c AS (SELECT event_type, max(epoch_us(ts)) // 3600000000 * 3600000000 + 3600000000 AS n FROM events GROUP BY 1), p AS (SELECT event_type, unnest(generate_series(n, epoch_us(TIMESTAMP '2024-03-05 00:00:00'), 86400000000)) AS start_us FROM c)
        SELECT event_type, start_us, least(start_us + 23 * 3600000000, epoch_us(TIMESTAMP '2024-03-05 00:00:00')) AS stop_us FROM p""",
}
