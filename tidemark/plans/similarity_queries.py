"""Queries of TF-IDF likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import text_key
from tidemark.operators import dedup as G
from tidemark.operators import similarity as Y
from tidemark.plans.cut import cut, read
from tidemark.plans.models import epoch_us

_DAY = 86_400_000_000


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "primary_source_events").where("published_at IS NOT NULL").select(F.col("record_id").alias("id"), "title", "source_type", epoch_us("published_at").alias("t"))


def _keys(t: DataFrame, *more: str) -> DataFrame:
    return t.select("id", "t", text_key(F.col("title")).alias("k"), *more)


def g14_story_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose titles have a character n-gram cosine of .84 or more within 72 hours, and whether they merge by themselves."""
    p = Y.alike_texts(_keys(_titles(spark, d)), Y.char_codes, 0.84, 3 * _DAY)
    return p.select("a", "b", F.round("cosine", 6).alias("cosine"), F.when(F.col("cosine") >= 0.965, "merge").otherwise("review").alias("action"))


def g14_story_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the pairs of .965 or more within 48 hours."""
    p = Y.alike_texts(_keys(_titles(spark, d)), Y.char_codes, 0.965, 2 * _DAY)
    return G.min_labels(p.select("a", "b"))


def g16_primary_media(spark: SparkSession, d: str) -> DataFrame:
    """For each article of an official source the most alike media article within 7 days, if the cosine is .35 or more."""
    t = _titles(spark, d)
    side = F.when(F.col("source_type") == "regulator", "a").when(F.col("source_type") == "media", "b")
    p = Y.alike_texts(_keys(t.withColumn("side", side), "side"), Y.word_codes, 0.35, 7 * _DAY, sided=True, best=True)
    return Y.nearest(p, 1).select("a", "b", F.round("cosine", 6).alias("cosine"))


def h24_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ten titles most alike to each of two queries."""
    t = _titles(spark, d)
    q = spark.createDataFrame([(1, "staking yield upgrade window"), (2, "bitcoin order book spread")], "query_id int, text string")
    r = Y.rank_texts(cut(Y.tfidf(t, "id", Y.word_grams(F.col("title")))), q, Y.word_grams(F.col("text")))
    return r.select("query_id", "id", F.round("score", 6).alias("score"), "place")


QUERIES = {f.__name__: f for f in (g14_story_pairs, g14_story_clusters, g16_primary_media, h24_ranking)}

_T = "t AS (SELECT record_id AS id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS k, source_type, epoch_us(published_at) AS t FROM primary_source_events WHERE published_at IS NOT NULL)"
_CHAR = "g AS (SELECT id, substr(' ' || k || ' ', i::INT, n::INT) AS gram FROM t, (SELECT unnest([3, 4, 5]) AS n), LATERAL (SELECT unnest(generate_series(1, length(k) + 3 - n)) AS i))"
_WORDS = "s AS (SELECT id, list_filter(string_split(k, ' '), lambda x: x <> '') AS w FROM t), g AS (SELECT id, unnest(w) AS gram FROM s UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM s, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i))"
_V = "tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT gram, ln((1 + (SELECT count(DISTINCT id) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), rw AS (SELECT id, gram, tf * idf AS w FROM tf JOIN df USING (gram)), v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM rw)"
_PAIR = "pr AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS cosine FROM v x JOIN v y ON x.gram = y.gram JOIN t tx ON tx.id = x.id JOIN t ty ON ty.id = y.id WHERE {0} AND abs(tx.t - ty.t) <= {1} GROUP BY 1, 2 HAVING sum(x.w * y.w) >= {2})"

SQL = {
    "g14_story_pairs": f"WITH {_T}, {_CHAR}, {_V}, {_PAIR.format('x.id < y.id', 3 * _DAY, 0.84)} SELECT a, b, round(cosine, 6) AS cosine, CASE WHEN cosine >= 0.965 THEN 'merge' ELSE 'review' END AS action FROM pr",
    "g14_story_clusters": f"""WITH RECURSIVE {_T}, {_CHAR}, {_V}, {_PAIR.format('x.id < y.id', 2 * _DAY, 0.965)}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), c(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root <= e.b)
        SELECT node, min(root) AS component FROM c GROUP BY 1""",
    "g16_primary_media": f"WITH {_T}, {_WORDS}, {_V}, {_PAIR.format(chr(39).join(['tx.source_type = ', 'regulator', ' AND ty.source_type = ', 'media', '']), 7 * _DAY, 0.35)} SELECT a, b, round(cosine, 6) AS cosine FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) = 1",
    "h24_ranking": f"""WITH {_T}, {_WORDS}, {_V}, qs AS (SELECT 1 AS query_id, string_split('staking yield upgrade window', ' ') AS w UNION ALL SELECT 2, string_split('bitcoin order book spread', ' ')), qg AS (SELECT query_id, unnest(w) AS gram FROM qs UNION ALL SELECT query_id, w[i] || ' ' || w[i + 1] FROM qs, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i)),
        q AS (SELECT query_id, gram, count(*) * any_value(idf) AS q FROM qg JOIN df USING (gram) GROUP BY 1, 2), n AS (SELECT query_id, sqrt(sum(q * q)) AS norm FROM q GROUP BY 1), sc AS (SELECT query_id, id, sum(q * w / norm) AS score FROM q JOIN n USING (query_id) JOIN v USING (gram) GROUP BY 1, 2)
        SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM sc QUALIFY place <= 10""",
}
