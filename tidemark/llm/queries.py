"""Queries of the corpus operators, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import groups, splits
from tidemark.llm.leaks import leaked_spans, without_leaks
from tidemark.llm.nearcopies import group_pairs, near_copy_groups
from tidemark.llm.nearest import nearest_time_join
from tidemark.llm.packing import containers
from tidemark.llm.repeats import repeated_lines, without_lines
from tidemark.llm.spam import scored_pages, spam_pages
from tidemark.llm.wrappers import boilerplate
from tidemark.plans.cut import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of a record's body that isn't the article's own text."""
    return boilerplate(read(spark, sf_dir, "primary_source_events"))


def p2_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's body without those lines."""
    records = read(spark, sf_dir, "primary_source_events").select("record_id", "source", "title", "author", "body")
    return without_lines(records, boilerplate(records)).select("record_id", "body")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records in the same group of near-copies."""
    return group_pairs(near_copy_groups(read(spark, sf_dir, "primary_source_events")))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the text it copies exactly and the group of near-copies it belongs to."""
    return near_copy_groups(read(spark, sf_dir, "primary_source_events"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line found in at least 8 records of its source."""
    return repeated_lines(read(spark, sf_dir, "primary_source_events"))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's body without those lines."""
    records = read(spark, sf_dir, "primary_source_events").select("record_id", "source", "body")
    return without_lines(records, repeated_lines(records)).select("record_id", "body")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each market reaction with the announcement of its asset published closest to the reaction's start, at most 10 minutes away."""
    reactions = read(spark, sf_dir, "stage16c_market_reactions")
    left = reactions.select(
        F.col("reaction_id").alias("left_id"), F.upper(F.regexp_replace("symbol", "(?i)USDT$", "")).alias("entity"),
        (F.unix_micros(F.col("baseline_time").cast("timestamp")) - F.col("latency_minutes").cast("bigint") * 60_000_000).alias("t"),
    )
    events = read(spark, sf_dir, "primary_source_events").where("published_at IS NOT NULL AND assets_json IS NOT NULL")
    right = events.select(
        F.col("record_id").alias("right_id"), F.explode(F.array_distinct(F.transform(F.from_json("assets_json", "array<string>"), lambda x: F.upper(F.trim(x))))).alias("entity"),
        F.unix_micros(F.col("published_at").cast("timestamp")).alias("t"),
    )
    return nearest_time_join(left, right, 600_000_000).select(F.col("left_id").alias("reaction_id"), F.col("right_id").alias("record_id")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows tied to at least one other row by event or author, with the key of their group."""
    return groups(read(spark, sf_dir, "production_rows"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's split, in the proportions of the earlier run, no tied rows in two splits."""
    s = read(spark, sf_dir, "stage17_summary").agg(F.sum("train"), F.sum("validation"), F.sum("test")).first()
    return splits(read(spark, sf_dir, "production_rows"), {"train": float(s[0] or 1), "validation": float(s[1] or 0), "test": float(s[2] or 0)})


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every text or piece of a text."""
    return containers(read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and evaluation item of which at least 12 consecutive words stand in the document."""
    return leaked_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the leaked passages."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_leaks(docs, leaked_spans(docs, read(spark, sf_dir, "eval_items")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is mostly piled-up keywords, links, hashtags or product tags."""
    return spam_pages(read(spark, sf_dir, "documents"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, before and after smoothing by its host."""
    return scored_pages(read(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_content": p2_content,
    "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_cleaned": p4_cleaned,
    "p5_found": p5_found, "p6_found": p6_found, "p6_splits": p6_splits, "p7_containers": p7_containers, "p8_found": p8_found, "p8_cleaned": p8_cleaned,
    "p9_found": p9_found, "p9_scores": p9_scores,
}

SQL = {
    "p5_found": """
        WITH r AS (SELECT DISTINCT reaction_id, upper(regexp_replace(symbol, 'USDT$', '')) AS a, epoch_us(baseline_time) - latency_minutes::BIGINT * 60000000 AS t
                   FROM stage16c_market_reactions),
        e AS (SELECT DISTINCT record_id, upper(trim(unnest(from_json(assets_json, '["VARCHAR"]')))) AS a, epoch_us(published_at) AS t
              FROM primary_source_events WHERE published_at IS NOT NULL AND assets_json IS NOT NULL),
        c AS (SELECT r.reaction_id, e.record_id, abs(e.t - r.t) AS d FROM r JOIN e ON r.a = e.a AND e.t BETWEEN r.t - 600000000 AND r.t + 600000000)
        SELECT reaction_id, record_id FROM c QUALIFY row_number() OVER (PARTITION BY reaction_id ORDER BY d, record_id) = 1
    """,
    "p8_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d)),
        eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
    """,
    "p8_cleaned": """
        WITH e AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        eg AS (SELECT DISTINCT array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT w, unnest(generate_series(1, len(w) - 11)) AS i FROM e)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d) JOIN eg ON g = array_to_string(w[i:i + 11], ' ')),
        gone AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 11)) AS i FROM hit),
        part AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\p{L}\\p{N}]+')) AS gap, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word,
                        generate_subscripts(regexp_split_to_array(text, '[\\p{L}\\p{N}]+'), 1) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM hit)),
        rest AS (SELECT part.doc_id, string_agg(CASE WHEN a.i IS NULL OR b.i IS NULL THEN gap ELSE '' END || CASE WHEN a.i IS NULL THEN coalesce(word, '') ELSE '' END, '' ORDER BY part.i) AS text
                 FROM part LEFT JOIN gone AS a USING (doc_id, i) LEFT JOIN gone AS b ON b.doc_id = part.doc_id AND b.i = part.i - 1 GROUP BY part.doc_id)
        SELECT doc_id, CASE WHEN rest.doc_id IS NULL THEN d.text ELSE rest.text END AS text FROM documents AS d LEFT JOIN rest USING (doc_id)
    """,
    "p4_found": """
        WITH l AS (SELECT record_id, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no
                   FROM primary_source_events WHERE body IS NOT NULL),
        k AS (SELECT record_id, source, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS key FROM l),
        f AS (SELECT source, key FROM k WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT record_id) >= 8)
        SELECT DISTINCT record_id, line_no FROM k JOIN f ON k.key = f.key AND k.source IS NOT DISTINCT FROM f.source
    """,
    "p4_cleaned": """
        WITH l AS (SELECT record_id, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no
                   FROM primary_source_events WHERE body IS NOT NULL),
        k AS (SELECT record_id, source, line, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS key FROM l),
        f AS (SELECT source, key FROM k WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT record_id) >= 8),
        c AS (SELECT k.record_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (f.key IS NULL), '') AS body
              FROM k LEFT JOIN f ON k.key = f.key AND k.source IS NOT DISTINCT FROM f.source GROUP BY k.record_id)
        SELECT record_id, c.body FROM primary_source_events LEFT JOIN c USING (record_id)
    """,
    "p6_found": """
        WITH RECURSIVE r AS (SELECT DISTINCT row_id, nullif(lower(trim(event_id)), '') AS e, lower(trim(regexp_replace(trim(author_handle), '^@', ''))) AS h FROM production_rows WHERE row_id IS NOT NULL),
        k AS (SELECT row_id, 'e:' || e AS e, CASE WHEN h NOT IN ('', 'n/a') THEN 'a:' || h END AS a FROM r),
        ed AS (SELECT DISTINCT e AS x, a AS y FROM k WHERE e IS NOT NULL AND a IS NOT NULL UNION SELECT DISTINCT a, e FROM k WHERE e IS NOT NULL AND a IS NOT NULL),
        cc(node, root) USING KEY (node) AS (
            SELECT DISTINCT n, n FROM (SELECT e AS n FROM k UNION ALL SELECT a FROM k) WHERE n IS NOT NULL
            UNION SELECT ed.y, min(cc.root) FROM cc JOIN ed ON ed.x = cc.node JOIN recurring.cc AS o ON o.node = ed.y WHERE cc.root < o.root GROUP BY ed.y),
        t AS (SELECT k.row_id, k.e, k.a, coalesce(c.root, 'r:' || k.row_id) AS g FROM k LEFT JOIN cc AS c ON c.node = coalesce(k.e, k.a)),
        g AS (SELECT g, coalesce(min(a)[3:], min(e)[3:]) AS group_key FROM t GROUP BY g HAVING count(DISTINCT row_id) >= 2)
        SELECT DISTINCT row_id, group_key FROM t JOIN g USING (g)
    """,
}
