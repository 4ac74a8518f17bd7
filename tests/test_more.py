import importlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import textrules as T
from tidemark.operators import context as X
from tidemark.operators import dedup as G
from tidemark.operators import quality as Q
from tidemark.operators import reactions as R
from tidemark.operators import similarity as Y
from tidemark.operators import stats as L
from tidemark.operators.windowed import meetings

SMALL = Path("/root/testdata/sf0.01")


def test_greedy_groups_equal_a_plain_loop(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randrange(500), [rng.choice("uvwxyz") for _ in range(rng.randrange(0, 4))]) for i in range(200)]
    want, open_ = {}, {}
    for k, i, t, w in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[2], r[1])):
        mine = set(w)
        for g in open_.setdefault(k, []):
            if t - g[1] <= 40 and all(m and mine and len(mine & m) >= 0.5 * min(len(m), len(mine)) for m in g[2]):
                g[2].append(mine)
                want[k, i] = g[0]
                break
        else:
            open_[k].append((i, t, [mine]))
            want[k, i] = i
    df = spark.createDataFrame(rows, "k string, i bigint, t bigint, w array<string>")
    assert {(r.k, r.i): r.group for r in G.greedy_groups(df, "k", "i", "t", "w", 40, 0.5).collect()} == want


def test_as_of_takes_the_row_of_equal_time_and_spans_days(spark):
    day = 86_400_000_000
    left = spark.createDataFrame([("a", 10, 1), ("a", 5 * day, 2), ("b", 5, 3), ("a", 3, 4)], "k string, t bigint, i int")
    right = spark.createDataFrame([("a", 10, 7.0), ("a", 4, 6.0), ("c", 1, 1.0)], "k string, t bigint, v double")
    assert {r.i: r.v for r in X.as_of(left, right, ["k"], "t", ["v"]).collect()} == {1: 7.0, 2: 7.0, 3: None, 4: None}
    assert {r.i: r.v for r in X.as_of(left, right, ["k"], "t", ["v"], day).collect()} == {1: 7.0, 2: None, 3: None, 4: None}


def test_cosine_pairs_lose_nothing(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), i * 10) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, text string, t bigint")
    v = Y.tfidf(df, "id", Y.char_grams(F.col("text")))
    vec = {}
    for r in v.collect():
        vec.setdefault(r.id, {})[r.gram] = r.w
    for least in (0.3, 0.8):
        want = {(a, b) for a in vec for b in vec if a < b and abs(a - b) * 10 <= 150 and sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= least}
        assert {(r.a, r.b) for r in Y.alike_pairs(v, df, least, 150).collect()} == want


def test_alike_texts_lose_nothing(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "t1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), rng.randrange(-300, 900), rng.choice(["a", "b", None])) for i in range(90)]
    df = spark.createDataFrame([*rows, rows[0]], "id bigint, k string, t bigint, side string")  # a repeated row counts once
    at, side = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for grams, codes in ((Y.char_grams, Y.char_codes), (Y.word_grams, Y.word_codes)):
        vec = {}
        for r in Y.tfidf(df.distinct(), "id", grams(F.col("k"))).collect():
            vec.setdefault(r.id, {})[r.gram] = r.w
        dot = {(a, b): sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) for a in vec for b in vec if abs(at[a] - at[b]) <= 150 and a != b}
        for least, cell in ((0.35, 4), (0.35, 1000), (0.84, 4)):
            for sided in (False, True):
                want = {p: c for p, c in dot.items() if c >= least and (side[p[0]] == "a" and side[p[1]] == "b" if sided else p[0] < p[1])}
                got = [(r.a, r.b, r.cosine) for r in Y.alike_texts(df, codes, least, 150, sided, cell).collect()]
                assert sorted((a, b) for a, b, _ in got) == sorted(want)
                assert all(abs(c - want[a, b]) < 1e-9 for a, b, c in got)


def shuffled(spark, df):
    """Bytes that the stages of a query write to shuffles."""

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    df().write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["g14_stories", "g14_story_pairs", "g14_story_clusters", "g22_story_candidates", "g16_primary_media"])
def test_likeness_shuffles_little(spark, name):
    query = importlib.import_module("__spark_entry__").queries()[name]
    assert 0 < shuffled(spark, lambda: query(spark, str(SMALL))) < 4 * (SMALL / "primary_source_events.parquet").stat().st_size


def test_best_partner_equals_nearest_of_all_pairs(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "t1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))), rng.randrange(-300, 900), rng.choice(["a", "b", "b", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, side string")
    want = {(r.a, r.b, round(r.cosine, 9)) for r in Y.nearest(Y.alike_texts(df, Y.word_codes, 0.35, 150, True), 1).collect()}
    for cell in (5, 1000):
        assert {(r.a, r.b, round(r.cosine, 9)) for r in Y.nearest(Y.alike_texts(df, Y.word_codes, 0.35, 150, True, cell, best=True), 1).collect()} == want != set()
    same = spark.range(2000).selectExpr("id", "'one title of all' AS k", "id AS t", "IF(id % 2 = 0, 'a', 'b') AS side")
    assert [(r.a, r.b) for r in Y.alike_texts(same, Y.word_codes, 0.35, 5000, True, best=True).orderBy("a").collect()] == [(i, 1) for i in range(0, 2000, 2)]


def test_rows_of_side_b_go_to_the_cells_of_side_a_only(spark):
    rows = spark.range(1000).selectExpr("id", "5L AS t", "IF(id % 10 = 0, 'a', 'b') AS side")
    sent = meetings(rows, "id", "t", 100, True, 50).groupBy("blk", "p", "cell").agg(F.count("*").alias("n"), F.count_if(F.expr("side = 'a'")).alias("a")).collect()
    assert sum(r.n for r in sent) <= 100 + 900 * 4
    assert sum(r.a for r in sent) == 100 and len({(r.blk, r.p) for r in sent if r.a}) == 2


def test_history_equals_all_pairs_and_shuffles_no_pairs(spark, monkeypatch):
    day, rng = 86_400_000_000, random.Random(9)
    rows = [(i, rng.randrange(-40 * day, 80 * day, day // 2), ["all", *rng.choices("abcdef", k=rng.randrange(0, 5))] if i % 9 else []) for i in range(150)]
    words = {i: set(w) for i, _, w in rows}
    want = {}
    for i, t, _ in rows:
        s = [(t - u, len(words[i] & words[k]) / len(words[i] | words[k])) for k, u, _ in rows if t - 30 * day <= u and (u, k) < (t, i) and words[i] & words[k]]
        want[i] = (round(max([j for age, j in s if age <= 7 * day], default=0), 9), sum(j >= 0.5 and age <= 7 * day for age, j in s), sum(j >= 0.5 for _, j in s))
    df = spark.createDataFrame(rows, "i bigint, t bigint, w array<string>")
    whole = G.meetings
    for most in (8192, 7):
        monkeypatch.setattr(G, "meetings", lambda *a, most=most: whole(*a, most=most))
        assert {r.id: (round(r.max_near, 9), r.similar_near, r.similar_all) for r in G.history_similarity(df, "i", "t", "w").collect()} == want
    monkeypatch.setattr(G, "meetings", whole)
    same = spark.range(1500).selectExpr("id AS i", "id AS t", "array('one', string(id % 50)) AS w")
    assert shuffled(spark, lambda: G.history_similarity(same, "i", "t", "w")) < 1_000_000


def test_alike_titles_shuffle_no_pairs(spark):
    rows = [(i, [*random.Random(i).sample("abcdefghijklmnop", 7), *random.Random(i).sample("qrstuvwxyz", 3)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "i bigint, w array<string>")
    want = sum(len({*x} & {*y}) >= 0.8 * len({*x} | {*y}) for a, x in rows for b, y in rows if a < b)
    assert shuffled(spark, lambda: G.alike_titles(df, "i", "w", 0.8)) < 3_000_000
    assert G.alike_titles(df, "i", "w", 0.8).distinct().count() == G.alike_titles(df, "i", "w", 0.8).count() == want


def test_titles(spark):
    df = spark.createDataFrame([("A title", "A title"), ("A title of it", "A title of its"), ("One", "Other"), (None, "x")], "a string, b string")
    out = df.select(T.drift(F.col("a"), F.col("b"), F.lit(0.0), T.sequence_ratio("a", "b"))).collect()
    assert [r[0] for r in out] == ["exact", "minor", "material", "unverified"]
    assert spark.createDataFrame([("ﬁn①",)], "x string").select(T.compatible("x")).first()[0] == "fin1"


def test_alike_titles_equal_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, rng.sample("abcdefgh", rng.randrange(0, 8))) for i in range(70)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}
    df = spark.createDataFrame(rows, "i bigint, w array<string>")
    assert {(r.a, r.b) for r in G.alike_titles(df, "i", "w", 0.6).collect()} == want


def test_benjamini_hochberg_is_monotone(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random() ** 3 if i % 7 else None) for i in range(60)], "i bigint, p double")
    q = sorted((r.p, r.q) for r in L.benjamini_hochberg(df, "p", "i").collect())
    assert all(a[1] <= b[1] for a, b in zip(q, q[1:], strict=False)) and all(p <= x <= 1 for p, x in q)


def test_feature_quality_reasons(spark):
    df = spark.createDataFrame([(float(i), 1.0, None if i % 2 else 1.0 * i, float("nan")) for i in range(50)], "a double, b double, c double, d double")
    got = {r.feature: r.removal_reason for r in Q.feature_quality(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": None, "b": "constant", "c": "missing", "d": "missing"}


def test_bootstrap_covers_the_mean_and_permutation_sees_no_difference(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("g", i // 4, rng.gauss(5, 1)) for i in range(800)], "g string, c bigint, v double")
    r = L.cluster_bootstrap(df, ["g"], "c", "v", 200).first()
    assert r.low < r["mean"] < r.high and r.high - r.low < 0.4 and r.clusters == 200
    p = L.permutation_difference(df, "c", "v", F.col("c") % 2 == 0, 200).first().p
    assert 0 < p <= 1


def test_late_prices_do_not_change_what_was_known(spark):
    grid = [("A", b, float(100 + b % 7), float(110 + b % 7), 90.0, float(101 + b % 5), 10.0) for b in range(200)] + [("B", b, float(50 + b % 3), 60.0, 40.0, 51.0, 5.0) for b in range(200)]
    schema = "symbol string, bar bigint, open double, high double, low double, close double, volume double"
    ev = spark.createDataFrame([(1, "A", 120)], "event_id bigint, symbol string, base bigint")
    early = spark.createDataFrame(grid, schema)
    late = early.withColumns({c: F.when(F.col("bar") >= 120, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    for f in (lambda g: X.beta_before(ev, g, "B", 60, 20), lambda g: X.averages_before(ev, g, 20), lambda g: X.ema_before(ev, g, 12)):
        a, b = f(early).first().asDict(), f(late).first().asDict()
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in a.items()} == b
    assert R.volume_shock(ev, early, 5, 10).first().shock == pytest.approx(1.0)
    assert R.contiguous(ev, early, 120, 79).first().whole and not R.contiguous(ev, early, 121, 0).first().whole


def test_ledger(spark):
    stored = spark.createDataFrame([("u0", "h0")], "u string, h string")
    batch = spark.createDataFrame([(1, "u0", "x"), (2, "u1", "h0"), (3, "u2", "y"), (4, "u2", "z"), (5, None, "y"), (6, "", "")], "i bigint, u string, h string")
    got = {r.i: r.status for r in G.ledger(batch, stored, ["u", "h"], ["i"]).collect()}
    assert got == {1: "stored:u", 2: "stored:h", 3: "new", 4: "batch:u", 5: "batch:h", 6: "new"}


def test_ledger_is_that_of_one_row_after_another(spark):
    rng = random.Random(7)
    stored = [(f"u{rng.randrange(40)}", f"h{rng.randrange(40)}") for _ in range(10)]
    pick = lambda c, n: rng.choice([f"{c}{rng.randrange(n)}", f"{c}{rng.randrange(n)}", None, "", f"{c}hot" if rng.random() < 0.3 else f"{c}{rng.randrange(n)}"])
    batch = [(i, pick("u", 120), pick("h", 120)) for i in range(200)]
    want, seen = {}, [set(), set()]
    for i, *v in batch:
        status = next((f"stored:{n}" for n, x, s in zip("uh", v, zip(*stored, strict=True), strict=True) if x and x in s), None)
        status = status or next((f"batch:{n}" for n, x, s in zip("uh", v, seen, strict=True) if x and x in s), "new")
        if status == "new":
            for x, s in zip(v, seen, strict=True):
                s.add(x)
        want[i] = status
    b, s = spark.createDataFrame(batch, "i bigint, u string, h string"), spark.createDataFrame(stored, "u string, h string")
    assert {r.i: r.status for r in G.ledger(b, s, ["u", "h"], ["i"]).collect()} == want
    twice = {(r.i, r.status) for r in G.ledger(b.limit(1).union(b.limit(1)), s.limit(0), ["u", "h"], ["i"]).collect()}
    assert G.ledger(b.limit(0), s, ["u", "h"], ["i"]).collect() == [] and len(twice) <= 2


@pytest.mark.parametrize(("hold", "holds"), [(7, 1), (7, 3), (7, 1000), (1, 5), (400, 2)])
def test_non_overlapping_is_the_same_however_it_is_cut(spark, hold, holds):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([rng.randrange(-200, 900), 10, None])) for i in range(300)]
    want = set()
    for key in "ab":
        free = None
        for t, i in sorted((t, i) for k, i, t in rows if k == key and t is not None):
            if free is None or t >= free:
                want.add((key, i))
                free = t + hold
    df = spark.createDataFrame(rows, "k string, i bigint, t bigint")
    assert {tuple(r) for r in G.non_overlapping(df, "k", "i", "t", hold, holds).collect()} == want
    assert G.non_overlapping(df.limit(0), "k", "i", "t", hold, holds).collect() == []
