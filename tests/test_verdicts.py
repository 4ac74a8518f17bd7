"""Verdicts, evidence, quantiles and resampling on small fixtures with NULLs, ties, repeated rows, empty tables and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.operators import context as X
from tidemark.operators import dataset as D
from tidemark.operators import ordered as O
from tidemark.operators import stats as L
from tidemark.operators import verdicts as V


@pytest.mark.parametrize(("buckets", "direct"), [(2, 0), (256, 0), (256, 10**6)])
def test_quantiles(spark, buckets, direct):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, 2.0, None, rng.random() * 100]), "q") for _ in range(400)] + [("lone", 7.0, "q"), ("none", None, "q")]
    df = spark.createDataFrame(rows, "g string, v double, q string")
    got = {r.g: r.q for r in O.quantiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.9, 1.0], buckets=buckets, direct=direct).collect()}
    assert got.keys() == {"a", "b", None, "lone"}
    for g, q in got.items():
        want = np.quantile([v for k, v, _ in rows if k == g and v is not None], [0.0, 0.05, 0.5, 0.9, 1.0])
        assert np.allclose(q, want)
    whole = O.quantiles(df, [], "v", [0.5], direct=direct).collect()
    assert np.isclose(whole[0].q[0], np.median([v for _, v, _ in rows if v is not None]))
    assert O.quantiles(df.limit(0), ["g"], "v", [0.5], direct=direct).collect() == O.quantiles(df.limit(0), [], "v", [0.5], direct=direct).collect() == []


def test_rolling_score_is_the_same_however_it_is_cut(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("xy"), i, None if i % 17 == 0 else rng.random()) for i in range(300)], "k string, t bigint, v double")
    runs = [{(r.k, r.t): r.score and round(r.score, 9) for r in X.rolling_score(df, ["k"], "t", "v", 10, 4, bucket=b).collect()} for b in (1, 37, 4096)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 300


def test_benjamini_hochberg(spark):
    rng = random.Random(3)
    p = [rng.random() ** 6 for _ in range(200)] + [0.0, 1.0, 0.5, 0.5]
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    want, best = {}, 1.0
    for k in range(len(p), 0, -1):
        best = min(best, p[order[k - 1]] * len(p) / k)
        want[order[k - 1]] = best
    got = {r.i: r.q for r in L.benjamini_hochberg(spark.createDataFrame([*enumerate(p), (999, None)], "i int, p double"), "p", "i").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_selected_candles(spark):
    good = (1.0, 2.0, 0.5, 1.5, 0, 59_999_999)
    rows = [good, (float("nan"), 2.0, 0.5, 1.5, 0, 59_999_999), (1.0, 1.2, 0.5, 1.5, 0, 59_999_999), (1.0, 2.0, 1.1, 1.5, 0, 59_999_999), (1.0, 2.0, 0.5, 1.5, 0, 60_000_000), (1.0, 2.0, 0.5, 1.5, 0, 59_998_999), (0.0, 2.0, 0.0, 1.5, 0, 59_999_999), (None, 2.0, 0.5, 1.5, 0, 59_999_000), good]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double, open_us bigint, close_us bigint")
    assert [r[0] for r in df.select(V.selected_candle_ok()).collect()] == [True, False, False, False, False, False, False, False, True]


def test_final_quality(spark):
    hour = 3600
    returns = spark.createDataFrame([
        (1, "A", 10, 1, 5.0, 0.1), (1, "A", 10, 2, 5.0, 0.2), (2, "A", 10, 1, 5.0, None), (2, "A", 10, 2, 5.0, 0.2), (3, "A", 10, 1, None, None), (3, "A", 10, 2, None, None), (4, "A", 20, 1, 5.0, None), (5, "B", 10, 1, None, None),
    ], "event_id int, symbol string, base bigint, horizon int, base_open double, ret double")
    months = spark.createDataFrame([("A", 1970 * 12)], "symbol string, month int")
    bad = spark.createDataFrame([("A", 21)], "symbol string, bar bigint")
    got = {r.event_id: (r.quality, r.reasons) for r in V.final_quality(returns, months, bad, hour).collect()}
    assert got == {
        1: ("raw_verified_v2", None), 2: ("partial_raw_verified_v2", '{"1":"endpoint_missing"}'), 3: ("missing_market_data", '{"1":"endpoint_missing","2":"endpoint_missing"}'),
        4: ("excluded_invalid_candle", '{"1":"invalid_candle"}'), 5: ("missing_market_data", '{"1":"market_archive_missing"}'),
    }
    assert V.final_quality(returns.limit(0), months, bad, hour).collect() == []


def test_event_records(spark):
    bars = [(s, b) for s in "AB" for b in range(100) if (s, b) not in {("A", 50), ("B", 80)}]
    events = [(i, c) for i, c in enumerate([-1, 3, 30, 52, 78, 98, 100, 30])]
    got = {r.event_id: r.reason for r in V.event_records(spark.createDataFrame(events, "event_id int, cutoff bigint"), spark.createDataFrame(bars, "symbol string, bar bigint"), ["A", "B"], 10, 3, 2).collect()}
    assert got == {
        0: "published_before_candle_coverage", 1: "insufficient_history", 2: None, 3: "insufficient_pre_news_candles_or_gap", 4: "insufficient_future_candles_or_gap", 5: "insufficient_future_candles_or_gap",
        6: "published_after_candle_coverage", 7: None,
    }


def test_leakage_guard():
    assert D.forbidden_features(["pre_return_1h", "hour", "title_length"]) == []
    bad = ["return_1h", "Abnormal_Return_5m", "max_favorable_1h", "max_adverse_x", "eth_reaction_1h", "my_mfe", "time_to_mae", "target_up", "future_vol", "volume_shock_5m", "realized_vol_1h", "post_event_x"]
    assert D.forbidden_features(bad) == bad


def test_repaired_scores(spark):
    rows = [("negative", 0.4), ("positive", -0.3), ("positive", 0.2), ("neutral", 0.9), ("mixed", -0.9), ("not_applicable", 0.1), (None, 0.5), ("negative", None)]
    score, how = V.repaired_score(F.col("l"), F.col("s"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "l string, s double").select(score, how).collect()]
    assert got == [(-0.4, "sign_from_label"), (0.3, "sign_from_label"), (0.2, "none"), (0.0, "none"), (0.0, "mixed_to_zero"), (None, "none"), (0.5, "none"), (None, "none")]


def test_evidence(spark):
    names = {"BTC": ["btc", "bitcoin"], "ETH": ["eth", "ether"]}
    rows = [("Bitcoin, and ether", None, True), ("Ethernet", "a BTC note", True), (None, "a BTC note", False), ("", "", True)]
    df = spark.createDataFrame(rows, "title string, body string, sure boolean")
    a = E.classified_assets(F.col("title"), F.col("body"), names, F.col("sure"))
    assert [tuple(r) for r in df.select(a, E.primary_asset(a)).collect()] == [(["BTC", "ETH"], None), (["BTC"], "BTC"), ([], None), ([], None)]
    told = spark.createDataFrame([("It took 5 minutes, and after 3 hours nothing. In 1 day all was over 24 hours.",), (None,)], "t string").select(F.explode(E.durations(F.col("t"))).alias("x"))
    assert [tuple(r) for r in told.select("x.n", "x.unit", E.horizon_of(F.col("x.n"), F.col("x.unit"))).collect()] == [(5, "minute", "5m"), (3, "hour", None), (1, "day", "24h"), (24, "hour", "24h")]


def test_group_comparison(spark):
    rows = [("a", float(v)) for v in (1, 2, 2, 3, 9)] + [("b", float(v)) for v in (2, 4, 4, 8, 8, 10)] + [("b", None), (None, 1.0)]
    r = L.group_comparison(spark.createDataFrame(rows, "g string, v double"), "v", F.col("g") == "a").first()
    assert (r.n1, r.n2, r.u) == (5, 6, 7.0) and abs(r.p - 0.1665) < 0.002 and abs(r.difference - (3.4 - 6)) < 1e-9


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i, "g", float(i % 10)) for i in range(500)], "i int, g string, v double")
    r = L.bootstrap_mean(df, ["g"], "i", "v", 200).first()
    assert r.n == 500 and r.low < 4.5 < r.high and 0.3 < r.high - r.low < 0.8


def test_locked_test_is_bound_to_its_list(spark):
    rows = spark.createDataFrame([(i, "r1" if i % 2 else "r2", i * 86_400_000_000, float(i)) for i in range(7)], "event int, rule string, t bigint, v double")
    one = {(r.rule, r.chunk): (r.n, r.digest) for r in V.locked_test(rows, spark.createDataFrame([("r1",), ("r1",)], "rule string"), ["rule"], "t", "event", "v").collect()}
    assert {k: n for k, (n, _) in one.items()} == {("r1", 1): 1, ("r1", 2): 1, ("r1", 3): 1}
    other = V.locked_test(rows, spark.createDataFrame([("r2",)], "rule string"), ["rule"], "t", "event", "v").first().digest
    assert len({d for _, d in one.values()} | {other}) == 2
