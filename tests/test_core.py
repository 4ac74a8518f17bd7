import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity as I
from tidemark.functions import textrules as T
from tidemark.operators import candles as C
from tidemark.operators import dataset as D
from tidemark.operators import dedup as G
from tidemark.operators import reactions as R
from tidemark.operators import serving as M
from tidemark.operators import signals as K
from tidemark.operators import stats as L
from tidemark.operators.ordered import global_rank, running
from tidemark.sources import tables as S
from tidemark.streaming import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_base_is_the_next_minute_also_on_a_border(spark):
    at = 14 * 3600 + 35 * 60
    assert [one(spark, R.base_bar(F.lit(at + s))) for s in (12, 0)] == [14 * 60 + 36] * 2
    assert one(spark, R.base_bar(F.lit(30), latency=1)) == 2


def test_returns_need_exact_ends(spark):
    grid = spark.createDataFrame([("A", 36, 100.0), ("A", 41, 105.0), ("A", 96, 90.0), ("B", 36, 0.0), ("B", 41, 5.0)], "symbol string, bar bigint, open double")
    ev = spark.createDataFrame([(1, "A", 36), (2, "A", 35), (3, "B", 36)], "event_id bigint, symbol string, base bigint")
    got = {(r.event_id, r.horizon): r.ret for r in R.horizon_returns(ev, grid, (5, 15, 60)).collect()}
    assert got[1, 5] == pytest.approx(5) and got[1, 60] == pytest.approx(-10) and got[1, 15] is None
    assert got[2, 5] is None and got[3, 5] is None


def test_excursions_take_the_first_of_equal_extremes(spark):
    rows = [(1, "A", o, h, lo) for o, (h, lo) in enumerate([(1.0, -1.0), (3.0, -2.0), (3.0, -2.0)])]
    p = spark.createDataFrame(rows, "event_id bigint, symbol string, offset bigint, high_ret double, low_ret double")
    assert R.excursions(p).first()[2:] == (3.0, -2.0, 1, 1)
    assert R.excursions(p, short=True).first()[2:] == (2.0, -3.0, 1, 1)


def test_gaps_across_days(spark):
    m = [1, 2, 4, 1438, 1439, 1440, 1445, 5000]
    g = spark.createDataFrame([("A", x) for x in m + m], "symbol string, minute bigint")
    assert sorted(r[1:] for r in C.gaps(g).collect()) == [(3, 3, 1), (5, 1437, 1433), (1441, 1444, 4), (1446, 4999, 3554)]
    assert C.resume_points(g, 1).first()[1] == 3


def test_candle_codes(spark):
    raw = [("A", 1748736000000, 1.0, 2.0, 0.5, 1.5, 0.0, 1748736059999, 0.0, 1, 0.0, 0.0), ("A", 1748736000000, 1.0, 0.5, 0.6, 1.5, 0.0, 1748736059999, 0.0, 1, 0.0, 0.0), ("A", 1748736000000, None, 2.0, 0.5, 1.5, 0.0, 1748736059999000, 0.0, 1, 0.0, 0.0), ("A", 5, 1.0, 1.0, 1.0, 1.0, 0.0, 6, 0.0, 1, 0.0, 0.0)]
    p = C.parse_candles(spark.createDataFrame(raw, "symbol string, open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trade_count bigint, taker_buy_base double, taker_buy_quote double"))
    got = p.select(C.candle_codes("A"), "error", C.sound_candle()).collect()
    assert tuple(got[0]) == ("", None, True) and got[1][0] == "high_below_open|high_below_close|high_below_low" and not got[1][2]
    assert got[1][0].startswith("high_below_open|high_below_close") and got[2][1] == "missing_field" and got[3][1] == "timestamp_out_of_range"


@pytest.mark.parametrize(("url", "want"), [("HTTPS://www.X.com/a/?utm_x=1&b=2", "https://x.com/a?b=2"), ("x.com//a//b/#top", "https://x.com/a/b"), (" ", ""), (None, ""), ("http://X.com", "http://x.com/"), ("https://x.com/a?b=2&a=1&REF=q", "https://x.com/a?a=1&b=2")])
def test_url_key(spark, url, want):
    assert one(spark, I.url_key(F.lit(url).cast("string"))) == want


def test_keys_and_ids(spark):
    assert one(spark, I.text_key(F.lit(' A,  B! "'))) == "a b"
    assert one(spark, I.official_id(F.lit("https://github.com/A/b/pull/7"))) == "github:a/b:7"
    assert one(spark, I.official_id(F.lit("https://www.sec.gov/archives/edgar/data/12/0001-22-333/x.htm"))) == "sec:000122333"
    assert one(spark, I.text_fingerprint(F.lit(None).cast("string"), F.lit(" "))) == ""
    assert one(spark, I.slug(F.lit("Ünïted: A & B"), F.to_timestamp(F.lit("2024-05-01")), F.lit("evt18-abcdef0123"))) == "united-a-b-2024-abcdef01"
    assert one(spark, I.jaccard(I.words(F.lit("a b c")), I.words(F.lit("b c d")))) == pytest.approx(0.5)


def test_text_rules(spark):
    assert one(spark, T.assets_in(F.lit("Bitcoin up"), F.lit("also $sol and ether"))) == "BTC:0.95|ETH:0.75"
    assert one(spark, T.amount_usd(F.lit("raised € 1,250.5 million"))) == pytest.approx(1250.5e6 * 1.08)
    assert one(spark, T.amount_usd(F.lit("nothing"))) is None
    html = "<html><head><title> A  B </title><link rel='canonical' href='https://x/y'></head><body><script>no</script><p>Hello <b>you</b></p></body></html>"
    c, t, x = T.page_text(F.lit(html))
    assert [one(spark, v) for v in (c, t, x)] == ["https://x/y", "A B", "Hello you"]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in G.min_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_star_pairs_and_ties(spark):
    m = spark.createDataFrame([(1, "u", None), (2, "u", "h"), (3, "", "h"), (4, None, "h")], "i bigint, url string, hash string")
    assert sorted(map(tuple, G.pairs_by_key(m, "i", ["url", "hash"]).collect())) == [(1, 2, "url"), (2, 3, "hash"), (2, 4, "hash")]


def test_non_overlapping(spark):
    r = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 10), ("a", 4, 10), ("b", 5, 3)], "k string, i bigint, t bigint")
    assert sorted(x.i for x in G.non_overlapping(r, "k", "i", "t", 10).collect()) == [1, 3, 5]


def test_global_order(spark):
    rng = random.Random(1)
    v = [(i, rng.randrange(10**12), float(rng.randrange(-50, 50))) for i in range(500)]
    df = spark.createDataFrame(v, "i bigint, t bigint, v double")
    day, order = F.floor(F.col("t") / 86_400_000_000), [F.asc("t"), F.asc("i")]
    want = sorted(v, key=lambda x: (x[1], x[0]))
    assert {r.i: r["rank"] for r in global_rank(df, day, order).collect()} == {x[0]: k for k, x in enumerate(want, 1)}
    e, total, peak, falls = K.equity(df, "t", "i", "v").collect(), 0.0, 0.0, {}
    for i, _, x in want:
        total += x
        peak = max(peak, total)
        falls[i] = total - peak
    assert {r.i: r.drawdown for r in e} == falls
    assert max(r.x for r in running(df, day, order, "v", "x", largest=True).collect()) == max(x[2] for x in v)
    folds = D.folds(df, "t", "i", 7).groupBy("fold").count().collect()
    assert [r["count"] for r in sorted(folds)] == [72, 72, 72, 71, 71, 71, 71]


def test_rules(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert [r[0] for r in x.select(K.rule_predicate({"x": {"gte": 2, "lt": 4}}, ["x"])).collect()] == [False, True, True, False, False]
    for bad in ({"y": {"eq": 1}}, {"x": {"like": 1}}):
        with pytest.raises(ValueError):
            K.rule_predicate(bad, ["x"])
    r = [{"direction": "bullish", "target_horizon": "1h", "conditions": {"a": {"gt": 1}, "b": {"lt": 2}}}, {"direction": "bullish", "target_horizon": "1h", "conditions": {"b": {"lt": 2}, "a": {"gt": 1}}}]
    assert K.distinct_rules(r) == r[:1]


def test_wilson_and_binomial(spark):
    low, high = L.wilson(F.lit(55), F.lit(100))
    assert 0.45 < one(spark, low) < 0.46 and 0.64 < one(spark, high) < 0.65
    assert one(spark, L.wilson(F.lit(0), F.lit(0))[0]) is None
    p = spark.createDataFrame([(8, 10), (0, 0), (0, 5)], "w bigint, n bigint").select(L.binomial_greater("w", "n")).collect()
    assert [r[0] for r in p] == pytest.approx([56 / 1024, 1.0, 1.0])


def test_streaks(spark):
    r = spark.createDataFrame([(i, i * 86_400_000_000 // 2, w) for i, w in enumerate([1, 1, 0, 1, 1, 1, 0, 0])], "i bigint, t bigint, w int")
    assert {x.won: x.longest for x in K.longest_streaks(r, "t", "i", F.col("w") > 0).collect()} == {True: 3, False: 2}


def test_query_validation_and_search():
    with pytest.raises(ValueError):
        M.EventQuery(date_from="2024-1-1")
    with pytest.raises(ValueError):
        M.EventQuery(date_from="2024-02-01", date_to="2024-01-01")
    assert M.parse_search('a OR b -c "d e"') == [("all", "a"), ("or", "b"), ("not", "c"), ("phrase", "d e")]


def test_labels(spark):
    d = spark.createDataFrame([(0.2,), (-0.2,), (0.0,), (0.1,), (None,)], "v double").select(D.direction(F.col("v"), 0.1)).collect()
    assert [r[0] for r in d] == ["UP", "DOWN", "NEUTRAL", "NEUTRAL", None]
    assert D.forbidden_features(["pre_x", "target_y", "future_z", "my_outcome"]) == ["target_y", "future_z", "my_outcome"]


def test_archives(spark, tmp_path):
    row = "1748736000000,1,2,0.5,1.5,0,1748736059999,0,1,0,0,0"
    for name, members in (("good.zip", {"a.csv": f"open_time,open\n{row}\n1,2\n"}), ("two.zip", {"a.csv": "", "b.csv": ""})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, text in members.items():
                z.writestr(n, text)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = S.read_archives(spark, f"{tmp_path}/*.zip")
    by = {}
    for r in got.collect():
        by.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row_no, r.error))
    assert by == {"good.zip": [(2, None), (3, "expected 12 columns, got 2")], "two.zip": [(0, "expected one member, got 2")], "bad.zip": [(0, "corrupted archive")]}
    assert S.archive_candles(got, F.lit("A")).first()["close"] == 1.5
    assert S.checksums(spark, f"{tmp_path}/bad.zip").first()[1] == hashlib.sha256(b"no archive").hexdigest()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i bigint, k string")
    path = str(tmp_path / "t")
    assert S.write_partitioned(df, path, ["k"], "v1") and not S.write_partitioned(df, path, ["k"], "v1") and S.write_partitioned(df, path, ["k"], "v2")
    assert spark.read.parquet(path).count() == 3
    S.export(df, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError):
        S.export(df, str(tmp_path / "x.xml"))
    with pytest.raises(ValueError):
        S.read_rules('{"a": 1}')
    assert S.read_rules('{"rules": [{"a": 1}]}') == [{"a": 1}]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(k, f"2024-01-01 00:{k % 60:02d}:00", "a" if k % 2 else "b", float(k)) for k in range(40)], "i bigint, t string, symbol string, price double")
    e = e.withColumns({"t": F.to_timestamp("t"), "volume": F.lit(1.0)})
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, query, mode in (("counts", W.window_counts(s, "symbol", "t", "10 minutes", "5 minutes"), "complete"), ("bars", W.streaming_bars(s, "t", "10 minutes", "5 minutes"), "complete"), ("firsts", W.first_copies(s, ["symbol"], "t", "1 hour"), "append")):
        q = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 40
    assert spark.table("bars").where("symbol = 'a'").orderBy("start").first()["open"] == 1.0
    assert spark.table("firsts").count() == 2
    cur = W.resume_cursor(e, "symbol", "t", "1 minute")
    pages = W.request_pages(cur, "symbol", "2024-01-01 01:00:00", "1 minute", 10).where("symbol = 'a'").orderBy("start").collect()
    assert [str(p.start)[14:16] for p in pages] == ["40", "50", "00"] and str(pages[0].stop)[14:16] == "49"


def test_minutes_missing_after_the_first_hours(spark, tmp_path):
    from tidemark.plans.candle_queries import c4_missing_minutes

    first, gone = 29_145_600, {5, 700, 1439, 1440, 3000}
    rows = [("A", (first + k) * 60_000, 1.0, 1.0, 1.0, 1.0, 1.0, (first + k) * 60_000 + 59_999, 1.0, 1, 0.5, 0.5) for k in range(4000) if k not in gone]
    columns = "symbol string, open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trade_count bigint, taker_buy_base double, taker_buy_quote double"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/archive_candles.parquet")
    assert {r.minute - first for r in c4_missing_minutes(spark, str(tmp_path)).collect()} == gone


def test_hours_without_candles_have_a_span(spark, tmp_path):
    from tidemark.plans.candle_queries import c7_coverage

    first = 29_145_600
    rows = [("BTCUSDT", (first + k) * 60_000, 1.0, 1.0, 1.0, 1.0, 1.0, (first + k) * 60_000 + 59_999, 1.0, 1, 0.5, 0.5) for k in range(901) if not 200 < k < 600]
    columns = "symbol string, open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trade_count bigint, taker_buy_base double, taker_buy_quote double"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/archive_candles.parquet")
    got = {(int(r.id.split(":")[1]) - first) // 60: r.status for r in c7_coverage(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(16)) and {h for h, x in got.items() if x == "missing_context"} == {5, 6, 7, 8}
