import datetime as dt
import zoneinfo

import pytest

from tidemark.functions.clock import read_clock
from tidemark.operators.instants import resolve_instants

TIMES = "time_id bigint, site string, raw string, source string, confidence double, published_at timestamp, fetched_at timestamp, home_zone string, micros int"
SITES = "site string, home_zone string, day_first boolean, raw string"
U = dt.UTC


def us(*a):
    return int(dt.datetime(*a, tzinfo=U).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("raw", "day_first", "home", "want"),
    [
        ("2021-01-02T23:42:58Z", False, "UTC", ("wall", us(2021, 1, 2, 23, 42, 58), 0)),
        ("20210102T034634Z", False, None, ("wall", us(2021, 1, 2, 3, 46, 34), 0)),
        ("Posted on 2021-01-05 12:00:50+05:30", True, None, ("wall", us(2021, 1, 5, 12, 0, 50), 330)),
        ("Mon, 04 Jan 2021 12:36:34 CST", False, "America/Chicago", ("wall", us(2021, 1, 4, 12, 36, 34), -360)),
        ("Mon, 04 Jan 2021 12:36:34 CST", False, "Asia/Shanghai", ("wall", us(2021, 1, 4, 12, 36, 34), 480)),
        ("26 Jul 2021 18:39:03 IST", True, "Europe/Dublin", ("wall", us(2021, 7, 26, 18, 39, 3), 60)),
        ("Feb. 18, 2021 5:32 a.m. ET", False, "America/New_York", ("wall", us(2021, 2, 18, 5, 32), None)),
        ("11. Februar 2021, 18:13 Uhr", True, "Europe/Berlin", ("wall", us(2021, 2, 11, 18, 13), None)),
        ("11 de enero de 2021 a las 09:11", True, "Europe/Madrid", ("wall", us(2021, 1, 11, 9, 11), None)),
        ("22 janvier 2021 à 00h50", True, "Europe/Paris", ("wall", us(2021, 1, 22, 0, 50), None)),
        ("03/02/2021 1:39PM", False, None, ("wall", us(2021, 3, 2, 13, 39), None)),
        ("03/02/2021 1:39PM", True, None, ("wall", us(2021, 2, 3, 13, 39), None)),
        ("05-03-21 04:48", True, None, ("wall", us(2021, 3, 5, 4, 48), None)),
        ("January 2, 2021", False, None, ("wall", us(2021, 1, 2), None)),
        ("12:31 AM on January 21, 2021", False, None, ("wall", us(2021, 1, 21, 0, 31), None)),
        ("1609549590", False, None, ("unix", 1609549590_000000, None)),
        ("1609715750.332", False, None, ("unix", 1609715750_332000, None)),
        ("1609741057802", False, None, ("unix", 1609741057802_000, None)),
        ("1609623098337143", False, None, ("unix", 1609623098337143, None)),
        ("1609623098337143999", False, None, ("unix", 1609623098337143, None)),
        ("47 minutes ago", False, None, ("ago", 47 * 60, None)),
        ("vor 3 Tagen", True, None, ("ago", 3 * 86400, None)),
        ("an hour ago", False, None, ("ago", 3600, None)),
    ],
)
def test_read_clock(raw, day_first, home, want):
    assert read_clock(raw, day_first, home) == want


@pytest.mark.parametrize("raw", [None, "", "  ", "n/a", "draft", "25:61", "2021-13-02T10:00:00Z", "2021-02-30 09:15:00", "32/13/2021", "0000-00-00 00:00:00", "2021-01-02 24:00", "2021-01-02 13:05 PM", "2021", "12 comments"])
def test_no_time(raw):
    assert read_clock(raw, False, "UTC") is None


def test_fraction_is_cut():
    assert read_clock("2021-01-05T16:32:37.453319779+01:00", False, None)[1] % 1_000_000 == 453319


def test_resolve(spark):
    late = dt.datetime(2021, 12, 31, tzinfo=U)
    rows = [
        (1, "ny", "2021-07-04 12:00:00", "a", None, None, late, "x", 0), (1, "ny", "2021-07-04 12:00:00", "a", None, None, late, "x", 0),  # repeated
        (2, "ny", "2021-11-07 01:30:00", "a", 1.0, None, late, "x", 0),  # twice: the earlier
        (3, "ny", "2021-03-14 02:30:00", "a", 1.0, None, late, "x", 0),  # never
        (4, "ny", "2022-01-01T00:00:01Z", "a", 1.0, None, late, "x", 0),  # after ingestion
        (5, None, "2021-07-04 12:00:00", "a", 1.0, None, late, "x", 0), (6, "other", "2021-07-04 12:00:00", "a", 1.0, None, late, "x", 0),
        (7, "ny", None, "a", 1.0, None, late, "x", 0), (8, "ny", "2 days ago", "a", 1.0, None, late, "x", 0), (9, "ny", "2 days ago", "a", 1.0, None, None, "x", 0),
        (10, "ny", "x" * 200_000 + " 2021-07-04 12:00:00 EST", "a", 1.0, None, late, "x", 0),
    ]
    out = resolve_instants(spark.createDataFrame(rows, TIMES), spark.createDataFrame([("ny", "America/New_York", False, "clash")], SITES)).collect()
    got = dict(tuple(r) for r in out)
    assert len(out) == len(got)
    assert got == {1: us(2021, 7, 4, 16), 2: us(2021, 11, 7, 5, 30), 5: us(2021, 7, 4, 12), 6: us(2021, 7, 4, 12), 8: us(2021, 12, 29), 10: us(2021, 7, 4, 17)}


def test_empty(spark):
    assert resolve_instants(spark.createDataFrame([], TIMES), spark.createDataFrame([], SITES)).collect() == []


def test_zone_is_estimated_from_ingestion(spark):
    rows, start = [], dt.datetime(2021, 1, 1, tzinfo=U)
    for k in range(300):  # wall times in Tokyo, read within two hours
        t = start + dt.timedelta(hours=29 * k, minutes=k % 60)
        rows.append((k, "t", (t + dt.timedelta(hours=9)).strftime("%Y-%m-%d %H:%M:%S"), "a", 1.0, None, t + dt.timedelta(minutes=5 + k % 110), "x", 0))
    out = resolve_instants(spark.createDataFrame(rows, TIMES), spark.createDataFrame([], SITES)).collect()
    assert {r[0]: r[1] for r in out} == {k: int((start + dt.timedelta(hours=29 * k, minutes=k % 60)).timestamp()) * 1_000_000 for k in range(300)}


def test_a_site_that_moves_has_two_zones(spark):
    rows, want, start = [], {}, dt.datetime(2021, 1, 1, tzinfo=U)
    for k in range(1500):  # wall times in Tokyo, from a new period on in New York, read within two hours
        t = start + dt.timedelta(hours=6 * k, minutes=k % 60)
        zone = zoneinfo.ZoneInfo("Asia/Tokyo" if t < dt.datetime(2021, 10, 28, tzinfo=U) else "America/New_York")
        rows.append((k, "t", t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), "a", 1.0, None, t + dt.timedelta(minutes=1 + k % 110), "x", 0))
        want[k] = int(t.timestamp()) * 1_000_000
    got = {r[0]: r[1] for r in resolve_instants(spark.createDataFrame(rows, TIMES), spark.createDataFrame([], SITES)).collect()}
    far = [k for k in want if got.get(k) != want[k]]
    assert len(far) <= 0.01 * len(want)  # only about the border, where days of wall time and of UTC differ
