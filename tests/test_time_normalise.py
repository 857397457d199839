import datetime as dt
import random
import zoneinfo

import pytest

from millrace.operators.time_normalise import normalise_times, page_times

SCHEMA = "id int, v string, z string, l string"


def resolve(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], SCHEMA)
    return {r["id"]: (r["epoch_us"], r["time_status"]) for r in normalise_times(df, "v", "z", "l").collect()}


def us(*parts, tz="UTC", fold=0):
    d = dt.datetime(*parts, tzinfo=zoneinfo.ZoneInfo(tz), fold=fold)
    return round((d - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) * 1_000_000


NY, BERLIN = "America/New_York", "Europe/Berlin"


@pytest.mark.parametrize("chunk", [0])
def test_written_forms(spark, chunk):
    cases = [
        ("2025-09-11T11:25:45Z", NY, "en-US", us(2025, 9, 11, 11, 25, 45)),
        (" 2025-12-19t07:32:36z ", NY, "en-US", us(2025, 12, 19, 7, 32, 36)),
        ("20251220T182904Z", NY, "en-US", us(2025, 12, 20, 18, 29, 4)),
        ("20251211", NY, "en-US", us(2025, 12, 11, tz=NY)),
        ("2025-09-19T00:40:48.418308999Z", NY, "en-US", us(2025, 9, 19, 0, 40, 48) + 418308),
        ("2026-01-04T23:52:29-0800", NY, "en-US", us(2026, 1, 5, 7, 52, 29)),
        ("1757681954841300", NY, "en-US", 1757681954841300),
        ("1767372984649", NY, "en-US", 1767372984649000),
        ("1774723175", NY, "en-US", 1774723175000000),
        ("06/07/2026", NY, "en-US", us(2026, 6, 7, tz=NY)),
        ("06/07/2026", "Europe/London", "en-GB", us(2026, 7, 6, tz="Europe/London")),
        ("01.06.2026, 15:56 Uhr", BERLIN, "de-DE", us(2026, 6, 1, 15, 56, tz=BERLIN)),
        ("13 janvier 2026 à 8h58", "Europe/Paris", "fr-FR", us(2026, 1, 13, 8, 58, tz="Europe/Paris")),
        ("18. September 2025", BERLIN, "de-DE", us(2025, 9, 18, tz=BERLIN)),
        ("Posted on 1/15/2026 1:54 AM", "America/Chicago", "en-US", us(2026, 1, 15, 1, 54, tz="America/Chicago")),
        ("2/4/2026 12:14 AM", NY, "en-US", us(2026, 2, 4, 0, 14, tz=NY)),
        ("9/9/2026 12:38 PM", NY, "en-US", us(2026, 9, 9, 12, 38, tz=NY)),
        ("Sep. 16th 2025 at 9:17pm", NY, "en-US", us(2025, 9, 16, 21, 17, tz=NY)),
        ("Tue JULY 22 2025", NY, "en-US", us(2025, 7, 22, tz=NY)),
        ("Sun, 15 Mar 2026 00:57:55 GMT", NY, "en-US", us(2026, 3, 15, 0, 57, 55)),
        ("Fri, 15 May 2026 22:55:25 -0400", NY, "en-US", us(2026, 5, 16, 2, 55, 25)),
        ("25-Aug-25", NY, "en-US", us(2025, 8, 25, tz=NY)),
        ("26 Dec 2025, 04.07", "Europe/London", "en-GB", us(2025, 12, 26, 4, 7)),
        ("2025-10-20T19:38:13[America/New_York]", "UTC", "en-US", us(2025, 10, 20, 19, 38, 13, tz=NY)),
        ("2026-01-06 20:48:10 Australia/Sydney", "UTC", "en-GB", us(2026, 1, 6, 20, 48, 10, tz="Australia/Sydney")),
        ("2026-01-08 09:28 AEDT", "Australia/Sydney", "en-GB", us(2026, 1, 7, 22, 28)),
        ("2025-12-18 16:03 IST", "Asia/Kolkata", "en-GB", us(2025, 12, 18, 10, 33)),
    ]
    got = resolve(spark, [c[:3] for c in cases])
    assert {i: g[0] for i, g in got.items()} == {i: c[3] for i, c in enumerate(cases)}


def test_changes_of_zone(spark):
    got = resolve(spark, [
        ("2025-11-02 01:35:00", NY, "en-US"), ("2025-11-02 01:35:00 EST", NY, "en-US"), ("2025-11-02 01:35:00 EDT", NY, "en-US"),
        ("2026-03-08 02:28", NY, "en-US"), ("2026-03-29T02:58:00", BERLIN, "de-DE"), ("2025-11-02 00:59:59", NY, "en-US"), ("2025-11-02 02:00:00", NY, "en-US"),
    ])
    assert got[0] == (us(2025, 11, 2, 1, 35, tz=NY), "ambiguous")
    assert got[1] == (us(2025, 11, 2, 1, 35, tz=NY, fold=1), "offset")
    assert got[2] == (us(2025, 11, 2, 1, 35, tz=NY), "offset")
    assert got[3] == (us(2026, 3, 8, 7, 28), "nonexistent")
    assert got[4] == (us(2026, 3, 29, 1, 58), "nonexistent")
    assert got[5][1] == got[6][1] == "zone"


def test_against_the_zone_database(spark):
    random.seed(4)
    zones = [NY, BERLIN, "Australia/Lord_Howe", "Africa/Casablanca", "America/Sao_Paulo", "Asia/Kolkata", "Pacific/Apia", "Europe/Dublin", "UTC"]
    cases, expected = [], []
    for _ in range(600):
        z = random.choice(zones)
        d = dt.datetime(random.randint(1975, 2037), random.randint(1, 12), random.randint(1, 28), random.randint(0, 23), random.randint(0, 59), random.randint(0, 59))
        cases.append((d.isoformat(sep=" "), z, "en-US"))
        first = d.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0)  # in a gap, the offset before it holds
        expected.append(round((first - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) * 1_000_000)
    got = resolve(spark, cases)
    assert [got[i][0] for i in range(len(cases))] == expected


def test_years_of_every_century(spark):
    cases = [("1935-01-05 12:00", "Europe/Amsterdam"), ("1750-06-01 12:00", BERLIN), ("1890-06-01 12:00", NY), ("2100-07-01 12:00", BERLIN), ("2101-07-01 12:00", NY), ("2150-03-29 02:30", BERLIN), ("2399-12-01 00:00", "Australia/Sydney"), ("2404-02-29 12:00", NY), ("9000-08-01 01:02", BERLIN)]
    got = resolve(spark, [(v, z, "en-US") for v, z in cases])
    for i, (v, z) in enumerate(cases):
        first = dt.datetime.fromisoformat(v).replace(tzinfo=zoneinfo.ZoneInfo(z))
        assert got[i][0] == round((first - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) * 1_000_000, v


def test_no_instants(spark):
    got = resolve(spark, [(v, NY, "en-US") for v in (None, "", "   ", "TBD", "2026-02-30", "2026-13-05T10:00:00Z", "31/31/2026", "0000-00-00", "??", "next term", "x" * 200_000, "25:99", "2026-01-01 25:00")])
    assert all(e is None for e, _ in got.values())
    assert got[0][1] is None and {s for i, (_, s) in got.items() if i} == {"unreadable"}


def test_odd_zones_locales_and_columns(spark):
    df = spark.createDataFrame([("2026-01-01 10:00", None, None, 1, 2), ("2026-01-01 10:00", "Nowhere/At_All", "en-US", 1, 2), ("2026-01-01T10:00:00Z", None, None, 1, 2), ("2026-01-01T10:00:00Z", None, None, 1, 2)], "v string, z string, l string, epoch_us int, _s int")
    out = normalise_times(df, "v", "z", "l")
    assert out.columns == ["v", "z", "l", "_s", "epoch_us", "time_status"]
    assert sorted((r["epoch_us"] or 0, r["time_status"]) for r in out.collect()) == [(0, "unknown_zone"), (0, "unknown_zone"), (us(2026, 1, 1, 10), "offset"), (us(2026, 1, 1, 10), "offset")]
    assert normalise_times(df.limit(0), "v", "z", "l").count() == 0


def test_pages_count_once_by_the_newest_crawl(spark, rows):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, "2026-01-01T00:00:00Z", None, t, "UTC", "en-US", "x"), (1, "2026-01-02T00:00:00Z", None, t + dt.timedelta(1), "UTC", "en-US", "x"), (None, "2026-01-02T00:00:00Z", None, t, "UTC", "en-US", "x")],
                               "page_id long, posted_at string, deadline_at string, last_crawled_at timestamp_ntz, site_zone string, site_locale string, extra string")
    assert rows(page_times(df).select("page_id", "field", "epoch_us")) == [(1, "deadline_at", None), (1, "posted_at", us(2026, 1, 2))]
