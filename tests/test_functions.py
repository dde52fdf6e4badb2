"""Column functions on hand-made values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import domain, geo, text, timefns


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_destinations(spark):
    raw = [None, "", "   ", "??", "@@@@", "---", "--", "0000", "XXX", "+", "A", "nlrtm", " ROTTERDAM   NL ", "\tLE HAVRE\n", "ÅRHUS"]
    want = [None, None, None, None, None, None, "--", None, None, None, None, "NLRTM", "ROTTERDAM NL", "LE HAVRE", "RHUS"]
    assert [r[0] for r in values(spark, [(x,) for x in raw], "d string", text.clean_destination("d"))] == want


def test_coordinates(spark):
    raw = [("4230N 00131E", 42.5, 1 + 31 / 60), ("1659S 17938W", -(16 + 59 / 60), -(179 + 38 / 60)), ("", None, None), (None, None, None), ("4510", None, None), ("45X 01E", None, None), ("4230Q 00131E", None, None)]
    got = values(spark, [(r[0],) for r in raw], "c string", *text.coordinate("c"))
    assert got == [pytest.approx(r[1:]) if r[1] is not None else (None, None) for r in raw]


def test_tolerant_numbers(spark):
    raw = ["12.7", "1e3", "x", None, "", "-3", "2.5", "40000", "1e99"]
    assert [r[0] for r in values(spark, [(x,) for x in raw], "c string", text.tolerant_int("c", "smallint"))] == [13, 1000, None, None, None, -3, 2, None, None]
    assert values(spark, [("IMO9212424",), ("IMO",), ("7",)], "c string", text.imo("c")) == [(9212424,), (None,), (7,)]
    assert values(spark, [("NA",), ("",), ("ok",), (None,)], "c string", text.without_tokens("c")) == [(None,), (None,), ("ok",), (None,)]


def test_search_takes_wildcards_literally(spark):
    assert [r[0] for r in values(spark, [("a%b",), ("axb",), ("A_b\\",)], "c string", text.contains("c", "a%"))] == [True, False, False]
    assert [r[0] for r in values(spark, [("a_b\\",), ("axb\\",)], "c string", text.contains("c", "A_B\\"))] == [True, False]


def test_lenient_and_strict_times(spark):
    rows = [(2026, 2, 30, 1, 2), (2026, 0, 0, 24, 60), (2026, 12, 31, 23, 59), (2026, 5, None, 1, 1)]
    got = values(spark, rows, "y int, m int, d int, h int, i int", timefns.lenient_timestamp("y", "m", "d", "h", "i"), timefns.strict_timestamp("y", "m", "d", "h", "i"))
    assert [a for a, _ in got] == [datetime(2026, 3, 2, 1, 2), datetime(2025, 12, 1, 1, 0), datetime(2026, 12, 31, 23, 59), None]
    assert [b for _, b in got] == [None, None, datetime(2026, 12, 31, 23, 59), None]


def test_eta_year(spark):
    rows = [(datetime(2026, 12, 30), 1, 2, 3, 4), (datetime(2026, 5, 10), 5, 10, 0, 0), (datetime(2026, 5, 10), 5, 9, 0, 0)]
    got = values(spark, rows, "t timestamp, m int, d int, h int, i int", timefns.eta_with_year("t", "m", "d", "h", "i"))
    assert [g[0] for g in got] == [datetime(2027, 1, 2, 3, 4), datetime(2026, 5, 10), datetime(2027, 5, 9)]


def test_feed_times(spark):
    raw = ["2016-01-12 00:06:52.390000 +0000 UTC", "2016-01-12 00:06:52", "2016-01-12T00:06:52.5+00:00", "2016-01-16 13:50:11.830771000 +0000 UTC", "soon", None]
    got = [g[0] for g in values(spark, [(x,) for x in raw], "c string", timefns.feed_timestamp("c"))]
    assert got == [datetime(2016, 1, 12, 0, 6, 52, 390000), datetime(2016, 1, 12, 0, 6, 52), datetime(2016, 1, 12, 0, 6, 52, 500000), datetime(2016, 1, 16, 13, 50, 11, 830771), None, None]


def test_rounding_and_boundaries(spark):
    rows = [(1_500_000, 59_000_000, 1_799_000_000), (2_500_000, 0, 59_999_999)]
    got = values(spark, rows, "a long, b long, c long", timefns.epoch_rounded(F.timestamp_micros("a")), timefns.boundaries_crossed("minute", F.timestamp_micros("b"), F.timestamp_micros("c")))
    assert got == [(2, 29), (2, 0)]


def test_geography(spark):
    rows = [(0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, -10.0, 0.0), (None, 0.0, 1.0, 1.0)]
    got = values(spark, rows, "a double, b double, c double, d double", geo.haversine_km("a", "b", "c", "d"), geo.bearing_deg("a", "b", "c", "d"))
    assert got[0] == pytest.approx((6371 * 3.141592653589793 / 2, 90.0)) and got[1][0] == 0 and got[2][1] == pytest.approx(180.0) and got[3] == (None, None)
    assert values(spark, [(350.0, 20.0), (10.0, 20.0)], "a double, b double", geo.folded("a", "b")) == [(30.0,), (10.0,)]
    assert geo.expanded_box(0, 0, 10, 20) == pytest.approx((5 - 5 * 3**0.5, 10 - 10 * 3**0.5, 5 + 5 * 3**0.5, 10 + 10 * 3**0.5))
    assert geo.box_inside((1, 1, 2, 2), (0, 0, 3, 3)) and not geo.box_inside((1, 1, 4, 2), (0, 0, 3, 3))


def test_codes(spark):
    rows = [(None,), (30,), (45,), (70,), (89,), (0,), (99,)]
    got = values(spark, rows, "c int", domain.ship_class("c"), domain.ship_label("c"), domain.nav_label("c"))
    assert [g[0] for g in got] == ["pleasure", "fishing", "pleasure", "cargo", "tanker", "pleasure", "pleasure"]
    assert [g[1] for g in got] == ["Unknown", "Fishing", "High Speed Craft", "Cargo", "Tanker", "Other (0)", "Other (99)"]
    assert got[0][2] == "Unknown" and got[5][2] == "Under way using engine" and got[6][2] == "Unknown (99)"
    assert [r[0] for r in values(spark, [(0.0,), (10.0,), (19999.0,), (20000.0,), (-1.0,)], "c double", domain.bucket_of("c"))] == [0, 1, 11, -1, -1]
    assert [r[0] for r in values(spark, [(0.5,), (1.0,), (199.0,), (300.0,)], "c double", domain.horizon_bin("c"))] == [0, 1, 4, None]
