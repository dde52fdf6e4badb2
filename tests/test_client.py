from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.functions import geo, registry
from tidewater.plans import client


def test_cache_forgets_by_time_and_number():
    now, made = [0.0], []
    cache = client.ResultCache(10, 2, lambda: now[0])
    make = lambda k: cache.get(k, lambda: made.append(k) or k)
    assert [make("a"), make("a"), make("b")] == ["a", "a", "b"] and made == ["a", "b"]
    now[0] = 11
    make("a")
    make("b")
    make("c")
    make("a")
    assert made == ["a", "b", "a", "b", "c", "a"]


def test_a_new_query_makes_the_old_one_stale(spark):
    latest = client.Latest(spark)
    with latest.run() as first:
        assert spark.range(5).count() == 5 and first()
        with latest.run() as second:
            assert second() and not first()


def test_chunks_and_accumulation(spark):
    assert [len(c) for c in client.chunks(spark.range(2500), 1000)] == [1000, 1000, 500]
    held = spark.createDataFrame([(1, 10, "old"), (2, 10, "old")], "mmsi long, ts_us long, v string")
    fresh = spark.createDataFrame([(1, 11, "new"), (2, 9, "late"), (3, 1, "new")], "mmsi long, ts_us long, v string")
    assert {r.mmsi: r.v for r in client.accumulate(held, fresh).collect()} == {1: "new", 2: "old", 3: "new"}


def test_sql_functions_equal_the_expressions(spark):
    registry.register(spark)
    df = spark.createDataFrame([(51.0, 3.0, 52.5, -4.0), (0.0, 179.9, 0.0, -179.9)], "a double, b double, c double, d double")
    df.createOrReplaceTempView("places")
    got = spark.sql("select haversine_km(a, b, c, d) as km, bearing_deg(a, b, c, d) as deg, grid_cell(a, b) as cell, ship_class(71) as class, epoch_rounded(timestamp_micros(2500000)) as s from places").collect()
    want = df.select(geo.haversine_km("a", "b", "c", "d"), geo.bearing_deg("a", "b", "c", "d"), geo.grid_cell("a", "b"), F.lit("cargo"), F.lit(2)).collect()
    for g, w in zip(got, want, strict=True):
        assert list(g) == [x if isinstance(x, str) else pytest.approx(x) for x in w]


def test_parameters_are_checked():
    assert client.number("1.5") == 1.5 and client.bounds(None) is None
    assert client.bounds({"west": "1", "east": 2, "south": -3.0, "north": 4, "more": "x"}) == {"west": 1.0, "east": 2.0, "south": -3.0, "north": 4.0}
    assert client.iso_date("2016-02-29") == "2016-02-29"
    assert client.iso_timestamp("2016-01-10T12:00:00.5+02:00") == "2016-01-10 10:00:00.500000" and client.iso_timestamp("2016-01-10T12:00:00Z") == "2016-01-10 12:00:00"
    bad = [(client.number, x) for x in ("x", None, "inf", float("nan"), True)]
    bad += [(client.iso_date, x) for x in ("2016-1-2", "2016-02-30", "2016-01-01'; drop", None)] + [(client.iso_timestamp, x) for x in ("2016-01-10 12:00:00", "2016-01-10T25:00:00", "now")]
    for check, x in bad:
        with pytest.raises(ValueError):
            check(x)


def test_sql_with_parameters_and_blocks(spark):
    got = client.run_sql(spark, "select :x as a, :x_y as b, :t as c", x=1, x_y=2, t="it's :x").first()
    assert (got.a, got.b, got.c) == (1, 2, "it's :x")
    text = "set a = 1;\n-- 1. vessels\nselect 1\n-- 2. Vessel_Tracks\nselect 2\n-- note\n-- 3. ports\nselect 3"
    assert client.blocks(text, {"vessel_tracks"}) == ["set a = 1;", "-- 2. Vessel_Tracks\nselect 2\n-- note"]
    assert len(client.blocks(text)) == 4 and client.blocks("-- 1. a\nselect 1") == ["-- 1. a\nselect 1"] and client.blocks("") == []
