from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests import brute
from tidewater.operators import trips

MIN = 60_000_000


def run(spark, pings):
    df = spark.createDataFrame([(*p, "x", 1, "y") for p in pings], "mmsi long, ts long, lat double, lon double, sog double, kind string, first int, __day string").withColumn("ts", F.timestamp_micros("ts"))
    got = trips.stops_and_trips(df, source="mmsi", event_time="ts", lat="lat", lon="lon", speed="sog").collect()
    return got, sorted((r.source, r.kind, r.start_us, r.end_us) for r in got)


def voyage(rng, mmsi, legs=8, strays=0.03):
    t, lat, lon = rng.randrange(24 * 60) * MIN, rng.uniform(-60, 60), rng.uniform(-170, 170)
    for k in range(legs):
        stop = k % 2 == 0
        speed = 0.0 if stop else rng.uniform(8, 20)
        for _ in range(rng.randrange(4, 200) if stop else rng.randrange(6, 60)):
            t += rng.randrange(2, 9) * MIN if rng.random() > 0.005 else 150 * MIN
            lat += speed * 5 / 60 / 60
            a, o, s = lat + rng.gauss(0, 2e-4), lon + rng.gauss(0, 2e-4), max(0.0, speed + rng.gauss(0, 0.2)) if not stop else abs(rng.gauss(0, 0.1))
            kind = rng.random()
            if kind < strays:
                s = rng.choice([None, 102.3, 0.0, 30.0, -4.0])
            elif kind < 1.5 * strays:
                a, o = rng.choice([(None, None), (a + 0.5, o), (91.0, 181.0)])
            yield mmsi, t, a, o, s


def test_against_brute_force_over_many_days(spark):
    rng = random.Random(9)
    pings = [p for m in range(25) for p in voyage(rng, m)]
    pings += rng.sample(pings, 50)
    rng.shuffle(pings)
    assert run(spark, pings)[1] == sorted(brute.stops_and_trips(pings))


def test_strays_neither_begin_nor_end_a_stop(spark):
    at = lambda k, sog=0.1, lat=10.0: (1, k * 5 * MIN, lat, 20.0, sog)
    pings = [at(0, 12.0), at(1, 12.0), at(2), at(3), at(4, 9.0), at(5, None), *[at(k) for k in range(6, 12)], at(12, 9.0), at(13, 9.0), at(14, 9.0), at(15)]
    assert run(spark, pings)[1] == [(1, "stop", 10 * MIN, 55 * MIN)]


def test_silence_ends_a_stop_but_not_a_trip(spark):
    stop = [(1, k * 10 * MIN, 10.0, 20.0, 0.0) for k in range(5)]
    there = [(1, 300 * MIN + k * 10 * MIN, 10.5, 20.0, 0.0) for k in range(5)]
    back = [(1, 600 * MIN + k * 10 * MIN, 10.5, 20.01, 0.0) for k in range(5)]
    got, rows = run(spark, stop + there + back)
    assert rows == [(1, "stop", 0, 40 * MIN), (1, "stop", 300 * MIN, 340 * MIN), (1, "stop", 600 * MIN, 640 * MIN), (1, "trip", 40 * MIN, 300 * MIN)]
    trip = next(r for r in got if r.kind == "trip")
    assert abs(trip.distance_km - brute.haversine(10.0, 20.0, 10.5, 20.0)) < 1e-6


def test_stop_of_several_days(spark):
    pings = [(1, k * 10 * MIN, 10.0, 20.0, 0.1 if k % 100 else 5.0) for k in range(1, 600)]
    assert run(spark, pings)[1] == [(1, "stop", 10 * MIN, 599 * 10 * MIN)]


def test_stops_of_which_half_are_strays(spark):
    pings, cases = [], [(0, 1), (0, 1, 1), (0, 0, 1, 1), (0, 0, 1)]
    for m, pattern in enumerate(cases):
        for start in (120, 24 * 60 - 45):  # the second over midnight
            under_way = [(m, (start - 5 * k) * MIN, 10.0 - 0.02 * k, 20.0, 12.0) for k in range(10, 0, -1)]
            there = [(m, (start + 5 * k) * MIN, 10.0, 20.0, 0.9 if pattern[k % len(pattern)] else 0.3) for k in range(24)]
            pings += under_way + there + [(m, (start + 120 + 5 * k) * MIN, 10.0 + 0.02 * k, 20.0, 12.0) for k in range(10)]
    rows = run(spark, pings)[1]
    assert rows == sorted(brute.stops_and_trips(pings))
    assert all(sum(r[0] == m and r[1] == "stop" for r in rows) == 2 for m in range(len(cases)))


def test_empty_and_nulls(spark):
    assert run(spark, [])[1] == []
    assert run(spark, [(None, 1, 1.0, 1.0, 0.0), (1, None, 1.0, 1.0, 0.0), (1, 5, None, None, None)])[1] == []


def test_durations_are_fitted_from_what_was_found(spark):
    hour = 3_600_000_000
    found = spark.createDataFrame([("stop", 0, h * hour) for h in (1, 2, 4, 8, 16)] + [("trip", 0, 5 * hour)], "kind string, start_us long, end_us long")
    m = trips.fitted(found)
    assert abs(m.stop_hours - 4) < 1e-9 and 0.9 < m.stop_spread < 1.2 and m.travel_hours == trips.Model().travel_hours
    assert trips.fitted(found.limit(0)) == trips.Model()


def test_every_earlier_stop_may_go_on(spark):
    """A stop that begins on one day goes on on the next, whatever number of short pieces lies between."""
    day = 86_400_000_000
    rows = [(1, day - 3_600_000_000 + k * 300_000_000, 10.0, 20.0, 0.1) for k in range(24)]
    got = spark.createDataFrame(rows, "m long, t long, lat double, lon double, sog double").selectExpr("m", "timestamp_micros(t) as t", "lat", "lon", "sog")
    r = trips.stops_and_trips(got, source="m", event_time="t", lat="lat", lon="lon", speed="sog").collect()
    assert [(x.kind, x.start_us, x.end_us) for x in r] == [("stop", rows[0][1], rows[-1][1])]


def day_of(pattern, minutes=5):
    """Columns of one vessel's day: a speed a ping; where it isn't slow the vessel goes on north."""
    sog = np.array(pattern, float)
    n = len(sog)
    return {"__source": np.ones(n, int), "__day": np.zeros(n, int), "__t": np.arange(n) * minutes * MIN, "lat": 10 + np.cumsum(np.where(sog >= 2, sog * minutes / 3600, 0.0)), "lon": np.full(n, 20.0), "sog": sog}


def pieces(c):
    r = trips._day(c, trips.Rules(), trips.Model())
    return [x for x in zip(r["kind"], r["first"], r["last"], strict=True) if x[0] == "piece"]


def test_what_is_not_decoded_as_stopped_is_not_reported(monkeypatch):
    c = day_of([12.0] * 10 + [0.1] * 12 + [12.0] * 10 + [0.9, 0.3] * 8 + [12.0] * 10)
    found = pieces(c)
    assert found == [("piece", 10, 21), ("piece", 33, 47)]
    monkeypatch.setattr(trips, "decode", lambda t, *_: np.arange(len(t)) < 30)
    assert pieces(c) == found[:1]
    monkeypatch.setattr(trips, "decode", lambda t, *_: np.zeros(len(t), bool))
    assert pieces(c) == []
    monkeypatch.setattr(trips, "decode", lambda t, *_: np.ones(len(t), bool))
    assert pieces(c) == found


def test_decoding_loses_no_stretch_whatever_the_model():
    rng, rules, lost = np.random.default_rng(4), trips.Rules(), 0
    models = [trips.Model(), trips.Model(slow_if_travelling=0.9), trips.Model(stop_hours=200, stop_spread=0.2), trips.Model(slow_if_stopped=0.05, travel_hours=0.1)]
    for k in range(200):
        n = int(rng.integers(1, 120))
        t = np.cumsum(rng.integers(1, 20, n)) * MIN
        slow = rng.random(n) < rng.choice([0.1, 0.4, 0.6, 0.95])
        known = slow | (rng.random(n) < 0.7)
        open_start, open_end = bool(k & 1), bool(k & 2)
        stop = trips.decode(t, slow, known, rules, open_start, open_end, models[k % 4])
        lost += (~stop).sum()
        for i in np.flatnonzero(slow):
            j = i
            while (on := np.flatnonzero(slow[j + 1 : j + 2 + rules.strays])).size:
                j += 1 + int(on[-1])
            if t[j] - t[i] >= rules.least_us or (open_start and i <= rules.strays) or (open_end and n - 1 - j <= rules.strays):
                assert stop[i : j + 1].all()
    assert lost  # the rest may be travelling
