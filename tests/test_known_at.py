from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewater.operators import known_at as k

HOUR = 3_600_000_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def run(spark, events, facts):
    e = spark.createDataFrame(events, "event_id long, mmsi long, at long, fact_id string, field string, bucket int").withColumn("at", F.timestamp_micros("at"))
    f = spark.createDataFrame(facts, "id long, mmsi long, ts long, received long, v double, entity string, salt int").withColumns({"ts": F.timestamp_micros("ts"), "received": F.timestamp_micros("received")})
    got = k.attributes_known_at(e, f, entity="mmsi", at="at", event_id="event_id", valid_from="ts", received="received", fact_id="id", fields={"v": F.expr("v is not null and v <> 0"), "any": F.lit(True)})
    return sorted((r.event_id, r.field, r.fact_id) for r in got.collect())


def brute(events, facts):
    out = []
    for e in events:
        for field, ok in (("v", lambda v: v is not None and v != 0), ("any", lambda v: True)):
            known = [f for f in facts if f[1] is not None and f[1] == e[1] and None not in (f[0], f[2], f[3], e[0], e[2]) and f[2] <= e[2] and f[3] <= e[2] and ok(f[4])]
            if known:
                best = min(known, key=lambda f: (-f[2], f[3], f[0]))
                out.append((e[0], field, best[0]))
    return sorted(out)


def test_against_brute_force_with_nulls_ties_and_clashing_names(spark):
    rng = random.Random(1)
    span = 40 * 24 * HOUR

    def some(p, v):
        return None if rng.random() < p else v

    facts = []
    for i in range(400):
        m = some(0.03, rng.choice([1, 1, 1, 2, 3]))
        t = some(0.03, rng.choice([rng.randrange(span), rng.randrange(20) * HOUR]))
        facts.append((i, m, t, some(0.03, (t or 0) + rng.choice([-HOUR, 0, 0, 5, HOUR, 30 * HOUR])), some(0.2, rng.choice([0.0, 1.5, 7.0])), "x", 3))
    events = [(i, some(0.05, rng.choice([1, 2, 3, 4])), some(0.05, rng.choice([rng.randrange(span * 3), rng.randrange(20) * HOUR])), "y", "z", 1) for i in range(300)]
    assert run(spark, events, facts) == brute(events, facts)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, 1, 5, "", "", 0)], []) == []
    assert run(spark, [], [(1, 1, 1, 1, 1.0, "", 0)]) == []


def test_repeated_rows(spark):
    """Repeated facts make one interval; repeated events keep their repetitions."""
    facts = [(7, 1, 10, 10, 1.0, "", 0)] * 3
    assert run(spark, [(1, 1, 20, "", "", 0)] * 2, facts) == [(1, "any", 7)] * 2 + [(1, "v", 7)] * 2


def test_hot_entity_with_many_intervals(spark):
    facts = [(i, 1, i * 7_000_000, i * 7_000_000, 1.0, "", 0) for i in range(3000)]
    events = [(i, 1, i * 7_000_000 + 3, "", "", 0) for i in range(0, 3000, 7)]
    assert [r for r in run(spark, events, facts) if r[1] == "v"] == [(i, "v", i) for i in range(0, 3000, 7)]


def test_intervals_are_disjoint_and_half_open(spark):
    f = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 5, 9), (3, 1, 4, 4), (4, 1, 9, 9)], "id long, mmsi long, ts long, r long").withColumns({"ts": F.timestamp_micros("ts"), "r": F.timestamp_micros("r")})
    got = k.change_intervals(f, entity="mmsi", valid_from="ts", received="r", fact_id="id", fields={"x": F.lit(True)}).orderBy("from_us").collect()
    assert [(r.fact_id, r.from_us, r.to_us) for r in got] == [(1, 0, 4), (3, 4, 9), (4, 9, None)]


def test_hot_entities_are_salted_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(k, "HOT_ROWS", 7)
    rng = random.Random(5)
    span = 400 * 24 * HOUR
    events = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(span), "x", "y", 0) for i in range(300)]
    facts = [(i, rng.choice([1, 2]), (t := rng.randrange(span)), t + rng.randrange(HOUR), 1.0, "e", 3) for i in range(40)]
    hot = {r.entity: r.salts for r in k.hot_entities(spark.createDataFrame([(e[0], e[1]) for e in events], "event_id long, entity long")).collect()}
    assert hot[1] > 20 and max(hot.values()) == hot[1]
    assert run(spark, events, facts) == brute(events, facts)
