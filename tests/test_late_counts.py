from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewater.operators import late_counts as lc

HOUR = lc.HOUR


def rows(spark, data):
    df = spark.createDataFrame([(*r, "v", 1, 2) for r in data], "row_id long, ts long, received long, src string, stage string, period_us int, seq int")
    return df.withColumns({"ts": F.timestamp_micros("ts"), "received": F.timestamp_micros("received")})


def stages(spark, data):
    return lc.staged(rows(spark, data), event_time="ts", received="received", source="src", row_id="row_id")


def read(df):
    return {r.period_us: (r.n_at_end, r.n_final) for r in df.collect()}


def random_rows(seed, n=500):
    rng = random.Random(seed)
    return [(i, t := rng.randrange(5 * HOUR), t + rng.choice([0, HOUR, 3 * HOUR, 9 * HOUR]), rng.choice(["a", "b", None, ""])) for i in range(n)]


def brute(data):
    out = {}
    for _, t, r, _ in data:
        p = t // HOUR * HOUR
        a, b = out.get(p, (0, 0))
        out[p] = (a + (r < p + HOUR), b + (r < p + 7 * HOUR))
    return {p: v for p, v in out.items() if v[1]}


def test_outcomes_at_the_boundaries(spark):
    data = [(1, 10, HOUR - 1, "a"), (2, 10, HOUR, "a"), (3, 10, 7 * HOUR - 1, None), (4, 10, 7 * HOUR, "a"), (5, 10, None, "a"), (6, None, 10, "a"), (7, HOUR, 0, "a"), (8, -1, 0, "b")]
    numbered, state = lc.numbered(stages(spark, data), lanes=3)
    got = {r.row_id: (r.outcome, r.seq, r.period_us) for r in lc.judged(numbered, lc.merge(state)).collect()}
    assert got == {1: ("on_time", 1, 0), 2: ("correction", 2, 0), 3: ("correction", 1, 0), 4: ("too_late", 3, 0), 7: ("on_time", 1, HOUR), 8: ("correction", 1, -HOUR)}


def test_numbers_are_whole_and_in_order_of_stages(spark):
    data = random_rows(1)
    data += data[:40]  # repeated rows are rows
    for lanes in (1, 4):
        numbered, _ = lc.numbered(stages(spark, data), lanes=lanes)
        per = {}
        for r in numbered.collect():
            per.setdefault((r.period_us, r.source), []).append((r.seq, r.stage))
        assert sum(map(len, per.values())) == len(data)
        for v in per.values():
            v.sort()
            assert [s for s, _ in v] == list(range(1, len(v) + 1)) and [g for _, g in v] == sorted(g for _, g in v)


def test_counts_do_not_depend_on_order_or_repetition_of_deliveries(spark):
    data = random_rows(3)
    numbered, state = lc.numbered(stages(spark, data), lanes=2)
    want = brute(data)
    assert read(lc.period_counts(state)) == want
    settled = numbered.cache()
    parts = [lc.deliveries(settled.where(F.pmod("row_id", F.lit(5)) == k)) for k in (3, 0, 4, 1, 2)]
    shuffled = lc.merge(*parts, parts[2], lc.deliveries(settled.where("row_id < 100")), parts[0])
    assert read(lc.period_counts(shuffled)) == want
    assert read(lc.period_counts(lc.merge(lc.merge(*parts[:3]), lc.merge(*parts[2:])))) == want
    settled.unpersist()


def test_empty(spark):
    numbered, state = lc.numbered(stages(spark, []))
    assert lc.judged(numbered, state).count() == 0 and read(lc.period_counts(state)) == {}
