from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from tidewater.operators import exactly_once

SCHEMA = "row_id long, mmsi long, kind long, ts long, received long, message_type string, producer string, route int, surplus string"


def messages(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], SCHEMA)
    return df.withColumns({"ts": F.timestamp_micros("ts"), "received": F.timestamp_micros("received")})


def accept(spark, rows, **more):
    got = exactly_once.accept(messages(spark, rows), producer=["mmsi", "message_type"], event_time="ts", received="received", row_id="row_id", **more)
    return got.persist()


def ids(got, kind):
    return sorted(r.row_id for r in got.where(F.col("kind") == kind).collect())


def brute(rows):
    best = {}
    for i, m, _, t, r, mt in rows:
        if None in (i, m, t, mt):
            continue
        key = (m, t, mt)
        best[key] = min(best.get(key, (float("inf"), float("inf"))), (float("inf") if r is None else r, i))
    stay = sorted(v[1] for v in best.values())
    return stay, sorted(r[0] for r in rows if None not in (r[0], r[1], r[3], r[5]) and r[0] not in set(stay))


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        t = rng.choice([rng.randrange(40) * 1000, rng.randrange(40) * 1000 + 3, rng.randrange(10) * 3_600_000_000])
        pick = lambda v: None if rng.random() < 0.03 else v
        rows.append((i, pick(rng.choice([1, 1, 2])), 0, pick(t), pick(rng.randrange(50)), pick(rng.choice(["a", "b"]))))
    got = accept(spark, rows)
    assert (ids(got, "accepted"), ids(got, "surplus")) == brute(rows)


def test_one_message_holds_most_rows(spark):
    rows = [(i, 1, 0, 5000, 100 + i, "a") for i in range(30000)] + [(40000, 1, 0, 6000, 1, "a")]
    got = accept(spark, rows)
    assert ids(got, "accepted") == [0, 40000] and got.where("kind = 'surplus'").count() == 29999


def test_ranges_merge_and_cover_later_batches(spark):
    first = accept(spark, [(i, 1, 0, i * 1000, i, "a") for i in range(10)] + [(50, 1, 0, 20_000, 1, "a"), (51, 1, 0, 20_007, 1, "a")])
    ranges = sorted((r["first"], r["last"]) for r in first.where("kind = 'range'").collect())
    assert ranges == [(0, 9), (20, 20)]
    assert [r["first"] for r in first.where("kind = 'key'").collect()] == [20_007]
    later = accept(spark, [(100, 1, 0, 3000, 1, "a"), (101, 1, 0, 11_000, 1, "a"), (102, 1, 0, 20_007, 1, "a"), (103, 1, 0, 3007, 1, "a"), (104, 2, 0, 3000, 1, "a")], seen=first)
    assert ids(later, "surplus") == [100, 102]
    assert ids(later, "accepted") == [101, 103, 104]


def test_ranges_of_a_state_are_merged_and_decide(spark):
    """Coverage, not what stands beside a row in the sort, makes a copy: here every number comes once only."""
    gap = accept(spark, [(i, 1, 0, i * 1000, i, "a") for i in range(20) if i % 5])
    assert sorted((r["first"], r["last"]) for r in gap.where("kind = 'range'").collect()) == [(1, 4), (6, 9), (11, 14), (16, 19)]
    rest = accept(spark, [(100 + i, 1, 0, i * 1000, i, "a") for i in range(25)], seen=gap)
    assert ids(rest, "accepted") == [100, 105, 110, 115, 120, 121, 122, 123, 124]
    assert [(r["first"], r["last"]) for r in rest.where("kind = 'range'").collect()] == [(0, 24)]


def test_seen_against_a_set():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(50):
        seen, plain = exactly_once.Seen(), set()
        for _ in range(8):
            x = np.sort(rng.integers(0, 60, rng.integers(0, 20)))
            want = []
            for v in x.tolist():
                want.append(v not in plain)
                plain.add(v)
            assert seen.take(x).tolist() == want
            assert seen.covers(np.arange(60)).tolist() == [v in plain for v in range(60)]
            assert (seen.a[1:] > seen.b[:-1] + 1).all()


@pytest.mark.parametrize("size", [1, 7])
def test_blocks_over_arrow_batches(spark, size):
    """A block's ranges are carried from one batch to the next."""
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 2]), 0, rng.choice([0, 3_600_000_000]) + rng.randrange(60) * 500, rng.randrange(9), "a") for i in range(600)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = accept(spark, rows)
        assert (ids(got, "accepted"), ids(got, "surplus")) == brute(rows)
        assert got.where("kind = 'key'").count() == len({(m, t) for _, m, _, t, _, _ in rows if t % 1000})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_empty_and_all_null(spark):
    assert accept(spark, []).count() == 0
    assert accept(spark, [(1, None, 0, 1, 1, "a"), (2, 1, 0, None, 1, "a"), (3, 1, 0, 1, 1, None)]).count() == 0
