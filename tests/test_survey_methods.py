"""Methods of the survey: cascade, journeys, R2, distance gate, residual head."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_models import mae, rows  # noqa: F401
from tidewater.plans import features, models


def test_cascade(rows):  # noqa: F811
    train, test = rows.where("train"), rows.where("not train")
    constant = mae(test, F.lit(train.agg(F.avg("tta_h")).first()[0]))
    got = models.Cascade(trees=5, least=10).fit(train).transform(test).persist()
    assert mae(got, F.col("hours")) < constant / 2
    for r in got.collect():
        want = (0 if r.dist_km / max(r.sog, 1) < 1 else 1) if r.under_6 else 2 if r.under_24 else 3 if r.under_72 else 4
        assert r.route == want and math.isclose(r.z, r[f"g_{want}"])
    assert {r.route for r in got.collect()} >= {1, 2, 3, 4}
    assert models.Cascade(trees=1, least=10**6).fit(train).transform(test).where("hours <> 0.05").count() == 0


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (9.0, 8.0), (5.0, None)], "tta_h double, hours double")
    assert models.r2(df) == pytest.approx(1 - (0.25 + 0 + 1 + 1) / (9 + 4 + 0 + 25))
    assert models.r2(df.where("tta_h = 1")) is None


def test_blends(spark):
    df = spark.createDataFrame([(0.0, 10.0, 30.0), (200.0, 10.0, 30.0), (5000.0, 10.0, 500.0)], "dist_km double, a double, b double")
    got = [r[0] for r in df.select(models.distance_gate("a", "b")).collect()]
    gate = 1 / (1 + math.exp(-3))
    assert got == pytest.approx([gate * 10 + (1 - gate) * 30, 20.0, 200.0])
    df = spark.createDataFrame([(10.0, 0.5), (None, 0.0), (10.0, float("nan")), (10.0, float("inf")), (1.0, -9.0)], "n double, r double")
    got = [r[0] for r in df.select(models.residual_hours("n", "r")).collect()]
    assert got == pytest.approx([11 * math.exp(0.5) - 1, 0.05, 10.0, 200.0, 0.0])


def test_journeys(spark):
    t = datetime(2016, 1, 20)
    a = spark.createDataFrame([(1, "NLRTM", t, 52.0, 4.0), (1, "", t, 52.0, 4.0), (2, "NLRTM", t, 52.0, 4.0)], "mmsi long, port_lo_code string, arrival_ts timestamp, port_lat double, port_lon double")
    p = spark.createDataFrame([(k, 1, t - timedelta(days=x), float(x), 1.0) for k, x in enumerate([11, 10, 3, -1])], "pos_id long, mmsi long, ts timestamp, lat double, lon double")
    got = {r.mmsi: (r.first_ts, r.journey_tta_h, r.origin_lat) for r in features.journeys(a, p).collect()}
    assert got == {1: (t - timedelta(days=10), 240.0, 10.0), 2: (None, None, None)}
