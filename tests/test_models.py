"""Models are fitted by vessel-wise split and beat a constant on vessels they haven't seen."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.plans import models


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for m in range(40):
        for k in range(12):
            tta = [0.5, 1, 2, 3, 6, 12, 24, 48, 72, 100, 120, 168][k]
            sog = 8 + m % 7
            out.append((m, f"P{m % 3}", datetime(2016, 1, 20), 1.0, 2.0, float(tta), datetime(2016, 1, 20) - timedelta(hours=tta), float(sog), sog * 1.852 * tta, float(tta)))
    s = spark.createDataFrame(out, "mmsi long, port_lo_code string, arrival_ts timestamp, port_lat double, port_lon double, horizon double, ts timestamp, sog double, dist_km double, tta_h double")
    return models.training_rows(s).persist()


def mae(df, guess):
    return df.agg(F.avg(F.abs(F.col("tta_h") - guess))).first()[0]


def test_two_stage_and_router(rows):
    train, test = rows.where("train"), rows.where("not train")
    assert train.select("mmsi").intersect(test.select("mmsi")).count() == 0 and test.count()
    constant = mae(test, F.lit(train.agg(F.avg("tta_h")).first()[0]))
    two = models.TwoStage(trees=8).fit(train).transform(test)
    assert mae(two, F.col("hours")) < constant / 3
    routed = models.Router(trees=5).fit(train).transform(test)
    assert mae(routed, F.col("hours")) < constant / 2
    assert models.weighted_rmse(two) < constant


def test_out_of_fold_covers_every_row(rows):
    got = models.out_of_fold(rows, folds=2, trees=3).count()
    assert got == rows.where("fold < 2").count()
