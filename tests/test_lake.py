from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.sources import lake, landing, tensors, transfer


def test_paths_belong_to_tables():
    assert lake.classify("silver/year=2016/month=01/day=2/x.parquet") == ("messages", True)
    assert lake.classify("/gold/vessels/vessels.parquet") == ("vessels", False)
    assert lake.classify("gold/vessels_positions/year=2016/a") == ("vessels_positions", True)
    assert lake.classify("raw/a") is None and lake.classify("silverware/a") is None


def test_replace_read_itself_vacuum_and_drop(spark, tmp_path):
    at = lake.Lake(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        at.table("vessels")
    at.replace("vessels", spark.range(3).withColumnRenamed("id", "mmsi"))
    old = at.table("vessels")
    at.replace("vessels", at.table("vessels").unionByName(spark.range(3, 5).withColumnRenamed("id", "mmsi")))
    assert at.table("vessels").count() == 5 and old.count() == 3  # a reader of the old version still has it
    assert at.vacuum("vessels") == 0 and at.vacuum("vessels", older_than_s=0) == 1
    assert at.table("vessels").count() == 5
    only = lake.Lake(spark, f"file://{tmp_path}", read_only=True)
    assert only.attach("lake_") == ["vessels"] and spark.table("lake_vessels").count() == 5
    for change in (lambda: only.drop("vessels"), lambda: only.replace("vessels", old), lambda: only.vacuum("vessels")):
        with pytest.raises(PermissionError):
            change()
    at.drop("vessels")
    assert at.names() == []


def test_a_day_is_removed_from_some_tables(spark, tmp_path):
    at = lake.Lake(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, 2016, 1, d, f"2016-01-{d:02d}") for d in (9, 10, 11)], "mmsi long, year int, month int, day int, date string")
    for name in ("messages", "base_stations"):
        at.append(name, rows.drop("date"), ["mmsi"])
    at.append("vessel_tracks", rows.select("mmsi", "date"), ["mmsi"])
    (tmp_path / "gold/base_stations/year=2016/month=01/day=10").mkdir(parents=True)
    assert at.delete_day(date(2016, 1, 10), {"messages", "vessel_tracks", "vessels"}) == {"messages": 1, "vessel_tracks": 1}
    assert {r.day for r in at.table("messages").collect()} == {9, 11} and at.table("base_stations").count() == 3
    assert at.delete_day(date(2016, 1, 10)) == {"base_stations": 2}
    assert at.delete_day(date(2030, 1, 1)) == {}


def test_catalogues_are_synchronised(spark, tmp_path):
    a, b = (lake.Lake(spark, f"file://{tmp_path}/{k}") for k in "ab")
    version = a.replace("vessels", spark.range(2))
    a.replace("port_calls", spark.range(4))
    assert b.catalogue() is None and a.save_catalogue()["vessels"]["version"] == version
    assert b.synchronise(a) == {}  # no data there yet
    files = lake.listing(spark, f"file://{tmp_path}/a/gold/vessels")
    done = transfer.transfer(files, f"file://{tmp_path}/a", f"file://{tmp_path}/b", tasks=2).collect()
    assert done and {r.outcome for r in done} == {"copied"}
    assert set(b.synchronise(a)) == {"vessels"} and b.table("vessels").count() == 2 and set(b.catalogue()) == {"vessels"}
    elsewhere = lake.Lake(spark, f"file://{tmp_path}/none", read_only=True, data_path=f"file://{tmp_path}/b")
    assert elsewhere.table("vessels").count() == 2


def test_transfer_repeats_nothing_and_mends_what_is_broken(spark, tmp_path):
    (tmp_path / "in/x").mkdir(parents=True)
    for k in range(5):
        (tmp_path / f"in/x/{k}.txt").write_bytes(bytes([k]) * (k * 1000))
    import gzip

    (tmp_path / "in/packed.txt.gz").write_bytes(gzip.compress(b"x" * 500))
    copied = transfer.transfer(lake.listing(spark, f"file://{tmp_path}/in", "*.gz"), f"file://{tmp_path}/in", f"file://{tmp_path}/out", tasks=1).collect()
    assert [r.outcome for r in copied] == ["copied"] and gzip.decompress((tmp_path / "out/packed.txt.gz").read_bytes()) == b"x" * 500
    files = lake.listing(spark, f"file://{tmp_path}/in", "*.txt").persist()
    run = lambda: sorted(r.outcome for r in transfer.transfer(files, f"file://{tmp_path}/in", f"file://{tmp_path}/out", tasks=3).collect())
    assert run() == ["copied"] * 5 and run() == ["kept"] * 5
    (tmp_path / "out/x/3.txt").write_bytes(b"cut")
    assert run() == ["copied"] + ["kept"] * 4
    assert (tmp_path / "out/x/3.txt").read_bytes() == (tmp_path / "in/x/3.txt").read_bytes()
    (tmp_path / "in/x/4.txt").unlink()
    (tmp_path / "out/x/4.txt").unlink()
    assert [o[:6] for o in run()] == ["failed"] + ["kept"] * 4


def test_files_of_a_table_are_deleted_by_a_subquery(spark):
    files = spark.createDataFrame([(1, "a/day=1/x"), (1, "a/day=2/x"), (2, "b/day=1/x"), (None, "c/day=1/x"), (1, None)], "owner int, path string")
    owners = spark.createDataFrame([(1, "messages"), (2, "tracks")], "owner int, name string")
    left = lambda name, p: sorted((r.owner or 0, r.path or "") for r in lake.without(files, owners, "owner", name, p).collect())
    assert left("messages", "%day=1/%") == [(0, "c/day=1/x"), (1, ""), (1, "a/day=2/x"), (2, "b/day=1/x")]
    assert len(left("nothing", "%")) == 5


def test_tensors_there_and_back(spark, tmp_path):
    rows = [(k, [[float(k), 1.0]] * 2 + [[0.0, 0.0]], 2, k / 2) for k in range(7)]
    df = spark.createDataFrame(rows, "mmsi long, x array<array<double>>, n int, hours double").coalesce(2)
    about = tensors.write_tensors(df, f"file://{tmp_path}/t", steps="x", length="n", target="hours", names=["a", "b"], most=3)
    assert tensors.about(f"file://{tmp_path}/t") == about and (about["samples"], about["target_max"]) == (7, 3.0)
    got = {}
    for b in tensors.batches(f"file://{tmp_path}/t", rows=3):
        assert b["steps"].shape[1:] == (3, 2) and (b["mask"].sum(1) == 2).all()
        got |= dict(zip(b["mmsi"].tolist(), b["steps"][:, 0, 0].tolist(), strict=True))
    assert got == {k: float(k) for k in range(7)}
    assert tensors.read_tensors(spark, f"file://{tmp_path}/t").agg(F.sum("hours")).first()[0] == pytest.approx(np.arange(7).sum() / 2)


def test_window_of_days(spark, tmp_path):
    for d in (1, 2, 8, 9, 10):
        folder = tmp_path / f"year=2016/month=01/day={d:02d}/hour=03"
        folder.mkdir(parents=True)
        (folder / "a.ndjson").write_text('{"message_type": "PositionReport", "metadata": {"MMSI": %d, "latitude": 1.0, "longitude": 2.0, "time_utc": ""}}\n' % d)
    got = landing.read_window(spark, f"file://{tmp_path}", date(2016, 1, 9))
    assert sorted(r.m for r in got.select(F.col("__m.metadata.MMSI").alias("m")).collect()) == [2, 8, 9]
    assert landing.read_window(spark, f"file://{tmp_path}", date(2020, 1, 9)).count() == 0
