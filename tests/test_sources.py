"""Readers and writers on small files."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewater.operators import relational as rel
from tidewater.sources import lake, landing, sinks


def envelope(kind="PositionReport", mmsi=1, lat=1.0, lon=2.0, time="2016-01-12 00:06:52 +0000 UTC", **body):
    return {"message_type": kind, "metadata": {"MMSI": mmsi, "ShipName": "", "latitude": lat, "longitude": lon, "time_utc": time}, "message": {kind: body}, "received_at": "2016-01-12T00:06:59+00:00", "listener_id": "l"}


def test_ndjson_to_silver(spark, tmp_path):
    rows = [
        envelope(Sog=1.5, TrueHeading=511),
        envelope("ShipStaticData", Name="A", Type=70, Dimension={"A": 1, "B": 2, "C": 3, "D": 4}, Eta={"Month": 1, "Day": 2, "Hour": 3, "Minute": 4}, FixType=1),
        envelope("StaticDataReport", ReportA={"Name": "B"}, ReportB={"CallSign": "C", "ShipType": 30, "Dimension": {"A": 5, "B": 6, "C": 0, "D": 0}}),
        envelope("AidsToNavigationReport", Type=3, Fixtype=7, OffPosition=True),
        envelope(lat=0.0, lon=0.0),
        envelope(lat=91.0, lon=181.0),
        envelope(mmsi=None),
    ]
    folder = tmp_path / "year=2016" / "hour=00"
    folder.mkdir(parents=True)
    (folder / "a.ndjson").write_text("\n".join([*map(json.dumps, rows), '{"message_type": "cut', ""]))
    raw = landing.read_ndjson(spark, str(tmp_path), base=str(tmp_path))
    assert raw.count() == 7 and landing.valid(raw).count() == 5
    flat = landing.flatten(raw)
    assert len([c for c in flat.columns if c not in ("value", "year", "hour")]) == 39
    got = {(r.message_type, r.lat): r for r in flat.collect()}
    static = got["ShipStaticData", 1.0]
    assert (static.name, static.ship_type, static.length, static.width, static.eta, static.fix_type) == ("A", 70, 3.0, 7.0, datetime(2017, 1, 2, 3, 4), 1)
    report = got["StaticDataReport", 1.0]
    assert (report.name, report.call_sign, report.ship_type, report.length) == ("B", "C", 30, 11.0)
    aton = got["AidsToNavigationReport", 1.0]
    assert (aton.type_of_aton, aton.fix_type, aton.off_position) == (3, 7, True)


def test_noaa_rows(spark, tmp_path):
    (tmp_path / "d.csv").write_text("mmsi,base_date_time,longitude,latitude,sog,cog,heading,vessel_name,imo,call_sign,vessel_type,status,length,width,draft,cargo,transceiver\n1,2016-01-01 00:00:01,1.5,2.5,0.1,NA,12.7,X,IMO9212424,N/A,70,0,100,20,5.5,,A\nx,bad,,,,,,,IMO\n")
    a, b = landing.read_noaa(spark, str(tmp_path / "d.csv")).orderBy(F.col("mmsi").asc_nulls_last()).collect()
    assert (a.mmsi, a.ts, a.heading, a.imo_number, a.call_sign, a.cog, a.transceiver_class) == (1, 1451606401, 13, 9212424, None, None, 1)
    assert set(b) == {None}


def test_noaa_vessels_are_the_most_complete(spark, tmp_path):
    head = "mmsi,base_date_time,longitude,latitude,vessel_name,imo,call_sign,length,width\n"
    (tmp_path / "d.csv").write_text(head + "1,2016-01-01 00:00:01,0,0,A,,,,\n1,2016-01-01 00:00:02,0,0,A,IMO5,C,10,\n1,2016-01-01 00:00:03,0,0,B,,C,,\n2,2016-01-01 00:00:03,0,0,,IMO7,C,1,1\n")
    got = landing.noaa_vessels(landing.read_noaa(spark, str(tmp_path / "d.csv"))).collect()
    assert [(r.mmsi, r.vessel_name, r.imo_number, r.length_m) for r in got] == [(1, "A", 5, 10)]


def test_ports_keep_the_first_row_of_a_code(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Country,Location,Name,NameWoDiacritics,Function,Coordinates,Subdivision,Status\nAA,BBB,One,One,--3-----,4230N 00131E,,AF\nAA,BBB,Two,Two,1-------,,,AF\nAA,CCC,X,X,1-------,bad,,\n")
    got = {r.lo_code: r for r in landing.read_ports(spark, str(tmp_path / "p.csv")).collect()}
    assert (got["AABBB"].name, got["AABBB"].is_port, got["AABBB"].lat) == ("One", 0, 42.5) and got["AACCC"].lat is None


def test_layout_row_groups_and_pruning(spark, tmp_path):
    df = spark.range(25_000).select("id", ((F.col("id") * 37) % 180 - 90.0).alias("lat"), ((F.col("id") * 91) % 360 - 180.0).alias("lon"), F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("mmsi"))
    hits = {}
    for layout in sinks.LAYOUTS:
        path = f"{tmp_path}/{layout}"
        sinks.write_layout(df, path, layout, rows=1000, files=1)
        stats = landing.row_groups(spark, path)
        assert stats.where("column = 'id'").agg(F.max("rows"), F.sum("rows")).first()[:] == (1000, 25_000)
        hits[layout] = sinks.groups_hit(stats, 0.0, 0.0, 5.0, 5.0).first().hit
    assert hits["lat"] < hits["temporal"] and hits["cell"] < hits["temporal"]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/m"
    day = lambda d, n: spark.range(n).select(F.lit("t").alias("message_type"), F.col("id").alias("mmsi"), F.lit(datetime(2016, 1, d)).alias("ts"), F.lit(2016).alias("year"), F.lit(1).alias("month"), F.lit(d).alias("day"))
    sinks.write_messages(day(1, 5).unionByName(day(2, 3)), path)
    sinks.write_messages(day(2, 9), path)
    assert {r.day: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()} == {1: 5, 2: 9}


def test_upsert_replaces_the_table_it_reads(spark, tmp_path):
    at = lake.Lake(spark, f"file://{tmp_path}")
    at.replace("vessels", spark.createDataFrame([(1, "old", 5), (2, "old", 5)], "mmsi int, name string, seen int"))
    fresh = spark.createDataFrame([(2, "new", 5), (1, "older", 4), (3, "new", None)], "mmsi int, name string, seen int")
    at.replace("vessels", rel.upsert(at.table("vessels"), fresh, ["mmsi"], F.col("seen")))
    assert {r.mmsi: r.name for r in at.table("vessels").collect()} == {1: "old", 2: "new", 3: "new"}
    more = rel.insert_missing(at.table("vessels"), spark.createDataFrame([(1, "x", 1), (9, "y", 1)], "mmsi int, name string, seen int"), ["mmsi"])
    assert {r.mmsi: r.name for r in more.collect()} == {1: "old", 2: "new", 3: "new", 9: "y"}


def test_older_envelopes_and_the_fallback_of_the_vessel(spark):
    rows = [
        '{"message_type": "P", "metadata": {"MMSI": "MMSI", "mmsi": "7", "timestamp": "2016-01-12 00:06:52.39 +0000 UTC", "lat": "1.5", "lon": 2}}',
        '{"message_type": "P", "metadata": {"MMSI": 8, "time_utc": "2016-01-12 00:06:52", "latitude": 3.5, "longitude": 4}, "message": {"P": {"UserID": 9}}}',
        '{"message_type": "P", "metadata": {"MMSI": "MMSI"}, "message": {"P": {"UserID": 9}}}',
        "cut {",
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, body string")
    got = df.select("k", *[v.alias(n) for n, v in landing.legacy_fields("body").items()]).orderBy("k").collect()
    assert [(r.mmsi, r.lat, r.lon, r.ts is not None) for r in got] == [(7, 1.5, 2.0, True), (8, 3.5, 4.0, True), (9, None, None, False), (None, None, None, False)]
    raw = landing.parse(spark.createDataFrame([(json.dumps(envelope(mmsi=None, UserID=5)),)], "value string"), "value")
    assert landing.flatten(raw).count() == 0 and landing.flatten(raw, fallback=True).first().mmsi == 5


def test_shards_and_missing_days(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, 10.0), (3, None, 1.0)], "id int, lat double, lon double")
    assert sorted((r.id, r.shard) for r in landing.by_shard(df).collect()) == [(1, "NE"), (1, "WORLD"), (2, "SE"), (2, "WORLD")]
    have = spark.createDataFrame([("2016-01-02",)], "date string")
    assert sorted(str(r.date) for r in landing.missing_days(spark, have, "2016-01-01", "2016-01-03").collect()) == ["2016-01-01", "2016-01-03"]
    assert landing.day_range("2016-02-28", "2016-03-01") == ["2016-02-28", "2016-02-29", "2016-03-01"]


def test_catalogue_table_gains_columns(spark, tmp_path):
    spark.createDataFrame([(1, 7)], "a int, d int").write.partitionBy("d").parquet(f"{tmp_path}/t")
    spark.sql("drop table if exists tide_t")
    sinks.register(spark, "tide_t", f"{tmp_path}/t", partitioned=False)
    sinks.add_columns(spark, "tide_t", {"a": "int", "heading": "int"})
    assert "heading" in spark.table("tide_t").columns
    sinks.analyze(spark, "tide_t")
    spark.sql("drop table tide_t")
