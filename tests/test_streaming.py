"""Streams give what their batch counterparts give, also when batches come again."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewater.operators import late_counts
from tidewater.sources import landing
from tidewater.streaming import ingest

START = datetime(2016, 1, 5)


def messages(spark, rows):
    return spark.createDataFrame([(i, m, START + timedelta(minutes=t), START + timedelta(minutes=r), s, "PositionReport", 1.0, 2.0) for i, m, t, r, s in rows], "row_id long, mmsi long, ts timestamp, received_at timestamp, source_listener string, message_type string, lat double, lon double")


def test_late_counter_is_idempotent(spark, tmp_path):
    rows = [(i, i % 3, i * 7 % 300, i * 7 % 300 + (i * 37 % 700), ["a", "b", None][i % 3]) for i in range(300)]
    numbered, state = late_counts.numbered(late_counts.staged(messages(spark, rows), event_time="ts", received="received_at", source="source_listener", row_id="row_id"))
    want = {(r.period_us, r.n_at_end, r.n_final) for r in late_counts.period_counts(state).collect()}
    counter = ingest.LateCounter(spark, f"file://{tmp_path}/state", fold_after=3)
    assert counter.state() is None
    parts = [numbered.where(F.col("row_id") % 4 == k) for k in range(4)]
    for k in (2, 0, 3, 1, 0, 3):  # out of order, and some again
        counter.take(parts[k], k)
    assert {tuple(r) for r in counter.counts().collect()} == want
    for batch, k in enumerate((1, 1, 0, 2), 10):  # the same rows under other batch numbers
        counter.take(parts[k], batch)
    assert {tuple(r) for r in counter.counts().collect()} == want
    assert len(counter._parts()) <= 4


def test_landing_stream_keeps_valid_envelopes(spark, tmp_path):
    lines = [{"message_type": "PositionReport", "metadata": {"MMSI": 5, "latitude": la, "longitude": 0.0, "time_utc": "x"}, "message": {}} for la in (0.0, 91.0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text("\n".join([*map(json.dumps, lines), "cut {", ""]))
    out = ingest.drained(ingest.landing_stream(spark, f"{tmp_path}/in").select(F.col("__m.metadata.latitude").alias("lat")), "test")
    assert [r.lat for r in out.collect()] == [0.0]
    (tmp_path / "in" / "b.ndjson").write_text("\n".join(json.dumps(lines[0] | {"received_at": str(k)}) for k in range(95)))
    q = ingest.raw_sink(ingest.landing_stream(spark, f"{tmp_path}/in"), f"file://{tmp_path}/out", f"{tmp_path}/cp", seconds=1, most=20, writers=2)
    q.processAllAvailable()
    q.stop()
    files = list((tmp_path / "out").glob("year=*/month=*/day=*/hour=*/*.zst"))
    assert len(files) == 6  # two writers with 48 messages each, in files of 20
    kept = landing.read_zst(spark, f"{tmp_path}/out")
    assert kept.count() == 96 and kept.select("__raw").distinct().count() == 96


def test_a_cut_zst_file_gives_its_whole_lines(spark, tmp_path):
    import zstandard

    text = b"".join(json.dumps({"message_type": "P", "k": k}).encode() + b"\n" for k in range(30000))
    whole = zstandard.ZstdCompressor(level=3).compress(text)
    (tmp_path / "a.zst").write_bytes(whole)
    (tmp_path / "b.zst").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "c.zst").write_bytes(b"no zstd")
    assert 30000 <= landing.read_zst(spark, str(tmp_path)).count() < 60000
    assert landing.read_zst(spark, f"{tmp_path}/a.zst").count() == 30000


def test_a_failed_query_is_started_again(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in.parquet")
    tries, pauses = [], []

    def start():
        def take(rows, batch):
            tries.append(batch)
            if len(tries) < 3:
                raise OSError("gone")

        return ingest.table_stream(spark, str(tmp_path), "in").writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    ingest.supervised(start, wait=pauses.append)
    assert tries == [0, 0, 0] and pauses == [15.0, 15.0]
    tries.clear()
    with pytest.raises(StreamingQueryException):
        ingest.supervised(lambda: ingest.table_stream(spark, str(tmp_path), "in").writeStream.foreachBatch(lambda r, b: 1 / 0).trigger(availableNow=True).start(), tries=2, wait=pauses.append)


def test_open_calls_carry_over_batches(spark, tmp_path):
    path = f"{tmp_path}/in.parquet"
    fixes = lambda rows: spark.createDataFrame([(k, 1, START + timedelta(hours=h), la, 0.0, s, "P", 10.0, 0.0) for k, (h, la, s) in enumerate(rows)], "row_id long, mmsi long, ts timestamp, lat double, lon double, sog double, port_lo string, port_lat double, port_lon double")
    fixes([(0, 11.0, 12.0), (5, 10.01, 0.5), (6, 10.0, 0.1)]).coalesce(1).write.parquet(path)
    for k in range(2):
        stream = ingest.table_stream(spark, str(tmp_path), "in")
        ingest.open_calls(stream, f"{tmp_path}/cp", f"{tmp_path}/out").awaitTermination()
        if k == 0:
            assert spark.read.schema("mmsi long, port_lo string, arrival_us long, departure_us long").parquet(f"{tmp_path}/out").count() == 0
            fixes([(30, 10.0, 0.0), (31, 10.02, 5.0), (32, 10.5, 12.0)]).coalesce(1).write.mode("append").parquet(path)
    r = spark.read.parquet(f"{tmp_path}/out").collect()
    us = lambda h: int((START + timedelta(hours=h) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert [(x.port_lo, x.arrival_us, x.departure_us) for x in r] == [("P", us(5), us(32))]


def test_exactly_once_over_batches_and_repeats(spark, tmp_path):
    rows = [(i, i % 2, i // 4, 100 - i, "a") for i in range(40)]
    df = messages(spark, rows)
    keep = ingest.ExactlyOnce(spark, f"file://{tmp_path}/once", producer=["mmsi", "message_type"])
    parts = [df.where(F.col("row_id") % 3 == k) for k in range(3)]
    for k in (0, 1, 1, 2, 0, 2):  # some again, as after a failure
        keep.take(parts[k], k)
    got = sorted(r.row_id for r in keep.accepted().collect())
    want, seen = [], set()
    for k in range(3):
        for i, m, t, r, _ in sorted((x for x in rows if x[0] % 3 == k), key=lambda x: (x[3], x[0])):
            if (m, t) not in seen:
                seen.add((m, t))
                want.append(i)
    assert got == sorted(want)


def test_state_of_the_stream_is_whole_and_merged(spark, tmp_path):
    """Each day's newest state is disjoint ranges over all that has come; older states are removed."""
    rows = [(i, 1, 24 * 60 * (i % 3) + i // 3, i, "a") for i in range(60)]
    df = messages(spark, rows).withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / 60_000) * 1000))
    keep = ingest.ExactlyOnce(spark, f"file://{tmp_path}/once", producer=["mmsi", "message_type"])
    for batch in range(6):
        keep.take(df.where(F.col("row_id") % 6 == batch), batch)
    assert keep.accepted().count() == 60
    days = list((tmp_path / "once" / "seen").glob("day=*"))
    for day in days:
        versions = sorted(day.glob("batch=*"))
        assert len(versions) <= 2
    newest = [str(sorted(day.glob("batch=*"))[-1]) for day in days]
    got = spark.read.parquet(*newest)
    assert sum(r["last"] - r["first"] + 1 for r in got.where("kind = 'range'").collect()) == 60


def test_downsampled_windows_all_come_from_the_sink(spark, data, monkeypatch):
    """Also those that no later message would close; no batch plan stands in for the stream."""
    from tidewater.plans import streams

    monkeypatch.setattr(streams, "table", None, raising=False)
    m = spark.read.parquet(f"{data}/messages.parquet").where("mmsi is not null and ts is not null")
    assert streams.stream_downsample(spark, data).count() == m.select("mmsi", F.window("ts", "10 minutes")).distinct().count() > 0
