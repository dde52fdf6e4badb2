"""Streams run over all that is there, with the same results as their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import domain
from tidewater.operators import late_counts
from tidewater.plans import gold
from tidewater.plans.catalogue import Catalogue
from tidewater.session import scratch
from tidewater.sources.tables import table
from tidewater.streaming import ingest

CAT = Catalogue()


@CAT.add("select distinct mmsi, epoch_us(ts) as ts_us, message_type from messages where mmsi is not null and ts is not null")
def stream_dedup(spark, d):
    s = ingest.deduplicated(ingest.table_stream(spark, d, "messages"), "60 days").select("mmsi", F.unix_micros("ts").alias("ts_us"), "message_type")
    return ingest.drained(s, "dedup")


@CAT.add("""
  select mmsi, epoch_us(ts) // 600000000 * 600000000 as window_us, epoch_us(ts) as ts_us, row_id, lat, lon from messages where mmsi is not null and ts is not null
  qualify row_number() over (partition by mmsi, epoch_us(ts) // 600000000 order by ts, row_id) = 1""")
def stream_downsample(spark, d):
    """All windows, from the stream's sink."""
    return ingest.drained_to_the_end(ingest.table_stream(spark, d, "messages"), lambda m: ingest.downsampled(m, delay="60 days"), "downsample")


def dealt(df, out: str, into: int, by):
    """Writes all rows of `df` as `into` files, one after the other, as a stream of files would land; the file that a
    row is in is `by`."""
    settled = df.withColumn("__file", by.cast("int")).persist()
    for k in range(into):
        settled.where(F.col("__file") == k).drop("__file").coalesce(1).write.mode("append").parquet(out)
    settled.unpersist()
    return settled.drop("__file").schema


@CAT.add("""
  with h as (select (epoch_us(ts) // 3600000000) * 3600000000 as period_us, epoch_us(received_at) as r from messages where ts is not null and received_at is not null)
  select period_us, count(*) filter (where r < period_us + 3600000000) as n_at_end, count(*) as n_final from h where r < period_us + 7 * 3600000000 group by 1""")
def stream_late_counts(spark, d):
    """Rows numbered by their sources land in files out of order, one of them again in the next stream: counts stay right."""
    m = table(spark, d, "messages")
    rows, _ = late_counts.numbered(late_counts.staged(m, event_time="ts", received="received_at", source="source_listener", row_id="row_id"))
    folder = scratch(spark, "late")
    schema = dealt(rows, f"{folder}/in", 4, F.pmod(F.xxhash64("row_id"), F.lit(4)))
    counter = ingest.LateCounter(spark, folder)
    counter.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    counter.take(spark.read.parquet(f"{folder}/in"), 99)  # everything once more, under another batch number
    return counter.counts()


@CAT.add("""
  select row_id from messages where mmsi is not null and ts is not null and message_type is not null
  qualify row_number() over (partition by mmsi, ts, message_type order by row_id % 4, received_at nulls last, row_id) = 1""")
def stream_exactly_once(spark, d):
    """Rows kept by a stream with seen ranges as its state: all rows land in four files, copies in any of them."""
    folder = scratch(spark, "once")
    m = table(spark, d, "messages").select("row_id", "mmsi", "ts", "message_type", "received_at")
    schema = dealt(m, f"{folder}/in", 4, F.pmod("row_id", F.lit(4)))
    keep = ingest.ExactlyOnce(spark, folder, producer=["mmsi", "message_type"])
    keep.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    return keep.accepted()


_PLACES = "select mmsi, port_lo, min(port_lat) as port_lat, min(port_lon) as port_lon from matched_decl where mmsi is not null and port_lo is not null and port_lat is not null and port_lon is not null group by 1, 2"
_KM = gold.hav_sql("lat", "lon", "port_lat", "port_lon")


@CAT.add(f"""
  with e as (select mmsi, port_lo, ts, row_id, case when sog <= 1 and {_KM} <= 10 then 1 when sog > 1 and {_KM} > 10 then 0 end as near
             from messages join ({_PLACES}) using (mmsi) where message_type in {gold._TRACK} and lat is not null and lon is not null and ts is not null),
  c as (select *, lag(near) over (partition by mmsi, port_lo order by ts, row_id) as prev from e where near is not null),
  t as (select *, lead(ts) over (partition by mmsi, port_lo order by ts, row_id) as until from c where near is distinct from prev and not (near = 0 and prev is null))
  select mmsi, port_lo, epoch_us(ts) as arrival_us, epoch_us(until) as departure_us from t where near = 1 and until is not null""")
def stream_open_calls(spark, d):
    """Calls that a stream of fixes, day by day, closes; open ones are carried over as state."""
    folder = scratch(spark, "calls")
    fixes = table(spark, d, "messages").where(F.col("message_type").isin(*domain.TRACK_TYPES)).where("lat is not null and lon is not null and mmsi is not null and ts is not null").select("row_id", "mmsi", "ts", "lat", "lon", "sog")
    day = F.floor(F.unix_micros("ts") / gold.DAY)
    span = fixes.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    files = 5
    schema = dealt(fixes, f"{folder}/in", files, F.floor((day - (span["lo"] or 0)) * files / ((span["hi"] or 0) - (span["lo"] or 0) + 1)))
    declared = table(spark, d, "matched_decl").where("mmsi is not null and port_lo is not null and port_lat is not null and port_lon is not null")
    places = declared.groupBy("mmsi", "port_lo").agg(F.min("port_lat").alias("port_lat"), F.min("port_lon").alias("port_lon"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").join(places, "mmsi")
    ingest.open_calls(stream, f"{folder}/checkpoint", f"{folder}/out").awaitTermination()
    return spark.read.schema("mmsi long, port_lo string, arrival_us long, departure_us long").parquet(f"{folder}/out")


QUERIES, SQL = CAT.queries, CAT.sql
