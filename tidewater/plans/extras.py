"""Smaller operators as queries: tolerant parsing, clock arithmetic, keys, samples, splits, scaling, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import geo, text, timefns
from tidewater.operators import relational as rel
from tidewater.plans import features, gold
from tidewater.plans.catalogue import Catalogue
from tidewater.sources import lake, landing
from tidewater.sources.tables import table

CAT = Catalogue()

_RAW = "case event_id % 6 when 0 then 'NA' when 1 then '' when 2 then (event_id % 1000) || '.7' when 3 then (event_id % 40) || 'e3' when 4 then 'IMO' || event_id else event_id || '' end"


@CAT.add(f"""
  select event_id, raw, case when round_even(try_cast(raw as double), 0) between -32769 and 32767 then round_even(try_cast(raw as double), 0)::smallint end as as_smallint,
    case when regexp_matches(raw, '^(IMO)?[0-9]+$') then try_cast(regexp_replace(raw, '^IMO', '') as integer) end as imo, case when raw not in ('', 'NA', 'N/A', 'nan', 'none', 'None', 'NULL') then raw end as kept
  from (select event_id, {_RAW} as raw from events)""")
def tolerant_cast(spark, d):
    """Numbers out of untidy text."""
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, "NA").when(i % 6 == 1, "").when(i % 6 == 2, F.concat(i % 1000, F.lit(".7"))).when(i % 6 == 3, F.concat(i % 40, F.lit("e3"))).when(i % 6 == 4, F.concat(F.lit("IMO"), i)).otherwise(i.cast("string"))
    r = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return r.select("event_id", "raw", text.tolerant_int("raw", "smallint").alias("as_smallint"), F.when(F.col("raw").rlike("^(IMO)?[0-9]+$"), text.imo("raw")).alias("imo"), text.without_tokens("raw").alias("kept"))


@CAT.add("""
  select event_id, round_even(epoch_us(ts) / 1e6, 0)::integer as epoch_s, epoch_us(ts + interval 90 minute) // 3600000000 - epoch_us(ts) // 3600000000 as hours_crossed, dayofweek(ts)::integer as dow, (epoch_us(ts) % 86400000000) / 86400000000 as day_part,
    md5(concat_ws('|', user_id::varchar, event_type, epoch_us(ts)::varchar)) as row_key
  from events""")
def clock_arithmetic(spark, d):
    """Seconds rounded half to even, boundaries crossed, days from Sunday, the part of the day, a digest as key."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    later = F.timestamp_micros(F.unix_micros("ts") + 5_400_000_000)
    return e.select("event_id", timefns.epoch_rounded("ts").alias("epoch_s"), timefns.boundaries_crossed("hour", "ts", later).alias("hours_crossed"), timefns.sunday_zero("ts").alias("dow"), timefns.day_fraction("ts").alias("day_part"), text.row_key("user_id", "event_type", F.unix_micros("ts")).alias("row_key"))


_SHARDS = ", ".join(f"('{k}', {s}, {w}, {n}, {e})" for k, (s, w, n, e) in geo.SHARDS.items())


@CAT.add(f"select shard, count(*) as n from vessels_positions join (values {_SHARDS}) as b(shard, south, west, north, east) on lat between south and north and lon between west and east group by 1")
def shard_counts(spark, d):
    return landing.by_shard(table(spark, d, "vessels_positions")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@CAT.add("select mmsi, n from (select mmsi, count(*) as n from vessels_positions group by 1) order by md5(mmsi::varchar), mmsi limit 10")
def random_subset(spark, d):
    """A sample of ten vessels, the same each time: those with the lowest digests."""
    p = table(spark, d, "vessels_positions")
    chosen = p.select("mmsi").distinct().orderBy(F.md5(F.col("mmsi").cast("string")), "mmsi").limit(10)
    return p.join(chosen, "mmsi", "left_semi").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))


@CAT.add(f"select mmsi, pos_id, row_number() over (partition by mmsi order by ts) <= 0.8 * count(*) over (partition by mmsi) as train from {features.PINGS}")
def temporal_split(spark, d):
    """The first four fifths of each vessel's fixes."""
    p = features.pings(table(spark, d, "vessels_positions")).withColumn("__day", F.floor(F.col("eu") / gold.DAY))
    numbered = rel.running(p, ["mmsi"], "__day", [F.col("ts")], F.lit(1), "number")
    return numbered.join(p.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")), "mmsi").select("mmsi", "pos_id", (F.col("number") <= 0.8 * F.col("n")).alias("train"))


@CAT.add(f"select pos_id, round((sog - m) / s, 6) as sog_scaled from {features.PINGS}, (select {features._avg('sog')} as m, {features._std('sog')} as s from {features.PINGS})")
def standard_scaling(spark, d):
    p = features.pings(table(spark, d, "vessels_positions"))
    stats = p.agg(features.exact_avg("sog").alias("m"), features.exact_std("sog").alias("s"))
    return p.crossJoin(F.broadcast(stats)).select("pos_id", F.round((F.col("sog") - F.col("m")) / F.col("s"), 6).alias("sog_scaled"))  # one row


@CAT.add("select pos_id, coalesce(sog, 0) as sog, coalesce(rate_of_turn, 0) as rate_of_turn, coalesce(navigational_status, -1) as navigational_status from vessels_positions where true_heading is not null")
def null_fill(spark, d):
    return table(spark, d, "vessels_positions").na.drop(subset=["true_heading"]).na.fill({"sog": 0.0, "rate_of_turn": 0, "navigational_status": -1}).select("pos_id", "sog", "rate_of_turn", "navigational_status")


@CAT.add("select mmsi, name, 'kept' as side from vessels union all select mmsi, name, 'new' from (select mmsi, min(name) as name from messages where mmsi is not null and message_type = 'StaticDataReport' group by 1) s where not exists (select 1 from vessels v where v.mmsi = s.mmsi)")
def insert_missing(spark, d):
    """Vessels that the table lacks are added, others left as they are."""
    fresh = table(spark, d, "messages").where("mmsi is not null and message_type = 'StaticDataReport'").groupBy("mmsi").agg(F.min("name").alias("name")).withColumn("side", F.lit("new"))
    return rel.insert_missing(table(spark, d, "vessels").select("mmsi", "name", F.lit("kept").alias("side")), fresh, ["mmsi"])


@CAT.add("select mmsi, n from (select mmsi, count(*) as n from vessels_positions group by 1) order by n desc, mmsi limit 10")
def busiest_vessels(spark, d):
    return table(spark, d, "vessels_positions").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "mmsi").limit(10)


@CAT.add("select sum(n)::double / count(*) as fixes_per_day, count(*) as vessel_days, max(n) as most from (select mmsi, year, month, day, count(*) as n from vessels_positions group by all)")
def nested_average(spark, d):
    per = table(spark, d, "vessels_positions").groupBy("mmsi", "year", "month", "day").agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("n").cast("double") / F.count(F.lit(1))).alias("fixes_per_day"), F.count(F.lit(1)).alias("vessel_days"), F.max("n").alias("most"))


@CAT.add(f"select pos_idx::integer as pos_idx, count(*) as n, {features._avg('sog')} as sog_mean, {features._std('sog')} as sog_std from ({features._LAST}) group by 1")
def step_statistics(spark, d):
    """Mean and deviation of a feature at each step of the sequences, padding left out."""
    s = features.last_n(features._windowed(spark, d, 24))
    return s.groupBy("pos_idx").agg(F.count(F.lit(1)).alias("n"), features.exact_avg("sog").alias("sog_mean"), features.exact_std("sog").alias("sog_std"))


#: What a step of a sequence holds, with the resolution at which its sums are exact.
STEPS = {"sog": 10, "cog": 10, "true_heading": 1, "rate_of_turn": 1, "lat": 100_000, "lon": 100_000, "dt_h": 1000, "d_km": 1000, "accel": 100}


def masked_statistics(steps: DataFrame, scales: dict[str, int]) -> DataFrame:
    """(feature, n, mean, std): over all steps there are, padding and nulls left out; the deviation is that of all steps
    (not of a sample), and 1 where it is 0, as it divides. Features in one pass, over whole numbers of their resolution."""
    name = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.round(F.col(k) * scale).cast("long").alias("w"), F.lit(float(scale)).alias("scale")) for k, scale in scales.items()])).alias("x")
    g = steps.select(name).select("x.*").where("w is not null").groupBy("feature", "scale").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"), F.sum(F.col("w").cast("decimal(38,0)") * F.col("w")).alias("q"))
    std = F.sqrt((F.col("n") * F.col("q") - F.col("s").cast("decimal(38,0)") * F.col("s")).cast("double")) / F.col("n") / F.col("scale")
    return g.select("feature", "n", (F.col("s") / F.col("scale") / F.col("n")).alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))


@CAT.add(" union all ".join(f"select '{k}' as feature, count(w) as n, sum(w)::double / {float(scale)} / count(w) as mean, case when count(w) * sum(w * w) > sum(w) * sum(w) then sqrt((count(w) * sum(w * w) - sum(w) * sum(w))::double) / count(w) / {float(scale)} else 1.0 end as std from (select round({k} * {scale})::hugeint as w from ({features._LAST}))" for k, scale in STEPS.items()))
def step_scaling(spark, d):
    """Mean and deviation of every feature of the steps, by which sequences are normalised."""
    return masked_statistics(features.last_n(features._windowed(spark, d, 24)), STEPS)


@CAT.add("""
  select h as hour_us, count(m.row_id) as n from (select unnest(generate_series(min(epoch_us(ts)) // 3600000000, max(epoch_us(ts)) // 3600000000)) * 3600000000 as h from messages) g
  left join messages m on epoch_us(m.ts) // 3600000000 * 3600000000 = g.h group by 1""")
def hour_series(spark, d):
    """Messages in every hour between the first and the last, empty hours too."""
    m = table(spark, d, "messages").where("ts is not null").select("row_id", (F.floor(F.unix_micros("ts") / 3_600_000_000) * 3_600_000_000).alias("hour_us"))
    per = m.groupBy("hour_us").agg(F.count(F.lit(1)).alias("n"))
    hours = per.agg(F.min("hour_us").alias("a"), F.max("hour_us").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(3_600_000_000))).alias("hour_us"))
    return hours.join(per, "hour_us", "left").select("hour_us", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@CAT.add("select date from (select unnest(generate_series(date '2016-01-01', date '2016-01-31', interval 1 day))::date as date) g where date not in (select (ts at time zone 'UTC')::date from messages where ts is not null)")
def missing_days(spark, d):
    have = table(spark, d, "messages").where("ts is not null").select(F.to_date("ts").alias("date"))
    return landing.missing_days(spark, have, "2016-01-01", "2016-01-31")


@CAT.add()
def parquet_footers(spark, d):
    """Row-group statistics of the positions."""
    return landing.row_groups(spark, f"{d}/vessels_positions.parquet")


_BOUNDED = ("pos_id", "mmsi", "lat", "lon", "sog", "cog")


@CAT.add(" union all ".join(f"select '{c}' as name, min({c})::double as low, max({c})::double as high, count(*) as n from vessels_positions" for c in _BOUNDED))
def footer_bounds(spark, d):
    """Least and greatest value of some columns, from the footers alone."""
    g = landing.row_groups(spark, f"{d}/vessels_positions.parquet").where(F.col("column").isin(*_BOUNDED))
    return g.groupBy(F.col("column").alias("name")).agg(F.min(F.col("low").cast("double")).alias("low"), F.max(F.col("high").cast("double")).alias("high"), F.sum("rows").alias("n"))


@CAT.add("select file_id from raw_files where not coalesce(listener_id = (select max(listener_id) from raw_files where path like '%/day=10/%') and path like '%/day=10/%', false)")
def delete_by_subquery(spark, d):
    """Files that stay when those of one day of the last of its listeners are deleted; the listener is a subquery."""
    f = table(spark, d, "raw_files").select("file_id", "path", "listener_id")
    last = f.where("path like '%/day=10/%'").select(F.max("listener_id").alias("listener_id"), F.lit("last").alias("name"))
    return lake.without(f, last, "listener_id", "last", "%/day=10/%").select("file_id")


@CAT.add("""
  select f.file_id, count(*) as messages, count(distinct try_cast(l.line as json) ->> 'message_type') as types from raw_files f, (select file_id, unnest(string_split(body, chr(10))) as line from raw_files) l
  where l.file_id = f.file_id and (try_cast(l.line as json) ->> 'message_type') is not null group by 1""")
def landing_messages(spark, d):
    """Readable envelopes in each landing file."""
    f = table(spark, d, "raw_files").select("file_id", F.explode(F.split("body", "\n")).alias("value"))
    m = landing.parse(f, "value").where("__m is not null and __m.message_type is not null")
    return m.groupBy("file_id").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("__m.message_type").alias("types"))


QUERIES, SQL = CAT.queries, CAT.sql
