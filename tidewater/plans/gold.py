"""Silver and gold derivations: deduplicated messages, positions, tracks, stations, vessels, port calls, congestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import domain, geo, text, timefns
from tidewater.operators import relational as rel
from tidewater.plans.catalogue import Catalogue
from tidewater.session import scratch, settle
from tidewater.sources import landing
from tidewater.sources.sinks import write_sorted
from tidewater.sources.tables import table

CAT = Catalogue()
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: What a vessel's time is cut into, so that one with a large part of all rows is spread.
SLOT = 6 * HOUR
RADIUS_KM, SLOW_KN, BERTH_KN, LEAST_MIN = 10.0, 0.5, 1.0, 30
_TRACK = "('PositionReport', 'ExtendedClassBPositionReport', 'StandardClassBPositionReport')"
HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a=a, b=b, c=c, d=d)


def silver(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a vessel, each (vessel, time, type) as it was first received."""
    m = table(spark, d, "messages").where("mmsi is not null")
    return rel.first_by(m, ["mmsi", "ts", "message_type"], [F.col("received_at").asc_nulls_last(), F.col("row_id").asc()])


SILVER = "select * from messages where mmsi is not null qualify row_number() over (partition by mmsi, ts, message_type order by received_at nulls last, row_id) = 1"


@CAT.add(f"select row_id, mmsi, epoch_us(ts) as ts_us, message_type from ({SILVER})")
def dedup_first_received(spark, d):
    return silver(spark, d).select("row_id", "mmsi", F.unix_micros("ts").alias("ts_us"), "message_type")


@CAT.add("select row_id, mmsi, epoch_us(ts) as ts_us, lat, lon, sog from messages where message_type in ('PositionReport', 'StandardClassBPositionReport', 'ExtendedClassBPositionReport', 'LongRangeAisBroadcast') and mmsi is not null and abs(lat) <> 91 and abs(lon) <> 181")
def positions_filter(spark, d):
    m = table(spark, d, "messages").where(F.col("message_type").isin(*domain.POSITION_TYPES) & F.col("mmsi").isNotNull() & domain.placed("lat", "lon"))
    return m.select("row_id", "mmsi", F.unix_micros("ts").alias("ts_us"), "lat", "lon", "sog")


def tracks(m: DataFrame) -> DataFrame:
    """First position of each vessel in every 10 minutes, coordinates as integers of 1e-5 degrees."""
    s = m.where(F.col("message_type").isin(*domain.TRACK_TYPES) & F.col("ts").isNotNull() & F.col("mmsi").isNotNull()).withColumn("__s", timefns.epoch_rounded("ts"))
    one = rel.first_by(s, ["mmsi", F.floor(F.col("__s") / 600)], [F.col("ts").asc(), F.col("row_id").asc()])
    return one.select(
        F.col("mmsi").cast("int").alias("mmsi"),
        F.col("__s").alias("ts"),
        F.round(F.col("lat") * 1e5).cast("int").alias("lat"),
        F.round(F.col("lon") * 1e5).cast("int").alias("lon"),
        F.round(F.coalesce("cog", F.col("true_heading").cast("double"))).cast("int").alias("heading"),
        F.to_date("ts").alias("date"),
    )


TRACKS = f"""
  select mmsi::integer as mmsi, epoch(ts)::integer as ts, round(lat * 1e5)::integer as lat, round(lon * 1e5)::integer as lon,
         round(coalesce(cog, true_heading))::integer as heading, (ts at time zone 'UTC')::date as date
  from messages where message_type in {_TRACK} and ts is not null and mmsi is not null
  qualify row_number() over (partition by mmsi, epoch(ts)::integer // 600 order by ts, row_id) = 1"""


@CAT.add(TRACKS)
def track_downsample_10m(spark, d):
    return tracks(table(spark, d, "messages"))


@CAT.add("select row_id, mmsi, epoch_us(ts) as ts_us, lat, lon, epoch_us(received_at) as received_us, source_listener, message_id, raim, year, month, day from messages where message_type = 'BaseStationReport'")
def base_stations(spark, d):
    return table(spark, d, "messages").where("message_type = 'BaseStationReport'").select("row_id", "mmsi", F.unix_micros("ts").alias("ts_us"), "lat", "lon", F.unix_micros("received_at").alias("received_us"), "source_listener", "message_id", "raim", "year", "month", "day")


@CAT.add("select row_id, mmsi, name, type_of_aton, epoch_us(ts) as ts_us, lat, lon, dimension_a, dimension_b, dimension_c, dimension_d, off_position, virtual_aton, raim, year, month, day from messages where message_type = 'AidsToNavigationReport'")
def aids_to_navigation(spark, d):
    return table(spark, d, "messages").where("message_type = 'AidsToNavigationReport'").select("row_id", "mmsi", "name", "type_of_aton", F.unix_micros("ts").alias("ts_us"), "lat", "lon", "dimension_a", "dimension_b", "dimension_c", "dimension_d", "off_position", "virtual_aton", "raim", "year", "month", "day")


VESSEL = ("name", "call_sign", "imo_number", "ship_type", "length", "width", "destination")


def latest_static(m: DataFrame) -> DataFrame:
    s = m.where("message_type = 'ShipStaticData' and mmsi is not null and ts is not null")
    one = rel.first_by(s, ["mmsi"], [F.col("ts").desc(), F.col("received_at").asc_nulls_last(), F.col("row_id").asc()])
    return one.select("mmsi", *VESSEL, F.col("ts").alias("last_seen_static"))


_STATIC = f"select mmsi, {', '.join(VESSEL)}, ts as last_seen_static from messages where message_type = 'ShipStaticData' and mmsi is not null and ts is not null qualify row_number() over (partition by mmsi order by ts desc, received_at nulls last, row_id) = 1"


@CAT.add(f"select * exclude (last_seen_static), epoch_us(last_seen_static) as seen_us from ({_STATIC})")
def vessels_latest(spark, d):
    return latest_static(table(spark, d, "messages")).withColumn("seen_us", F.unix_micros("last_seen_static")).drop("last_seen_static")


@CAT.add(f"""
  select * exclude (last_seen_static, side), epoch_us(last_seen_static) as seen_us from (
    select mmsi, {', '.join(VESSEL)}, last_seen_static, 1 as side from vessels union all select *, 0 from ({_STATIC}))
  qualify row_number() over (partition by mmsi order by last_seen_static desc nulls last, side) = 1""")
def vessels_merge(spark, d):
    """Upsert of the day's latest static reports into the vessel table; newer ones only."""
    kept = table(spark, d, "vessels").select("mmsi", *VESSEL, "last_seen_static")
    return rel.upsert(kept, latest_static(table(spark, d, "messages")), ["mmsi"], F.col("last_seen_static")).withColumn("seen_us", F.unix_micros("last_seen_static")).drop("last_seen_static")


_SCORE = "((name is not null)::int + (call_sign is not null)::int + (imo_number is not null)::int + (length is not null)::int + (width is not null)::int)"


@CAT.add(f"select row_id, mmsi, name, call_sign, imo_number, {_SCORE} as score from messages where message_type in ('ShipStaticData', 'StaticDataReport') and mmsi is not null and name is not null and name <> '' qualify row_number() over (partition by mmsi order by score desc, ts desc nulls last, row_id) = 1")
def vessels_best_completeness(spark, d):
    """The most complete static report of each vessel, the newest of equals."""
    score = sum((F.col(k).isNotNull().cast("int") for k in ("name", "call_sign", "imo_number", "length", "width")), F.lit(0))
    m = table(spark, d, "messages").where("message_type in ('ShipStaticData', 'StaticDataReport') and mmsi is not null and name is not null and name <> ''").withColumn("score", score)
    return rel.first_by(m, ["mmsi"], [F.col("score").desc(), F.col("ts").desc_nulls_last(), F.col("row_id").asc()]).select("row_id", "mmsi", "name", "call_sign", "imo_number", "score")


@CAT.add("""
  with j as (select row_id, raw_message::json as r, (raw_message::json ->> 'message_type') as t from messages where raw_message is not null and (raw_message::json -> 'metadata' ->> 'MMSI') is not null),
  b as (select *, (r -> 'message' -> t) as m, (r -> 'message' -> 'StaticDataReport') as s from j)
  select row_id, t as message_type, (r -> 'metadata' ->> 'MMSI')::bigint as mmsi, (r -> 'metadata' ->> 'latitude')::double as lat, (r -> 'metadata' ->> 'longitude')::double as lon,
         (m ->> 'Sog')::double as sog, (m ->> 'Cog')::double as cog, (m ->> 'TrueHeading')::integer as true_heading, (m ->> 'NavigationalStatus')::integer as navigational_status, (m ->> 'RateOfTurn')::integer as rate_of_turn,
         coalesce((m ->> 'Name'), (s -> 'ReportA' ->> 'Name'), nullif((r -> 'metadata' ->> 'ShipName'), '')) as name,
         coalesce((m ->> 'CallSign'), (s -> 'ReportB' ->> 'CallSign')) as call_sign, (m ->> 'ImoNumber')::bigint as imo_number,
         coalesce((m ->> 'Type')::integer, (s -> 'ReportB' ->> 'ShipType')::integer) as ship_type,
         coalesce((m -> 'Dimension' ->> 'A')::double, (s -> 'ReportB' -> 'Dimension' ->> 'A')::double, 0) + coalesce((m -> 'Dimension' ->> 'B')::double, (s -> 'ReportB' -> 'Dimension' ->> 'B')::double, 0) as length,
         (m ->> 'MaximumStaticDraught')::double as max_static_draught, (m ->> 'Destination') as destination, coalesce((m ->> 'FixType')::integer, (m ->> 'Fixtype')::integer) as fix_type
  from b""")
def flatten_raw(spark, d):
    """The raw envelope as columns, with an explicit schema."""
    m = table(spark, d, "messages").where("raw_message is not null").select("row_id", "raw_message")
    flat = landing.flatten(landing.parse(m, "raw_message"))
    return flat.select("row_id", "message_type", "mmsi", "lat", "lon", "sog", "cog", "true_heading", "navigational_status", "rate_of_turn", "name", "call_sign", "imo_number", "ship_type", "length", "max_static_draught", "destination", "fix_type")


@CAT.add("""
  with j as (select row_id, ts at time zone 'UTC' as u, raw_message::json -> 'message' -> 'ShipStaticData' -> 'Eta' as e from messages where message_type = 'ShipStaticData' and raw_message is not null and ts is not null),
  p as (select row_id, u, (e ->> 'Month')::int as mo, (e ->> 'Day')::int as dd, (e ->> 'Hour')::int as hh, (e ->> 'Minute')::int as mi from j where (e ->> 'Month') is not null)
  select row_id, epoch_us((make_date((extract(year from u) + case when mo < extract(month from u) or (mo = extract(month from u) and dd < extract(day from u)) then 1 else 0 end)::int, 1, 1) + to_months(mo - 1))::timestamp)
         + ((dd - 1) * 86400::bigint + hh * 3600 + mi * 60) * 1000000 as eta_us
  from p""")
def lenient_eta(spark, d):
    """Arrival times declared without a year; parts out of range carry over."""
    m = table(spark, d, "messages").where("message_type = 'ShipStaticData' and raw_message is not null and ts is not null").select("row_id", F.col("ts").alias("__ts"), "raw_message")
    e = F.col("__m.message")["ShipStaticData"]["Eta"]
    p = landing.parse(m, "raw_message", name="__m").select("row_id", "__ts", e.alias("e")).where("e.Month is not null")
    return p.select("row_id", F.unix_micros(timefns.eta_with_year("__ts", F.col("e.Month"), F.col("e.Day"), F.col("e.Hour"), F.col("e.Minute"))).alias("eta_us"))


_CLEAN = r"""
  with s as (select decl_id, regexp_replace(upper(regexp_replace(dest_raw, '^\s+|\s+$', '', 'g')), '[^\x20-\x7E]', '', 'g') as s from matched_decl),
  t as (select decl_id, s, trim(regexp_replace(s, '\s+', ' ', 'g')) as tidy from s)
  select decl_id, case when not regexp_matches(s, '^[?@]{2,}$') and not regexp_matches(s, '^-{3,}$') and not regexp_matches(s, '^0+$') and not regexp_matches(s, '^[Xx]{2,}$') and not regexp_matches(s, '^\+?$') and length(tidy) >= 2 then tidy end as cleaned from t"""


@CAT.add(_CLEAN)
def clean_destination(spark, d):
    return table(spark, d, "matched_decl").select("decl_id", text.clean_destination("dest_raw").alias("cleaned"))


@CAT.add(r"""
  select lo_code, coord_raw, name, case when ok then (regexp_extract(coord_raw, p, 1)::double + regexp_extract(coord_raw, p, 2)::double / 60.0) * case when regexp_extract(coord_raw, p, 3) = 'S' then -1 else 1 end end as parsed_lat,
         case when ok then (regexp_extract(coord_raw, p, 4)::double + regexp_extract(coord_raw, p, 5)::double / 60.0) * case when regexp_extract(coord_raw, p, 6) = 'W' then -1 else 1 end end as parsed_lon
  from (select *, '^\s*(\d{2})(\d{2})([NS])\S*\s+(\d{3})(\d{2})([EW])\S*\s*$' as p, coalesce(regexp_matches(coord_raw, '^\s*(\d{2})(\d{2})([NS])\S*\s+(\d{3})(\d{2})([EW])\S*\s*$'), false) as ok from ports)""")
def coord_parse(spark, d):
    lat, lon = text.coordinate("coord_raw")
    return table(spark, d, "ports").select("lo_code", "coord_raw", "name", lat.alias("parsed_lat"), lon.alias("parsed_lon"))


def port_keys(ports: DataFrame) -> list[DataFrame]:
    """Lookup tables in order of priority: code, names of ports, any name (in each, the plain before the ASCII name).

    The reference table is one row a place on earth (about 10^5 rows), so Spark's size check lets it be broadcast;
    beyond that the joins are shuffled.
    """
    p = ports.where("lo_code is not null")
    best = F.max(F.struct("country", "lo_code", "name")).alias("b")
    out = []
    for key, keep in (("lo_code", "true"), ("name", "is_port = 1"), ("name_ascii", "is_port = 1"), ("name", "true"), ("name_ascii", "true")):
        out.append(p.where(keep).where(f"{key} is not null").groupBy(F.upper(key).alias("__key")).agg(best).select("__key", F.col("b.lo_code").alias("__lo"), F.col("b.name").alias("__name")))
    return out


def match_ports(declared: DataFrame, ports: DataFrame, dest: str) -> DataFrame:
    """Adds match_lo, match_name and match_level (1 to 5, null where nothing matches)."""
    out, los, names = declared, [], []
    for k, t in enumerate(port_keys(ports)):
        out = out.join(t.select(F.col("__key").alias(f"__k{k}"), F.col("__lo").alias(f"__lo{k}"), F.col("__name").alias(f"__name{k}")), F.col(dest) == F.col(f"__k{k}"), "left")
        los.append(f"__lo{k}")
        names.append(F.when(F.col(f"__lo{k}").isNotNull(), F.lit(k + 1)))
    first_name = F.coalesce(*[F.when(F.col(lo).isNotNull(), F.struct(F.col(f"__name{k}").alias("n"))) for k, lo in enumerate(los)])["n"]
    return out.select(*[declared[x] for x in declared.columns], F.coalesce(*los).alias("match_lo"), first_name.alias("match_name"), F.coalesce(*names).alias("match_level"))


def _level(key: str, keep: str) -> str:
    return f"select upper({key}) as key, max(struct_pack(country := country, lo_code := lo_code, name := name)) as b from ports where lo_code is not null and {key} is not null and {keep} group by 1"


@CAT.add(f"""
  with k1 as ({_level('lo_code', 'true')}), k2 as ({_level('name', 'is_port = 1')}), k3 as ({_level('name_ascii', 'is_port = 1')}), k4 as ({_level('name', 'true')}), k5 as ({_level('name_ascii', 'true')})
  select decl_id, coalesce(k1.b.lo_code, k2.b.lo_code, k3.b.lo_code, k4.b.lo_code, k5.b.lo_code) as match_lo,
         case when k1.key is not null then k1.b.name when k2.key is not null then k2.b.name when k3.key is not null then k3.b.name when k4.key is not null then k4.b.name else k5.b.name end as match_name,
         case when k1.key is not null then 1 when k2.key is not null then 2 when k3.key is not null then 3 when k4.key is not null then 4 when k5.key is not null then 5 end as match_level
  from matched_decl d left join k1 on k1.key = d.dest_clean left join k2 on k2.key = d.dest_clean left join k3 on k3.key = d.dest_clean left join k4 on k4.key = d.dest_clean left join k5 on k5.key = d.dest_clean""")
def priority_port_match(spark, d):
    return match_ports(table(spark, d, "matched_decl"), table(spark, d, "ports"), "dest_clean").select("decl_id", "match_lo", "match_name", "match_level")


# port calls

#: As `declarations_by_eta`.
_DECL = "(select distinct mmsi, dest_clean, eta, static_ts, port_lo, port_name, port_lat, port_lon from (select * from matched_decl where mmsi is not null and dest_clean is not null and eta is not null qualify row_number() over (partition by mmsi, dest_raw, eta order by static_ts desc nulls last, decl_id) = 1))"
_FIX = f"(select row_id, mmsi, ts, lat, lon, sog from messages where message_type in {_TRACK} and lat is not null and lon is not null and mmsi is not null and ts is not null qualify row_number() over (partition by mmsi, ts order by row_id) = 1)"
_POS_ETA = f"select p.*, m.* exclude (mmsi) from {_FIX} p join {_DECL} m on p.mmsi = m.mmsi and p.ts >= m.static_ts - interval 1 day and p.ts <= coalesce(m.eta, m.static_ts) + interval 7 day"


def fixes(m: DataFrame) -> DataFrame:
    p = m.where(F.col("message_type").isin(*domain.TRACK_TYPES)).where("lat is not null and lon is not null and mmsi is not null and ts is not null")
    return rel.first_by(p.select("row_id", "mmsi", "ts", "lat", "lon", "sog"), ["mmsi", "ts"], [F.col("row_id").asc()])


def declarations_by_eta(m: DataFrame) -> DataFrame:
    """The latest declaration of each vessel, destination as sent and eta: what was declared before a vessel named a
    place again is kept, with as many rows as it gave times."""
    d = m.where("mmsi is not null and dest_clean is not null and eta is not null")
    return rel.first_by(d, ["mmsi", "dest_raw", "eta"], [F.col("static_ts").desc_nulls_last(), F.col("decl_id").asc()]).select("mmsi", "dest_clean", "eta", "static_ts", "port_lo", "port_name", "port_lat", "port_lon").distinct()


def span_of(m: DataFrame) -> DataFrame:
    """(lo, hi): first and last time of a table, in us."""
    return m.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))


def positions_in_window(positions: DataFrame, declared: DataFrame, span: DataFrame) -> DataFrame:
    """Each fix with the declarations of its vessel whose window [declared - 1 day, eta + 7 days] it lies in: a row for
    each of the two. What only needs the first of them goes by `first_slow` and `stop_events_of`. The join is spread over (vessel,
    quarter of a day), and the quarter stays in the result as __slot for what goes on with it."""
    return rel.interval_join(positions, declared, "mmsi", F.unix_micros("ts"), F.unix_micros("static_ts") - DAY, F.unix_micros(F.coalesce("eta", "static_ts")) + 7 * DAY, SLOT, span, keep="__slot")


def _inputs(spark, d, again: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixes, declarations and the span of time; fixes that a plan goes over again and again are settled."""
    m = table(spark, d, "messages")
    fixed = fixes(m)
    return settle(fixed) if again else fixed, declarations_by_eta(table(spark, d, "matched_decl")), span_of(m)


@CAT.add(f"select mmsi, count(*) as n, count(distinct row_id) as fixes, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from ({_POS_ETA}) group by 1")
def eta_window_join(spark, d):
    return positions_in_window(*_inputs(spark, d)).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("fixes"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


ARRIVAL = ("mmsi", "dest_clean", "port_lo", "port_name", "port_lat", "port_lon", "arrival_ts", "arrival_lat", "arrival_lon", "eta", "static_ts", "detection_method")


def geofenced(window: DataFrame) -> DataFrame:
    """First slow fix within reach of the declared port, per vessel and port."""
    near = window.where((F.col("sog") <= BERTH_KN) & (geo.haversine_km("lat", "lon", "port_lat", "port_lon") <= RADIUS_KM))
    one = rel.first_by(near, ["mmsi", "port_lo"], [F.col("ts").asc(), F.col("row_id").asc(), F.col("static_ts").asc_nulls_last(), F.col("eta").asc_nulls_last(), F.col("dest_clean").asc_nulls_last()])
    return one.withColumns({"arrival_ts": F.col("ts"), "arrival_lat": F.col("lat"), "arrival_lon": F.col("lon"), "detection_method": F.lit("geofence")}).select(*ARRIVAL)


_GEO = f"""
  select mmsi, dest_clean, port_lo, port_name, port_lat, port_lon, ts as arrival_ts, lat as arrival_lat, lon as arrival_lon, eta, static_ts, 'geofence' as detection_method
  from ({_POS_ETA}) where sog <= 1.0 and {hav_sql('lat', 'lon', 'port_lat', 'port_lon')} <= 10
  qualify row_number() over (partition by mmsi, port_lo order by ts, row_id, static_ts nulls last, eta nulls last, dest_clean nulls last) = 1"""
_US = "* exclude (arrival_ts, eta, static_ts), epoch_us(arrival_ts) as arrival_us, epoch_us(eta) as eta_us, epoch_us(static_ts) as static_us"


def _us(df: DataFrame) -> DataFrame:
    """Times as microseconds, for comparison."""
    for k in ("arrival", "departure"):
        if f"{k}_ts" in df.columns:
            df = df.withColumn(f"{k}_us", F.unix_micros(f"{k}_ts")).drop(f"{k}_ts")
    return df.withColumns({"eta_us": F.unix_micros("eta"), "static_us": F.unix_micros("static_ts")}).drop("eta", "static_ts")


@CAT.add(f"select {_US} from ({_GEO})")
def geofence_arrivals(spark, d):
    return _us(geofenced(first_slow(*_inputs(spark, d))))


_NEAR = f"""
  select m.mmsi, m.port_lo, m.static_ts, p.row_id, p.ts, round({hav_sql('p.lat', 'p.lon', 'm.port_lat', 'm.port_lon')}, 6) as km
  from ({_POS_ETA}) m join {_FIX} p on p.row_id = m.row_id where m.sog <= 5.0 and {hav_sql('m.lat', 'm.lon', 'm.port_lat', 'm.port_lon')} <= 10
  qualify row_number() over (partition by m.mmsi, m.port_lo order by p.ts, p.row_id, m.static_ts nulls last, m.eta nulls last, m.dest_clean nulls last) = 1"""


def boxed_arrivals(window: DataFrame, most_kn: float = 5.0, half_deg: float = 0.2) -> DataFrame:
    """Variant of `geofenced` for model data: faster fixes count too, and a box around the port, widened with the
    latitude, is tested before the distance."""
    wide = half_deg / F.greatest(F.cos(F.radians("port_lat")), F.lit(0.01))
    across = F.abs(F.col("lon") - F.col("port_lon"))
    box = (F.abs(F.col("lat") - F.col("port_lat")) <= half_deg) & (F.least(across, 360 - across) <= wide)
    near = window.where((F.col("sog") <= most_kn) & box & (geo.haversine_km("lat", "lon", "port_lat", "port_lon") <= RADIUS_KM))
    one = rel.first_by(near, ["mmsi", "port_lo"], [F.col("ts").asc(), F.col("row_id").asc(), F.col("static_ts").asc_nulls_last(), F.col("eta").asc_nulls_last(), F.col("dest_clean").asc_nulls_last()])
    return one.withColumn("km", geo.haversine_km("lat", "lon", "port_lat", "port_lon"))


@CAT.add(f"select mmsi, port_lo, epoch_us(static_ts) as static_us, row_id, epoch_us(ts) as ts_us, km from ({_NEAR})")
def box_geofence(spark, d):
    return boxed_arrivals(first_slow(*_inputs(spark, d), 5.0)).select("mmsi", "port_lo", F.unix_micros("static_ts").alias("static_us"), "row_id", F.unix_micros("ts").alias("ts_us"), F.round("km", 6).alias("km"))


_ORDER = "ts, row_id, static_ts nulls last, eta nulls last, dest_clean nulls last, port_lo nulls last"


def stop_events(window: DataFrame) -> DataFrame:
    """Stretches of slow fixes of a vessel between fast ones, at least half an hour by the clock's minutes."""
    order = [F.col(k).asc_nulls_last() for k in ("ts", "row_id", "static_ts", "eta", "dest_clean", "port_lo")]
    grouped = rel.running(window.where("sog is not null"), ["mmsi"], "__slot", order, F.when(F.col("sog") >= SLOW_KN, 1).otherwise(0), "stop_grp")
    first = F.min_by(F.struct("lat", "lon", "eta", "static_ts", "dest_clean", "port_lo", "port_name", "port_lat", "port_lon"), F.struct("ts", "row_id", F.coalesce("static_ts", F.lit("9999-12-31").cast("timestamp")), F.coalesce("eta", F.lit("9999-12-31").cast("timestamp")), F.coalesce("dest_clean", F.lit(chr(0xFFFF))), F.coalesce("port_lo", F.lit(chr(0xFFFF)))))
    s = grouped.where(F.col("sog") < SLOW_KN).groupBy("mmsi", "stop_grp").agg(F.min("ts").alias("stop_start"), F.max("ts").alias("stop_end"), first.alias("f"))
    return s.select("mmsi", "stop_grp", "stop_start", "stop_end", timefns.boundaries_crossed("minute", "stop_start", "stop_end").alias("dur_min"), "f.*").where(F.col("dur_min") >= LEAST_MIN)


def _spans(declared: DataFrame) -> DataFrame:
    return declared.withColumns({"__lo": F.unix_micros("static_ts") - DAY, "__hi": F.unix_micros(F.coalesce("eta", "static_ts")) + 7 * DAY}).where("__lo <= __hi")


def first_slow(positions: DataFrame, declared: DataFrame, span: DataFrame, most_kn: float = BERTH_KN) -> DataFrame:
    """Of `positions_in_window` the rows that `geofenced` chooses from: the first slow fix at each vessel's declared
    port with its declarations. Windows of one vessel and place are merged before fixes meet them."""
    keys = ["mmsi", "port_lo", "port_lat", "port_lon"]
    before = Window.partitionBy(*keys).orderBy("__lo", "__hi").rowsBetween(Window.unboundedPreceding, -1)
    d = _spans(declared)
    merged = rel.islands(d.withColumn("__top", F.max("__hi").over(before)), keys, [F.col("__lo"), F.col("__hi")], F.col("__lo") > F.col("__top")).groupBy(*keys, "island").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")).drop("island")
    slow = positions.where(F.col("sog") <= most_kn)
    met = rel.interval_join(slow, merged.withColumnsRenamed({"__lo": "__a", "__hi": "__b"}), "mmsi", F.unix_micros("ts"), F.col("__a"), F.col("__b"), SLOT, span)
    near = met.drop("__a", "__b").where(geo.haversine_km("lat", "lon", "port_lat", "port_lon") <= RADIUS_KM).withColumn("__at", F.unix_micros("ts"))
    one = rel.first_by(near, keys, [F.col("ts").asc(), F.col("row_id").asc()]).withColumnsRenamed({k: f"__{k}" for k in keys[1:]})
    same = F.lit(True)
    for k in keys[1:]:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return one.join(d, "mmsi").where(same & F.col("__at").between(F.col("__lo"), F.col("__hi"))).drop("__at", "__lo", "__hi", *[f"__{k}" for k in keys[1:]])


def stop_events_of(positions: DataFrame, declared: DataFrame) -> DataFrame:
    """The rows of `stop_events(positions_in_window(positions, declared))` without a row for each fix and declaration.

    A sweep over each vessel's fixes, starts and ends of windows gives how many windows a fix lies in, by which fast
    fixes count; only the first fix of a stop meets the declarations."""
    d = _spans(declared)
    none = {k: F.lit(None).cast(t) for k, t in positions.dtypes if k != "mmsi"}
    edge = lambda at, order, by: d.select("mmsi", F.col(at).alias("__at"), F.lit(order).alias("__o"), F.lit(by).alias("__by")).withColumns(none)
    p = positions.where("sog is not null").withColumns({"__at": F.unix_micros("ts"), "__o": F.lit(1), "__by": F.lit(0)})
    every = p.unionByName(edge("__lo", 0, 1)).unionByName(edge("__hi", 2, -1))
    order = [F.col("__at"), F.col("__o"), F.col("row_id")]
    k = rel.running(every.withColumn("__slot", F.floor(F.col("__at") / SLOT)), ["mmsi"], "__slot", order, F.col("__by"), "__k")
    grouped = rel.running(k, ["mmsi"], "__slot", order, F.when((F.col("__o") == 1) & (F.col("sog") >= SLOW_KN), F.col("__k")).otherwise(0), "stop_grp").where("__o = 1 and __k > 0")
    s = grouped.where(F.col("sog") < SLOW_KN).groupBy("mmsi", "stop_grp").agg(F.min("ts").alias("stop_start"), F.max("ts").alias("stop_end"), F.min_by(F.struct("lat", "lon", "__at"), F.struct("ts", "row_id")).alias("f"))
    s = s.withColumn("dur_min", timefns.boundaries_crossed("minute", "stop_start", "stop_end")).where(F.col("dur_min") >= LEAST_MIN)
    met = s.select("mmsi", "stop_grp", "stop_start", "stop_end", "dur_min", "f.*").join(d, "mmsi").where("__at between __lo and __hi")
    one = rel.first_by(met, ["mmsi", "stop_grp"], [F.col(k).asc_nulls_last() for k in ("static_ts", "eta", "dest_clean", "port_lo")])
    return one.select("mmsi", "stop_grp", "stop_start", "stop_end", "dur_min", "lat", "lon", "eta", "static_ts", "dest_clean", "port_lo", "port_name", "port_lat", "port_lon")


_STOPS = f"""
  with g as (select *, sum(case when sog >= 0.5 then 1 else 0 end) over (partition by mmsi order by {_ORDER} rows unbounded preceding) as stop_grp from ({_POS_ETA}) where sog is not null),
  s as (select *, row_number() over (partition by mmsi, stop_grp order by {_ORDER}) as rn, min(ts) over (partition by mmsi, stop_grp) as stop_start, max(ts) over (partition by mmsi, stop_grp) as stop_end from g where sog < 0.5)
  select mmsi, stop_grp::bigint as stop_grp, stop_start, stop_end, epoch_us(stop_end) // 60000000 - epoch_us(stop_start) // 60000000 as dur_min, lat, lon, eta, static_ts, dest_clean, port_lo, port_name, port_lat, port_lon
  from s where rn = 1 and epoch_us(stop_end) // 60000000 - epoch_us(stop_start) // 60000000 >= 30"""


@CAT.add(f"select mmsi, stop_grp, epoch_us(stop_start) as start_us, epoch_us(stop_end) as end_us, dur_min, lat, lon, dest_clean, port_lo from ({_STOPS})")
def stop_islands(spark, d):
    return stop_events_of(*_inputs(spark, d, again=True)[:2]).select("mmsi", "stop_grp", F.unix_micros("stop_start").alias("start_us"), F.unix_micros("stop_end").alias("end_us"), "dur_min", "lat", "lon", "dest_clean", "port_lo")


def by_speed(stops: DataFrame) -> DataFrame:
    s = stops.where(F.unix_micros("stop_start") >= F.unix_micros("static_ts") - DAY)
    one = rel.first_by(s, ["mmsi", "dest_clean", "eta"], [F.col("stop_start").asc(), F.col("stop_grp").asc()])
    return one.withColumns({"arrival_ts": F.col("stop_start"), "arrival_lat": F.col("lat"), "arrival_lon": F.col("lon"), "detection_method": F.lit("speed")}).select(*ARRIVAL)


_SPEED = f"""
  select mmsi, dest_clean, port_lo, port_name, port_lat, port_lon, stop_start as arrival_ts, lat as arrival_lat, lon as arrival_lon, eta, static_ts, 'speed' as detection_method
  from ({_STOPS}) where stop_start >= static_ts - interval 1 day qualify row_number() over (partition by mmsi, dest_clean, eta order by stop_start, stop_grp) = 1"""


@CAT.add(f"select {_US} from ({_SPEED})")
def speed_arrivals(spark, d):
    return _us(by_speed(stop_events_of(*_inputs(spark, d, again=True)[:2])))


def arrivals(window: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    g = geofenced(window)
    return g.unionByName(by_speed(stop_events(window) if stops is None else stops).join(g.select("mmsi", "port_lo"), ["mmsi", "port_lo"], "left_anti"))


_ARRIVALS = f"select * from ({_GEO}) union all select * from ({_SPEED}) a where not exists (select 1 from ({_GEO}) g where g.mmsi = a.mmsi and g.port_lo = a.port_lo)"


@CAT.add(f"select {_US} from ({_ARRIVALS})")
def arrivals_union_anti(spark, d):
    fixed, declared, span = _inputs(spark, d, again=True)
    return _us(arrivals(first_slow(fixed, declared, span), stop_events_of(fixed, declared)))


#: Days after an arrival that are searched first for the departure; what they don't hold is searched for in all later fixes.
SOON = 4


def departures(calls: DataFrame, positions: DataFrame, span: DataFrame, strict: bool = False) -> DataFrame:
    """First fix under way beyond reach of the port after the arrival; per vessel and port, or in `strict` per call.

    Calls meet the fixes of the next days, by (vessel, quarter of a day); only those that don't end there meet all later ones, so a
    vessel's calls times its history are joined for open calls alone.
    """
    keys = ["mmsi", "port_lo", "arrival_ts"] if strict else ["mmsi", "port_lo"]
    call = ["mmsi", "port_lo", "port_lat", "port_lon", "arrival_ts"]
    moving = positions.where(F.col("sog") > BERTH_KN).select("mmsi", "ts", "lat", "lon", "row_id")
    asked = calls.select(*call).where("port_lo is not null and port_lat is not null and port_lon is not null").distinct()

    def exits(some: DataFrame, until: Column) -> DataFrame:
        met = rel.interval_join(moving, some, "mmsi", F.unix_micros("ts"), F.unix_micros("arrival_ts") + 1, until, SLOT, span)
        out = met.where(geo.haversine_km("lat", "lon", "port_lat", "port_lon") > RADIUS_KM)
        return out.groupBy(*call).agg(F.min(F.struct("ts", "row_id", "lat", "lon")).alias("f"))

    soon = settle(exits(asked, F.unix_micros("arrival_ts") + SOON * DAY))
    later = exits(asked.join(soon.select(*call), call, "left_anti"), F.lit(2**62))
    first = soon.unionByName(later).groupBy(*keys).agg(F.min("f").alias("f"))
    return first.select(*keys, F.col("f.ts").alias("departure_ts"), F.col("f.lat").alias("departure_lat"), F.col("f.lon").alias("departure_lon"))


_DEPART = f"""
  select a.mmsi, a.port_lo, p.ts as departure_ts, p.lat as departure_lat, p.lon as departure_lon
  from ({_ARRIVALS}) a join {_FIX} p on p.mmsi = a.mmsi and p.sog > 1.0 and p.ts > a.arrival_ts and {hav_sql('p.lat', 'p.lon', 'a.port_lat', 'a.port_lon')} > 10
  qualify row_number() over (partition by a.mmsi, a.port_lo order by p.ts, p.row_id) = 1"""


@CAT.add(f"select mmsi, port_lo, epoch_us(departure_ts) as departure_us, departure_lat, departure_lon from ({_DEPART})")
def departures_first_exit(spark, d):
    fixed, declared, span = _inputs(spark, d, again=True)
    got = departures(settle(arrivals(first_slow(fixed, declared, span), stop_events_of(fixed, declared))), fixed, span)
    return got.select("mmsi", "port_lo", F.unix_micros("departure_ts").alias("departure_us"), "departure_lat", "departure_lon")


def port_calls(window: DataFrame, positions: DataFrame, span: DataFrame, strict: bool = False, stops: DataFrame | None = None) -> DataFrame:
    """Arrivals with the departures after them. Arrivals are few against the fixes they come from and are used twice,
    so they are settled once."""
    calls = settle(arrivals(window, stops))
    keys = ["mmsi", "port_lo", "arrival_ts"] if strict else ["mmsi", "port_lo"]
    return calls.join(departures(calls, positions, span, strict), keys, "left").withColumn("arrival_date", F.to_date("arrival_ts"))


@CAT.add(f"select {_US}, epoch_us(departure_ts) as departure_us, (arrival_ts at time zone 'UTC')::date as arrival_date from (select a.*, d.departure_ts, d.departure_lat, d.departure_lon from ({_ARRIVALS}) a left join ({_DEPART}) d on a.mmsi = d.mmsi and a.port_lo = d.port_lo)".replace("* exclude (arrival_ts,", "* exclude (departure_ts, arrival_ts,"))
def port_calls_full(spark, d):
    """Calls over a whole history, with every eta that was declared."""
    fixed, declared, span = _inputs(spark, d, again=True)
    return _us(port_calls(first_slow(fixed, declared, span), fixed, span, stops=stop_events_of(fixed, declared)))


@CAT.add("""
  select mmsi, port_lo_code, epoch_us(arrival_ts) as arrival_us, destination_clean, detection_method, epoch_us(static_ts) as static_us, count(*) over (partition by mmsi) as calls
  from (select distinct * from arrivals_today) qualify row_number() over (partition by mmsi, port_lo_code, arrival_ts order by static_ts desc nulls last, departure_ts desc nulls last, eta desc nulls last, detection_method, arrival_lat, destination_clean) = 1""")
def port_calls_merge(spark, d):
    """Calls known from before merged with new ones: of equal calls the one declared last. `calls`: all of the vessel."""
    a = table(spark, d, "arrivals_today").distinct().withColumn("calls", F.count(F.lit(1)).over(Window.partitionBy("mmsi")))
    one = rel.first_by(a, ["mmsi", "port_lo_code", "arrival_ts"], [F.col("static_ts").desc_nulls_last(), F.col("departure_ts").desc_nulls_last(), F.col("eta").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in ("detection_method", "arrival_lat", "destination_clean")]])
    return one.select("mmsi", "port_lo_code", F.unix_micros("arrival_ts").alias("arrival_us"), "destination_clean", "detection_method", F.unix_micros("static_ts").alias("static_us"), "calls")


def congestion(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Vessels in port, arrivals and departures per port and hour, where there are any.

    A call adds one vessel at its first hour and takes it away after its last; the changes are summed by port and hour
    and run on over a port's hours, so neither a grid of ports and hours nor a row for each hour of a call is made. The
    hours end at the last departure (`strict`: the last event of any kind).
    """
    hour = lambda x: F.floor(F.unix_micros(x) / HOUR) * HOUR
    c = calls.where("port_lo_code is not null and port_lo_code <> '' and arrival_ts is not null").select("port_lo_code", "arrival_ts", "departure_ts")
    last = F.coalesce(F.max("departure_ts"), F.max("arrival_ts")) if not strict else F.greatest(F.max("departure_ts"), F.max("arrival_ts"))
    span = calls.agg(hour(F.min("arrival_ts")).alias("lo"), hour(last).alias("hi"))
    b = c.crossJoin(F.broadcast(span))  # one row
    a, dep = F.unix_micros("arrival_ts"), F.unix_micros("departure_ts")
    first, end = F.greatest(F.ceil(a / HOUR) * HOUR, F.col("lo")), F.least(F.coalesce(F.floor(dep / HOUR) * HOUR, F.col("hi")), F.col("hi"))
    change = lambda at, v, a, d, when: F.when(when, F.struct(at.cast("long").alias("hour_us"), F.lit(v).alias("v"), F.lit(a).alias("a"), F.lit(d).alias("d")))
    came, went = hour("arrival_ts"), hour("departure_ts")
    changes = F.array_compact(F.array(change(first, 1, 0, 0, first <= end), change(end + HOUR, -1, 0, 0, first <= end), change(came, 0, 1, 0, came.between(F.col("lo"), F.col("hi"))), change(went, 0, 0, 1, went.between(F.col("lo"), F.col("hi")))))
    per = b.select("port_lo_code", "hi", F.inline(changes)).groupBy("port_lo_code", "hi", "hour_us").agg(*[F.sum(k).alias(k) for k in ("v", "a", "d")])
    w = Window.partitionBy("port_lo_code").orderBy("hour_us")  # at most a row an hour
    ran = per.withColumns({"vessels_in_port": F.sum("v").over(w), "next": F.coalesce(F.lead("hour_us").over(w), F.col("hour_us") + HOUR)})
    until = F.when(F.col("vessels_in_port") > 0, F.col("next") - HOUR).otherwise(F.col("hour_us"))
    hours = ran.withColumn("at", F.explode(F.sequence("hour_us", until, F.lit(HOUR))))
    only = lambda k: F.when(F.col("at") == F.col("hour_us"), F.col(k)).otherwise(0)
    return hours.select("port_lo_code", F.col("at").alias("hour_us"), "vessels_in_port", only("a").alias("arrivals"), only("d").alias("departures"), "hi").where("hour_us <= hi and (vessels_in_port > 0 or arrivals > 0 or departures > 0)").drop("hi")


CONGESTION = """
  with bounds as (select epoch_us(min(arrival_ts)) // 3600000000 as lo, epoch_us(coalesce(max(departure_ts), max(arrival_ts))) // 3600000000 as hi from arrivals_today),
  grid as (select p.port_lo_code, h.hour * 3600000000 as hour_us from (select distinct port_lo_code from arrivals_today where port_lo_code <> '') p, (select unnest(generate_series(lo, hi)) as hour from bounds) h),
  hourly as (select g.port_lo_code, g.hour_us, count(case when epoch_us(c.arrival_ts) <= g.hour_us and (c.departure_ts is null or epoch_us(c.departure_ts) >= g.hour_us) then 1 end) as vessels_in_port,
      count(case when epoch_us(c.arrival_ts) >= g.hour_us and epoch_us(c.arrival_ts) < g.hour_us + 3600000000 then 1 end) as arrivals,
      count(case when epoch_us(c.departure_ts) >= g.hour_us and epoch_us(c.departure_ts) < g.hour_us + 3600000000 then 1 end) as departures
    from grid g left join arrivals_today c on c.port_lo_code = g.port_lo_code group by 1, 2)
  select * from hourly where vessels_in_port > 0 or arrivals > 0 or departures > 0"""


@CAT.add(CONGESTION)
def port_congestion_hourly(spark, d):
    return congestion(table(spark, d, "arrivals_today"))


@CAT.add(f"select port_lo_code, hour_us, vessels_in_port / greatest(1, max(vessels_in_port) over ())::double as level from ({CONGESTION})")
def congestion_normalised(spark, d):
    c = congestion(table(spark, d, "arrivals_today"))
    top = c.agg(F.greatest(F.lit(1), F.max("vessels_in_port")).alias("top"))
    return c.crossJoin(F.broadcast(top)).select("port_lo_code", "hour_us", (F.col("vessels_in_port") / F.col("top").cast("double")).alias("level"))


_written: dict[tuple, str] = {}


def written(spark: SparkSession, d: str, source: str, name: str, derive, order: list[str]) -> DataFrame:
    """A gold table derived from a source table and written once, sorted, so that requests read the row groups they
    need. It is derived again when the source's files change (their names, sizes or times of change)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{source}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))
    key = (spark.sparkContext.applicationId, d, source, name, state)
    if key not in _written:
        out = scratch(spark, name)
        write_sorted(derive(table(spark, d, source)), out, order)
        _written[key] = out
    return spark.read.parquet(_written[key])


QUERIES, SQL = CAT.queries, CAT.sql
