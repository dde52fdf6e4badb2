"""Interactive queries: positions now and at a time, tracks, wakes, search, ports, and what clients derive from them.

Each takes its parameters with defaults, filters partitions and columns that the scan can prune by, and sorts only
what it returns. Limits are the feature here: they bound what a client receives.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import domain, geo, text, timefns
from tidewater.operators import relational as rel
from tidewater.plans import gold
from tidewater.plans.catalogue import Catalogue
from tidewater.sources.tables import table

CAT = Catalogue()
NOW = "2016-01-10 12:00:00"
BOX = (-60.0, -180.0, 70.0, 180.0)  # south, west, north, east
LIMIT = 100_000
VIEW = ("mmsi", "ts_us", "lat", "lon", "sog", "cog", "true_heading", "navigational_status")
OF_VESSEL = ("name", "ship_type", "destination", "imo_number", "call_sign", "length", "width")
_VIEW = "p.mmsi, epoch_us(p.ts) as ts_us, p.lat, p.lon, p.sog, p.cog, p.true_heading, p.navigational_status, " + ", ".join(f"v.{c}" for c in OF_VESSEL)
_BOX = "p.lat between -60.0 and 70.0 and p.lon between -180.0 and 180.0"


def _at(t: str, seconds: int) -> str:
    return (datetime.fromisoformat(t) + timedelta(seconds=seconds)).isoformat(sep=" ")


def _between(a: str, b: str):
    return F.col("ts").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))


def _named(one: DataFrame, vessels: DataFrame, limit: int) -> DataFrame:
    v = vessels.select("mmsi", *OF_VESSEL)
    return one.withColumn("ts_us", F.unix_micros("ts")).join(v, "mmsi", "left").select(*VIEW, *OF_VESSEL).orderBy("mmsi").limit(limit)


def last_positions(positions: DataFrame, vessels: DataFrame, t: str = NOW, seconds: int = 300, box=BOX, limit: int = LIMIT) -> DataFrame:
    """Latest fix of each vessel from t on for some minutes; partitions follow the time range, across midnight too."""
    end = _at(t, seconds)
    p = positions.where(timefns.partition_filter(t, end) & _between(t, end) & geo.in_box("lat", "lon", *box))
    return _named(rel.first_by(p, ["mmsi"], [F.col("ts").desc(), F.col("pos_id").asc()]), vessels, limit)


@CAT.add(f"""
  select {_VIEW} from (select * from vessels_positions p where ts between timestamptz '{NOW}+00' and timestamptz '2016-01-10 12:05:00+00' and {_BOX}
    qualify row_number() over (partition by mmsi order by ts desc, pos_id) = 1) p left join vessels v on v.mmsi = p.mmsi""")
def q_last_positions(spark, d):
    return last_positions(table(spark, d, "vessels_positions"), table(spark, d, "vessels"))


def positions_at(positions: DataFrame, vessels: DataFrame, t: str = NOW, before: int = 180, after: int = 120, box=BOX, limit: int = LIMIT) -> DataFrame:
    """The fix of each vessel nearest to t."""
    a, b = _at(t, -before), _at(t, after)
    p = positions.where(timefns.partition_filter(a, b) & _between(a, b) & geo.in_box("lat", "lon", *box))
    away = F.abs(F.unix_micros("ts") - F.unix_micros(F.lit(t).cast("timestamp")))
    return _named(rel.nearest_by(p, ["mmsi"], away, [F.col("ts").asc(), F.col("pos_id").asc()]), vessels, limit)


@CAT.add(f"""
  select {_VIEW} from (select * from vessels_positions p where ts between timestamptz '2016-01-10 11:57:00+00' and timestamptz '2016-01-10 12:02:00+00' and {_BOX}
    qualify row_number() over (partition by mmsi order by abs(epoch_us(ts) - epoch_us(timestamptz '{NOW}+00')), ts, pos_id) = 1) p left join vessels v on v.mmsi = p.mmsi""")
def q_positions_at_time(spark, d):
    return positions_at(table(spark, d, "vessels_positions"), table(spark, d, "vessels"))


HOT = 189000001


def history(tracks: DataFrame, mmsi: int = HOT, end: str = NOW, days: int = 3, limit: int = 1000) -> DataFrame:
    """A vessel's track of some days, decoded, oldest first."""
    start = _at(end, -86400 * days)
    s = lambda t: F.unix_timestamp(F.lit(t).cast("timestamp"))
    p = tracks.where((F.col("mmsi") == mmsi) & F.col("date").between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")) & F.col("ts").between(s(start), s(end))).where("lat is not null and lon is not null")
    return p.orderBy("ts").limit(limit).select((F.col("lat") / 1e5).alias("lat"), (F.col("lon") / 1e5).alias("lon"), F.col("ts").cast("long").alias("ts_s"), "heading")


@CAT.add(f"""
  select lat / 1e5 as lat, lon / 1e5 as lon, ts::bigint as ts_s, heading from ({gold.TRACKS}) where mmsi = {HOT} and lat is not null and lon is not null
  and ts between epoch(timestamptz '2016-01-07 12:00:00+00') and epoch(timestamptz '{NOW}+00') order by ts limit 1000""")
def q_vessel_history(spark, d):
    """Reads the tracks as they were written, in order of vessel and time; the first request after a change writes them."""
    return history(gold.written(spark, d, "messages", "tracks", gold.tracks, ["mmsi", "ts"]))


def wake(positions: DataFrame, mmsis: list[int], start: str, end: str, limit: int = LIMIT) -> DataFrame:
    """Fixes of some vessels in a time range, in order."""
    p = positions.where(F.col("mmsi").isin(mmsis) & timefns.partition_filter(start, end) & _between(start, end)).where("lat is not null and lon is not null")
    return p.orderBy("mmsi", "ts", "pos_id").limit(limit).select("mmsi", "pos_id", F.unix_micros("ts").alias("ts_us"), "lat", "lon", "sog", "cog")


@CAT.add(f"""
  select mmsi, pos_id, epoch_us(ts) as ts_us, lat, lon, sog, cog from vessels_positions where mmsi in ({HOT}, 190000009, 190000013)
  and ts between timestamptz '2016-01-10 06:00:00+00' and timestamptz '{NOW}+00' and lat is not null and lon is not null order by mmsi, ts, pos_id limit {LIMIT}""")
def q_vessel_wake(spark, d):
    return wake(table(spark, d, "vessels_positions"), [HOT, 190000009, 190000013], "2016-01-10 06:00:00", NOW)


_CLASS = "case when ship_type between 30 and 39 then 'fishing' when ship_type between 60 and 69 then 'passenger' when ship_type between 70 and 79 then 'cargo' when ship_type between 80 and 89 then 'tanker' else 'pleasure' end"


def search(vessels: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Vessels whose name or number contains the text; blank text finds nothing."""
    q = query.strip()
    hit = text.contains("name", q) | F.col("mmsi").cast("string").contains(q) if q else F.lit(False)
    return vessels.where(hit).select("mmsi", F.coalesce("name", F.lit("Unknown")).alias("name"), domain.ship_class("ship_type").alias("category")).orderBy("name", "mmsi").limit(limit)


@CAT.add(f"select mmsi, coalesce(name, 'Unknown') as name, {_CLASS} as category from vessels where name ilike '%os%' or mmsi::varchar like '%os%' order by coalesce(name, 'Unknown'), mmsi limit 15")
def q_search_vessels(spark, d):
    return search(table(spark, d, "vessels"), "os")


DATE = "2016-01-10"


def congestion_on(hours: DataFrame, calls: DataFrame, date: str = DATE) -> DataFrame:
    """Each port's latest hour of a day, with the port's attributes; one row a port."""
    day = timefns.UNIT_US["day"]
    start = F.unix_micros(F.lit(date).cast("timestamp"))
    ports = calls.where("port_lat is not null and port_lon is not null").groupBy("port_lo_code").agg(F.min(F.struct("port_name", "port_lat", "port_lon")).alias("p"))
    one = rel.first_by(hours.where((F.col("hour_us") >= start) & (F.col("hour_us") < start + day)), ["port_lo_code"], [F.col("hour_us").desc()])
    return one.join(ports, "port_lo_code").select("port_lo_code", "hour_us", "vessels_in_port", "arrivals", "departures", "p.port_name", "p.port_lat", "p.port_lon")


@CAT.add(f"""
  with c as ({gold.CONGESTION}), p as (select port_lo_code, min(struct_pack(port_name := port_name, port_lat := port_lat, port_lon := port_lon)) as p from arrivals_today where port_lat is not null and port_lon is not null group by 1)
  select c.*, p.p.port_name as port_name, p.p.port_lat as port_lat, p.p.port_lon as port_lon from c join p on p.port_lo_code = c.port_lo_code
  where hour_us >= epoch_us(timestamptz '{DATE} 00:00:00+00') and hour_us < epoch_us(timestamptz '{DATE} 00:00:00+00') + 86400000000
  qualify row_number() over (partition by c.port_lo_code order by hour_us desc) = 1""")
def q_port_congestion_latest(spark, d):
    hours = gold.written(spark, d, "arrivals_today", "congestion", gold.congestion, ["hour_us", "port_lo_code"])
    return congestion_on(hours, table(spark, d, "arrivals_today"))


def calls_at(calls: DataFrame, port: str, date: str | None = None, limit: int = 50) -> DataFrame:
    """Calls at a port, of a day (ISO date or date-time) or of all; the newest first."""
    c = calls.where(F.col("port_lo_code") == port)
    if date:
        c = c.where(F.col("arrival_date") == F.lit(date[:10]).cast("date"))
    keep = c.select("mmsi", "destination_clean", "port_lo_code", "port_name", "port_lat", "port_lon", F.unix_micros("arrival_ts").alias("arrival_us"), F.unix_micros("departure_ts").alias("departure_us"), "arrival_lat", "arrival_lon", "detection_method", "arrival_date")
    return keep.orderBy(F.col("arrival_us").desc_nulls_last(), "mmsi", F.col("departure_us").asc_nulls_last(), "destination_clean").limit(limit)


@CAT.add("""
  select mmsi, destination_clean, port_lo_code, port_name, port_lat, port_lon, epoch_us(arrival_ts) as arrival_us, epoch_us(departure_ts) as departure_us, arrival_lat, arrival_lon, detection_method, arrival_date
  from arrivals_today where port_lo_code = 'XDOWR' order by arrival_us desc nulls last, mmsi, departure_us nulls last, destination_clean limit 50""")
def q_port_calls(spark, d):
    return calls_at(table(spark, d, "arrivals_today"), "XDOWR")


@CAT.add(f"select {_CLASS} as category, count(*) as vessels, max(sog) as fastest from (select p.mmsi, max(p.sog) as sog, any_value(v.ship_type) as ship_type from vessels_positions p left join vessels v on v.mmsi = p.mmsi group by 1) group by 1")
def category_counts(spark, d):
    """Vessels seen and the highest speed sent, by category."""
    seen = table(spark, d, "vessels_positions").groupBy("mmsi").agg(F.max("sog").alias("sog"))
    v = table(spark, d, "vessels").select("mmsi", "ship_type")
    return seen.join(v, "mmsi", "left").groupBy(domain.ship_class("ship_type").alias("category")).agg(F.count(F.lit(1)).alias("vessels"), F.max("sog").alias("fastest"))


def sidebar(rows: DataFrame, categories: tuple[str, ...] = ("cargo", "tanker", "fishing"), slowest: float = 0.0, fastest: float = 30.0, query: str = "", sort: str = "speed") -> DataFrame:
    """The client's list: some categories, a range of speeds, a text; by speed, name or type."""
    p = rows.where(F.col("category").isin(*categories) & F.coalesce("sog", F.lit(0.0)).between(slowest, fastest))
    if query.strip():
        p = p.where(text.contains("name", query) | F.col("mmsi").cast("string").contains(query))
    order = {"speed": [F.col("sog").desc_nulls_last()], "name": [F.col("name").asc_nulls_last()], "type": [F.col("category").asc()]}[sort]
    return p.orderBy(*order, "mmsi")


_LATEST = "select * from vessels_positions qualify row_number() over (partition by mmsi order by ts desc, pos_id) = 1"


@CAT.add(f"""
  select p.mmsi, coalesce(v.name, 'Unknown') as name, {_CLASS} as category, p.sog, coalesce(p.true_heading::double, p.cog, 0.0) as heading
  from ({_LATEST}) p left join vessels v on v.mmsi = p.mmsi where {_CLASS} in ('cargo', 'tanker', 'fishing') and coalesce(p.sog, 0) between 0 and 30""")
def q_sidebar(spark, d):
    one = rel.first_by(table(spark, d, "vessels_positions"), ["mmsi"], [F.col("ts").desc(), F.col("pos_id").asc()])
    v = table(spark, d, "vessels").select("mmsi", "name", "ship_type")
    view = one.join(v, "mmsi", "left").select("mmsi", F.coalesce("name", F.lit("Unknown")).alias("name"), domain.ship_class("ship_type").alias("category"), "sog", F.coalesce(F.col("true_heading").cast("double"), "cog", F.lit(0.0)).alias("heading"))
    return sidebar(view)


def ticks(positions: DataFrame, step_s: int = 3600, before_s: int = 180, after_s: int = 120) -> DataFrame:
    """Replay: at each step of the clock the nearest fix of every vessel. A fix finds its steps by arithmetic, no join."""
    t, step, us = F.unix_micros("ts"), step_s * 1_000_000, 1_000_000
    first, last = F.ceil((t - after_s * us) / step) * step, F.floor((t + before_s * us) / step) * step
    near = positions.where((first <= last) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("tick_us", F.explode(F.sequence(first, last, F.lit(step))))
    return rel.nearest_by(near, ["tick_us", "mmsi"], F.abs(F.unix_micros("ts") - F.col("tick_us")), [F.col("ts").asc(), F.col("pos_id").asc()])


@CAT.add("""
  select tick_us, mmsi, pos_id, lat, lon from (select *, ((epoch_us(ts) + 180000000) // 3600000000) * 3600000000 as tick_us from vessels_positions where lat is not null and lon is not null)
  where epoch_us(ts) - 120000000 <= tick_us qualify row_number() over (partition by tick_us, mmsi order by abs(epoch_us(ts) - tick_us), ts, pos_id) = 1""")
def timeline_ticks(spark, d):
    return ticks(table(spark, d, "vessels_positions")).select("tick_us", "mmsi", "pos_id", "lat", "lon")


#: Boxes (south, north, west, east) over which layouts are compared. Fixed values.
BOXES = (
    ("English Channel", 49.5, 51.5, -5.0, 2.0),
    ("Strait of Gibraltar", 35.5, 36.5, -6.0, -5.0),
    ("Singapore Strait", 1.0, 1.5, 103.5, 104.5),
    ("North Sea", 51.0, 56.0, 0.0, 7.0),
    ("West Mediterranean", 35.0, 42.0, -5.0, 15.0),
    ("Panama Canal", 8.5, 9.5, -80.0, -79.0),
    ("Suez Canal", 29.5, 31.5, 32.0, 33.0),
    ("Malacca Strait", 1.0, 4.0, 100.0, 104.0),
    ("Global view", -60.0, 70.0, -180.0, 180.0),
)


@CAT.add("select 'SW' as box, count(*) filter (where lat between -90 and 0 and lon between -180 and 0) as n from vessels_positions union all " + " union all ".join(f"select '{n}', count(*) filter (where lat between {s} and {no} and lon between {w} and {e}) from vessels_positions" for n, s, no, w, e in BOXES))
def bbox_counts(spark, d):
    """Fixes in each of some boxes, in one pass and without a join."""
    boxes = (("SW", -90, 0, -180, 0), *BOXES)
    one = table(spark, d, "vessels_positions").agg(*[F.count_if(geo.in_box("lat", "lon", s, w, n, e)).alias(f"b{k}") for k, (_, s, n, w, e) in enumerate(boxes)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b[0]).alias("box"), F.col(f"b{k}").alias("n")) for k, b in enumerate(boxes)])).alias("x")).select("x.*")


@CAT.add("select floor(lat * 10)::bigint * 100000 + floor(lon * 10)::bigint as cell, count(*) as n from vessels_positions where lat is not null and lon is not null group by 1")
def grid_cell_counts(spark, d):
    return table(spark, d, "vessels_positions").where("lat is not null and lon is not null").groupBy(geo.grid_cell("lat", "lon").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@CAT.add(f"""
  with p as (select mmsi, ts, pos_id, lat, lon, true_heading, lead(lat) over w as la, lead(lon) over w as lo from vessels_positions where abs(lat) <= 90 and abs(lon) <= 180 window w as (partition by mmsi order by ts, pos_id))
  select pos_id, round(coalesce(case when true_heading < 360 then true_heading::double end, case when la is not null then
    (degrees(atan2(sin(radians(lo - lon)) * cos(radians(la)), cos(radians(lat)) * sin(radians(la)) - sin(radians(lat)) * cos(radians(la)) * cos(radians(lo - lon)))) + 360) % 360 end), 6) as heading from p""")
def heading_to_next(spark, d):
    """A fix's heading, or where it is unknown the course to the next fix."""
    own = ["mmsi", "__day"]
    p = table(spark, d, "vessels_positions").where("abs(lat) <= 90 and abs(lon) <= 180").withColumn("__day", F.floor(F.unix_micros("ts") / timefns.UNIT_US["day"]))
    place = F.struct("lat", "lon")
    # a day's last fix goes on to the first of the vessel's next day with any: one row a vessel and day is carried
    starts = p.groupBy(*own).agg(F.min_by(place, F.struct("ts", "pos_id")).alias("first"))
    later = starts.withColumn("later", F.lead("first").over(W.partitionBy("mmsi").orderBy("__day"))).drop("first")
    p = p.withColumn("next", F.lead(place).over(W.partitionBy(*own).orderBy("ts", "pos_id"))).join(later, own, "left").withColumn("next", F.coalesce("next", "later"))
    p = p.withColumns({"la": F.col("next.lat"), "lo": F.col("next.lon")})
    return p.select("pos_id", F.round(F.coalesce(domain.known_heading("true_heading").cast("double"), geo.bearing_deg("lat", "lon", "la", "lo")), 6).alias("heading"))


_NAV = "case navigational_status " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(domain.NAV_LABELS)) + " else case when navigational_status is null then 'Unknown' else 'Unknown (' || navigational_status || ')' end end"
_LABEL = "case when ship_type is null then 'Unknown' " + " ".join(f"when ship_type between {a} and {b} then '{n}'" for a, b, n in domain.SHIP_LABELS) + " else 'Other (' || ship_type || ')' end"


@CAT.add(f"select {_NAV} as nav, {_LABEL} as ship, count(*) as n from messages group by all")
def code_labels(spark, d):
    return table(spark, d, "messages").groupBy(domain.nav_label("navigational_status").alias("nav"), domain.ship_label("ship_type").alias("ship")).agg(F.count(F.lit(1)).alias("n"))


@CAT.add(f"""
  select mmsi, round(coalesce(sog, 0) * 0.514444 * abs(epoch_us(ts) - epoch_us(timestamptz '{NOW}+00')) / 1e6, 3) as radius_m from ({_LATEST})""")
def reckoning_radius(spark, d):
    """How far each vessel may be from its latest fix at a time."""
    one = rel.first_by(table(spark, d, "vessels_positions"), ["mmsi"], [F.col("ts").desc(), F.col("pos_id").asc()])
    away = (F.unix_micros("ts") - F.unix_micros(F.lit(NOW).cast("timestamp"))) / 1e6
    return one.select("mmsi", F.round(geo.reckoning_radius_m(F.coalesce("sog", F.lit(0.0)), away), 3).alias("radius_m"))


@CAT.add(f"""
  select p.mmsi, 'Feature' as kind, p.lon, p.lat, round(coalesce(p.sog, 0), 1) as speed, coalesce(v.name, 'Unknown') as name, {_CLASS} as category from ({_LATEST}) p left join vessels v on v.mmsi = p.mmsi""")
def feature_rows(spark, d):
    """Rows of the map's feature collection."""
    one = rel.first_by(table(spark, d, "vessels_positions"), ["mmsi"], [F.col("ts").desc(), F.col("pos_id").asc()])
    v = table(spark, d, "vessels").select("mmsi", "name", "ship_type")
    return one.join(v, "mmsi", "left").select("mmsi", F.lit("Feature").alias("kind"), "lon", "lat", F.round(F.coalesce("sog", F.lit(0.0)), 1).alias("speed"), F.coalesce("name", F.lit("Unknown")).alias("name"), domain.ship_class("ship_type").alias("category"))


@CAT.add(f"""
  select p.mmsi, json_object('type', 'Feature', 'geometry', json_object('type', 'Point', 'coordinates', json_array(p.lon, p.lat)), 'properties', json_object('speed', round(coalesce(p.sog, 0), 1), 'name', coalesce(v.name, 'Unknown'), 'category', {_CLASS}))::varchar as feature
  from ({_LATEST}) p left join vessels v on v.mmsi = p.mmsi""")
def geojson_features(spark, d):
    """The same as GeoJSON text."""
    f = feature_rows(spark, d)
    return f.select("mmsi", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("speed", "name", "category").alias("properties"))).alias("feature"))


@CAT.add("select mmsi, name from vessels order by name nulls last, mmsi limit 10 offset 10")
def vessel_page(spark, d):
    """Second page of ten."""
    return table(spark, d, "vessels").orderBy(F.col("name").asc_nulls_last(), "mmsi").offset(10).limit(10).select("mmsi", "name")


QUERIES, SQL = CAT.queries, CAT.sql
