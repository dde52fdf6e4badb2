"""Queries of the general training-data problems, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import compaction, exactly_once, implausible, known_at, late_counts, nearby, trips
from tidewater.session import scratch
from tidewater.sources.tables import table

KNOWN_FIELDS = {
    "max_static_draught": "message_type = 'ShipStaticData' and max_static_draught is not null and max_static_draught <> 0",
    "eta": "message_type = 'ShipStaticData' and eta is not null",
}


def _known(spark: SparkSession, d: str) -> DataFrame:
    return known_at.attributes_known_at(
        table(spark, d, "matched_decl"),
        table(spark, d, "messages").where("message_type = 'ShipStaticData'"),
        entity="mmsi",
        at="static_ts",
        event_id="decl_id",
        valid_from="ts",
        received="received_at",
        fact_id="row_id",
        fields={k: F.expr(v) for k, v in KNOWN_FIELDS.items()},
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select(F.col("event_id").alias("decl_id"), "field", F.col("fact_id").alias("row_id"))


def p1_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Each declaration with the values known at its time, null where none was."""
    values = table(spark, d, "messages").where("message_type = 'ShipStaticData'").select(F.col("row_id").alias("fact_id"), "max_static_draught", "eta")
    got = _known(spark, d).join(values, "fact_id").groupBy("event_id").agg(F.max(F.when(F.col("field") == "max_static_draught", F.col("max_static_draught"))).alias("draught_known"), F.max(F.when(F.col("field") == "eta", F.unix_micros("eta"))).alias("eta_known_us"))
    return table(spark, d, "matched_decl").select("decl_id", "mmsi").join(got.withColumnRenamed("event_id", "decl_id"), "decl_id", "left")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Compacts the landing zone into the shared folder; the lines that the published manifest sets aside."""
    out = scratch(spark, "landing")
    compaction.compact(table(spark, d, "raw_files"), out)
    return compaction.set_aside(spark, out)


def p2_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the published output files hold in all."""
    out = scratch(spark, "landing")
    compaction.compact(table(spark, d, "raw_files"), out)
    return compaction.current_manifest(spark, out).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "kept", "surplus", "unreadable", "blank", "lines")])


def _numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return late_counts.numbered(late_counts.staged(table(spark, d, "messages"), event_time="ts", received="received_at", source="source_listener", row_id="row_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that came after their hour's end, judged by their number against the merged counters."""
    rows, state = _numbered(spark, d)
    return late_counts.judged(rows, late_counts.merge(state)).where("outcome <> 'on_time'").select("row_id", "outcome")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per hour the count at its end and after the last correction."""
    return late_counts.period_counts(_numbered(spark, d)[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible.flag_readings(table(spark, d, "vessels_positions"), source="mmsi", event_time="ts", row_id="pos_id").select(F.col("row_id").alias("pos_id"), "field")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearby.within_distance(table(spark, d, "vessels_positions"), table(spark, d, "arrivals_today"), km=10.0, point=("pos_id", "lat", "lon"), target=("port_lo_code", "port_lat", "port_lon"))
    return near.select(F.col("point_id").alias("pos_id"), F.col("target_id").alias("port_lo_code")).distinct()


def _harbours(spark: SparkSession, d: str) -> DataFrame:
    """An octagonal region around each port of the day's arrivals, 0.08 degrees from its centre to a corner."""
    port = table(spark, d, "arrivals_today").where("port_lo_code is not null and port_lat is not null and port_lon is not null").select("port_lo_code", "port_lat", "port_lon").distinct()
    corner = [(1.0, 0.0), (0.7, 0.7), (0.0, 1.0), (-0.7, 0.7), (-1.0, 0.0), (-0.7, -0.7), (0.0, -1.0), (0.7, -0.7)]
    return port.select("port_lo_code", F.array(*[F.struct((F.col("port_lon") + 0.08 * x).alias("lon"), (F.col("port_lat") + 0.08 * y).alias("lat")) for x, y in corner]).alias("ring"))


def p5_regions(spark: SparkSession, d: str) -> DataFrame:
    """Fixes inside each harbour region."""
    hits = nearby.in_regions(table(spark, d, "vessels_positions"), _harbours(spark, d), point=("pos_id", "lat", "lon"), region=("port_lo_code", "ring"))
    return hits.select(F.col("point_id").alias("pos_id"), F.col("region_id").alias("port_lo_code")).distinct()


def _stops(spark: SparkSession, d: str) -> DataFrame:
    return trips.stops_and_trips(table(spark, d, "vessels_positions"), source="mmsi", event_time="ts", lat="lat", lon="lon", speed="sog")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _stops(spark, d).select(F.col("source").alias("mmsi"), "kind", "start_us", "end_us")


def p6_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips with duration and distance."""
    return _stops(spark, d).select(F.col("source").alias("mmsi"), "kind", "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 3.6e9).alias("hours"), "distance_km", "lat", "lon")


def _sorted_out(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return exactly_once.accept(table(spark, d, "messages"), producer=["mmsi", "message_type"], event_time="ts", received="received_at", row_id="row_id", kinds=(kind,))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose number the seen ranges (or, off the grid, the seen keys) cover already."""
    return _sorted_out(spark, d, "surplus").select("row_id")


def p7_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The one row of each identified message that stays."""
    return _sorted_out(spark, d, "accepted").select("row_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p2_found, p2_manifest, p3_found, p3_counts, p4_found, p5_found, p5_regions, p6_found, p6_trips, p7_found, p7_accepted)}

_P1 = """
  select d.decl_id, f.field, f.row_id
  from matched_decl d join (
    select 'max_static_draught' as field, row_id, mmsi, ts, received_at from messages
    where message_type = 'ShipStaticData' and max_static_draught is not null and max_static_draught <> 0
    union all
    select 'eta', row_id, mmsi, ts, received_at from messages where message_type = 'ShipStaticData' and eta is not null
  ) f on f.mmsi = d.mmsi and f.ts <= d.static_ts and f.received_at <= d.static_ts
  qualify row_number() over (partition by d.decl_id, f.field order by f.ts desc, f.received_at, f.row_id) = 1"""
#: Lines of the landing zone; a JSON value's key is the list of its nodes' paths, kinds and values, in order of the paths.
_LINES = r"""
  l as (select file_id, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1))::int as line_no from raw_files where body is not null and file_id is not null),
  p as (select file_id, line_no, rtrim(line, chr(13))::json as j from l where json_valid(rtrim(line, chr(13)))),
  k as (select file_id, line_no, (select string_agg(fullkey || chr(31) || case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'n' || (atom::double)::varchar when type = 'VARCHAR' then 's' || (atom ->> '$')
        else type || coalesce(atom::varchar, '') end, chr(30) order by fullkey) from json_tree(j)) as k from p)"""
_HOUR = "(epoch_us(ts) - ((epoch_us(ts) % 3600000000) + 3600000000) % 3600000000)"
_DUPES = "row_number() over (partition by mmsi, ts, message_type order by received_at nulls last, row_id)"
_RING = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate([(1.0, 0.0), (0.7, 0.7), (0.0, 1.0), (-0.7, 0.7), (-1.0, 0.0), (-0.7, -0.7), (0.0, -1.0), (0.7, -0.7)]))

_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
#: Stops by the definition: from each slow ping the pings that it reaches, then a walk from stretch to stretch.
_P6 = f"""
  with recursive one as (select mmsi, ts, lat, lon, sog from vessels_positions where mmsi is not null and ts is not null qualify row_number() over (partition by mmsi, ts order by lat nulls first, lon nulls first, sog nulls first) = 1),
  silent as (select *, row_number() over w as i, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over w > 7200000000 then 1 else 0 end as cut from one window w as (partition by mmsi order by ts)),
  ping as (select *, sum(cut) over (partition by mmsi order by i) as part, coalesce(sog >= 0 and sog < 0.5 and abs(lat) <= 90 and abs(lon) <= 180, false) as good from silent),
  fit as (select a.mmsi, a.part, a.i, a.t, b.i as j, b.t as tj, b.lat, b.lon, b.i - lag(b.i) over (partition by a.mmsi, a.i order by b.i) as step
          from ping a join ping b on b.mmsi = a.mmsi and b.part = a.part and b.i >= a.i and a.good and b.good and {_HAV.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} <= 1),
  whole as (select *, max(case when step > 3 then 1 else 0 end) over (partition by mmsi, i order by j) as over from fit),
  reach as (select mmsi, part, i, any_value(t) as t, max(j) as last, max(tj) as until, median(lat) as lat, median(lon) as lon from whole where over = 0 group by 1, 2, 3),
  hop as (select *, case when until - t >= 1800000000 then last else i end as past from reach),
  jump as (select h.mmsi, h.i, min(n.i) as next from hop h join hop n on n.mmsi = h.mmsi and n.part = h.part and n.i > h.past group by 1, 2),
  walk as (select mmsi, min(i) as i from hop group by mmsi, part union all select j.mmsi, j.next from walk w join jump j on j.mmsi = w.mmsi and j.i = w.i),
  stop as (select h.mmsi, h.t, h.until, h.lat, h.lon from walk w join hop h on h.mmsi = w.mmsi and h.i = w.i where h.until - h.t >= 1800000000),
  pair as (select *, lead(t) over w as nt, lead(lat) over w as nlat, lead(lon) over w as nlon from stop window w as (partition by mmsi order by t))
  select mmsi, 'stop' as kind, t as start_us, until as end_us from stop
  union all select mmsi, 'trip', until, nt from pair where nt is not null and {_HAV.format(a='lat', b='lon', c='nlat', d='nlon')} > 2"""

SQL = {
    "p1_found": _P1,
    "p1_attributes": f"""
      with found as ({_P1})
      select d.decl_id, d.mmsi, any_value(m.max_static_draught) filter (where f.field = 'max_static_draught') as draught_known,
             any_value(epoch_us(m.eta)) filter (where f.field = 'eta') as eta_known_us
      from matched_decl d left join found f on f.decl_id = d.decl_id left join messages m on m.row_id = f.row_id
      group by 1, 2""",
    "p2_found": f"with {_LINES} select file_id, line_no from k qualify row_number() over (partition by k order by file_id, line_no) > 1",
    "p2_manifest": f"""
      with {_LINES}, n as (select count(distinct k) as kept, count(*) as parsed from k),
      t as (select count(*) as lines, count(*) filter (where regexp_full_match(line, '\\s*')) as blank, count(distinct file_id) as files from l)
      select files, kept, parsed - kept as surplus, lines - blank - parsed as unreadable, blank, lines from n, t""",
    "p3_found": f"""
      select row_id, case when epoch_us(received_at) < {_HOUR} + 7 * 3600000000 then 'correction' else 'too_late' end as outcome
      from messages where ts is not null and epoch_us(received_at) >= {_HOUR} + 3600000000""",
    "p3_counts": f"""
      select {_HOUR} as period_us, count(*) filter (where epoch_us(received_at) < {_HOUR} + 3600000000) as n_at_end, count(*) as n_final
      from messages where ts is not null and epoch_us(received_at) < {_HOUR} + 7 * 3600000000 group by 1""",
    "p5_found": """
      select distinct p.pos_id, a.port_lo_code
      from vessels_positions p join (select distinct port_lo_code, port_lat, port_lon from arrivals_today) a
        on p.lat between -90 and 90 and p.lon between -180 and 180
       and 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(a.port_lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(a.port_lat)) * pow(sin(radians(a.port_lon - p.lon) / 2), 2)))) <= 10
      where a.port_lo_code is not null""",
    "p5_regions": f"""
      with ports as (select distinct port_lo_code, port_lat, port_lon from arrivals_today where port_lo_code is not null and port_lat is not null and port_lon is not null),
      corner(k, x, y) as (values {_RING}),
      edge as (select p.port_lo_code, p.port_lat, p.port_lon, p.port_lon + 0.08 * a.x as x1, p.port_lat + 0.08 * a.y as y1, p.port_lon + 0.08 * b.x as x2, p.port_lat + 0.08 * b.y as y2
               from ports p, corner a join corner b on b.k = (a.k + 1) % 8)
      select distinct pos_id, port_lo_code from (
        select v.pos_id, e.port_lo_code, e.port_lat, e.port_lon
        from vessels_positions v join edge e on v.lat >= least(e.y1, e.y2) and v.lat < greatest(e.y1, e.y2) and v.lon < e.x1 + (v.lat - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)
        where v.lat between -90 and 90 and v.lon between -180 and 180
        group by all having count(*) % 2 = 1)""",
    "p6_found": _P6,
    "p7_found": f"select row_id from (select row_id, {_DUPES} as n from messages where mmsi is not null and ts is not null and message_type is not null) where n > 1",
    "p7_accepted": f"select row_id from (select row_id, {_DUPES} as n from messages where mmsi is not null and ts is not null and message_type is not null) where n = 1",
}
