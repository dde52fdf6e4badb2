"""Features for time-to-arrival models: rolling speeds, samples at horizons, six-hour behaviour, ports, routes, sequences.

Averages and deviations of readings with a fixed resolution are taken over whole numbers of that resolution, so they
come out the same whatever the order in which partitions are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import domain, geo, timefns
from tidewater.functions.arrow import Columns, over_groups
from tidewater.operators import known_at as pit
from tidewater.operators import relational as rel
from tidewater.plans import gold
from tidewater.plans.catalogue import Catalogue
from tidewater.session import settle
from tidewater.sources.tables import table

CAT = Catalogue()
H = 3600
MIN = 60_000_000


def whole(x: str | Column, scale: int = 10) -> Column:
    return F.round(geo.c(x) * scale).cast("long")


def exact_avg(x, over=None, scale: int = 10) -> Column:
    w = whole(x, scale)
    s, n = F.sum(w), F.count(w)
    return (s.over(over) / float(scale) / n.over(over)) if over is not None else F.sum(w) / float(scale) / F.count(w)


def exact_std(x, over=None, scale: int = 10) -> Column:
    """Sample deviation; null for fewer than two readings. Exact sums, one root."""
    w = whole(x, scale)
    s, q, n = (f.over(over) if over is not None else f for f in (F.sum(w), F.sum(w * w), F.count(w)))
    return F.when(n > 1, F.sqrt((n * q - s * s).cast("double") / (n * (n - 1)).cast("double")) / scale)


def _avg(x: str, over: str = "", scale: int = 10) -> str:
    return f"(sum(round({x} * {scale})::bigint) {over})::double / {float(scale)} / count({x}) {over}"


def _std(x: str, over: str = "", scale: int = 10) -> str:
    w = f"round({x} * {scale})::bigint"
    return f"case when count({x}) {over} > 1 then sqrt((count({x}) {over} * (sum({w} * {w}) {over}) - (sum({w}) {over}) * (sum({w}) {over}))::double / (count({x}) {over} * (count({x}) {over} - 1))::double) / {scale} end"


def pings(p: DataFrame) -> DataFrame:
    """Fixes with a speed and a place, one for each vessel and time."""
    keep = p.where("mmsi is not null and ts is not null and sog between 0 and 102.2 and abs(lat) <= 90 and abs(lon) <= 180").select("pos_id", "mmsi", "ts", "lat", "lon", "sog", "cog", "true_heading", "rate_of_turn", "navigational_status")
    return rel.first_by(keep, ["mmsi", "ts"], [F.col("pos_id").asc()]).withColumn("eu", F.unix_micros("ts"))


PINGS = "(select pos_id, mmsi, ts, lat, lon, sog, cog, true_heading, rate_of_turn, navigational_status, epoch_us(ts) as eu from vessels_positions where mmsi is not null and ts is not null and sog between 0 and 102.2 and abs(lat) <= 90 and abs(lon) <= 180 qualify row_number() over (partition by mmsi, ts order by pos_id) = 1)"


def back(seconds: int, to: int = 0):
    """The vessel's fixes from some seconds ago until now, or until `to` seconds ago."""
    return W.partitionBy("mmsi").orderBy("eu").rangeBetween(-seconds * 1_000_000, -to * 1_000_000)


def _back(seconds: int, to: str = "current row") -> str:
    return f"over (partition by mmsi order by eu range between {seconds}000000 preceding and {to})"


def half_up(x: Column, digits: int) -> Column:
    """Rounded by plain arithmetic, the same in any engine."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {float(10**digits)}"


WEEK = 7 * 24 * H * 1_000_000


def rolling(p: DataFrame) -> DataFrame:
    """(pos_id, mmsi, ...): mean speeds of the last 1, 6 and 24 hours, the trend of the last hour, heading statistics.

    Groups are (vessel, week), a week with the day before it, so a vessel with many fixes is spread. Within a group every
    window is a difference of running sums of whole numbers, found by the window's first fix: a sliding frame would add
    up each window anew, which is the square of a vessel's rate of sending.
    """
    import numpy as np

    hour = H * 1_000_000
    hd = whole(domain.known_heading("true_heading"), 1)
    narrow = p.select("pos_id", "mmsi", "eu", whole("sog").alias("sog10"), "sog", hd.alias("hd"), F.coalesce(F.col("true_heading").cast("double"), F.lit(-1.0)).alias("own_heading"))

    def run(c: Columns) -> dict | None:
        t = c["eu"]
        keep = np.flatnonzero(t // WEEK == int(c["__block"][0]))
        if not len(keep):
            return None
        known = np.asarray(c["hd"], float)
        there = ~np.isnan(known)
        run_up = lambda x: np.r_[0, np.cumsum(x)].astype(np.int64)
        v = np.where(there, known, 0).astype(np.int64)
        sog, one, head, heads, square = (run_up(x) for x in (c["sog10"].astype(np.int64), np.ones(len(t), np.int64), v, there, v * v))

        def over(sums: np.ndarray, seconds: int, to: int = 0) -> np.ndarray:
            now = t[keep]
            return sums[np.searchsorted(t, now - to * 1_000_000, "right")] - sums[np.searchsorted(t, now - seconds * 1_000_000)]

        def mean(s: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
            return np.where(n > 0, s / scale / np.maximum(n, 1), np.nan)

        n, s, q = over(heads, H), over(head, H), over(square, H)
        before = mean(over(sog, H, 1), over(one, H, 1), 10.0)
        deviation = np.where(n > 1, np.sqrt(np.maximum(n * q - s * s, 0) / np.maximum(n * (n - 1), 1)), 0.0)
        average = mean(s, n, 1.0)
        out = {f"avg_sog_{h}h": mean(over(sog, h * H), over(one, h * H), 10.0) for h in (1, 6, 24)}
        out |= {"sog_trend_1h": np.where(np.isnan(before), 0.0, c["sog"][keep] - before), "heading_std_1h": deviation, "avg_heading_1h": np.where(np.isnan(average), c["own_heading"][keep], average)}
        return {"pos_id": c["pos_id"][keep], "mmsi": c["mmsi"][keep], **out}

    columns = ("avg_sog_1h", "avg_sog_6h", "avg_sog_24h", "sog_trend_1h", "heading_std_1h", "avg_heading_1h")
    return over_groups(rel.haloed(narrow, "eu", WEEK, 24 * hour), ["mmsi", "__block"], ["eu"], run, "pos_id long, mmsi long, " + ", ".join(f"{k} double" for k in columns))


def with_own_average(p: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` with their vessel's mean speed over all of `p`; partial aggregation, one row a vessel joins."""
    return rows.join(p.groupBy("mmsi").agg(exact_avg("sog").alias("mmsi_avg_sog")), "mmsi")


_HD = "case when true_heading < 360 then true_heading end"
_ROLL = f"""
  select *, {_avg('sog', _back(3600))} as avg_sog_1h, {_avg('sog', _back(21600))} as avg_sog_6h, {_avg('sog', _back(86400))} as avg_sog_24h,
    coalesce(sog - case when count(sog) {_back(3600, '1000000 preceding')} > 0 then {_avg('sog', _back(3600, '1000000 preceding'))} end, 0.0) as sog_trend_1h,
    {_avg('sog', 'over (partition by mmsi)')} as mmsi_avg_sog from {PINGS}"""


@CAT.add(f"select pos_id, avg_sog_1h, avg_sog_6h, avg_sog_24h, sog_trend_1h, mmsi_avg_sog from ({_ROLL})")
def rolling_sog(spark, d):
    p = pings(table(spark, d, "vessels_positions"))
    return with_own_average(p, rolling(p)).select("pos_id", "avg_sog_1h", "avg_sog_6h", "avg_sog_24h", "sog_trend_1h", "mmsi_avg_sog")


@CAT.add(f"select pos_id, coalesce({_std('hd', _back(3600), 1)}, 0.0) as heading_std_1h, coalesce(case when count(hd) {_back(3600)} > 0 then {_avg('hd', _back(3600), 1)} end, true_heading::double, -1.0) as avg_heading_1h from (select *, {_HD} as hd from {PINGS})")
def heading_stats(spark, d):
    return rolling(pings(table(spark, d, "vessels_positions"))).select("pos_id", "heading_std_1h", "avg_heading_1h")


def known_arrivals(a: DataFrame) -> DataFrame:
    return a.where("mmsi is not null and arrival_ts is not null and port_lat is not null and port_lon is not null").select("mmsi", "port_lo_code", "arrival_ts", "port_lat", "port_lon").distinct()


_ARR = "(select distinct mmsi, port_lo_code, arrival_ts, port_lat, port_lon from arrivals_today where mmsi is not null and arrival_ts is not null and port_lat is not null and port_lon is not null)"


def horizon_samples(p: DataFrame, arrivals: DataFrame) -> DataFrame:
    """For each arrival and horizon the fix nearest to that many hours before it, within five minutes.

    An arrival has one narrow window for each horizon, so a fix only meets the arrivals it is a sample of, instead of
    all in the week after it.
    """
    windows = arrivals.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in domain.HORIZONS])))
    target = F.unix_micros("arrival_ts") - (F.col("horizon") * 3.6e9).cast("long")
    pairs = rel.interval_join(p, windows, "mmsi", F.unix_micros("ts"), target - 5 * MIN - 1_000_000, target + 5 * MIN + 1_000_000, width_us=10 * MIN)
    each = pairs.withColumn("tta_s", timefns.boundaries_crossed("second", "ts", "arrival_ts")).where(F.abs(F.col("tta_s") - F.col("horizon") * 3600) <= 300)
    before = F.unix_micros("arrival_ts") - F.unix_micros("ts")
    each = each.where((before >= 5 * MIN) & (before <= 7 * 24 * 60 * MIN))
    one = rel.nearest_by(each, ["mmsi", "arrival_ts", "port_lo_code", "port_lat", "port_lon", "horizon"], F.abs(F.col("tta_s") - F.col("horizon") * 3600), [F.col("ts").asc(), F.col("pos_id").asc()])
    return one.withColumn("tta_h", F.col("tta_s") / 3600).withColumn("dist_km", F.round(geo.haversine_km("lat", "lon", "port_lat", "port_lon"), 3))


_SAMPLES = f"""
  select *, tta_s / 3600 as tta_h, round({gold.hav_sql('lat', 'lon', 'port_lat', 'port_lon')}, 3) as dist_km from (
    select p.*, a.* exclude (mmsi), epoch_us(a.arrival_ts) // 1000000 - epoch_us(p.ts) // 1000000 as tta_s from {PINGS} p join {_ARR} a on a.mmsi = p.mmsi and p.ts >= a.arrival_ts - interval 7 day and p.ts <= a.arrival_ts - interval 5 minute)
  join (select unnest([0.5, 1, 2, 3, 6, 12, 24, 48, 72, 120, 168])::double as horizon) h on abs(tta_s - horizon * 3600) <= 300
  qualify row_number() over (partition by mmsi, arrival_ts, port_lo_code, port_lat, port_lon, horizon order by abs(tta_s - horizon * 3600), ts, pos_id) = 1"""


def _samples(spark, d) -> DataFrame:
    return horizon_samples(pings(table(spark, d, "vessels_positions")), known_arrivals(table(spark, d, "arrivals_today")))


KEY = ("mmsi", "port_lo_code", "arrival_us", "horizon")
_KEY = "mmsi, port_lo_code, epoch_us(arrival_ts) as arrival_us, horizon"


def keyed(df: DataFrame, *more) -> DataFrame:
    return df.withColumn("arrival_us", F.unix_micros("arrival_ts")).select(*KEY, *more)


@CAT.add(f"select {_KEY}, pos_id, tta_h, dist_km from ({_SAMPLES})")
def horizon_sampling(spark, d):
    return keyed(_samples(spark, d), "pos_id", "tta_h", "dist_km")


def approach(s: DataFrame) -> DataFrame:
    """Speed over ground towards the port since the sample before, in km/h, and its ratio to that sample's speed."""
    w = W.partitionBy("mmsi", "arrival_ts", "port_lo_code", "port_lat", "port_lon").orderBy("ts", "horizon")
    gone, hours = F.lag("dist_km").over(w) - F.col("dist_km"), (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 3.6e9
    before = F.lag("sog").over(w)
    s = s.withColumn("closing_kmh", F.coalesce(half_up(gone / F.greatest(hours, F.lit(0.01)), 2), F.lit(0.0))).withColumn("__before", before)
    return s.withColumn("efficiency", F.when(F.col("__before") > 0.5, half_up(F.col("closing_kmh") / F.col("__before"), 3)).otherwise(0.0)).drop("__before")


_APPROACH = f"""
  select *, case when before > 0.5 then {_half_up('closing_kmh / before', 3)} else 0.0 end as efficiency from (
    select *, coalesce({_half_up('(lag(dist_km) over w - dist_km) / greatest((epoch_us(ts) - lag(epoch_us(ts)) over w) / 3.6e9, 0.01)', 2)}, 0.0) as closing_kmh, lag(sog) over w as before
    from ({_SAMPLES}) window w as (partition by mmsi, arrival_ts, port_lo_code, port_lat, port_lon order by ts, horizon))"""


@CAT.add(f"select {_KEY}, closing_kmh, efficiency from ({_APPROACH})")
def closing_speed(spark, d):
    return keyed(approach(_samples(spark, d)), "closing_kmh", "efficiency")


@CAT.add(f"""
  select {_KEY}, round(abs(b - cog) - 2 * greatest(abs(b - cog) - 180, 0), 3) as bearing_offset_deg, case when true_heading < 360 then round(abs(cog - true_heading) - 2 * greatest(abs(cog - true_heading) - 180, 0), 3) else -1 end as heading_offset_deg,
    case when rate_of_turn is null or rate_of_turn = -128 then 0 else rate_of_turn end as rot, (rate_of_turn is not null and rate_of_turn <> -128)::int as rot_available, coalesce(navigational_status, -1) as nav
  from (select *, (degrees(atan2(sin(radians(port_lon - lon)) * cos(radians(port_lat)), cos(radians(lat)) * sin(radians(port_lat)) - sin(radians(lat)) * cos(radians(port_lat)) * cos(radians(port_lon - lon)))) + 360) % 360 as b from ({_SAMPLES}))""")
def course_offsets(spark, d):
    """Angles between course, heading and the bearing of the port; sentinels of the turn rate and status."""
    s = _samples(spark, d).withColumn("b", geo.bearing_deg("lat", "lon", "port_lat", "port_lon"))
    turning = F.col("rate_of_turn").isNotNull() & (F.col("rate_of_turn") != -128)
    return keyed(s, F.round(geo.folded("b", "cog"), 3).alias("bearing_offset_deg"), F.when(F.col("true_heading") < 360, F.round(geo.folded("cog", F.col("true_heading").cast("double")), 3)).otherwise(-1.0).alias("heading_offset_deg"), F.when(turning, F.col("rate_of_turn")).otherwise(0).alias("rot"), turning.cast("int").alias("rot_available"), F.coalesce("navigational_status", F.lit(-1)).alias("nav"))


def six_hours(samples: DataFrame, p: DataFrame) -> DataFrame:
    """Behaviour over the six hours up to each sample, the sample included."""
    s = samples.select("mmsi", "port_lo_code", "arrival_ts", "port_lat", "port_lon", "horizon", F.col("ts").alias("sample_ts"))
    q = p.select("mmsi", "ts", "eu", "sog", "cog", "true_heading")
    j = rel.interval_join(q, s, "mmsi", F.unix_micros("ts"), F.unix_micros("sample_ts") - 360 * MIN, F.unix_micros("sample_ts"), width_us=360 * MIN)
    key = ["mmsi", "port_lo_code", "arrival_ts", "port_lat", "port_lon", "horizon"]
    turn = F.abs(whole("cog") - F.lag(whole("cog")).over(W.partitionBy(*key).orderBy("ts")))
    j = j.withColumn("turn", turn)
    span = (F.max("eu") - F.min("eu")) / 3.6e9
    return j.groupBy(*key).agg(
        (F.sum((F.col("sog") < 1).cast("int")) / F.count("sog")).alias("stop_fraction_6h"),
        (F.sum((F.col("sog") < 2).cast("int")) / F.count("sog")).alias("slow_fraction_6h"),
        exact_std("cog").alias("cog_std_6h"),
        (F.max("sog") - F.min("sog")).alias("sog_range_6h"),
        F.count(F.lit(1)).alias("n_positions_6h"),
        F.min_by("sog", "ts").alias("sog_6h_ago"),
        F.median("sog").alias("median_sog_6h"),
        F.count_if((F.col("turn") > 300) & (F.col("turn") < 1800)).alias("n_sharp_turns_6h"),
        span.alias("window_span_h"),
    )


_SIX = f"""
  with s as (select mmsi, port_lo_code, arrival_ts, port_lat, port_lon, horizon, ts as sample_ts from ({_SAMPLES})),
  j as (select s.*, q.ts, q.eu, q.sog, q.cog, abs(round(q.cog * 10)::bigint - lag(round(q.cog * 10)::bigint) over (partition by s.mmsi, s.port_lo_code, s.arrival_ts, s.port_lat, s.port_lon, s.horizon order by q.ts)) as turn
    from s join {PINGS} q on q.mmsi = s.mmsi and q.ts >= s.sample_ts - interval 6 hour and q.ts <= s.sample_ts)
  select mmsi, port_lo_code, arrival_ts, port_lat, port_lon, horizon, sum((sog < 1)::int)::double / count(sog) as stop_fraction_6h, sum((sog < 2)::int)::double / count(sog) as slow_fraction_6h,
    {_std('cog')} as cog_std_6h, max(sog) - min(sog) as sog_range_6h, count(*) as n_positions_6h, arg_min(sog, ts) as sog_6h_ago, median(sog) as median_sog_6h, count(*) filter (where turn > 300 and turn < 1800) as n_sharp_turns_6h, (max(eu) - min(eu)) / 3.6e9 as window_span_h
  from j group by all"""
SIX = ("stop_fraction_6h", "slow_fraction_6h", "cog_std_6h", "sog_range_6h", "n_positions_6h", "sog_6h_ago", "median_sog_6h", "n_sharp_turns_6h", "window_span_h")


@CAT.add(f"select {_KEY}, {', '.join(SIX)}, case when window_span_h > 0.5 then n_sharp_turns_6h / window_span_h else 0.0 end as turn_rate_6h from ({_SIX})")
def trajectory_agg_6h(spark, d):
    t = six_hours(_samples(spark, d), pings(table(spark, d, "vessels_positions")))
    return keyed(t, *SIX, F.when(F.col("window_span_h") > 0.5, F.col("n_sharp_turns_6h") / F.col("window_span_h")).otherwise(0.0).alias("turn_rate_6h"))


@CAT.add(f"""
  select p.pos_id, s.row_id, s.max_static_draught as draught from {PINGS} p join (select row_id, mmsi, ts, max_static_draught from messages where message_type = 'ShipStaticData' and ts is not null and max_static_draught > 0 and max_static_draught < 30) s
    on s.mmsi = p.mmsi and s.ts <= p.ts qualify row_number() over (partition by p.pos_id order by s.ts desc, s.row_id) = 1""")
def asof_static(spark, d):
    """Each fix with the draught last declared before it: the point-in-time join, declarations known when made."""
    p = pings(table(spark, d, "vessels_positions"))
    m = table(spark, d, "messages").where("message_type = 'ShipStaticData'")
    got = pit.attributes_known_at(p, m, entity="mmsi", at="ts", event_id="pos_id", valid_from="ts", received="ts", fact_id="row_id", fields={"draught": F.expr("max_static_draught > 0 and max_static_draught < 30")})
    return got.select(F.col("event_id").alias("pos_id"), F.col("fact_id").alias("row_id")).join(m.select("row_id", F.col("max_static_draught").alias("draught")), "row_id").select("pos_id", "row_id", "draught")


@CAT.add("select mmsi, ship_type, coalesce(length, median(length) over (partition by ship_type), (select median(length) from vessels)) as length_filled, coalesce(nullif(imo_number, 0), -1) as imo_filled from vessels")
def median_fill(spark, d):
    """Missing lengths from the median of the ship type, else of all."""
    v = table(spark, d, "vessels")
    by_type = v.groupBy("ship_type").agg(F.median("length").alias("__t"))
    every = v.agg(F.median("length").alias("__a"))
    j = v.join(by_type.withColumnRenamed("ship_type", "__k"), F.col("ship_type").eqNullSafe(F.col("__k")), "left").crossJoin(F.broadcast(every))  # one row
    return j.select("mmsi", "ship_type", F.coalesce("length", "__t", "__a").alias("length_filled"), F.coalesce(F.nullif("imo_number", F.lit(0)), F.lit(-1)).alias("imo_filled"))


@CAT.add(f"""
  with s as ({_SAMPLES}), p as (select port_lo_code, count(*) as n, sum(tta_s)::double / 3600 / count(*) as avg_tta, {_avg('sog')} as avg_sog, count(distinct arrival_ts) as arrivals, greatest((epoch_us(max(arrival_ts)) - epoch_us(min(arrival_ts))) / 3.6e9, 1) as span_h from s where port_lo_code <> '' group by 1)
  select port_lo_code, n, avg_tta, avg_sog, arrivals / span_h as arrival_rate, (select max(n) from p) as busiest from p""")
def port_stats(spark, d):
    s = _samples(spark, d).where("port_lo_code <> ''")
    span = F.greatest((F.unix_micros(F.max("arrival_ts")) - F.unix_micros(F.min("arrival_ts"))) / 3.6e9, F.lit(1.0))
    p = s.groupBy("port_lo_code").agg(F.count(F.lit(1)).alias("n"), (F.sum("tta_s").cast("double") / 3600 / F.count(F.lit(1))).alias("avg_tta"), exact_avg("sog").alias("avg_sog"), (F.countDistinct("arrival_ts") / span).alias("arrival_rate"))
    return p.crossJoin(F.broadcast(p.agg(F.max("n").alias("busiest"))))  # one row


@CAT.add(f"select mmsi, count(*) as n, {_std('sog')} as sog_std, median(sog) as median_sog, case when sum(sog) > 0 then ({_std('sog')}) / ({_avg('sog')}) end as sog_cv from {PINGS} group by 1")
def mmsi_stats(spark, d):
    p = pings(table(spark, d, "vessels_positions"))
    return p.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), exact_std("sog").alias("sog_std"), F.median("sog").alias("median_sog"), F.when(F.sum("sog") > 0, exact_std("sog") / exact_avg("sog")).alias("sog_cv"))


_EDGES = domain.DISTANCE_EDGES
_BUCKET = "case " + " ".join(f"when dist_km >= {a} and dist_km < {b} then {k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + " else -1 end"


def route_stats(s: DataFrame, least: int = 5) -> DataFrame:
    b = s.withColumn("bucket", domain.bucket_of("dist_km"))
    return b.groupBy("port_lo_code", "bucket").agg(F.count(F.lit(1)).alias("n"), F.median("tta_h").alias("median_tta"), (F.sum("tta_s").cast("double") / 3600 / F.count(F.lit(1))).alias("avg_tta"), F.median("sog").alias("median_sog")).where(F.col("n") >= least)


_ROUTE = f"select port_lo_code, {_BUCKET} as bucket, count(*) as n, median(tta_h) as median_tta, sum(tta_s)::double / 3600 / count(*) as avg_tta, median(sog) as median_sog from ({_SAMPLES}) group by 1, 2"


@CAT.add(f"{_ROUTE} having count(*) >= 5")
def route_buckets(spark, d):
    return route_stats(_samples(spark, d))


@CAT.add(f"""
  with s as (select *, {_BUCKET} as bucket from ({_SAMPLES})), r as ({_ROUTE} having count(*) >= 5),
  g as (select bucket, median(tta_h) as g_tta from s group by 1), m as (select mmsi, port_lo_code, count(*) as n, median(tta_h) as m_tta from s group by 1, 2 having count(*) >= 3)
  select s.mmsi, s.port_lo_code, epoch_us(s.arrival_ts) as arrival_us, s.horizon, coalesce(r.median_tta / nullif(g.g_tta, 0), 1.0) as port_route_efficiency, coalesce(m.m_tta / nullif(r.median_tta, 0), 1.0) as mmsi_port_tta_ratio
  from s left join r on r.port_lo_code = s.port_lo_code and r.bucket = s.bucket left join g on g.bucket = s.bucket left join m on m.mmsi = s.mmsi and m.port_lo_code = s.port_lo_code""")
def route_star_join(spark, d):
    """Samples with statistics of the port and distance, the distance, and the vessel at the port."""
    s = settle(_samples(spark, d).withColumn("bucket", domain.bucket_of("dist_km")))  # used four times
    g = s.groupBy("bucket").agg(F.median("tta_h").alias("g_tta"))
    m = s.groupBy("mmsi", "port_lo_code").agg(F.count(F.lit(1)).alias("n"), F.median("tta_h").alias("m_tta")).where("n >= 3").drop("n")
    j = s.join(route_stats(s).select("port_lo_code", "bucket", "median_tta"), ["port_lo_code", "bucket"], "left").join(g, "bucket", "left").join(m, ["mmsi", "port_lo_code"], "left")
    return keyed(j, F.coalesce(F.col("median_tta") / F.nullif(F.col("g_tta"), F.lit(0.0)), F.lit(1.0)).alias("port_route_efficiency"), F.coalesce(F.col("m_tta") / F.nullif(F.col("median_tta"), F.lit(0.0)), F.lit(1.0)).alias("mmsi_port_tta_ratio"))


# sequences

SNAP = 24 * 60 * MIN


def _windowed(spark, d, hours: int) -> DataFrame:
    """Fixes of the hours before each arrival."""
    return rel.interval_join(pings(table(spark, d, "vessels_positions")), known_arrivals(table(spark, d, "arrivals_today")), "mmsi", F.unix_micros("ts"), F.unix_micros("arrival_ts") - hours * 60 * MIN, F.unix_micros("arrival_ts"), width_us=SNAP)


ARR = ("mmsi", "port_lo_code", "arrival_ts", "port_lat", "port_lon")


def _in_window(hours: int) -> str:
    return f"(select p.*, a.* exclude (mmsi) from {PINGS} p join {_ARR} a on a.mmsi = p.mmsi and p.ts >= a.arrival_ts - interval {hours} hour and p.ts <= a.arrival_ts)"


_W = "partition by mmsi, port_lo_code, arrival_ts, port_lat, port_lon"


def last_n(df: DataFrame, n: int = 50) -> DataFrame:
    """The last n fixes before each arrival, numbered in order of time, with the step since the one before."""
    kept = rel.first_by(df, list(ARR), [F.col("ts").desc(), F.col("pos_id").desc()], n)
    w = W.partitionBy(*ARR).orderBy("ts", "pos_id")
    dt = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 3.6e9
    km = F.round(geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), 3)
    dv = (whole("sog") - F.lag(whole("sog")).over(w)) / 10.0
    return kept.withColumns({"pos_idx": F.row_number().over(w) - 1, "dt_h": F.coalesce(dt, F.lit(0.0)), "d_km": F.coalesce(km, F.lit(0.0)), "accel": F.when(dt > 0, dv / dt).otherwise(0.0)})


_LAST = f"""
  select *, row_number() over w - 1 as pos_idx, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over w) / 3.6e9, 0.0) as dt_h, case when lag(lat) over w is null then 0.0 else round({gold.hav_sql('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')}, 3) end as d_km,
    case when (epoch_us(ts) - lag(epoch_us(ts)) over w) / 3.6e9 > 0 then ((round(sog * 10)::bigint - lag(round(sog * 10)::bigint) over w) / 10.0) / ((epoch_us(ts) - lag(epoch_us(ts)) over w) / 3.6e9) else 0.0 end as accel
  from (select * from {_in_window(24)} qualify row_number() over ({_W} order by ts desc, pos_id desc) <= 50) window w as ({_W} order by ts, pos_id)"""


@CAT.add(f"select mmsi, port_lo_code, epoch_us(arrival_ts) as arrival_us, pos_id, pos_idx, dt_h, d_km, accel from ({_LAST})".replace("row_number() over w - 1 as pos_idx", "(row_number() over w - 1)::integer as pos_idx"))
def sequence_last_n(spark, d):
    s = last_n(_windowed(spark, d, 24))
    return s.select("mmsi", "port_lo_code", F.unix_micros("arrival_ts").alias("arrival_us"), "pos_id", "pos_idx", "dt_h", "d_km", "accel")


def strided(df: DataFrame, n: int = 100) -> DataFrame:
    """Each window thinned to n steps: the newest fix of each of n equal parts."""
    w = W.partitionBy(*ARR).orderBy(F.col("ts").desc(), F.col("pos_id").desc())
    b = df.withColumn("__part", F.ntile(n).over(w))
    return rel.first_by(b, [*ARR, "__part"], [F.col("ts").desc(), F.col("pos_id").desc()]).withColumn("part", F.col("__part")).drop("__part")


@CAT.add(f"""
  select mmsi, port_lo_code, epoch_us(arrival_ts) as arrival_us, part::integer as part, pos_id from (select *, ntile(100) over ({_W} order by ts desc, pos_id desc) as part from {_in_window(168)})
  qualify row_number() over ({_W}, part order by ts desc, pos_id desc) = 1""")
def sequence_ntile(spark, d):
    return strided(_windowed(spark, d, 168)).select("mmsi", "port_lo_code", F.unix_micros("arrival_ts").alias("arrival_us"), "part", "pos_id")


def arrays(seq: DataFrame, columns: list[str], n: int) -> DataFrame:
    """One array of n steps for each window, padded with zeros behind; `length` is the number of true steps."""
    step = F.struct("pos_idx", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    g = seq.groupBy(*ARR).agg(F.slice(F.array_sort(F.collect_list(step)), 1, n).alias("s"))  # at most n steps a window
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), F.lit(n) - F.size("s"))
    return g.select(*ARR, F.size("s").alias("length"), F.concat(F.transform("s", lambda e: e["x"]), pad).alias("steps"))


@CAT.add(f"select mmsi, port_lo_code, epoch_us(arrival_ts) as arrival_us, least(count(*), 50)::integer as length, round(sum(sog), 4) as sog_total, round(max(d_km), 3) as longest from ({_LAST}) group by mmsi, port_lo_code, arrival_ts, port_lat, port_lon")
def sequence_arrays(spark, d):
    """Padded arrays of the last 50 steps; checked by their length and by sums over the array."""
    a = arrays(last_n(_windowed(spark, d, 24)), ["sog", "d_km"], 50)
    total = F.aggregate("steps", F.lit(0.0), lambda x, s: x + s[0])
    return a.select("mmsi", "port_lo_code", F.unix_micros("arrival_ts").alias("arrival_us"), "length", F.round(total, 4).alias("sog_total"), F.round(F.aggregate("steps", F.lit(0.0), lambda x, s: F.greatest(x, s[1])), 3).alias("longest"))


# samples to model inputs

_U = "(ts at time zone 'UTC')"


@CAT.add(f"select pos_id, extract(hour from {_U})::integer as hour, extract(dow from {_U})::integer as dow, round(sin(2 * pi() * extract(hour from {_U}) / 24), 6) as hour_sin, round(cos(2 * pi() * extract(hour from {_U}) / 24), 6) as hour_cos, round(sin(radians(cog)), 6) as cog_sin from {PINGS}")
def cyclic_time(spark, d):
    p = pings(table(spark, d, "vessels_positions"))
    return p.select("pos_id", F.hour("ts").alias("hour"), timefns.sunday_zero("ts").alias("dow"), F.round(F.sin(2 * F.pi() * F.hour("ts") / 24), 6).alias("hour_sin"), F.round(F.cos(2 * F.pi() * F.hour("ts") / 24), 6).alias("hour_cos"), F.round(F.sin(F.radians("cog")), 6).alias("cog_sin"))


@CAT.add(f"""
  select {_KEY}, {_half_up('dist_km / greatest(sog, 1)', 2)} as eta_naive_h, {_half_up('case when closing_kmh > 1 then dist_km / closing_kmh else dist_km / greatest(sog, 1) end', 2)} as eta_closing_h, round(ln(1 + tta_h), 9) as log_tta, tta_h / greatest({_half_up('dist_km / greatest(sog, 1)', 2)}, 0.05) as tta_ratio
  from ({_APPROACH}) where dist_km > 0 and dist_km < 20000 and tta_h > 0 and tta_h < 200 and sog > 0 and sog < 50""")
def eta_baselines(spark, d):
    """Naive times to arrival (distance in km over speed in knots, as the models were fed) and targets."""
    s = approach(_samples(spark, d)).where("dist_km > 0 and dist_km < 20000 and tta_h > 0 and tta_h < 200 and sog > 0 and sog < 50")
    slow = F.greatest("sog", F.lit(1.0))
    naive = half_up(F.col("dist_km") / slow, 2)
    return keyed(s, naive.alias("eta_naive_h"), half_up(F.when(F.col("closing_kmh") > 1, F.col("dist_km") / F.col("closing_kmh")).otherwise(F.col("dist_km") / slow), 2).alias("eta_closing_h"), F.round(F.log1p("tta_h"), 9).alias("log_tta"), (F.col("tta_h") / F.greatest(naive, F.lit(0.05))).alias("tta_ratio"))


@CAT.add(f"select {_KEY}, dist_km * closing_kmh as dist_closing, round(efficiency * ln(1 + dist_km), 9) as eff_logdist, (sog < 0.5 and dist_km > 10 and dist_km < 80)::int as anchored from ({_APPROACH})")
def interaction_features(spark, d):
    s = approach(_samples(spark, d))
    return keyed(s, (F.col("dist_km") * F.col("closing_kmh")).alias("dist_closing"), F.round(F.col("efficiency") * F.log1p("dist_km"), 9).alias("eff_logdist"), ((F.col("sog") < 0.5) & (F.col("dist_km") > 10) & (F.col("dist_km") < 80)).cast("int").alias("anchored"))


_BIN = "case when tta_h < 1 then 0 when tta_h < 6 then 1 when tta_h < 24 then 2 when tta_h < 72 then 3 when tta_h < 200 then 4 end"


def journeys(arrivals: DataFrame, positions: DataFrame, days: int = 10) -> DataFrame:
    """Each arrival with the vessel's first fix in the days before it: when, where, and hours from there to the arrival.
    Arrivals without one stay, with nulls."""
    keys = ["mmsi", "port_lo_code", "arrival_ts", "port_lat", "port_lon"]
    a = arrivals.where("port_lo_code is not null and port_lo_code <> ''").select(*keys).distinct()
    p = positions.where("mmsi is not null and ts is not null").select("mmsi", "ts", "lat", "lon", "pos_id")
    to, day = F.unix_micros("arrival_ts"), 24 * H * 1_000_000
    met = rel.interval_join(p, a.where("mmsi is not null"), "mmsi", F.unix_micros("ts"), to - days * day, to, day, gold.span_of(p))
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__{k}") for k in keys]  # null places are places
    first = met.groupBy(*own).agg(F.min_by(F.struct("ts", "lat", "lon"), F.struct("ts", "pos_id")).alias("f"))
    joined = a.select("*", *own).join(first, [f"__{k}" for k in keys], "left")
    return joined.select(*keys, F.col("f.ts").alias("first_ts"), ((F.unix_micros("arrival_ts") - F.unix_micros("f.ts")) / 3.6e9).alias("journey_tta_h"), F.col("f.lat").alias("origin_lat"), F.col("f.lon").alias("origin_lon"))


@CAT.add("""
  select mmsi, port_lo_code, epoch_us(arrival_ts) as arrival_us, port_lat, port_lon, epoch_us(min(ts)) as first_us, (epoch_us(arrival_ts) - epoch_us(min(ts))) / 3.6e9::double as journey_tta_h, first(lat order by ts, pos_id) as origin_lat, first(lon order by ts, pos_id) as origin_lon
  from arrivals_today a left join (select mmsi as m, ts, lat, lon, pos_id from vessels_positions) p on a.mmsi = p.m and p.ts >= a.arrival_ts - interval 10 day and p.ts <= a.arrival_ts
  where port_lo_code is not null and port_lo_code <> '' group by mmsi, port_lo_code, arrival_ts, port_lat, port_lon""")
def arrival_journeys(spark, d):
    j = journeys(table(spark, d, "arrivals_today"), table(spark, d, "vessels_positions"))
    return j.withColumns({"arrival_us": F.unix_micros("arrival_ts"), "first_us": F.unix_micros("first_ts")}).drop("arrival_ts", "first_ts")


def metrics(s: DataFrame, truth: str, guess: Column, bins: Column) -> DataFrame:
    """Errors of a prediction clipped to [0.05, 200] hours, per bin: means over thousandths of an hour."""
    e = s.withColumn("__g", F.round(F.greatest(F.lit(0.05), F.least(F.lit(200.0), guess)), 3)).withColumn("__e", F.round((F.col("__g") - F.col(truth)) * 1000).cast("long")).withColumn("bin", bins)
    return e.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.abs("__e")) / 1000.0 / F.count(F.lit(1))).alias("mae"), F.sqrt(F.sum(F.col("__e") * F.col("__e")).cast("double") / F.count(F.lit(1))).alias("rmse_ms"), (F.sum((F.abs("__e") <= 1000).cast("int")) / F.count(F.lit(1))).alias("within_1h"))


@CAT.add(f"""
  with e as (select {_BIN} as bin, round((round(greatest(0.05, least(200.0, dist_km / greatest(sog, 1) / 1.852)), 3) - tta_h) * 1000)::bigint as e from ({_SAMPLES}))
  select bin, count(*) as n, sum(abs(e))::double / 1000.0 / count(*) as mae, sqrt(sum(e * e)::double / count(*)) as rmse_ms, sum((abs(e) <= 1000)::int)::double / count(*) as within_1h from e group by 1""")
def error_metrics_by_horizon(spark, d):
    return metrics(_samples(spark, d), "tta_h", F.col("dist_km") / F.greatest("sog", F.lit(1.0)) / 1.852, domain.horizon_bin("tta_h"))


WITHIN = (0.5, 1, 2, 6, 12, 24)


def overall_metrics(s: DataFrame, truth: str, guess: Column) -> DataFrame:
    """Errors of a prediction clipped to [0.05, 200] hours over all samples: mean and root mean square, R2, and the parts
    within some hours; over thousandths of an hour."""
    g = F.round(F.greatest(F.lit(0.05), F.least(F.lit(200.0), guess)), 3)
    e = s.select(F.round((g - F.col(truth)) * 1000).cast("long").alias("e"), F.round(F.col(truth) * 1000).cast("long").alias("y"))
    n, wide = F.count(F.lit(1)), lambda x: F.sum((x * x).cast("decimal(38,0)"))
    spread = (n * wide(F.col("y")) - F.sum(F.col("y").cast("decimal(38,0)")) * F.sum("y")).cast("double") / n
    return e.agg(
        n.alias("n"),
        (F.sum(F.abs("e")) / 1000.0 / n).alias("mae"),
        (F.sqrt(wide(F.col("e")).cast("double") / n) / 1000.0).alias("rmse"),
        (1 - wide(F.col("e")).cast("double") / spread).alias("r2"),
        *[(F.count_if(F.abs("e") <= int(h * 1000)) / n).alias(f"within_{int(h * 60)}m") for h in WITHIN],
    )


_WITHIN = ", ".join(f"count(*) filter (where abs(e) <= {int(h * 1000)})::double / count(*) as within_{int(h * 60)}m" for h in WITHIN)


@CAT.add(f"""
  with e as (select round((round(greatest(0.05, least(200.0, dist_km / greatest(sog, 1) / 1.852)), 3) - tta_h) * 1000)::hugeint as e, round(tta_h * 1000)::hugeint as y from ({_SAMPLES}))
  select count(*) as n, sum(abs(e))::double / 1000.0 / count(*) as mae, sqrt(sum(e * e)::double / count(*)) / 1000.0 as rmse, 1 - sum(e * e)::double / ((count(*) * sum(y * y) - sum(y) * sum(y))::double / count(*)) as r2, {_WITHIN} from e""")
def error_metrics_overall(spark, d):
    return overall_metrics(_samples(spark, d), "tta_h", F.col("dist_km") / F.greatest("sog", F.lit(1.0)) / 1.852)


def onehot(df: DataFrame, column: str, least: int) -> DataFrame:
    """`df` with a column of 0 and 1 for each value that at least `least` rows have, in order of the values, and one for
    all others and nulls where there are any.

    The columns follow from the data, one small aggregation: a code has few values.
    """
    v = F.coalesce(F.col(column).cast("long"), F.lit(-1))
    counts = {r[0]: r[1] for r in df.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = sorted(k for k, n in counts.items() if n >= least)
    cols = {f"{column}_{k}": (v == k).cast("int") for k in top}
    if set(counts) - set(top):
        cols[f"{column}_other"] = (~v.isin(top)).cast("int") if top else F.lit(1)
    return df.withColumns(cols)


@CAT.add("""
  with v as (select mmsi, coalesce(ship_type, -1) as v from vessels), t as (select v from v group by 1 having count(*) >= 2)
  select mmsi, 'ship_type_' || t.v as feature, (v.v = t.v)::int as value from v, t
  union all select mmsi, 'ship_type_other', (v not in (select v from t))::int from v where exists (select 1 from v x where x.v not in (select v from t))""")
def onehot_topk(spark, d):
    """Frequent ship types as columns, the rest together; given by name, as the columns depend on the data."""
    wide = onehot(table(spark, d, "vessels").select("mmsi", "ship_type"), "ship_type", 2)
    names = [c for c in wide.columns if c.startswith("ship_type_")]
    return wide.select("mmsi", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names])).alias("x")).select("mmsi", "x.feature", "x.value")


def fold(key: str, n: int) -> Column:
    """A group's fold, by a multiplicative hash of its number: all rows of a vessel fall into one."""
    return F.pmod(F.shiftright(geo.c(key) * 2654435761, 7), F.lit(n)).cast("int")


@CAT.add(f"select mmsi, ((mmsi * 2654435761) >> 7) % 100 < 80 as train, (((mmsi * 2654435761) >> 7) % 5)::integer as fold, count(*) as n from {PINGS} group by 1")
def grouped_split(spark, d):
    """80:20 and five folds, by vessel."""
    return pings(table(spark, d, "vessels_positions")).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")).select("mmsi", (fold("mmsi", 100) < 80).alias("train"), fold("mmsi", 5).alias("fold"), "n")


@CAT.add(f"with s as (select *, 1000000 // (1 + tta_s) as w from ({_SAMPLES})) select {_KEY}, w::double / (select sum(w)::double / count(*) from s) as weight from s")
def sample_weights(spark, d):
    """Weights falling with the time to arrival, of mean one."""
    s = _samples(spark, d).withColumn("w", F.floor(F.lit(1000000) / (1 + F.col("tta_s"))))
    mean = s.agg((F.sum("w").cast("double") / F.count(F.lit(1))).alias("__m"))
    return keyed(s.crossJoin(F.broadcast(mean)), (F.col("w").cast("double") / F.col("__m")).alias("weight"))  # one row


@CAT.add("select p.pos_id from vessels_positions p where p.mmsi in (select mmsi from matched_decl) and p.lat is not null")
def semi_join_targets(spark, d):
    """Fixes of the vessels that declared a destination."""
    return table(spark, d, "vessels_positions").where("lat is not null").join(table(spark, d, "matched_decl").select("mmsi"), "mmsi", "left_semi").select("pos_id")


QUERIES, SQL = CAT.queries, CAT.sql
