"""Stops and trips from location pings.

A hidden semi-Markov model with two states, stopped and travelling, is decoded over each vessel's pings: slow spells
(slow pings never more than two strays apart) are observed with a chance in either state, and each state has an
explicit duration distribution (log-normal), under which a stop of minutes isn't likely. A journey can't hold a spell of
half an hour, nor one that a day's edge cuts, however likely it is otherwise. Silences of over two hours split the
sequence, as the state behind them is unknown. What is decoded as stopped, and nothing else, is then held to the
definition: a longest stretch that keeps below `slow` knots and within `radius` km, in which one or two successive
strays are passed over. Such a stretch is part of a spell, so none is lost to the model, whatever its parameters are.
Between two stops that lie apart is a trip.

Plan: decoding is grouped by (vessel, day), so a vessel with a third of all pings is spread over its days and a group
is what one transponder sends in a day. A day's edge cuts states, so there durations count as censored, and pieces of
stops at an edge are reported whatever their length. The pieces, few for each vessel and day, are put together by a
second pass per vessel, which also gives the trips. Two shuffles, the second of pieces only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.arrow import Columns, over_groups
from tidewater.operators.nearby import EARTH_KM, haversine_km

DAY = 86_400_000_000
HOUR = 3_600_000_000
_RAD = math.pi / 180


@dataclass(frozen=True)
class Rules:
    slow: float = 0.5
    radius_km: float = 1.0
    least_us: int = HOUR // 2
    strays: int = 2
    silence_us: int = 2 * HOUR
    apart_km: float = 2.0
    fastest_kn: float = 80.0  # a place that needs more to be reached is a stray, for path lengths


@dataclass(frozen=True)
class Model:
    """Chance of a ping of a slow spell in either state; median hours and spread (of the logarithm) of their durations.

    The defaults are wide on purpose: a stop of a fix's length and one of a week lie within two spreads. `fitted` takes
    the durations from stops and trips found in the data. They decide which spells of less than half an hour are looked
    at with the longer ones. What is reported doesn't hang on them, as the definition has no stop in these.
    """

    slow_if_stopped: float = 0.97
    slow_if_travelling: float = 0.08
    stop_hours: float = 3.0
    travel_hours: float = 5.0
    stop_spread: float = 1.5
    travel_spread: float = 1.5


TOO_SHORT = -8.0


def fitted(found: DataFrame, model: Model = Model()) -> Model:
    """`model` with the log-normal durations of the stops and trips in a result of `stops_and_trips`; from one aggregation
    over all of them. A kind of which there are fewer than two keeps its figures."""
    hours = F.log((F.col("end_us") - F.col("start_us")) / HOUR)
    got = {r["kind"]: (r["n"], r["mean"], r["spread"]) for r in found.where("end_us > start_us").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(hours).alias("mean"), F.stddev(hours).alias("spread")).collect()}
    change = {}
    for kind, name in (("stop", "stop"), ("trip", "travel")):
        n, mean, spread = got.get(kind, (0, 0.0, 0.0))
        if n > 1:
            change |= {f"{name}_hours": math.exp(mean), f"{name}_spread": max(0.1, spread)}
    return replace(model, **change)


def _log_duration(us: np.ndarray, hours: float, spread: float, least_us: int, open_end: bool) -> np.ndarray:
    """Log density of a state's duration on the scale of its logarithm; where it is cut off, the log of surviving it."""
    z = (np.log(np.maximum(us, 1e6) / HOUR) - math.log(hours)) / spread
    if open_end:
        return np.log(np.maximum(0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)]), 1e-12))
    return -0.5 * z * z - math.log(spread * math.sqrt(2 * math.pi)) + np.where(us < least_us, TOO_SHORT, 0.0)


def decode(t: np.ndarray, slow: np.ndarray, known: np.ndarray, rules: Rules, open_start: bool, open_end: bool, model: Model = Model()) -> np.ndarray:
    """Semi-Markov Viterbi: for each ping whether it is decoded as stopped.

    Observed are slow spells, with the strays in them; outside of them what is not `known` tells nothing. A journey that
    holds a spell of `least_us`, or one that may be longer than it is seen beyond an open edge, has no likelihood, so
    each of these lies whole in one state of being stopped.

    Pings in a row with the same observation form a run, and states change between runs only (a change within a run
    is never likelier than one at its edge), so the work is quadratic in the runs, not in the pings.
    """
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    code, barred, edge = np.where(known, 0, -1).astype(np.int8), np.zeros(n, bool), rules.strays + 1
    at = np.flatnonzero(slow)
    if len(at):
        gaps = np.flatnonzero(np.diff(at) > edge)
        for i, j in zip(at[np.r_[0, gaps + 1]], at[np.r_[gaps, len(at) - 1]], strict=True):
            code[i : j + 1] = 1
            barred[i : j + 1] = t[j] - t[i] >= rules.least_us or (open_start and i < edge) or (open_end and n - 1 - j < edge)
    cuts = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), n]
    a, b = model.slow_if_stopped, model.slow_if_travelling
    chance = {1: (math.log(a), math.log(b)), 0: (math.log(1 - a), math.log(1 - b)), -1: (0.0, 0.0)}
    like = np.zeros((2, len(cuts)))
    for k in range(len(cuts) - 1):
        for s in (0, 1):
            like[s, k + 1] = like[s, k] + (cuts[k + 1] - cuts[k]) * chance[int(code[cuts[k]])][s]
    begin, finish = t[cuts[:-1]], t[cuts[1:] - 1]
    barred_before = np.r_[0, np.cumsum(barred)][cuts]
    r = len(cuts) - 1
    best = np.full((2, r + 1), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((2, r + 1), int)
    for j in range(1, r + 1):
        for s, hours, spread, least in ((0, model.stop_hours, model.stop_spread, rules.least_us), (1, model.travel_hours, model.travel_spread, 1)):
            span = finish[j - 1] - begin[:j]
            length = _log_duration(span, hours, spread, least, open_end and j == r)
            if open_start:
                length = np.array(length, float)
                length[0] = _log_duration(span[:1], hours, spread, least, True)[0]
            score = best[1 - s, :j] + like[s, j] - like[s, :j] + length
            if s == 1:
                score = np.where(barred_before[j] > barred_before[:j], -np.inf, score)
            came[s, j] = int(score.argmax())
            best[s, j] = score[came[s, j]]
    out, s, j = np.zeros(n, bool), int(best[:, r].argmax()), r
    while j > 0:
        i = came[s, j]
        if s == 0:
            out[cuts[i] : cuts[j]] = True
        s, j = 1 - s, i
    return out


def stretches(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, good: np.ndarray, lo: int, hi: int, rules: Rules) -> list[tuple[int, int]]:
    """Longest stretches (first, last ping) within [lo, hi) by the definition, whatever their length."""
    found, i = [], lo
    while i < hi:
        if not good[i]:
            i += 1
            continue
        fits = good[i:hi] & (haversine_km(lat[i], lon[i], lat[i:hi], lon[i:hi]) <= rules.radius_km)
        at = np.flatnonzero(fits)
        broken = np.flatnonzero(np.diff(at) > rules.strays + 1)
        last = i + int(at[broken[0]] if len(broken) else at[-1])
        found.append((i, last))
        # a stray that began nothing must not hide the stretch behind it
        i = last + 1 if t[last] - t[i] >= rules.least_us else i + 1
    return found


def _km(a: float, b: float, c: float, d: float) -> float:
    """`haversine_km` of one pair."""
    a, b, c, d = a * _RAD, b * _RAD, c * _RAD, d * _RAD
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def _path(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, placed: np.ndarray, rules: Rules) -> tuple[np.ndarray, int | None, int | None]:
    """Length of the path up to each ping, and the first and last place on it.

    A place that the one before can't have reached is a stray, unless the next one confirms it.
    """
    at = np.flatnonzero(placed)
    path = np.zeros(len(t))
    if not len(at):
        return path, None, None
    tt, la, lo = t[at], lat[at], lon[at]
    step = haversine_km(la[:-1], lo[:-1], la[1:], lo[1:])
    reach = rules.fastest_kn * 1.852 / HOUR
    if (step <= reach * np.diff(tt) + 0.2).all():
        gone, last = np.r_[0.0, np.cumsum(step)], len(at) - 1
    else:
        ts, ls, os_ = tt.tolist(), la.tolist(), lo.tolist()
        last, pending, total, gone = 0, None, 0.0, np.zeros(len(at))
        for k in range(1, len(at)):
            d = _km(ls[last], os_[last], ls[k], os_[k])
            if d <= reach * (ts[k] - ts[last]) + 0.2:
                total, last, pending = total + d, k, None
            elif pending is not None and _km(ls[pending], os_[pending], ls[k], os_[k]) <= reach * (ts[k] - ts[pending]) + 0.2:
                last, pending = k, None
            else:
                pending = k
            gone[k] = total
    path[at] = gone
    return np.maximum.accumulate(path), int(at[0]), int(at[last])


def _day(c: Columns, rules: Rules, model: Model) -> dict:
    every = c["__t"]
    at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    t = every[at]
    lat, lon, sog = (np.asarray(c[k], float)[at] for k in ("lat", "lon", "sog"))
    n = len(t)
    placed = (np.abs(lat) <= 90) & (np.abs(lon) <= 180)
    known = (sog >= 0) & (sog <= 102.2)
    good = known & (sog < rules.slow) & placed
    moving = known & (sog >= rules.slow)
    path, first_place, before = _path(t, lat, lon, placed, rules)
    rows: dict[str, list] = {k: [] for k in ("kind", "first", "last", "t0", "t1", "lat", "lon", "p0", "p1", "head", "tail")}

    def add(kind, first, last, t0, t1, la, lo, p0, p1, head=None, tail=None):
        for k, v in zip(rows, (kind, first, last, t0, t1, la, lo, p0, p1, head, tail), strict=True):
            rows[k].append(v)

    edge = rules.strays + 1
    ends = [np.nan] * 4 if first_place is None else [lat[first_place], lon[first_place], lat[before], lon[before]]
    add("day", 0, n - 1, int(t[0]), int(t[-1]), None, None, float(path[-1]), None, t[:edge].tolist(), t[-edge:].tolist())
    add("ends", 0, n - 1, int(t[0]), int(t[0]), ends[0], ends[1], ends[2], ends[3])
    parts = np.r_[0, np.flatnonzero(np.diff(t) > rules.silence_us) + 1, n]
    for a, b in zip(parts[:-1], parts[1:], strict=True):
        at_start, at_end = a == 0, b == n
        stop = decode(t[a:b], good[a:b], moving[a:b], rules, at_start, at_end, model)
        marks = np.flatnonzero(np.diff(np.r_[0, stop.astype(np.int8), 0]))
        for lo, hi in zip(marks[::2] + a, marks[1::2] + a, strict=True):
            reported = -1
            for i, j in stretches(t, lat, lon, good, lo, hi, rules):
                if j == reported:  # the rest of a piece too short to be a stop by itself
                    continue
                if t[j] - t[i] >= rules.least_us or (at_start and i - a < edge) or (at_end and b - 1 - j < edge):
                    reported = j
                    inside = good[i : j + 1] & (haversine_km(lat[i], lon[i], lat[i : j + 1], lon[i : j + 1]) <= rules.radius_km)
                    add("piece", i, j, int(t[i]), int(t[j]), float(np.median(lat[i : j + 1][inside])), float(np.median(lon[i : j + 1][inside])), float(path[i]), float(path[j]))
    m = len(rows["kind"])
    return {"__source": np.repeat(c["__source"][:1], m), "__day": np.repeat(c["__day"][:1], m), **rows}


def _vessel(c: Columns, rules: Rules) -> dict | None:
    """Pieces of one vessel to stops, then the trips between them."""
    offset, seen_n, km, edges = {}, 0, {}, {}
    carried, last_end = 0.0, None
    ends = {d: (c["lat"][k], c["lon"][k], c["p0"][k], c["p1"][k]) for k, d in enumerate(c["__day"]) if c["kind"][k] == "ends"}
    for k in np.flatnonzero(c["kind"] == "day"):
        d = c["__day"][k]
        la0, lo0, la1, lo1 = ends[d]
        if last_end is not None and not np.isnan(la0):
            carried += float(haversine_km(last_end[0], last_end[1], la0, lo0))
        offset[d], km[d] = seen_n, carried
        n = int(c["last"][k]) + 1
        head, tail = c["head"][k], c["tail"][k]
        edges |= {seen_n + i: x for i, x in enumerate(head)} | {seen_n + n - len(tail) + i: x for i, x in enumerate(tail)}
        carried += float(c["p0"][k])
        seen_n += n
        if not np.isnan(la1):
            last_end = (la1, lo1)
    stops: list[dict] = []
    by_end: dict[int, list[int]] = {}  # stops by their last ping
    for k in np.flatnonzero(c["kind"] == "piece"):
        d = c["__day"][k]
        p = {"i": offset[d] + int(c["first"][k]), "j": offset[d] + int(c["last"][k]), "t0": int(c["t0"][k]), "t1": int(c["t1"][k]), "lat": c["lat"][k], "lon": c["lon"][k], "p0": km[d] + c["p0"][k], "p1": km[d] + c["p1"][k], "day": d}
        near = sorted(n for j in range(p["i"] - rules.strays - 1, p["i"]) for n in by_end.get(j, ()))
        for n in near:  # the earliest that it continues; shorter ones within it come to nothing
            s = stops[n]
            if s["day"] == d or float(haversine_km(s["lat"], s["lon"], p["lat"], p["lon"])) > rules.radius_km:
                continue
            times = [s["t1"], *[edges[x] for x in range(s["j"] + 1, p["i"])], p["t0"]]
            if max(np.diff(times)) <= rules.silence_us:
                by_end[s["j"]].remove(n)
                s |= {"j": p["j"], "t1": p["t1"], "p1": p["p1"], "day": d}
                by_end.setdefault(p["j"], []).append(n)
                break
        else:
            by_end.setdefault(p["j"], []).append(len(stops))
            stops.append(p)
    stops = sorted((s for s in stops if s["t1"] - s["t0"] >= rules.least_us), key=lambda s: s["t0"])
    out: dict[str, list] = {k: [] for k in ("kind", "start_us", "end_us", "distance_km", "lat", "lon")}
    for k, s in enumerate(stops):
        rows = [("stop", s["t0"], s["t1"], s["p1"] - s["p0"], s["lat"], s["lon"])]
        if k + 1 < len(stops):
            nxt = stops[k + 1]
            if float(haversine_km(s["lat"], s["lon"], nxt["lat"], nxt["lon"])) > rules.apart_km:
                rows.append(("trip", s["t1"], nxt["t0"], nxt["p0"] - s["p1"], s["lat"], s["lon"]))
        for row in rows:
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
    return {"source": np.repeat(c["__source"][:1], len(out["kind"])), **out} if stops else None


def stops_and_trips(pings: DataFrame, *, source: str, event_time: str, lat: str, lon: str, speed: str, rules: Rules = Rules(), model: Model = Model()) -> DataFrame:
    """(source, kind, start_us, end_us, distance_km, lat, lon); kind is 'stop' or 'trip', lat and lon where it begins.

    Rows of a source with the same time are one ping (the first by place and speed counts). Null or impossible
    speeds and places are strays. Rows with a null source or time are left out; an empty table gives no rows. The
    distance is the path over places that can have been reached; a stop's distance is its drift.
    """
    narrow = pings.select(F.col(source).cast("long").alias("__source"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("__t"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(speed).cast("double").alias("sog")).where("__source is not null and __t is not null")
    daily = narrow.withColumn("__day", F.floor(F.col("__t") / DAY))
    piece = "__source long, __day long, kind string, first long, last long, t0 long, t1 long, lat double, lon double, p0 double, p1 double, head array<long>, tail array<long>"
    pieces = over_groups(daily, ["__source", "__day"], ["__t", "lat", "lon", "sog"], lambda c: _day(c, rules, model), piece)
    return over_groups(pieces, ["__source"], ["__day", "t0", "kind", "t1"], lambda c: _vessel(c, rules), "source long, kind string, start_us long, end_us long, distance_km double, lat double, lon double")
