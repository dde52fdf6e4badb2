"""Readings that can't be right, measured against how the same source otherwise behaves.

Three tests per field, each by itself:
* range: a value outside what the field can hold (and no code for "not available");
* constant run: `run` or more successive readings of one identical value while the source is under way;
* spikes: each reading's deviation from the median of its neighbours, in units of what is usual for the source, is
  laid out as a matrix of daily profiles, a row for a day and a column for a time of day (a slot that holds several
  readings has several rows a day, so that each reading has its own cell; empty cells are unobserved). Robust
  principal components split it into a low-rank part, the source's recurring behaviour, and a sparse part. A reading
  in the sparse part is a candidate; it is a spike when it and at most one reading beside it stand apart from the
  readings on both sides.

Plan: readings are grouped by (source, block of `BLOCK_DAYS` days) with a halo of `HALO_DAYS` on each side, so a
source with a third of all rows is spread over its blocks and a block's edge sees its neighbours; a group holds what
one source sends in 18 days. One shuffle, one sort, no collect.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.arrow import Columns, over_groups

DAY = 86_400_000_000
BLOCK_DAYS, HALO_DAYS = 16, 1
SLOT = 300_000_000
SILENCE = 2 * 3_600_000_000


@dataclass(frozen=True)
class Field:
    """A field's range, its codes for "not available", the least deviation that can be a spike, and the least size of
    one that has a neighbour on one side only, as at a silence, where a lasting change can't be told from a spike."""

    name: str
    low: float
    high: float
    codes: tuple[float, ...]
    floor: float
    alone: float = float("inf")
    kind: str = "linear"  # linear, circular (degrees) or place (degrees of latitude, beyond what the pace allows)


AIS_FIELDS = (
    Field("sog", 0.0, 102.2, (102.3,), 2.2, 60.0),
    Field("lat", -90.0, 90.0, (91.0, -91.0), 0.01, 0.15, "place"),
    Field("true_heading", 0.0, 359.0, (511.0,), 40.0, kind="circular"),
    Field("rate_of_turn", -127.0, 127.0, (-128.0,), 44.0, 60.0),
)


def robust_pca(m: np.ndarray, seen: np.ndarray, steps: int = 100, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Principal component pursuit by inexact augmented Lagrangians: m = low rank + sparse on the cells seen.

    Unseen cells carry no penalty, so they follow the low-rank part. Singular values come from the smaller Gram
    matrix, as the profile matrix has few rows or few columns.
    """
    if m.shape[0] > m.shape[1]:
        low, sparse = robust_pca(m.T, seen.T, steps, tol)
        return low.T, sparse.T
    m = np.where(seen, m, 0.0)
    size = np.linalg.norm(m)
    low, sparse = np.zeros_like(m), np.zeros_like(m)
    if size == 0:
        return low, sparse
    lam = 1 / np.sqrt(m.shape[1])
    top = np.linalg.norm(m, 2)
    dual = m / max(top, np.abs(m).max() / lam)
    mu = 1.25 / top
    for _ in range(steps):
        a = m - sparse + dual / mu
        values, vectors = np.linalg.eigh(a @ a.T)
        s = np.sqrt(np.maximum(values, 0))
        shrunk = np.where(s > 1 / mu, (s - 1 / mu) / np.maximum(s, 1e-300), 0.0)
        low = (vectors * shrunk) @ (vectors.T @ a)
        b = m - low + dual / mu
        sparse = np.where(seen, np.sign(b) * np.maximum(np.abs(b) - lam / mu, 0), b)
        rest = m - low - sparse
        dual = dual + mu * rest
        mu *= 1.25
        if np.linalg.norm(rest) < tol * size:
            break
    return low, np.where(seen, sparse, 0.0)


def _turn(d: np.ndarray) -> np.ndarray:
    return (d + 180) % 360 - 180


def _shift(v: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(v), np.nan)
    if k > 0:
        out[k:] = v[:-k]
    else:
        out[:k] = v[-k:]
    return out


def _nanmedian(a: np.ndarray) -> np.ndarray:
    """Median over axis 0, NaN where all are NaN, without the warning."""
    ordered, n = np.sort(a, axis=0), (~np.isnan(a)).sum(0)
    at = np.arange(a.shape[1])
    lo, hi = ordered[np.maximum(n - 1, 0) // 2, at], ordered[np.maximum(n // 2, 0).clip(max=a.shape[0] - 1), at]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def _sparse_part(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sparse part of each reading's deviation y in the daily profile matrix."""
    day, slot = t // DAY, t % DAY // SLOT
    cell = day * (DAY // SLOT) + slot
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    layer = np.arange(len(t)) - np.repeat(first, np.diff(np.r_[first, len(t)]))
    _, row = np.unique(day * (layer.max() + 1) + layer, return_inverse=True)
    _, col = np.unique(slot, return_inverse=True)
    m = np.zeros((row.max() + 1, col.max() + 1))
    seen = np.zeros(m.shape, bool)
    m[row, col], seen[row, col] = y, True
    return robust_pca(m, seen)[1][row, col]


def pace(speed: np.ndarray, fastest: float) -> np.ndarray:
    """How fast the source goes at each ping: the greatest of its own valid speed and the medians of three before and
    three after.

    A moored vessel's is next to nothing, however fast it goes at sea; without speeds around it is `fastest`.
    """
    valid = np.where((speed >= 0) & (speed <= 102.2), speed, np.nan)
    before, after = (_nanmedian(np.stack([_shift(valid, k * side) for k in (1, 2, 3)])) for side in (1, -1))
    return np.nan_to_num(np.fmax(np.fmax(before, after), valid), nan=fastest)


def spikes(t: np.ndarray, v: np.ndarray, field: Field, fastest: float, near: np.ndarray, candidate: float = 0.25) -> np.ndarray:
    """Which readings v at times t (both without gaps, in order, in range) are spikes; `near` is the pace at each."""
    n, out = len(v), np.zeros(len(v), bool)
    if n < 3:
        return out
    diff = (lambda a, b: _turn(a - b)) if field.kind == "circular" else (lambda a, b: a - b)
    around = np.stack([diff(_shift(v, k), v) for k in (-3, -2, -1, 1, 2, 3)])
    y = _nanmedian(np.abs(around)) if field.kind == "circular" else -_nanmedian(around)  # opposite courses have no sign
    usual = 1.4826 * np.median(np.abs(y - np.median(y)))
    least = field.floor if field.kind == "place" else max(field.floor, 5 * usual)
    # deviations that are usual for the source play no part in the matrix beyond their size
    # and what is far beyond it none beyond being so: it must not hide what is less far
    cand = np.flatnonzero(np.abs(_sparse_part(t, np.clip(y / least, -20, 20))) > candidate)
    if not len(cand):
        return out
    common = np.quantile(v, 0.98)
    run_first = np.r_[True, np.diff(cand) > 1]
    starts, ends = cand[run_first], cand[np.r_[np.flatnonzero(run_first)[1:] - 1, len(cand) - 1]]
    for a, b in zip(starts, ends, strict=True):
        for first, last in ((i, j) for i in range(a, b + 1) for j in (i, i + 1) if j <= b):
            lo, hi = first - 1, last + 1
            has_lo, has_hi = lo >= 0, hi < n
            near_lo = has_lo and t[first] - t[lo] <= SILENCE
            near_hi = has_hi and t[hi] - t[last] <= SILENCE
            x = v[first : last + 1]
            dl = diff(x, v[lo]) if has_lo else None
            dh = diff(x, v[hi]) if has_hi else None
            if field.kind == "place":
                # beyond what the pace around it, or over a longer gap the fastest usual speed, can have covered;
                # at the end of the record the pace to come isn't known
                own, base = (near[first : last + 1].max(), field.floor) if has_lo and has_hi else (fastest, field.alone)
                reach = lambda gap: base + 1.5 * (own if gap <= SILENCE // 4 else fastest) / 60 * gap / 3.6e9  # noqa: B023, E731
                sides = [np.abs(dl) > reach(t[first] - t[lo])] if has_lo else []
                sides += [np.abs(dh) > reach(t[hi] - t[last])] if has_hi else []
                ok = bool(sides) and all(s.all() for s in sides) and (bool((np.sign(dl) == np.sign(dh)).all()) if len(sides) == 2 else n > last - first + 3)
            elif near_lo and near_hi:
                least_dev = np.minimum(np.abs(dl), np.abs(dh))
                between = abs(float(diff(v[hi], v[lo])))
                ok = bool((least_dev > least).all()) and (between < 0.75 * least_dev.min() if field.kind == "circular" else bool((np.sign(dl) == np.sign(dh)).all()))
            elif field.kind == "linear":
                ok = bool((np.abs(x) > max(field.alone, abs(common) + least)).all()) and all((np.abs(d) > least).all() for d in (dl, dh) if d is not None)
            else:
                ok = False
            if ok:
                out[first : last + 1] = True
    return out


def under_way(t: np.ndarray, speed: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Whether the median of the valid speeds around a ping, two on each side, is at least `least`."""
    valid = np.where((speed >= 0) & (speed <= 102.2), speed, np.nan)
    return np.nan_to_num(_nanmedian(np.stack([valid, *[_shift(valid, k) for k in (-2, -1, 1, 2)]])), nan=0.0) >= least


def constant_runs(v: np.ndarray, moving: np.ndarray, run: int) -> np.ndarray:
    """Readings in runs of `run` or more identical ones, all while moving."""
    if not len(v):
        return np.zeros(0, bool)
    cut = np.r_[True, (v[1:] != v[:-1]) | (moving[1:] != moving[:-1])].cumsum() - 1
    return (np.bincount(cut)[cut] >= run) & moving


def judge(t: np.ndarray, readings: dict[str, np.ndarray], fields: tuple[Field, ...], run: int = 12) -> dict[str, np.ndarray]:
    """For pings in order of time, all at different times, the readings of each field that are cases."""
    speed = readings["sog"]
    moving = under_way(t, speed)
    fine = speed[(speed >= 0) & (speed <= 102.2)]
    fastest = max(5.0, float(np.quantile(fine, 0.98))) if len(fine) else 40.0
    near = pace(speed, fastest)
    found = {}
    for f in fields:
        v = readings[f.name]
        valid = ~np.isnan(v) & ~np.isin(v, f.codes)
        wrong = valid & ((v < f.low) | (v > f.high))
        at = np.flatnonzero(valid & ~wrong)
        case = wrong.copy()
        case[at[constant_runs(v[at], moving[at], run)]] = True
        rest = at[~case[at]]  # a stuck stretch isn't what its neighbours are measured against
        case[rest[spikes(t[rest], v[rest], f, fastest, near[rest])]] = True
        found[f.name] = case
    return found


def flag_readings(positions: DataFrame, *, source: str, event_time: str, row_id: str, fields: tuple[Field, ...] = AIS_FIELDS, run: int = 12) -> DataFrame:
    """(row_id, field) of the readings that can't be right; `fields` must contain the speed, 'sog'.

    Null readings and codes for "not available" are no cases and are passed over: the readings before and after them
    are neighbours. Rows of a source with the same time are one ping, judged by the row with the lowest id, and are
    all cases or none. Rows with a null source, time or id aren't judged. An empty table gives no rows.
    """
    t = F.unix_micros(F.col(event_time).cast("timestamp"))
    block = BLOCK_DAYS * DAY
    halo = HALO_DAYS * DAY
    narrow = positions.select(F.col(source).alias("__source"), t.alias("__t"), F.col(row_id).cast("long").alias("__id"), *[F.col(f.name).cast("double").alias(f.name) for f in fields]).where("__source is not null and __t is not null and __id is not null")
    spread = narrow.withColumn("__block", F.explode(F.array_distinct(F.array(*[F.floor((F.col("__t") + d) / block) for d in (-halo, 0, halo)]))))

    def run_group(c: Columns) -> dict | None:
        every, block_no = c["__t"], int(c["__block"][0])
        first = np.r_[True, every[1:] != every[:-1]]
        at = np.flatnonzero(first)
        found = judge(every[at], {f.name: np.asarray(c[f.name], float)[at] for f in fields}, fields, run)
        core = every // block == block_no
        back = first.cumsum() - 1
        ids, names = [], []
        for name, case in found.items():
            hit = np.flatnonzero(case[back] & core)
            ids.append(c["__id"][hit])
            names += [name] * len(hit)
        return {"row_id": np.concatenate(ids), "field": names}

    return over_groups(spread, ["__source", "__block"], ["__t", "__id"], run_group, "row_id long, field string")
