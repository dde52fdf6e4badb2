from __future__ import annotations

import math
import random

import numpy as np

from tests.brute import haversine
from tidewater.operators import nearby as n


def run(spark, points, targets, km):
    p = spark.createDataFrame(points, "id long, la double, lo double, cell string, key int")
    t = spark.createDataFrame(targets, "code string, la double, lo double, salt string")
    got = n.within_distance(p, t, km=km, point=("id", "la", "lo"), target=("code", "la", "lo")).collect()
    return sorted((r.point_id, r.target_id) for r in got)


def brute(points, targets, km):
    ok = lambda a, b: a is not None and b is not None and not math.isnan(a) and -90 <= a <= 90 and -180 <= b <= 180
    where = {(c, a, b) for c, a, b, _ in targets if c is not None and ok(a, b)}
    return sorted((i, c) for i, a, b, *_ in points if i is not None and ok(a, b) for c, x, y in where if haversine(a, b, x, y) <= km)


def places(rng, k):
    for i in range(k):
        kind = rng.random()
        if kind < 0.3:
            yield i, 51.0 + rng.gauss(0, 0.05), 3.0 + rng.gauss(0, 0.05)
        elif kind < 0.5:
            yield i, rng.uniform(-1, 1), rng.choice([-180.0, 180.0, 179.99, -179.99])
        elif kind < 0.6:
            yield i, rng.choice([89.99, -89.99, 90.0]), rng.uniform(-180, 180)
        elif kind < 0.65:
            yield i, rng.choice([None, 91.0, float("nan"), -100.0]), rng.choice([None, 181.0, 0.0])
        else:
            yield i, rng.uniform(-90, 90), rng.uniform(-180, 180)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "CELL_TARGETS", 20)
    rng = random.Random(6)
    points = [(*p, "x", 1) for p in places(rng, 1500)]
    targets = [(f"t{i % 250}" if i % 40 else None, a, b, "s") for i, a, b in places(rng, 300)] * 2
    for km in (5.0, 10.0, 400.0):
        assert run(spark, points, targets, km) == brute(points, targets, km)


def test_all_points_in_one_place(spark):
    points = [(i, 10.0, 20.0, "", 0) for i in range(5000)]
    assert len(run(spark, points, [("a", 10.0, 20.0, ""), ("b", 10.5, 20.0, "")], 10.0)) == 5000


def test_empty(spark):
    assert run(spark, [], [("a", 1.0, 1.0, "")], 10.0) == []
    assert run(spark, [(1, 1.0, 1.0, "", 0)], [], 10.0) == []


def test_tree_finds_all_within_the_chord():
    rng = np.random.default_rng(7)
    t = n.unit(rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500))
    q = n.unit(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200))
    r = n.chord(700)
    i, j = n.KdTree(t).within(q, r)
    want = {(a, b) for a, b in zip(*np.nonzero(((q[:, None] - t[None]) ** 2).sum(2) <= r * r), strict=True)}
    assert want <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) <= len(want) + 1


def test_regions_against_ray_casting(spark):
    rng = random.Random(8)
    rings = {f"r{k}": [(rng.uniform(-3, 3) + k % 5, rng.uniform(-3, 3)) for _ in range(rng.randrange(3, 9))] for k in range(15)}
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 8)) for i in range(800)] + [(900, None, 1.0), (901, 95.0, 1.0)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    rows = [(k, [{"lon": float(x), "lat": float(y)} for x, y in v]) for k, v in rings.items()] + [("none", None), ("two", [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}])]
    r = spark.createDataFrame(rows, "name string, ring array<struct<lon: double, lat: double>>")
    got = sorted((x.point_id, x.region_id) for x in n.in_regions(p, r, point=("id", "lat", "lon"), region=("name", "ring")).collect())
    want = []
    for i, la, lo in points:
        for name, ring in rings.items():
            odd = False
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if la is not None and min(y1, y2) <= la < max(y1, y2) and lo < x1 + (la - y1) / (y2 - y1) * (x2 - x1):
                    odd = not odd
            if odd:
                want.append((i, name))
    assert got == sorted(want)


def test_a_quay_with_most_points_and_places(spark, monkeypatch):
    """Neither side of a cell that can't be split is held whole."""
    monkeypatch.setattr(n, "PART_TARGETS", 30)
    points = [(i, 10.0 + i * 1e-5, 20.0, "", 0) for i in range(400)]
    targets = [(f"t{k}", 10.0, 20.0 + k * 1e-5, "") for k in range(200)] + [("far", 50.0, 20.0, "")]
    got = run(spark, points, targets, 10.0)
    assert len(got) == len(set(got)) == 400 * 200


def test_regions_over_many_tiles_with_salted_points(spark, monkeypatch):
    monkeypatch.setattr(n, "TILE_POINTS", 10)
    rng = random.Random(9)
    ring = [(float(x), float(y)) for x, y in ((-20, -10), (0, -12), (25, -9), (24, 11), (5, 3), (-18, 12))]
    points = [(i, rng.uniform(-15, 15), rng.uniform(-30, 30)) for i in range(600)] + [(1000 + i, 0.5, 0.5) for i in range(200)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    r = spark.createDataFrame([("big", [{"lon": x, "lat": y} for x, y in ring])] * 2, "name string, ring array<struct<lon: double, lat: double>>")
    got = sorted(x.point_id for x in n.in_regions(p, r, point=("id", "lat", "lon"), region=("name", "ring"), tile_deg=2.0).collect())
    inside = lambda la, lo: sum(min(y1, y2) <= la < max(y1, y2) and lo < x1 + (la - y1) / (y2 - y1) * (x2 - x1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2
    want = [i for i, la, lo in points if inside(la, lo)]
    assert got == sorted(want * 2) and len(want) > 200
    assert n.in_regions(p, r.limit(0), point=("id", "lat", "lon"), region=("name", "ring")).count() == 0
