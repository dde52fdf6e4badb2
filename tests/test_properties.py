"""Properties of the pieces that run inside tasks, on generated inputs."""

from __future__ import annotations

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators import compaction, implausible, nearby, trips

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


def shuffled(v):
    """Equal as JSON, with the keys in the other order."""
    if isinstance(v, dict):
        return {k: shuffled(x) for k, x in reversed(v.items())}
    return [shuffled(x) for x in v] if isinstance(v, list) else v


def same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


@given(VALUES, VALUES)
@settings(max_examples=200, deadline=None)
def test_canonical_text_decides_equality(a, b):
    assert compaction.canonical(json.dumps(a)) == compaction.canonical(json.dumps(shuffled(a), indent=1, ensure_ascii=False).replace("\n", " "))
    assert (compaction.canonical(json.dumps(a)) == compaction.canonical(json.dumps(b))) == same(a, b)


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_canonical_accepts_what_json_accepts(text):
    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
        parses = True
    except ValueError:
        parses = False
    assert (compaction.canonical(text) is not None) == parses


PLACES = st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), min_size=1, max_size=40)


@given(PLACES, PLACES, st.floats(1, 15000))
@settings(max_examples=60, deadline=None)
def test_tree_and_cells_lose_nothing(targets, points, km):
    t, p = np.array(targets), np.array(points)
    d = nearby.haversine_km(p[:, None, 0], p[:, None, 1], t[None, :, 0], t[None, :, 1])
    i, j = nearby.KdTree(nearby.unit(t[:, 0], t[:, 1]), leaf=2).within(nearby.unit(p[:, 0], p[:, 1]), nearby.chord(km))
    assert set(zip(*np.nonzero(d <= km * (1 - 1e-9)), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    boxes, tree = nearby.kd_cells(nearby.unit(t[:, 0], t[:, 1]), nearby.unit(p[:, 0], p[:, 1]), 0.0001, 1000.0, 8)
    xyz = nearby.unit(p[:, 0], p[:, 1])
    cell = nearby.cell_of(tree, xyz)
    assert (xyz >= boxes[cell, 0] - 1e-12).all() and (xyz <= boxes[cell, 1] + 1e-12).all()


@given(st.floats(-90, 90), st.floats(-180, 180), st.floats(-90, 90), st.floats(-180, 180))
@settings(max_examples=100, deadline=None)
def test_distance_is_symmetric_and_the_scalar_form_agrees(a, b, c, d):
    there, back = float(nearby.haversine_km(a, b, c, d)), float(nearby.haversine_km(c, d, a, b))
    assert abs(there - back) < 1e-6 and abs(there - trips._km(a, b, c, d)) < 1e-6 and 0 <= there <= 20016


@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=60), st.integers(2, 6))
@settings(max_examples=100, deadline=None)
def test_constant_runs_by_definition(rows, run):
    v, moving = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], bool)
    got = implausible.constant_runs(v, moving, run)
    for k in range(len(rows)):
        a = b = k
        while a > 0 and v[a - 1] == v[k] and moving[a - 1]:
            a -= 1
        while b + 1 < len(rows) and v[b + 1] == v[k] and moving[b + 1]:
            b += 1
        assert got[k] == (moving[k] and b - a + 1 >= run)


@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([True, False, None])), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_decoding_finds_long_stops_and_ignores_short_ones(rows):
    t = np.cumsum([r[0] for r in rows]) * 60_000_000
    slow, known = np.array([bool(r[1]) for r in rows]), np.array([r[1] is not None for r in rows])
    stop = trips.decode(t, slow, known, trips.Rules(), False, False)
    assert len(stop) == len(rows)
    run = 0
    for k in range(len(rows)):
        run = run + 1 if slow[k] else 0
        if run >= 12 and t[k] - t[k - run + 1] > 2 * trips.HOUR:
            assert stop[k - run + 1 : k + 1].all()
