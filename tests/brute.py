"""Plain versions of operators that SQL can't express, written from the definitions for small inputs."""

from __future__ import annotations

import json
import math


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def none(x):
    return None if x is None or x != x else x


def stops_and_trips(pings):
    """pings: (mmsi, ts_us, lat, lon, sog), in any order. Returns a set of (mmsi, kind, start, end)."""
    by = {}
    for m, t, *rest in sorted(pings, key=lambda p: (p[0], p[1])):
        by.setdefault(m, {}).setdefault(t, [none(x) for x in rest])
    out = set()
    for m, own in by.items():
        rows = [(t, *v) for t, v in own.items()]
        good = [s is not None and 0 <= s < 0.5 and la is not None and lo is not None and abs(la) <= 90 and abs(lo) <= 180 for _, la, lo, s in rows]
        stops, i = [], 0
        while i < len(rows):
            if not good[i]:
                i += 1
                continue
            members, strays = [i], 0
            for j in range(i + 1, len(rows)):
                if rows[j][0] - rows[j - 1][0] > 7_200_000_000:
                    break
                if good[j] and haversine(rows[i][1], rows[i][2], rows[j][1], rows[j][2]) <= 1:
                    members.append(j)
                    strays = 0
                elif (strays := strays + 1) > 2:
                    break
            if rows[members[-1]][0] - rows[i][0] >= 1_800_000_000:
                mid = lambda k: sorted(rows[x][k] for x in members)[len(members) // 2]
                stops.append((rows[i][0], rows[members[-1]][0], mid(1), mid(2)))
                i = members[-1] + 1
            else:
                i += 1
        out |= {(m, "stop", a, b) for a, b, *_ in stops}
        out |= {(m, "trip", p[1], q[0]) for p, q in zip(stops, stops[1:]) if haversine(p[2], p[3], q[2], q[3]) > 2}
    return out


def surplus_lines(files):
    """files: (file_id, body). Returns a set of (file_id, line_no)."""
    def freeze(v):
        if isinstance(v, dict):
            return ("o", frozenset((k, freeze(x)) for k, x in v.items()))
        if isinstance(v, list):
            return ("l", tuple(map(freeze, v)))
        return ("b", v) if isinstance(v, bool) or v is None else ("v", v)

    seen, out = set(), set()
    for fid, body in sorted(files):
        for k, line in enumerate((body or "").split("\n"), 1):
            try:
                v = freeze(json.loads(line))
            except ValueError:
                continue
            if v in seen:
                out.add((fid, k))
            seen.add(v)
    return out


FIELDS = {"sog": (0, 102.2, {102.3}, 2.5), "lat": (-90, 90, {91, -91}, 0.01), "true_heading": (0, 359, {511}, 40), "rate_of_turn": (-127, 127, {-128}, 44)}


def implausible(pings):
    """pings: dicts with mmsi, ts (us), pos_id and the fields. Spikes by comparing with the neighbours on both sides."""
    by = {}
    for p in sorted(pings, key=lambda p: (p["mmsi"], p["ts"], p["pos_id"])):
        by.setdefault(p["mmsi"], {}).setdefault(p["ts"], []).append(p)
    out = set()
    for own in by.values():
        rows = list(own.values())
        speed = [none(r[0]["sog"]) for r in rows]
        speed = [s if s is not None and 0 <= s <= 102.2 else None for s in speed]

        def moving(i, speed=speed):
            s = sorted(x for x in speed[max(0, i - 2) : i + 3] if x is not None)
            return bool(s) and (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 >= 0.5

        for f, (low, high, codes, floor) in FIELDS.items():
            v = [(i, none(r[0][f])) for i, r in enumerate(rows)]
            v = [(i, x) for i, x in v if x is not None and x not in codes]
            case = {i for i, x in v if not low <= x <= high}
            v = [(i, x) for i, x in v if i not in case]
            k = 0
            while k < len(v):
                j = k
                while j + 1 < len(v) and v[j + 1][1] == v[k][1] and moving(v[j + 1][0]) and moving(v[k][0]):
                    j += 1
                if j - k >= 11:
                    case |= {i for i, _ in v[k : j + 1]}
                k = j + 1
            v = [(i, x) for i, x in v if i not in case]
            d = (lambda a, b: (a - b + 180) % 360 - 180) if f == "true_heading" else (lambda a, b: a - b)
            for n in (1, 2):
                for k in range(1, len(v) - n):
                    if any(v[q][0] in case for q in range(k - 1, k + n + 1)):
                        continue
                    x, lo, hi = [z for _, z in v[k : k + n]], v[k - 1][1], v[k + n][1]
                    below, above, apart = floor, floor, floor / 2
                    if f == "lat":  # what may be covered at the pace around
                        i, j = v[k][0], v[k + n - 1][0]
                        mid = lambda s: sorted(q for q in s if q is not None)
                        sides = [q for q in (mid(speed[max(0, i - 3) : i]), mid(speed[j + 1 : j + 4])) if q]
                        go = max((q[len(q) // 2] for q in sides), default=40)
                        gap = lambda p, q: (rows[q][0]["ts"] - rows[p][0]["ts"]) / 3.6e9
                        a, b = gap(v[k - 1][0], i), gap(j, v[k + n][0])
                        if max(a, b) > 0.5:
                            continue
                        below, above, apart = floor + go / 40 * a, floor + go / 40 * b, floor + go / 40 * (a + b)
                    if all(abs(d(z, lo)) > below and abs(d(z, hi)) > above for z in x) and abs(d(hi, lo)) < apart:
                        case |= {i for i, _ in v[k : k + n]}
            out |= {(p["pos_id"], f) for i in case for p in rows[i]}
    return out
