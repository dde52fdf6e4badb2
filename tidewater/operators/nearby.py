"""Points within a distance of other points, and points in regions.

Distances: places become unit vectors, where a great-circle distance is a chord and comparing chords needs no
trigonometry and knows no date line or poles. Space is cut by k-d splits into cells; each search place is copied to
every cell that its radius reaches (the halo), each point lies in one cell, and a cell is searched by itself with a
local k-d tree.

The splits come from a bounded sample of both sides (`SAMPLE` rows each, the lowest hashes of the ids); they only
decide where work is done, every row takes part. A cell that holds a large share of either side, such as one quay, can't
be split further (below four radii a halo copies more than a split saves), so there the work is a grid: the points are
dealt to salts and the search places to parts of about `PART_TARGETS`, each point goes to every part and each place to
every salt. Within a task the rows are sorted with a part's search places first; points are streamed past the tree in
Arrow batches, so memory follows the search places of one part.

Regions: edges go to tiles one by one, so no polygon is held whole, and only to those tiles in whose band of latitude
they lie and from which they are not seen in the west. A tile with many points is salted by their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
SAMPLE = 20_000
CELL_TARGETS, PART_TARGETS, MAX_CELLS = 2_000, 8_000, 4_096
#: Points of a tile's salt.
TILE_POINTS = 500_000
SLACK = 1e-9


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=-1)


def chord(km: float) -> float:
    return 2 * np.sin(min(km / EARTH_KM, np.pi) / 2)


def haversine_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, o, c, e = np.radians(lat1), np.radians(lon1), np.radians(lat2), np.radians(lon2)
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((e - o) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def kd_cells(targets: np.ndarray, points: np.ndarray, radius: float, target_scale: float, most: int) -> tuple[np.ndarray, list]:
    """Cells of space from samples of both sides.

    A cell is halved at the median of its widest axis while it is expected to hold more than `CELL_TARGETS` targets
    or more than its part of the points, and its sides are wider than four radii (below that a halo copies more than
    a split saves). Returns the boxes (n, 2, 3) and the splits as a nested list for descending.
    """
    boxes: list[np.ndarray] = []
    lo, hi = np.full(3, -1.0 - 1e-9), np.full(3, 1.0 + 1e-9)
    share = max(1, len(points) // most)

    def build(t: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list | int:
        both = np.concatenate([t, p]) if len(t) + len(p) else np.zeros((0, 3))
        if len(boxes) < MAX_CELLS and (len(t) * target_scale > CELL_TARGETS or len(p) > share):
            spread = both.max(0) - both.min(0)
            axis = int(spread.argmax())
            cut = float(np.median(both[:, axis]))
            if spread[axis] > 4 * radius and both[:, axis].min() < cut:
                up, down = hi.copy(), lo.copy()
                up[axis] = down[axis] = cut
                return [axis, cut, build(t[t[:, axis] < cut], p[p[:, axis] < cut], lo, up), build(t[t[:, axis] >= cut], p[p[:, axis] >= cut], down, hi)]
        boxes.append(np.stack([lo, hi]))
        return len(boxes) - 1

    tree = build(targets, points, lo, hi)
    return np.array(boxes), tree


def cell_of(tree: list | int, xyz: np.ndarray) -> np.ndarray:
    out = np.zeros(len(xyz), np.int32)

    def descend(node: list | int, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            out[at] = node
            return
        axis, cut, below, above = node
        less = xyz[at, axis] < cut
        descend(below, at[less])
        descend(above, at[~less])

    descend(tree, np.arange(len(xyz)))
    return out


class KdTree:
    """A local k-d tree; a query takes many points at once and sends those that may reach a node down to it."""

    def __init__(self, xyz: np.ndarray, leaf: int = 16):
        self.xyz, self.leaf = xyz, leaf
        self.root = self._build(np.arange(len(xyz)))

    def _build(self, at: np.ndarray) -> tuple:
        p = self.xyz[at]
        lo, hi = p.min(0), p.max(0)
        if len(at) <= self.leaf or not (hi - lo).any():
            return lo, hi, at, None, None
        axis = int((hi - lo).argmax())
        order = at[np.argsort(p[:, axis], kind="stable")]
        half = len(at) // 2
        return lo, hi, None, self._build(order[:half]), self._build(order[half:])

    def within(self, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, target) at a chord of at most the radius."""
        a, b, reach = [], [], (radius * (1 + 1e-9) + SLACK) ** 2
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            (lo, hi, at, below, above), who = stack.pop()
            x = q[who]
            gap = np.maximum(np.maximum(lo - x, x - hi), 0)
            who = who[(gap * gap).sum(1) <= reach]
            if not len(who):
                continue
            if at is None:
                stack += [(below, who), (above, who)]
                continue
            step = max(1, 2_000_000 // len(at))
            for k in range(0, len(who), step):
                w = who[k : k + step]
                d = ((q[w][:, None, :] - self.xyz[at][None, :, :]) ** 2).sum(2)
                i, j = np.nonzero(d <= reach)
                a.append(w[i])
                b.append(at[j])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _valid(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("key is not null and lat between -90 and 90 and lon between -180 and 180")


def _sample(df: DataFrame) -> np.ndarray:
    rows = df.select("lat", "lon", F.xxhash64("key", "lat", "lon").alias("h")).orderBy("h").limit(SAMPLE).select("lat", "lon").collect()
    return unit(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)).reshape(-1, 3)


def within_distance(points: DataFrame, targets: DataFrame, *, km: float, point: tuple[str, str, str], target: tuple[str, str, str], point_type: str = "long", target_type: str = "string") -> DataFrame:
    """(point_id, target_id, km): every point with the targets at most `km` away by haversine.

    `point` and `target` name id, latitude and longitude. Rows with a null id or coordinates that are null, NaN or
    out of range don't count. Repeated targets (equal id and place) count once; a target with several places counts
    once for each place in reach, so (point_id, target_id) may come twice. Repeated points keep their repetitions.
    """
    spark = points.sparkSession
    p, t = _valid(points, *point), _valid(targets, *target).distinct()
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ts, ps = _sample(t), _sample(p)
    scale = max(1.0, t.count() / max(1, len(ts))) if len(ts) == SAMPLE else 1.0
    radius = chord(km)
    boxes, tree = kd_cells(ts, ps, radius, scale, 2 * many)
    held = np.bincount(cell_of(tree, ps), minlength=len(boxes))
    salts = np.maximum(1, np.ceil(held / max(1, len(ps)) * 2 * many)).astype(np.int32)
    parts = np.maximum(1, np.ceil(np.bincount(cell_of(tree, ts), minlength=len(boxes)) * scale / PART_TARGETS)).astype(np.int32)
    cells = "cell int, salt int, part int, side int, point_id {p}, target_id {t}, lat double, lon double".format(p=point_type, t=target_type)

    def put(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, salt: np.ndarray, part: np.ndarray, side: int) -> pa.RecordBatch:
        n, key = len(at), batch.column("key").take(pa.array(at))
        mine, none = (key, None) if side else (None, key)
        cols = {"cell": pa.array(cell, pa.int32()), "salt": pa.array(salt, pa.int32()), "part": pa.array(part, pa.int32()), "side": pa.array(np.full(n, side), pa.int32()), "point_id": mine if mine is not None else pa.nulls(n, PT), "target_id": none if none is not None else pa.nulls(n, TT), "lat": batch.column("lat").take(pa.array(at)), "lon": batch.column("lon").take(pa.array(at))}
        return pa.record_batch(list(cols.values()), names=list(cols))

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    PT, TT = kinds[point_type], kinds[target_type]

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            cell = cell_of(tree, unit(batch.column("lat").to_numpy(), batch.column("lon").to_numpy()))
            salt = (np.arange(batch.num_rows) + turn) % salts[cell]
            turn += batch.num_rows
            copies = parts[cell]
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            yield put(batch, np.repeat(np.arange(batch.num_rows), copies), np.repeat(cell, copies), np.repeat(salt, copies), part, 1)

    def place_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            xyz = unit(batch.column("lat").to_numpy(), batch.column("lon").to_numpy())
            for k in range(0, len(xyz), 1000):
                part = xyz[k : k + 1000, None, :]
                gap = np.maximum(np.maximum(boxes[None, :, 0] - part, part - boxes[None, :, 1]), 0)
                i, cell = np.nonzero((gap * gap).sum(2) <= (radius * (1 + 1e-9) + SLACK) ** 2)
                copies = salts[cell]
                salt = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                part = np.repeat((i + k + turn) % parts[cell], copies)
                yield put(batch, np.repeat(i + k, copies), np.repeat(cell, copies), salt, part, 0)
            turn += batch.num_rows

    both = t.mapInArrow(place_targets, cells).unionByName(p.mapInArrow(place_points, cells))
    ordered = both.repartition("cell", "salt", "part").sortWithinPartitions("cell", "salt", "part", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, places, local = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.stack([batch.column(c).to_numpy() for c in ("cell", "salt", "part")], 1)
            side = batch.column("side").to_numpy()
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(1) | (side[1:] != side[:-1])])
            for s, e in zip(starts, [*starts[1:], len(code)], strict=True):
                if at is None or (code[s] != at).any():
                    at, names, places, local = code[s], [], [], None
                lat, lon = (batch.column(c).slice(s, e - s).to_numpy() for c in ("lat", "lon"))
                if side[s] == 0:
                    names.append(batch.column("target_id").slice(s, e - s))
                    places.append(np.stack([lat, lon], 1))
                    continue
                if not places:
                    continue
                if local is None:
                    ll, ids = np.concatenate(places), pa.concat_arrays(names)
                    local = KdTree(unit(ll[:, 0], ll[:, 1])), ll, ids
                kd, ll, ids = local
                i, j = kd.within(unit(lat, lon), radius)
                d = haversine_km(lat[i], lon[i], ll[j, 0], ll[j, 1])
                ok = d <= km
                if ok.any():
                    yield pa.record_batch([batch.column("point_id").take(pa.array(i[ok] + s)), ids.take(pa.array(j[ok])), pa.array(d[ok])], names=["point_id", "target_id", "km"])

    return ordered.mapInArrow(search, f"point_id {point_type}, target_id {target_type}, km double")


def in_regions(points: DataFrame, regions: DataFrame, *, point: tuple[str, str, str], region: tuple[str, str], tile_deg: float = 1.0) -> DataFrame:
    """(point_id, region_id): the polygons that contain each point, by a plane sweep over the edges.

    `region` names the id and the ring, an array of structs (lon, lat) in order; the last vertex joins the first.
    Rings lie in the plane of degrees and don't cross the date line. Points and edges go to tiles of `tile_deg`; an edge
    goes to the tiles whose band of latitude it meets, from the polygon's western one to that of its own eastern end, as
    further east no point has it in the east. In a tile the points are sorted by latitude and each edge flips the parity
    of those between its ends that lie west of it, half-open at the upper end, so a vertex counts once. Points with null
    or out-of-range coordinates and rings with under three vertices or a null in them contain nothing; repeated points or
    regions repeat their rows.
    """
    p = _valid(points, *point).select(F.col("key").alias("point_id"), "lat", "lon")
    r = regions.select(F.col(region[0]).cast("string").alias("region_id"), F.col(region[1]).alias("ring")).where("region_id is not null and size(ring) >= 3 and not exists(ring, v -> v is null or v.lon is null or v.lat is null)")
    tile = lambda c: F.floor(c / tile_deg)
    number = lambda f: F.transform("ring", lambda v: v[f].cast("double"))
    turned = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))
    ring = r.select("region_id", F.monotonically_increasing_id().alias("ring_no"), number("lon").alias("x"), number("lat").alias("y")).withColumn("west", tile(F.array_min("x")))
    edge = ring.select("region_id", "ring_no", "west", F.inline(F.arrays_zip(F.col("x").alias("x1"), F.col("y").alias("y1"), turned(F.col("x")).alias("x2"), turned(F.col("y")).alias("y2")))).where("y1 <> y2")
    placed = edge.withColumn("ty", F.explode(F.sequence(tile(F.least("y1", "y2")), tile(F.greatest("y1", "y2"))))).withColumn("tx", F.explode(F.sequence("west", tile(F.greatest("x1", "x2")))))
    at = p.withColumns({"tx": tile(F.col("lon")), "ty": tile(F.col("lat"))})
    # there are at most (360 / tile_deg) * (180 / tile_deg) tiles, so those with many points can be broadcast
    hot = at.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_POINTS).select("tx", "ty", F.ceil(F.col("n") / TILE_POINTS).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    side = "tx long, ty long, salt int, side int, point_id long, lat double, lon double, region_id string, ring_no long, x1 double, y1 double, x2 double, y2 double"
    columns = [x.split() for x in side.split(", ")]
    filled = lambda df: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])
    left = at.join(F.broadcast(hot), ["tx", "ty"], "left").withColumns({"salt": F.pmod(F.xxhash64("point_id"), salts).cast("int"), "side": F.lit(1)})
    right = placed.join(F.broadcast(hot), ["tx", "ty"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("side", F.lit(0))
    ordered = filled(right).unionByName(filled(left)).repartition("tx", "ty", "salt").sortWithinPartitions("tx", "ty", "salt", "side", "lat")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, edges = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("tx", "ty", "salt", "side")], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                if here is None or (key[s, :3] != here).any():
                    here, waiting, edges = key[s, :3], [], None
                part = batch.slice(s, e - s)
                if key[s, 3] == 0:
                    waiting.append(part)
                    continue
                if not waiting:
                    continue
                edges = edges or EdgeSet(pa.Table.from_batches(waiting))
                for at_point, name in edges.inside(part.column("lat").to_numpy(), part.column("lon").to_numpy()):
                    yield pa.record_batch([part.column("point_id").take(pa.array(at_point)), name], names=["point_id", "region_id"])

    return ordered.mapInArrow(sweep, "point_id long, region_id string")


class EdgeSet:
    """The edges of a tile, each with its polygon."""

    def __init__(self, table: pa.Table):
        self.x1, self.y1, self.x2, self.y2 = (table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
        rings, first, self.ring = np.unique(table.column("ring_no").to_numpy(), return_index=True, return_inverse=True)
        self.names = table.column("region_id").combine_chunks().take(pa.array(first))
        self.rings = len(rings)

    def inside(self, lat: np.ndarray, lon: np.ndarray, pairs: int = 4_000_000) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Points, sorted by latitude, with the polygons they are inside of; so many at a time that the edges that pass
        them are about `pairs`."""
        step = max(1, pairs // max(1, len(self.x1)))
        for k in range(0, len(lat), step):
            a, o = lat[k : k + step], lon[k : k + step]
            lo, hi = np.searchsorted(a, np.minimum(self.y1, self.y2)), np.searchsorted(a, np.maximum(self.y1, self.y2))
            count = hi - lo
            edge = np.repeat(np.arange(len(count)), count)
            if not len(edge):
                continue
            point = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + lo[edge]
            x1, y1, x2, y2 = self.x1[edge], self.y1[edge], self.x2[edge], self.y2[edge]
            east = o[point] < x1 + (a[point] - y1) / (y2 - y1) * (x2 - x1)
            code, crossed = np.unique(point[east] * self.rings + self.ring[edge][east], return_counts=True)
            code = code[crossed % 2 == 1]
            if len(code):
                yield code // self.rings + k, self.names.take(pa.array(code % self.rings))
