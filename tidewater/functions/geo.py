"""Geographic column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KNOT_MS = 0.514444
#: World quarters of the live feed as (south, west, north, east). Fixed values.
SHARDS = {
    "NW": (0.0, -180.0, 90.0, 0.0),
    "NE": (0.0, 0.0, 90.0, 180.0),
    "SW": (-90.0, -180.0, 0.0, 0.0),
    "SE": (-90.0, 0.0, 0.0, 180.0),
    "WORLD": (-90.0, -180.0, 90.0, 180.0),
}


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null where any coordinate is."""
    lat1, lon1, lat2, lon2 = map(c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial course from the first place to the second, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(c, (lat1, lon1, lat2, lon2))
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def folded(a, b) -> Column:
    """Angle between two courses, 0 to 180."""
    d = F.abs(c(a) - c(b))
    return F.when(d > 180, 360 - d).otherwise(d)


def grid_cell(lat, lon) -> Column:
    """Number of the 0.1-degree cell."""
    return F.floor(c(lat) * 10).cast("long") * 100000 + F.floor(c(lon) * 10).cast("long")


def in_box(lat, lon, south, west, north, east) -> Column:
    """Inclusive on all sides; with literal bounds the scan prunes row groups by their statistics."""
    return c(lat).between(south, north) & c(lon).between(west, east)


def expanded_box(south: float, west: float, north: float, east: float, by: float = 3**0.5) -> tuple[float, float, float, float]:
    """A viewport grown about its middle by a factor on each axis, within the world."""
    mid_lat, mid_lon, h, w = (south + north) / 2, (west + east) / 2, (north - south) / 2 * by, (east - west) / 2 * by
    return max(-90.0, mid_lat - h), max(-180.0, mid_lon - w), min(90.0, mid_lat + h), min(180.0, mid_lon + w)


def box_inside(inner: tuple[float, float, float, float], outer: tuple[float, float, float, float]) -> bool:
    return inner[0] >= outer[0] and inner[1] >= outer[1] and inner[2] <= outer[2] and inner[3] <= outer[3]


def reckoning_radius_m(speed_kn, seconds) -> Column:
    """How far a vessel may have come since its last fix."""
    return c(speed_kn) * KNOT_MS * F.abs(c(seconds))
