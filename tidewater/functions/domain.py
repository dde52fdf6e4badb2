"""Vessel-tracking vocabulary: message types, ship and navigation codes, sentinels, bins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.geo import c

#: Fixed values of the protocol.
POSITION_TYPES = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport", "LongRangeAisBroadcast")
TRACK_TYPES = POSITION_TYPES[:3]
SHIP_CLASSES = ((30, 39, "fishing"), (60, 69, "passenger"), (70, 79, "cargo"), (80, 89, "tanker"))
SHIP_LABELS = ((30, 39, "Fishing"), (40, 49, "High Speed Craft"), (50, 59, "Special Craft"), (60, 69, "Passenger"), (70, 79, "Cargo"), (80, 89, "Tanker"))
NAV_LABELS = (
    "Under way using engine",
    "At anchor",
    "Not under command",
    "Restricted manoeuvrability",
    "Constrained by draught",
    "Moored",
    "Aground",
    "Engaged in fishing",
    "Under way sailing",
    "High speed craft",
    "Wing in ground",
    "Power-driven vessel",
    "Push/tow convoy",
    "Manoeuvring",
    "AIS-SART active",
    "Undefined",
)
#: Hours to arrival at which samples are taken, and the bins they are reported in. Fixed values.
HORIZONS = (0.5, 1.0, 2.0, 3.0, 6.0, 12.0, 24.0, 48.0, 72.0, 120.0, 168.0)
HORIZON_BINS = (1.0, 6.0, 24.0, 72.0, 200.0)
DISTANCE_EDGES = (0, 10, 25, 50, 100, 200, 350, 500, 750, 1000, 2000, 5000, 20000)


def _ladder(code, steps, otherwise: Column) -> Column:
    out = otherwise
    for lo, hi, name in reversed(steps):
        out = F.when(c(code).between(lo, hi), name).otherwise(out)
    return out


def ship_class(code) -> Column:
    return _ladder(code, SHIP_CLASSES, F.lit("pleasure"))


def ship_label(code) -> Column:
    return _ladder(code, SHIP_LABELS, F.when(c(code).isNull(), "Unknown").otherwise(F.concat(F.lit("Other ("), c(code).cast("string"), F.lit(")"))))


def nav_label(code) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in enumerate(NAV_LABELS)))
    return F.when(c(code).isNull(), "Unknown").otherwise(F.coalesce(F.try_element_at(names, c(code)), F.concat(F.lit("Unknown ("), c(code).cast("string"), F.lit(")"))))


def placed(lat, lon) -> Column:
    """Coordinates that are there and not the code for "not available"; 0.0 is a place."""
    return c(lat).isNotNull() & c(lon).isNotNull() & (F.abs(c(lat)) != 91) & (F.abs(c(lon)) != 181)


def known_heading(heading) -> Column:
    return F.when(c(heading) < 360, c(heading))


def bucket_of(value, edges=DISTANCE_EDGES) -> Column:
    """Number of the half-open bucket [edge k, edge k+1) from 0; -1 outside."""
    out = F.lit(-1)
    for k in range(len(edges) - 1):
        out = F.when((c(value) >= edges[k]) & (c(value) < edges[k + 1]), k).otherwise(out)
    return out


def horizon_bin(hours) -> Column:
    out = F.lit(None).cast("int")
    for k, top in reversed(list(enumerate(HORIZON_BINS))):
        out = F.when((c(hours) >= 0) & (c(hours) < top), k).otherwise(out)
    return out
