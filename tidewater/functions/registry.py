"""The engine's expressions as SQL functions of a session; they are inlined, so nothing leaves code generation."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewater.functions import domain

_CLASS = " ".join(f"when code between {a} and {b} then '{n}'" for a, b, n in domain.SHIP_CLASSES)

FUNCTIONS = {
    "haversine_km(lat1 double, lon1 double, lat2 double, lon2 double) returns double": "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "bearing_deg(lat1 double, lon1 double, lat2 double, lon2 double) returns double": "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360.0D)",
    "grid_cell(lat double, lon double) returns bigint": "cast(floor(lat * 10) as bigint) * 100000 + cast(floor(lon * 10) as bigint)",
    "ship_class(code int) returns string": f"case {_CLASS} else 'pleasure' end",
    "epoch_rounded(ts timestamp) returns int": "cast(rint(unix_micros(ts) / 1e6) as int)",
}


def register(spark: SparkSession) -> None:
    """Temporary functions of the session, usable as in `select haversine_km(a, b, c, d)`."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
