"""Small relational operators that the plans share. Orders are total: callers pass tiebreaks, nulls sort last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import c


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Catalyst limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*[c(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def nearest_by(df: DataFrame, keys: list[str], distance: Column, ties: list[Column]) -> DataFrame:
    return first_by(df, keys, [distance.asc_nulls_last(), *ties])


def islands(df: DataFrame, keys: list[str], order: list[Column], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the stretches between rows where `breaks` holds; a breaking row begins a stretch of its own."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def running(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of `value` over each key's rows in `order`, the row itself included.

    The scan is blocked: `block`, a column that rises with the order, splits a key with many rows. Sums run inside the
    blocks, the blocks' totals (partial aggregation, one row a block) are carried forward and joined.
    """
    own = [*keys, block]
    totals = df.groupBy(*own).agg(F.sum(value).alias("__total"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__inside", F.sum(value).over(inside)).join(before, own).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def haloed(df: DataFrame, at_us: str, block_us: int, halo_us: int) -> DataFrame:
    """Rows with the `__block` of time that they lie in, copied to the next one if that begins within `halo_us`.

    A window over (key, __block) that looks back no further than the halo sees in a block what it would see without
    blocks; results are taken from the rows whose own block it is.
    """
    return df.withColumn("__block", F.explode(F.array_distinct(F.array(*[F.floor((F.col(at_us) + d) / block_us) for d in (0, halo_us)]))))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at_us: Column, from_us: Column, to_us: Column, width_us: int, span: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """Rows of `points` with the `intervals` of equal key that contain them (both ends included).

    A time bucket of `width_us` joins the key, so a hot key is spread over its buckets; an interval is copied to the
    buckets it meets, where `span` is given within that one row (lo, hi), which bounds the points' times: an interval
    without a sensible end then costs no more than the points' own time. The bucket stays in the result under the name
    `keep`, if given.
    """
    bucket = keep or "__bucket"
    left = points.withColumn("__at", at_us).withColumn(bucket, F.floor(F.col("__at") / width_us))
    right = intervals.withColumns({"__from": from_us, "__to": to_us})
    if span is not None:
        right = right.crossJoin(F.broadcast(span.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))))  # one row
        right = right.withColumns({"__from": F.greatest("__from", "__lo"), "__to": F.least("__to", "__hi")}).drop("__lo", "__hi")
    right = right.where("__from <= __to").withColumn(bucket, F.explode(F.sequence(F.floor(F.col("__from") / width_us), F.floor(F.col("__to") / width_us))))
    got = left.join(right, [key, bucket]).where("__at between __from and __to").drop("__at", "__from", "__to")
    return got if keep else got.drop(bucket)


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str], newest: Column, ties: list[Column] | None = None) -> DataFrame:
    """Latest row per key over both sides by `newest`; on equal ones the fresh row counts."""
    both = existing.withColumn("__side", F.lit(1)).unionByName(fresh.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    return first_by(both, keys, [newest.desc_nulls_last(), F.col("__side").asc(), *(ties or [])]).drop("__side")


def insert_missing(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)
