"""Attributes as they were known at event time (point-in-time join).

A fact carries when it holds from (`valid_from`) and when it was received. At an instant t only facts with
valid_from <= t and received <= t are known, that is, facts with max(valid_from, received) <= t; of these the one
with the latest valid_from counts, then the earliest received, then the lowest id. As t grows the answer changes only
where a better fact becomes known, so the successive change times of an entity cut time into half-open validity
intervals [from, to), disjoint for an entity and field.

Plan
1. Running best per (entity, field) in order of the time known. An entity may hold a third of all rows, so the scan
   is blocked by day: running best inside (entity, field, day), best of each day carried forward over the day
   summaries, joined back. No task holds more than one entity's day.
2. Intervals are exploded into time buckets. A ladder of widths keeps this small: an interval goes to the widest
   rung not longer than itself, so it covers at most `RATIO` + 1 buckets, and a bucket of a wide rung meets at most
   two intervals of an entity. Open-ended intervals go to a rung with one bucket.
3. Events are exploded into their bucket on each rung and equi-joined on (entity, rung, bucket, salt), with the
   containment from <= t < to as residual. The upper rungs, in which a hot entity's events meet in few buckets, are
   salted where an entity has many events: events by their id, the few intervals of these rungs copied to every salt.
   The number of salts follows from the entity's count of events; hot entities are those with more than `HOT_ROWS`
   events and more than a `MOST_HOT`th of all, so there are fewer than `MOST_HOT` of them, and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: Widths of the rungs in microseconds: 10 minutes, 4 hours, 4 days, 96 days; after them the rung without an end.
RATIO = 24
RUNGS = tuple(10 * MINUTE * RATIO**i for i in range(4))
SALTED_FROM = 3
#: Events of an entity from which on it is split, and the most entities that can be.
HOT_ROWS, MOST_HOT = 200_000, 10_000
DAY = 86_400_000_000


def change_intervals(facts: DataFrame, *, entity: str, valid_from: str, received: str, fact_id: str, fields: dict[str, Column], block_us: int = DAY) -> DataFrame:
    """Validity intervals (entity, field, fact_id, from_us, to_us); to_us is null for the last one.

    `fields` maps a field's name to the condition under which a fact supplies it. Facts with a null entity,
    valid_from, received or condition supply nothing. Repeated rows (equal in everything) yield one interval.
    """
    # the field array is null-free; a fact that supplies two fields becomes two narrow rows
    f = (
        facts.select(
            F.col(entity).alias("__e"),
            F.unix_micros(F.col(valid_from).cast("timestamp")).alias("__v"),
            F.unix_micros(F.col(received).cast("timestamp")).alias("__r"),
            F.col(fact_id).alias("__id"),
            F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in fields.items()])).alias("__fs"),
        )
        .where("__e is not null and __v is not null and __r is not null and __id is not null and size(__fs) > 0")
        .select("__e", F.explode("__fs").alias("__f"), F.greatest("__v", "__r").alias("__k"), F.struct("__v", (-F.col("__r")).alias("r"), (-F.col("__id")).alias("i")).alias("__rank"))
        .withColumn("__b", F.floor(F.col("__k") / block_us))
    )
    key, blocked = ["__e", "__f"], ["__e", "__f", "__b"]
    # equal times known are peers of a RANGE frame: of them only the best is a change
    inside = Window.partitionBy(*blocked).orderBy("__k")
    local = f.withColumn("__best", F.max("__rank").over(inside)).where("__rank = __best").drop("__best")
    carried = (
        f.groupBy(*blocked).agg(F.max("__rank").alias("__top")).withColumn("__carry", F.max("__top").over(Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    )
    changes = local.join(carried, blocked).where("__carry is null or __rank > __carry").drop("__carry").dropDuplicates([*blocked, "__k"])
    first = changes.groupBy(*blocked).agg(F.min("__k").alias("__first")).withColumn("__after", F.lead("__first").over(Window.partitionBy(*key).orderBy("__b"))).drop("__first")
    return changes.join(first, blocked).select(
        F.col("__e").alias("entity"),
        F.col("__f").alias("field"),
        (-F.col("__rank.i")).alias("fact_id"),
        F.col("__k").alias("from_us"),
        F.coalesce(F.lead("__k").over(inside), "__after").alias("to_us"),
    )


def hot_entities(events: DataFrame) -> DataFrame:
    """(entity, salts) of the entities whose events are split; fewer than `MOST_HOT` rows."""
    part = max(HOT_ROWS, events.count() / MOST_HOT)
    return events.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("entity", F.ceil(F.col("n") / part).cast("int").alias("salts"))


def bucketed(intervals: DataFrame, hot: DataFrame) -> DataFrame:
    """Intervals exploded into (rung, bucket, salt)."""
    length = F.col("to_us") - F.col("from_us")
    rung, width = F.lit(len(RUNGS)), F.lit(None).cast("long")
    for i in reversed(range(len(RUNGS))):
        upper = length < RUNGS[i] * RATIO
        rung, width = F.when(upper, i).otherwise(rung), F.when(upper, F.lit(RUNGS[i])).otherwise(width)
    span = F.when(F.col("__w").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("from_us") / F.col("__w")), F.floor((F.col("to_us") - 1) / F.col("__w"))))
    salts = F.when(F.col("rung") >= SALTED_FROM, F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).otherwise(F.array(F.lit(0)))
    known = intervals.where("to_us is null or to_us > from_us").join(F.broadcast(hot), "entity", "left")
    return known.withColumns({"rung": rung, "__w": width}).withColumn("bucket", F.explode(span)).withColumn("salt", F.explode(salts)).drop("__w", "salts")


def known_at(events: DataFrame, intervals: DataFrame, *, entity: str, at: str, event_id: str) -> DataFrame:
    """(event_id, field, fact_id): for each event the facts known at its time; no row where nothing was known.

    Events with a null entity, time or id match nothing. Repeated events keep their repetitions.
    """
    e = events.select(F.col(event_id).alias("event_id"), F.col(entity).alias("entity"), F.unix_micros(F.col(at).cast("timestamp")).alias("__t")).where("event_id is not null and entity is not null and __t is not null")
    hot = hot_entities(e)
    salt = F.pmod(F.xxhash64("event_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    rungs = F.array(*[F.struct(F.lit(i).alias("rung"), F.floor(F.col("__t") / w).alias("bucket"), salt if i >= SALTED_FROM else F.lit(0).alias("salt")) for i, w in enumerate(RUNGS)], F.struct(F.lit(len(RUNGS)).alias("rung"), F.lit(0).cast("long").alias("bucket"), salt))
    spread = e.join(F.broadcast(hot), "entity", "left").select("event_id", "entity", "__t", F.inline(rungs))
    # sorted and merged, never broadcast: the planner sizes a side before it is exploded
    return (
        spread.hint("merge")
        .join(bucketed(intervals, hot), ["entity", "rung", "bucket", "salt"])
        .where((F.col("from_us") <= F.col("__t")) & (F.col("to_us").isNull() | (F.col("__t") < F.col("to_us"))))
        .select("event_id", "field", "fact_id")
    )


def attributes_known_at(events: DataFrame, facts: DataFrame, *, entity: str, at: str, event_id: str, valid_from: str, received: str, fact_id: str, fields: dict[str, Column]) -> DataFrame:
    """Both steps: the facts' change intervals, then the events placed in them."""
    return known_at(events, change_intervals(facts, entity=entity, valid_from=valid_from, received=received, fact_id=fact_id, fields=fields), entity=entity, at=at, event_id=event_id)
