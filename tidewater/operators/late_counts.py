"""Counts per period of event time that late rows put right, up to a cut-off.

Every source keeps its own counter of each period, numbers what it counts (1, 2, ...) and only ever raises it. A
delivery says how far a counter had come at two versions of the period: at its end and at the cut-off for late rows.
Two states merge by taking, for each (period, source), the highest number of each version; a period's count is the sum
over its sources. Taking maxima is idempotent, commutative and associative, so a delivery that comes twice, late, out
of order or in another batch changes nothing that it shouldn't. Rows past the cut-off have the numbers after the last
version and raise neither. Whether a row was in time, a correction or too late is what its number says against the
merged state.

Numbers of rows that come without them follow the order in which they were received, so far as versions go: stage
(before the end, before the cut-off, after it), then lane, then id. Lanes split what one source sends for one period by
the hash of the row's id, so that a source or period with a third of all rows isn't numbered in one task; their sizes
are counted with partial aggregation and give each lane the number it begins at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Rows of a lane, were all rows in one period of one source; most lanes.
LANE_ROWS, MOST_LANES = 1_000_000, 4096
KEY = ("period_us", "source")


def staged(rows: DataFrame, *, event_time: str, received: str, source: str, row_id: str, period_us: int = HOUR, lateness_us: int = 6 * HOUR) -> DataFrame:
    """(row_id, period_us, source, stage): stage 0 received before the period's end, 1 less than `lateness_us` after
    it, 2 later.

    Rows with a null event time have no period, rows with a null received time can't be shown to lie before a version:
    both are left out. A null source is a source of its own. Rows received before they happened are of stage 0. Every
    row counts, repeated ones too.
    """
    t, r = F.unix_micros(F.col(event_time).cast("timestamp")), F.unix_micros(F.col(received).cast("timestamp"))
    start = (F.floor(t / period_us) * period_us).alias("period_us")
    s = rows.select(F.col(row_id).alias("row_id"), start, F.col(source).alias("source"), r.alias("__r")).where("period_us is not null and __r is not null")
    late = F.col("__r") - F.col("period_us") - period_us
    return s.withColumn("stage", F.when(late < 0, 0).when(late < lateness_us, 1).otherwise(2)).drop("__r")


def numbered(stages: DataFrame, lanes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, period_us, source, stage, seq), numbered from 1 per (period, source), and the deliveries
    (period_us, source, at_end, final) that the lanes make; `lanes` follows from the number of rows unless given."""
    lanes = lanes or max(1, min(MOST_LANES, -(-stages.count() // LANE_ROWS)))
    # null sources are a group as well; rows are moved once, as numbering and the lanes' first numbers share their keys
    laned = stages.withColumns({"lane": F.pmod(F.xxhash64("row_id"), F.lit(lanes)).cast("int"), "__s": F.coalesce("source", F.lit("")), "__none": F.col("source").isNull()})
    group = ["period_us", "__s", "__none", "stage", "lane"]
    before = Window.partitionBy(*group[:3]).orderBy("stage", "lane").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laned.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*group).orderBy("row_id"))
    rows = laned.withColumn("own", own).join(sizes.drop("n"), group).select("row_id", *KEY, "stage", (F.col("before") + F.col("own")).alias("seq"))
    sizes = sizes.withColumn("source", F.when(~F.col("__none"), F.col("__s")))
    return rows, deliveries(sizes.select(*KEY, "stage", (F.col("before") + F.col("n")).alias("seq")))


def deliveries(rows: DataFrame) -> DataFrame:
    """State (period_us, source, at_end, final) of rows (period_us, source, stage, seq): the highest numbers that were
    reached by the period's end and by the cut-off, 0 where none."""
    top = lambda stage: F.coalesce(F.max(F.when(F.col("stage") <= stage, F.col("seq"))), F.lit(0)).cast("long")
    return rows.groupBy(*KEY).agg(top(0).alias("at_end"), top(1).alias("final"))


def merge(*states: DataFrame) -> DataFrame:
    """One state out of several: per (period, source) the maximum of each version."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(*KEY).agg(F.max("at_end").alias("at_end"), F.max("final").alias("final"))


def judged(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (row_id, period_us, source, seq) with their outcome by the merged state: 'on_time', 'correction' or 'too_late'."""
    s = state.select(F.col("period_us").alias("__p"), F.col("source").alias("__source"), "at_end", "final")
    outcome = F.when(F.col("seq") <= F.col("at_end"), "on_time").when(F.col("seq") <= F.col("final"), "correction").otherwise("too_late")
    # adaptive skew handling splits a source and period with many rows; its one state row is copied
    return rows.join(s, (F.col("period_us") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__source"))).select("row_id", *KEY, "seq", outcome.alias("outcome"))


def period_counts(state: DataFrame) -> DataFrame:
    """(period_us, n_at_end, n_final): the counts at each period's end and after its last correction."""
    merged = merge(state)
    return merged.groupBy("period_us").agg(F.sum("at_end").alias("n_at_end"), F.sum("final").alias("n_final")).where("n_final > 0")
