"""Writers: physical layout, partition overwrite, registration. Whole tables are replaced by `lake.Lake`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import geo

ROWS = 100_000


def write_sorted(df: DataFrame, path: str, order: list[str], *, partition: list[str] | None = None, level: int = 3, rows: int = ROWS, mode: str = "overwrite", files: int | None = None) -> None:
    """Parquet, zstd, row groups of `rows` rows, in one order across and within files, so that statistics prune.

    Partitioned tables are sorted within their partitions; overwriting replaces only the partitions that have rows.
    """
    if partition:
        laid = df.repartition(*partition).sortWithinPartitions(*partition, *order)
    else:
        laid = (df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    w = laid.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.row.count.limit", rows).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_messages(silver: DataFrame, path: str) -> None:
    """Silver by event day, in the order that most reads filter by."""
    write_sorted(silver, path, ["message_type", "mmsi", "ts"], partition=["year", "month", "day"])


LAYOUTS = {"temporal": ["ts", "mmsi"], "lat": ["lat", "mmsi"], "lat_lon": ["lat", "lon", "mmsi"], "cell": ["__cell", "mmsi"]}


def write_layout(df: DataFrame, path: str, layout: str, rows: int = ROWS, files: int | None = None) -> None:
    """One of four physical orders, to compare how well boxes prune; files are ranges of the order."""
    staged = df.withColumn("__cell", geo.grid_cell("lat", "lon")) if layout == "cell" else df
    write_sorted(staged, path, LAYOUTS[layout], rows=rows, files=files)


def groups_hit(stats: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Row groups whose statistics overlap a box, of all, from `landing.row_groups`."""
    wide = stats.where(F.col("column").isin("lat", "lon")).groupBy("file", "row_group").agg(*[F.max(F.when(F.col("column") == c, F.col(k).cast("double"))).alias(f"{c}_{k}") for c in ("lat", "lon") for k in ("low", "high")])
    hit = (F.col("lat_high") >= south) & (F.col("lat_low") <= north) & (F.col("lon_high") >= west) & (F.col("lon_low") <= east)
    return wide.agg(F.count_if(hit).alias("hit"), F.count(F.lit(1)).alias("groups"))


def register(spark: SparkSession, name: str, path: str, partitioned: bool = False) -> None:
    """A catalogue table over files that are already there; partitions are discovered."""
    spark.sql(f"create table if not exists {name} using parquet location '{path}'")
    if partitioned:
        spark.sql(f"msck repair table {name}")


def add_columns(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """Schema migration: columns that the table lacks."""
    have = {f.name for f in spark.table(name).schema}
    lacking = ", ".join(f"{c} {t}" for c, t in columns.items() if c not in have)
    if lacking:
        spark.sql(f"alter table {name} add columns ({lacking})")


def analyze(spark: SparkSession, name: str) -> None:
    """Table and column statistics, which join reordering and broadcast sizes go by."""
    spark.sql(f"analyze table {name} compute statistics for all columns")
