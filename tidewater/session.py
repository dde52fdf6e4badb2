"""Session factory and the settings every plan relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results (time zone, ANSI) or the physical plan (AQE); sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # settled results go when nothing refers to them
}


def build_session(app: str = "tidewater", master: str | None = None, **extra: str) -> SparkSession:
    """A session with `SETTINGS`; `extra` overrides them (dots in names are written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where the setting is absent (tests, a single machine) a temporary folder is made and set; on a cluster the
    setting must be there, as a machine-local folder isn't seen by the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, with its scheme, so that Spark and pyarrow read it alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}"))
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def settle(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, and the rows outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
