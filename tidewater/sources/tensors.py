"""Model inputs as tensors: arrays in Parquet with a description in JSON beside them, and back as NumPy."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tensors(samples: DataFrame, path: str, *, steps: str, length: str, target: str, names: list[str], most: int) -> dict:
    """Writes samples with an array column `steps` (most x names), their true lengths and targets; returns the description.

    The figures of the description come from one aggregation.
    """
    samples.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/samples")
    written = samples.sparkSession.read.parquet(f"{path}/samples")
    got = written.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), F.avg(target).alias("t"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    about = {"samples": got["n"], "steps": steps, "length": length, "target": target, "features": names, "most_steps": most, "mean_length": got["mean"], "target_mean": got["t"], "target_min": got["lo"], "target_max": got["hi"]}
    filesystem, root = pafs.FileSystem.from_uri(path)
    with filesystem.open_output_stream(f"{root}/about.json") as f:
        f.write(json.dumps(about, sort_keys=True).encode())
    return about


def about(path: str) -> dict:
    filesystem, root = pafs.FileSystem.from_uri(path)
    with filesystem.open_input_stream(f"{root}/about.json") as f:
        return json.loads(f.read())


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/samples")


def batches(path: str, rows: int = 4096) -> Iterator[dict[str, np.ndarray]]:
    """The samples as NumPy in pieces, for a trainer that reads them one after the other: 'steps' (n, most, features),
    'mask' (n, most), and every other column."""
    d = about(path)
    filesystem, root = pafs.FileSystem.from_uri(path)
    found = filesystem.get_file_info(pafs.FileSelector(f"{root}/samples"))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with filesystem.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(rows):
                cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names) if c != d["steps"]}
                flat = b.column(b.schema.get_field_index(d["steps"])).flatten().flatten().to_numpy(zero_copy_only=False)
                cols["steps"] = flat.reshape(b.num_rows, d["most_steps"], len(d["features"]))
                cols["mask"] = np.arange(d["most_steps"])[None, :] < cols[d["length"]][:, None]
                yield cols
