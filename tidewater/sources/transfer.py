"""Copying many files in parallel, again and again without doing work twice.

Every task streams one file at a time, so what is in flight is bounded by the number of tasks. A target that is there
with the source's size is left alone; others are written beside their place and renamed, so a broken copy is never
taken for a whole one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 8 << 20


def copy_one(source: str, target: str, size: int) -> str:
    """'kept' where the target is whole already, 'copied', or 'failed: ...'."""
    try:
        a, path_a = pafs.FileSystem.from_uri(source)
        b, path_b = pafs.FileSystem.from_uri(target)
        there = b.get_file_info(path_b)
        if there.type == pafs.FileType.File and there.size == size:
            return "kept"
        b.create_dir(path_b.rsplit("/", 1)[0], recursive=True)
        staged, moved = f"{path_b}.{uuid.uuid4().hex}", 0
        with a.open_input_stream(path_a, compression=None) as r, b.open_output_stream(staged, compression=None) as w:
            while part := r.read(CHUNK):
                w.write(part)
                moved += len(part)
        if moved != size:
            b.delete_file(staged)
            return f"failed: {moved} of {size} bytes"
        b.move(staged, path_b)
        return "copied"
    except OSError as e:
        return f"failed: {e}"


def transfer(files: DataFrame, source: str, target: str, tasks: int = 32) -> DataFrame:
    """(path, outcome) of each file of `files` (path, bytes) below `source`, copied to the same place below `target`.

    Paths outside `source` fail. The result is lazy: settle or write it, then see whether any outcome is 'failed'.
    """
    a, b = source.rstrip("/"), target.rstrip("/")
    local = lambda p: p.split(":", 1)[-1].lstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside = local(path)[len(local(a)) + 1 :] if local(path).startswith(local(a) + "/") else None
                uri = path if "://" in path else "file:///" + local(path)
                done.append("failed: not below the source" if inside is None else copy_one(uri, f"{b}/{inside}", size))
            yield pa.record_batch([batch.column(0), pa.array(done, pa.string())], names=["path", "outcome"])

    return files.select("path", F.col("bytes").cast("long").alias("bytes")).repartition(tasks, "path").mapInArrow(run, "path string, outcome string")
