"""A folder of tables with a small catalogue of its own: where a path belongs, versions, days, attaching, synchronising.

Partitioned tables grow by folders of days; whole tables are replaced as a version and a pointer to it, so a reader
has the old version or the new one and never neither. Only names and pointers pass through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where each table lies, and by what its folders part it. Fixed values.
DAYS = ("year", "month", "day")
LAYOUT: dict[str, tuple[str, tuple[str, ...]]] = {
    "messages": ("silver", DAYS),
    "vessels_positions": ("gold/vessels_positions", DAYS),
    "vessel_tracks": ("gold/vessel_tracks", ("date",)),
    "base_stations": ("gold/base_stations", DAYS),
    "aids_to_navigation": ("gold/aids_to_navigation", DAYS),
    "vessels": ("gold/vessels", ()),
    "port_calls": ("gold/port_calls", ()),
    "port_congestion": ("gold/port_congestion", ()),
}
POINTER, CATALOGUE = "CURRENT", "catalogue.json"


def classify(path: str) -> tuple[str, bool] | None:
    """The table that a path relative to the lake belongs to and whether it is partitioned; None for none of them."""
    for name, (folder, parts) in LAYOUT.items():
        if path.strip("/").startswith(folder + "/"):
            return name, bool(parts)
    return None


class Lake:
    """Tables below `root`. A read-only lake refuses what would change it."""

    def __init__(self, spark: SparkSession, root: str, *, read_only: bool = False, data_path: str | None = None):
        """`data_path` overrides where the data of the tables lie; the catalogue stays at `root`."""
        self.spark, self.root, self.read_only, self.data = spark, root.rstrip("/"), read_only, (data_path or root).rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _may_change(self) -> None:
        if self.read_only:
            raise PermissionError("the lake is attached read-only")

    def _read_text(self, *parts: str) -> str | None:
        path = self._path(*parts)
        if not self._fs(path).exists(path):
            return None
        stream = self._fs(path).open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write_text(self, text: str, *parts: str) -> None:
        """Written beside the target and renamed onto it in one step."""
        target = self._path(*parts)
        staged = self._path(f"{target}.{uuid.uuid4().hex}")
        stream = self._fs(target).create(staged, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        option = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(option, 1)
        how[0] = option.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, how)

    def folder(self, name: str) -> str:
        return f"{self.data}/{LAYOUT[name][0]}"

    def replace(self, name: str, df: DataFrame) -> str:
        """Overwrites a whole table, which `df` itself may read: a new version, then the pointer to it. Returns the version."""
        self._may_change()
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder(name)}/{version}")
        self._write_text(version, self.folder(name), POINTER)
        return version

    def append(self, name: str, df: DataFrame, order: list[str]) -> None:
        """Adds to a partitioned table; days that come again are replaced whole."""
        from tidewater.sources.sinks import write_sorted

        self._may_change()
        write_sorted(df, self.folder(name), order, partition=list(LAYOUT[name][1]))

    def table(self, name: str) -> DataFrame:
        if LAYOUT[name][1]:
            return self.spark.read.parquet(self.folder(name))
        version = self._read_text(self.folder(name), POINTER)
        if version is None:
            raise FileNotFoundError(f"no version of {name} has been published")
        return self.spark.read.parquet(f"{self.folder(name)}/{version}")

    def names(self) -> list[str]:
        """Tables that are there."""
        there = []
        for name, (_, parts) in LAYOUT.items():
            path = self._path(self.folder(name)) if parts else self._path(self.folder(name), POINTER)
            if self._fs(path).exists(path):
                there.append(name)
        return there

    def attach(self, prefix: str = "") -> list[str]:
        """Makes every table a view of the session, under its name behind the prefix."""
        for name in self.names():
            self.table(name).createOrReplaceTempView(prefix + name)
        return self.names()

    def drop(self, name: str) -> None:
        self._may_change()
        path = self._path(self.folder(name))
        self._fs(path).delete(path, True)

    def _day_folders(self, name: str, day: date) -> list:
        """Folders of a day, whether or not their numbers have leading zeros."""
        parts = LAYOUT[name][1]
        want = {"date": day.isoformat(), "year": day.year, "month": day.month, "day": day.day}
        level = [self._path(self.folder(name))]
        for part in parts:
            below = [s.getPath() for p in level if self._fs(p).exists(p) for s in self._fs(p).listStatus(p) if s.isDirectory()]
            value = lambda p: p.getName().partition("=")[2]
            level = [p for p in below if p.getName().startswith(part + "=") and (value(p) == want[part] if part == "date" else value(p).isdigit() and int(value(p)) == want[part])]
        return level if parts else []

    def delete_day(self, day: date, tables: set[str] | None = None) -> dict[str, int]:
        """Removes a day's folders from partitioned tables (all, or those named); the number removed by table.

        Whole tables hold all days and have none to remove; `replace` is what renews them.
        """
        self._may_change()
        gone = {}
        for name in LAYOUT:
            if tables is None or name in tables:
                for path in self._day_folders(name, day):
                    self._fs(path).delete(path, True)
                    gone[name] = gone.get(name, 0) + 1
        return gone

    def vacuum(self, name: str, older_than_s: float = 7 * 86400) -> int:
        """Removes versions that are not current and older than the limit, within which a reader may still be at one."""
        self._may_change()
        path, current = self._path(self.folder(name)), self._read_text(self.folder(name), POINTER)
        gone = 0
        for s in self._fs(path).listStatus(path) if self._fs(path).exists(path) else []:
            version = s.getPath().getName()
            if version.startswith("v") and version != current and int(version[1:21]) < time.time_ns() - older_than_s * 1e9:
                self._fs(path).delete(s.getPath(), True)
                gone += 1
        return gone

    def save_catalogue(self) -> dict:
        """Writes which tables there are and which version of each is current."""
        self._may_change()
        known = {name: {"folder": LAYOUT[name][0], "version": None if LAYOUT[name][1] else self._read_text(self.folder(name), POINTER)} for name in self.names()}
        self._write_text(json.dumps(known, sort_keys=True), self.root, CATALOGUE)
        return known

    def catalogue(self) -> dict | None:
        text = self._read_text(self.root, CATALOGUE)
        return None if text is None else json.loads(text)

    def synchronise(self, other: Lake) -> dict:
        """Takes over the other lake's catalogue: its file, and its pointers where the versions are here too.

        A version that isn't here yet is left for the next time, so a pointer never names what a reader can't find.
        """
        self._may_change()
        known = other.catalogue() or {}
        taken = {}
        for name, entry in known.items():
            version = entry["version"]
            path = self._path(self.folder(name), version) if version else self._path(self.folder(name))
            if self._fs(path).exists(path):
                if version:
                    self._write_text(version, self.folder(name), POINTER)
                taken[name] = entry
        self._write_text(json.dumps(taken, sort_keys=True), self.root, CATALOGUE)
        return taken


def without(files: DataFrame, owners: DataFrame, owner: str, name: str, pattern: str) -> DataFrame:
    """What is left of registered files after those of one table whose path is like the pattern are deleted.

    `files` has (owner, path), `owners` (owner, name); the owner comes from a scalar subquery, which fails if a name has
    several. A file with a null owner or path stays, and so do all where the name is unknown.
    """
    found = owners.where(F.col("name") == name).select(owner).scalar()
    return files.where(~F.coalesce((F.col(owner) == found) & F.col("path").like(pattern), F.lit(False)))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified_us) of the files below a folder whose name fits the pattern; no file is opened.

    The driver lists the folder itself; what lies in its folders is listed by tasks. Empty files are files.
    """
    from fnmatch import fnmatch

    filesystem, root = pafs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else folder.split("//", 1)[0] + "//"
    top = filesystem.get_file_info(pafs.FileSelector(root, recursive=False))
    row = lambda f: (scheme + f.path, f.size, (f.mtime_ns or 0) // 1000)
    fits = lambda f: f.type == pafs.FileType.File and fnmatch(f.base_name, pattern)
    schema = "path string, bytes long, modified_us long"
    here = spark.createDataFrame([row(f) for f in top if fits(f)], schema)
    folders = spark.createDataFrame([(f.path,) for f in top if f.type == pafs.FileType.Directory], "path string")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [row(f) for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fits(f)]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "modified_us"])

    return here.unionByName(folders.repartition("path").mapInArrow(below, schema))
