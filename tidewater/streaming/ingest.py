"""Streams: ingestion from the landing folders, deduplication, downsampling, late counts and port calls.

Every stream restarts from its checkpoint in the shared folder. File sinks are exactly-once; `foreachBatch` writers
are idempotent, as a batch that is repeated after a failure writes the same state again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewater.functions import geo
from tidewater.operators import exactly_once, late_counts
from tidewater.session import scratch, settle
from tidewater.sources import landing

LATENESS = "7 days"
DAY = 86_400_000_000


def landing_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, base: str | None = None) -> DataFrame:
    """Envelopes from NDJSON files as they land; the number of files a trigger takes bounds a batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if base:
        reader = reader.option("basePath", base)
    lines = reader.text(folder)
    return landing.valid(landing.parse(lines, "value").where("__m is not null and __m.message_type is not null"))


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table's files as a stream; the pattern lets the table be one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def raw_sink(envelopes: DataFrame, out: str, checkpoint: str, seconds: int = 60, most: int = 50_000, writers: int = 4, level: int = 3) -> StreamingQuery:
    """Messages as zstd NDJSON in folders by processing hour, flushed after `seconds`, or sooner at `most` messages.

    A trigger fires when the time is over; what it brings is written by `writers` tasks, each into files of at most
    `most` messages. Folder and names follow from the batch (its number, the time it was first seen at, the task), so a
    batch that comes again after a failure replaces its own files.
    """

    def flush(rows: DataFrame, batch: int) -> None:
        import pyarrow as pa
        from pyarrow import fs as pafs

        filesystem, root = pafs.FileSystem.from_uri(out)
        log = f"{root}/_batches/{batch:012d}"
        if filesystem.get_file_info(log).type == pafs.FileType.File:
            with filesystem.open_input_stream(log) as f:
                hour = f.read().decode()
        else:
            hour = datetime.now(UTC).strftime("year=%Y/month=%m/day=%d/hour=%H")
            filesystem.create_dir(f"{root}/_batches", recursive=True)
            with filesystem.open_output_stream(log) as f:
                f.write(hour.encode())

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            fs, base = pafs.FileSystem.from_uri(out)
            task, held, part = TaskContext.get().partitionId(), [], 0

            def put() -> pa.RecordBatch:
                name = f"{base}/{hour}/b{batch:012d}-w{task:03d}-{part:04d}.ndjson.zst"
                fs.create_dir(f"{base}/{hour}", recursive=True)
                text = "\n".join(held).encode() + b"\n"
                with fs.open_output_stream(name, compression=None) as raw:
                    raw.write(pa.Codec("zstd", compression_level=level).compress(text, asbytes=True))
                return pa.record_batch([pa.array([name]), pa.array([len(held)], pa.int64())], names=["path", "n"])

            for b in batches:
                for text in b.column(0).to_pylist():
                    held.append(text)
                    if len(held) >= most:
                        yield put()
                        held, part = [], part + 1
            if held:
                yield put()

        rows.repartition(writers).mapInArrow(write, "path string, n long").collect()  # a name a file of a batch

    one = envelopes.select(F.col("__raw").alias("value"))
    return one.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def supervised(start: Callable[[], StreamingQuery], tries: int = 10, pause_s: float = 15.0, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Starts a query and, when it fails, starts it again from its checkpoint after a pause, `tries` times in all; the
    last failure is raised. Returns the query once it has ended without one."""
    for k in range(tries):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if k + 1 == tries:
                raise
            wait(pause_s)
    raise ValueError("tries must be at least 1")


def deduplicated(messages: DataFrame, delay: str = LATENESS) -> DataFrame:
    """The first copy to arrive of each (vessel, time, type); state is dropped once the watermark has passed."""
    return messages.where("mmsi is not null and ts is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["mmsi", "ts", "message_type"])


def downsampled(messages: DataFrame, minutes: int = 10, delay: str = LATENESS) -> DataFrame:
    """First position of each vessel in each window, emitted when the watermark passes the window."""
    p = messages.where("mmsi is not null and ts is not null").withWatermark("ts", delay)
    return p.groupBy(F.window("ts", f"{minutes} minutes"), "mmsi").agg(F.min_by(F.struct("ts", "row_id", "lat", "lon"), F.struct("ts", "row_id")).alias("f")).select("mmsi", F.unix_micros("window.start").alias("window_us"), F.unix_micros("f.ts").alias("ts_us"), "f.row_id", "f.lat", "f.lon")


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives what its sink holds."""
    spark = stream.sparkSession
    out = scratch(spark, what)
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drained_to_the_end(messages: DataFrame, plan, what: str) -> DataFrame:
    """As `drained` for `plan` over a stream with a watermark on ts, with the windows that its end leaves open: a second
    run from the same checkpoint brings one message of the far future, which moves the watermark past all others."""
    spark = messages.sparkSession
    ends, out = scratch(spark, f"{what}-end"), scratch(spark, what)
    none = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in messages.schema])
    none.where("false").write.mode("overwrite").parquet(ends)
    stream = plan(messages.unionByName(spark.readStream.schema(messages.schema).parquet(ends)))
    for last in (False, True):
        if last:
            none.withColumns({"ts": F.lit("9000-01-01").cast("timestamp"), "mmsi": F.lit(-1).cast(messages.schema["mmsi"].dataType)}).write.mode("append").parquet(ends)
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


class LateCounter:
    """Counts per period kept right by a stream: the state of `late_counts` in a folder.

    The stream's rows carry (period_us, source, stage, seq): a source numbers what it counts, see
    `late_counts.numbered`. A batch adds the highest numbers that it brings under its own name, and reading merges by
    maximum, so a batch that comes again, under the same number or another, in any order, changes nothing. After
    `fold_after` batches what was added is folded into one state, which is written before the parts are removed; as
    maxima are idempotent, a failure between the two does no harm.
    """

    def __init__(self, spark: SparkSession, folder: str, fold_after: int = 32):
        self.spark, self.folder, self.fold_after = spark, folder, fold_after

    def _parts(self) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted((s.getPath().toString() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), key=str) if fs.exists(path) else []

    def state(self) -> DataFrame | None:
        """(period_us, source, at_end, final), merged."""
        parts = self._parts()
        return late_counts.merge(self.spark.read.parquet(*parts)) if parts else None

    def take(self, rows: DataFrame, batch: int) -> None:
        late_counts.deliveries(rows).write.mode("overwrite").parquet(f"{self.folder}/state/batch-{batch:012d}")
        parts = self._parts()
        if len(parts) > self.fold_after:
            late_counts.merge(self.spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{self.folder}/state/until-{batch:012d}")
            for part in parts:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(part)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def counts(self) -> DataFrame:
        """(period_us, n_at_end, n_final)."""
        return late_counts.period_counts(self.state())

    def run(self, stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


class ExactlyOnce:
    """Keeps one copy of each message over all batches of a stream: the ranges seen so far are the state.

    The state is stored by day of event time, each day whole and merged under the number of the batch that wrote it
    last. A batch reads the newest state before it of the days it brings (few, as late rows are), accepts what the
    ranges don't cover, and writes those days anew; what it replaces is removed with the next batch but one, so a batch
    that is repeated after a failure finds the same state and writes the same rows again. A batch's cost follows its
    own days and not the stream's age. The first copy to come in is kept; of copies in one batch the first received.
    """

    def __init__(self, spark: SparkSession, folder: str, *, producer: list[str], event_time: str = "ts", received: str = "received_at", row_id: str = "row_id"):
        self.spark, self.folder, self.event_time = spark, folder, event_time
        self.names = {"producer": producer, "event_time": event_time, "received": received, "row_id": row_id}

    def _batches(self, day: int) -> list[tuple[int, object, object]]:
        """(batch, path, file system) of a day's states, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seen/day={day}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(((int(s.getPath().getName().split("=")[1]), s.getPath(), fs) for s in fs.listStatus(path)), key=lambda x: x[0])

    def take(self, rows: DataFrame, batch: int) -> None:
        day = lambda us: F.floor(us / DAY)
        days = [r[0] for r in rows.select(day(F.unix_micros(self.event_time)).alias("d")).where("d is not null").distinct().collect()]
        states = {d: self._batches(d) for d in days}
        before = {d: [x for x in s if x[0] < batch][-1:] for d, s in states.items()}
        paths = [x[1].toString() for s in before.values() for x in s]
        seen = self.spark.read.parquet(*paths) if paths else None
        got = settle(exactly_once.accept(rows, **self.names, seen=seen))
        replace = lambda df, what, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{what}")
        replace(got.where("kind = 'accepted'").select("row_id", F.lit(batch).cast("long").alias("batch")), "accepted", ["batch"])
        state = got.where("kind in ('range', 'key')").withColumns({"day": day(F.when(F.col("kind") == "range", F.col("first") * 1000).otherwise(F.col("first"))), "batch": F.lit(batch).cast("long")})
        replace(state.repartition("day"), "seen", ["day", "batch"])
        for d, s in states.items():
            for number, path, fs in s:
                if before[d] and number < before[d][0][0]:
                    fs.delete(path, True)

    def accepted(self) -> DataFrame:
        """(row_id) of the rows that are kept."""
        return self.spark.read.parquet(f"{self.folder}/accepted").select("row_id")

    def run(self, stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def open_calls(stream: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Calls per vessel and port over days: the state of each is since when the vessel lies there.

    `stream` has (mmsi, ts, row_id, lat, lon, sog, port_lo, port_lat, port_lon): fixes with the places their vessel has
    named, a batch's fixes later than those of the batches before. A call opens with the first slow fix within 10 km of
    the port and closes with the first fix under way beyond it; one row a closed call. A vessel that leaves for another
    port closes its call here and opens one there. Null readings say nothing.
    """
    import numpy as np
    import pandas as pd

    schema = "mmsi long, port_lo string, arrival_us long, departure_us long"

    def step(key, frames, state):
        since = state.get[0] if state.exists else None
        f = pd.concat(list(frames), ignore_index=True)
        order = np.lexsort((f.row_id.to_numpy(), f.ts_us.to_numpy()))
        t, near = f.ts_us.to_numpy()[order], f.near.to_numpy()[order]
        t, near = np.r_[-1 if since is None else since, t], np.r_[since is not None, near]
        change = np.flatnonzero(near[1:] != near[:-1]) + 1
        edges = np.r_[t[:1], t[change]] if since is not None else t[change]
        closed = edges[: len(edges) // 2 * 2].reshape(-1, 2)
        if len(edges) % 2:
            state.update((int(edges[-1]),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"mmsi": np.full(len(closed), key[0]), "port_lo": [key[1]] * len(closed), "arrival_us": closed[:, 0], "departure_us": closed[:, 1]})

    km = geo.haversine_km("lat", "lon", "port_lat", "port_lon")
    near = F.when((F.col("sog") <= 1.0) & (km <= 10), True).when((F.col("sog") > 1.0) & (km > 10), False)
    narrow = stream.where("mmsi is not null and ts is not null and port_lo is not null").select("mmsi", "port_lo", "row_id", F.unix_micros("ts").alias("ts_us"), near.alias("near")).where("near is not null")
    calls = narrow.groupBy("mmsi", "port_lo").applyInPandasWithState(step, schema, "since long", "append", "NoTimeout")
    return calls.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
