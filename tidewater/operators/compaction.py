"""Many small line files into few well-sized ones, every message once.

Plan
1. Keys: in one pass over the files each line is parsed as JSON and reduced to a 128-bit digest of its canonical form
   (sorted keys, no spacing, no escapes). What comes of it, a row a file with the numbers and digests of its parseable
   lines, its counts of lines and an estimate of its compressed size, is settled; JSON isn't parsed again for writing.
2. Schedule: files are dealt to shards by the hash of their id, and each shard gives its files, longest first, to the
   least loaded of its output groups (a heap). Sizes are compressed ones, as the output's are. Shards and groups follow
   from all bytes, a shard holds about `SHARD_GROUPS` groups, so no task and not the driver ever holds all files.
3. Spark takes the first place (file, line) of each digest; partial aggregation collapses a message with millions of
   copies before the shuffle. The places are gathered per file.
4. Write: bodies are shuffled once, to the partition of their shard, sorted by group and streamed through pyarrow into
   one Parquet file a group, in row groups of `GROUP_ROWS` rows or `GROUP_BYTES` bytes; lines at which a message comes
   first are kept, other parseable lines are set aside as surplus in a second file, the rest (blank, cut off) is counted.
5. Verify and publish: files, lines and surplus must be those of the keys; then the kept files are read again, their
   messages digested anew, and number and two commutative digests of the digests must equal those of the distinct
   digests of the input. Then a manifest of the files that the successful tasks wrote is renamed into place, which
   makes the new files visible in one step. Files of failed or repeated tasks are in no manifest.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.arrow import over_groups
from tidewater.session import settle

KEPT = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("message", pa.large_string())])
SURPLUS = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32())])
#: Groups of a shard, most files of a shard; rows and bytes of a Parquet row group.
SHARD_GROUPS, SHARD_FILES = 4, 2_000_000
GROUP_ROWS, GROUP_BYTES = 100_000, 64 << 20
KEYS = "file_id long, raw long, packed double, lines long, blank long, nos array<int>, hi array<long>, lo array<long>"
MANIFEST = "group_id long, kept_path string, surplus_path string, files long, chars long, kept long, surplus long, unreadable long, blank long, lines long"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> float | int:
    """A JSON number with a fraction or exponent; integral values equal the integer, as in 1.0 and 1."""
    v = float(text)
    if v in (float("inf"), float("-inf")):
        raise ValueError(text)
    return int(v) if v.is_integer() and abs(v) < 2**53 else v


_decode = json.JSONDecoder(parse_constant=_no_constant, parse_float=_number).decode


def canonical(line: str) -> str | None:
    """The JSON value's canonical text; None where the line is no JSON. Of repeated object keys the last counts."""
    try:
        return json.dumps(_decode(line), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except (ValueError, RecursionError):
        return None


def digest(text: str) -> tuple[int, int]:
    """128 bits of BLAKE2b as two signed integers."""
    d = hashlib.blake2b(text.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def lines_of(body: str) -> list[str]:
    """Lines by LF, counted from 1; a CR before the LF belongs to the line's end, blank lines count."""
    return body.split("\n")


def file_keys(files: DataFrame, *, file_id: str, body: str) -> DataFrame:
    """A row a file (`KEYS`): its bytes, their estimated size when compressed, its lines and blank lines, and number and
    digest (128 bits of BLAKE2b) of every line that parses as JSON. Files with a null id or body have no row.

    A batch of files is compressed as a whole, as the output will be, and the ratio holds for each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("file_id", "raw", "packed", "lines", "blank", "nos", "hi", "lo")}
            whole = []
            for fid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nos, hi, lo, blank = [], [], [], 0
                lines = lines_of(text)
                for k, line in enumerate(lines, 1):
                    if not line.strip():
                        blank += 1
                    elif (c := canonical(line)) is not None:
                        x, y = digest(c)
                        nos.append(k)
                        hi.append(x)
                        lo.append(y)
                data = text.encode("utf-8", "surrogatepass")
                whole.append(data)
                for name, v in zip(cols, (fid, len(data), 0.0, len(lines), blank, nos, hi, lo), strict=True):
                    cols[name].append(v)
            every = b"".join(whole)
            ratio = len(pa.compress(every, codec="zstd", asbytes=True)) / len(every) if every else 1.0
            cols["packed"] = [n * ratio for n in cols["raw"]]
            long, ints, longs = pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
            types = (long, long, pa.float64(), long, long, ints, longs, longs)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], names=list(cols))

    return _bodies(files, file_id, body).mapInArrow(run, KEYS)


def _bodies(files: DataFrame, file_id: str, body: str) -> DataFrame:
    return files.select(F.col(file_id).cast("long").alias("file_id"), F.col(body).alias("body")).where("file_id is not null and body is not null")


def shards_of(total_bytes: float, files: int, target_bytes: int) -> tuple[int, int]:
    """How many shards, and how many groups in each."""
    shards = max(1, round(total_bytes / (SHARD_GROUPS * target_bytes)), -(-files // SHARD_FILES))
    return shards, max(1, round(total_bytes / (shards * target_bytes)))


def schedule(files: DataFrame, shards: int, groups: int, *, file_id: str, size: str) -> DataFrame:
    """(file_id, group_id): longest first onto the least loaded of the `groups` groups of the file's shard.

    Null or negative sizes count as 0; ties go by file id, then the lowest group. A file larger than a group's part
    has a group to itself as far as groups last. An empty table has no rows.
    """
    sized = files.select(F.col(file_id).cast("long").alias("file_id"), F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("size")).where("file_id is not null")

    def assign(cols: dict) -> dict:
        shard = int(cols["shard"][0])
        heap = [(0.0, g) for g in range(groups)]
        ids, to = cols["file_id"], []
        for s in cols["size"].tolist():
            load, g = heap[0]
            heapq.heapreplace(heap, (load + s, g))
            to.append(shard * groups + g)
        return {"file_id": ids, "group_id": to}

    dealt = sized.withColumn("shard", F.pmod(F.hash("file_id"), F.lit(shards)).cast("int")).withColumn("neg", -F.col("size"))
    return over_groups(dealt, ["shard"], ["neg", "file_id"], assign, "file_id long, group_id long")


def _sums(digests: DataFrame) -> DataFrame:
    """Number of digests and two sums over them in which their order plays no part but every one of them counts."""
    h = F.xxhash64("hi", "lo")
    return digests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"), F.coalesce(F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31))), F.lit(0)).alias("added"))


def compact(files: DataFrame, out: str, *, file_id: str = "file_id", body: str = "body", target_bytes: int = 128 << 20) -> str:
    """Compacts `files` (one row a file: id, text) below the folder `out`; returns the manifest's path.

    File ids must be unique; files with a null id or body hold no lines. Which copy of a message stays is fixed by
    the order of (file id, line number), so a second run gives the same content. `target_bytes` is the compressed size
    of an output file. Raises RuntimeError, and publishes nothing, where the files written don't hold every message of
    the input once. Data files are new on each run and old manifests stay readable until `out` is cleaned.
    """
    spark = files.sparkSession
    # settled: JSON is parsed once for the schedule, for what to keep and for what is verified
    keys = settle(file_keys(files, file_id=file_id, body=body))
    want = keys.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("lines", "lines"), ("blank", "blank"), ("parsed", F.size("nos").cast("long")), ("packed", "packed"))]).first()
    shards, groups = shards_of(want["packed"], want["files"], target_bytes)
    placed = schedule(keys, shards, groups, file_id="file_id", size="packed")
    line = keys.select("file_id", F.inline(F.arrays_zip("nos", "hi", "lo"))).select("hi", "lo", "file_id", F.col("nos").alias("line_no"))
    first = settle(line.groupBy("hi", "lo").agg(F.min(F.struct("file_id", "line_no")).alias("p")))
    keep = first.groupBy(F.col("p.file_id").alias("file_id")).agg(F.collect_list("p.line_no").alias("keep"))
    known = placed.join(keys.select("file_id", "nos"), "file_id").join(keep, "file_id", "left")
    # what to do with a file goes before its body in the partition of its shard: bodies move once and are never a side
    # of a join, which the planner might spread otherwise or broadcast
    row = "file_id long, turn int, group_id long, nos array<int>, keep array<int>, body string"
    none = lambda df: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ") for x in row.split(", "))])
    both = none(known.withColumn("turn", F.lit(0))).unionByName(none(_bodies(files, file_id, body).withColumn("turn", F.lit(1))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict | None = None
        for batch in batches:
            turn = batch.column("turn").to_pylist()
            bodies = [k for k, t in enumerate(turn) if t]
            plans = {k: r for k, r in zip((k for k, t in enumerate(turn) if not t), batch.select(["file_id", "group_id", "nos", "keep"]).filter(pa.array([not t for t in turn])).to_pylist(), strict=True)}
            ids, found = batch.column("file_id").to_pylist(), []
            for k, t in enumerate(turn):
                if not t:
                    if plan is not None and plan["file_id"] == ids[k]:
                        raise RuntimeError(f"file id {ids[k]} comes more than once")
                    plan = plans[k]
                elif plan is None or plan["file_id"] != ids[k]:
                    raise RuntimeError(f"file {ids[k]} has no keys")
                else:
                    found.append(plan)
            if bodies:
                at = pa.array(bodies)
                column = lambda name, t: pa.array([r[name] for r in found], t)  # noqa: B023, E731
                yield pa.record_batch([column("group_id", pa.int64()), batch.column("file_id").take(at), column("nos", pa.list_(pa.int32())), column("keep", pa.list_(pa.int32())), batch.column("body").take(at)], names=["group_id", "file_id", "nos", "keep", "body"])

    whole = both.repartition(shards, "file_id").sortWithinPartitions("file_id", "turn").mapInArrow(meet, "group_id long, file_id long, nos array<int>, keep array<int>, body string")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: OutputGroup | None = None
        for batch in batches:
            for g, fid, nos, stay, text in zip(*(batch.column(c).to_pylist() for c in ("group_id", "file_id", "nos", "keep", "body")), strict=True):
                if open_group is None or g != open_group.group:
                    if open_group is not None:
                        yield open_group.close()
                    open_group = OutputGroup(out, g)
                open_group.add(fid, lines_of(text), nos, set(stay or ()))
        if open_group is not None:
            yield open_group.close()

    # settled at once: what counts is the manifest of the tasks that succeeded, and it must be the same when read again
    written = settle(whole.sortWithinPartitions("group_id", "file_id").mapInArrow(write, MANIFEST))
    verify(spark, out, written, want, first)
    return publish(spark, written, out)


class OutputGroup:
    """One output group's files: rows wait until they make a row group."""

    most_rows, most_bytes = GROUP_ROWS, GROUP_BYTES

    def __init__(self, out: str, group: int):
        filesystem, root = pafs.FileSystem.from_uri(out)
        filesystem.create_dir(f"{root}/data", recursive=True)
        name = f"{root}/data/{group:08d}-{uuid.uuid4().hex}"
        self.group = group
        self.row = {"group_id": group, "kept_path": f"{name}.kept.parquet", "surplus_path": f"{name}.surplus.parquet"} | dict.fromkeys(("files", "chars", "kept", "surplus", "unreadable", "blank", "lines"), 0)
        self.streams = [filesystem.open_output_stream(self.row[k]) for k in ("kept_path", "surplus_path")]
        self.writers = [pq.ParquetWriter(s, schema, compression="zstd") for s, schema in zip(self.streams, (KEPT, SURPLUS), strict=True)]
        self.waiting: list[tuple[list, ...]] = [([], [], []), ([], [])]
        self.waiting_bytes = 0

    def add(self, fid: int, lines: list[str], nos: list[int], stay: set[int]) -> None:
        kept, surplus = self.waiting
        parsed = set(nos)
        row = self.row
        for k, line in enumerate(lines, 1):
            if k in stay:
                text = line.rstrip("\r")
                for column, v in zip(kept, (fid, k, text), strict=True):
                    column.append(v)
                row["kept"] += 1
                self.waiting_bytes += len(text)
            elif k in parsed:
                surplus[0].append(fid)
                surplus[1].append(k)
                row["surplus"] += 1
            else:
                row["blank" if not line.strip() else "unreadable"] += 1
            row["chars"] += len(line) + 1
            if len(kept[0]) >= self.most_rows or self.waiting_bytes >= self.most_bytes or len(surplus[0]) >= 10 * self.most_rows:
                self.flush()
        row["chars"] -= 1
        row["files"] += 1
        row["lines"] += len(lines)

    def flush(self) -> None:
        for writer, columns, schema in zip(self.writers, self.waiting, (KEPT, SURPLUS), strict=True):
            if columns[0]:
                t = pa.table([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)
                writer.write_table(t, row_group_size=t.num_rows)
                for v in columns:
                    v.clear()
        self.waiting_bytes = 0

    def close(self) -> pa.RecordBatch:
        """The group's row of the manifest, once everything is on disk: a stream that fails to close fails the task."""
        self.flush()
        for x in (*self.writers, *self.streams):
            x.close()
        return pa.RecordBatch.from_pylist([self.row], pa.schema([(k, pa.string() if k.endswith("path") else pa.int64()) for k in self.row]))


def verify(spark: SparkSession, out: str, written: DataFrame, want, first: DataFrame) -> None:
    """Raises RuntimeError unless what was written accounts for every file and line and holds each message once."""
    got = written.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "kept", "surplus", "unreadable", "blank", "lines")]).first()
    expected = {"files": want["files"], "lines": want["lines"], "blank": want["blank"], "unreadable": want["lines"] - want["blank"] - want["parsed"], "surplus": want["parsed"] - got["kept"]}
    wrong = {k: (got[k], v) for k, v in expected.items() if got[k] != v}
    if wrong:
        raise RuntimeError(f"the written files don't account for what the input holds (written, expected): {wrong}")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for path, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(path) as f:
                    texts = pq.ParquetFile(f).read_row_group(group, columns=["message"]).column(0)
                    for part in texts.chunks:
                        pairs = [digest(canonical(m)) for m in part.to_pylist()]
                        yield pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["hi", "lo"])

    def row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with filesystem.open_input_file(path) as f:
                    n = pq.ParquetFile(f).num_row_groups
                yield pa.record_batch([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32())], names=["path", "part"])

    # a row group is work for seconds however few bytes its name has, so tasks aren't merged by size
    parts = written.select("kept_path").mapInArrow(row_groups, "path string, part int").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    held, distinct = _sums(parts.mapInArrow(again, "hi long, lo long")).first(), _sums(first).first()
    if held != distinct:
        raise RuntimeError(f"the written files hold {held}, the input's distinct messages are {distinct}")


def publish(spark: SparkSession, manifest: DataFrame, out: str) -> str:
    """Writes the manifest beside the data and points CURRENT to it by a rename, which is atomic."""
    name = f"manifest-{uuid.uuid4().hex}"
    manifest.write.parquet(f"{out}/{name}")
    filesystem, root = pafs.FileSystem.from_uri(out)
    with filesystem.open_output_stream(f"{root}/{name}.pointer") as f:
        f.write(name.encode())
    filesystem.move(f"{root}/{name}.pointer", f"{root}/CURRENT")
    return f"{out}/{name}"


def current_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The manifest that CURRENT names."""
    filesystem, root = pafs.FileSystem.from_uri(out)
    with filesystem.open_input_stream(f"{root}/CURRENT") as f:
        return spark.read.parquet(f"{out}/{f.read().decode()}")


def _listed(spark: SparkSession, out: str, column: str, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows of the files in one column of the manifest, read through pyarrow by tasks: the driver needs no list of files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with filesystem.open_input_file(path) as f:
                    for b in pq.ParquetFile(f).iter_batches(20_000, columns=schema.names):
                        yield b.cast(schema)

    return current_manifest(spark, out).select(column).repartition(column).mapInArrow(read, ddl)


def published_messages(spark: SparkSession, out: str) -> DataFrame:
    """(file_id, line_no, message) of the current manifest."""
    return _listed(spark, out, "kept_path", pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("message", pa.string())]), "file_id long, line_no int, message string")


def set_aside(spark: SparkSession, out: str) -> DataFrame:
    """(file_id, line_no) of the lines that repeat a message which is kept elsewhere."""
    return _listed(spark, out, "surplus_path", SURPLUS, "file_id long, line_no int")
