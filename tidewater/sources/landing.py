"""The raw landing zone and other inputs: NDJSON envelopes, NOAA-style CSV, port lists, folder listings, footers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import domain, text, timefns
from tidewater.functions.geo import SHARDS

_DIMENSION = "STRUCT<A: DOUBLE, B: DOUBLE, C: DOUBLE, D: DOUBLE>"
#: What any message type may hold; a type's own struct leaves the rest null. Explicit, so nothing is inferred.
BODY = (
    "STRUCT<UserID: BIGINT, MessageID: INT, Valid: BOOLEAN, Sog: DOUBLE, Cog: DOUBLE, TrueHeading: INT, NavigationalStatus: INT, RateOfTurn: INT, PositionAccuracy: BOOLEAN, Raim: BOOLEAN, "
    "Name: STRING, CallSign: STRING, ImoNumber: BIGINT, Type: INT, AisVersion: INT, "
    f"Dimension: {_DIMENSION}, MaximumStaticDraught: DOUBLE, Destination: STRING, "
    "Eta: STRUCT<Month: INT, Day: INT, Hour: INT, Minute: INT>, Dte: BOOLEAN, FixType: INT, OffPosition: BOOLEAN, VirtualAtoN: BOOLEAN, "
    "ReportA: STRUCT<Name: STRING, Valid: BOOLEAN>, "
    f"ReportB: STRUCT<CallSign: STRING, ShipType: INT, FixType: INT, Valid: BOOLEAN, Dimension: {_DIMENSION}>>"
)
ENVELOPE = f"message_type STRING, metadata STRUCT<MMSI: BIGINT, ShipName: STRING, latitude: DOUBLE, longitude: DOUBLE, time_utc: STRING>, message MAP<STRING, {BODY}>, received_at STRING, listener_id STRING"


def parse(df: DataFrame, column: str, name: str = "__m") -> DataFrame:
    """Adds the envelope in a JSON column as a struct, null where it is no JSON; keeps the text as __raw."""
    return df.withColumn("__raw", F.col(column)).withColumn(name, F.from_json(column, ENVELOPE))


def read_ndjson(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """Envelopes from NDJSON files, plain or compressed (gz by the name; for zst see `read_zst`); malformed lines are
    dropped. With `base`, folders key=value below it become columns and prune the listing.
    """
    lines = spark.read.option("basePath", base).text(list(paths)) if base else spark.read.text(list(paths))
    return parse(lines, "value").where("__m is not null and __m.message_type is not null")


def zst_lines(files: DataFrame) -> DataFrame:
    """(value) of the lines of zstd files given as `content`; a file that is cut off gives its whole lines so far."""
    import pyarrow as pa

    def run(batches):
        import io

        import zstandard

        for batch in batches:
            for content in batch.column(0).to_pylist():
                held = []
                try:
                    for line in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(content), "utf-8", errors="replace", newline="\n"):
                        held.append(line.rstrip("\r\n"))
                        if len(held) >= 20_000:
                            yield pa.record_batch([pa.array(held, pa.string())], names=["value"])
                            held = []
                except zstandard.ZstdError:
                    pass
                if held:
                    yield pa.record_batch([pa.array(held, pa.string())], names=["value"])

    return files.select("content").mapInArrow(run, "value string")


def read_zst(spark: SparkSession, *paths: str, pattern: str = "*.zst") -> DataFrame:
    """Envelopes from zstd NDJSON files below the paths, without a native codec of the file system; malformed lines are
    dropped. A file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(list(paths))
    return parse(zst_lines(files), "value").where("__m is not null and __m.message_type is not null")


def read_window(spark: SparkSession, root: str, day: date, back: int = 7) -> DataFrame:
    """Envelopes that landed on `day` or in the days before it, year=/month=/day= folders below `root`.

    Late messages lie in later folders than their event time, so what is derived for a day is derived again from the
    window that ends with it. Days without a folder are passed over; numbers may have leading zeros or not.
    """
    paths = []
    for k in range(back + 1):
        d = day - timedelta(k)
        for text in (f"year={d.year}/month={d.month:02d}/day={d.day:02d}", f"year={d.year}/month={d.month}/day={d.day}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{text}")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and path.toString() not in paths:
                paths.append(path.toString())
    if not paths:
        return parse(spark.createDataFrame([], "value string"), "value")
    return parse(spark.read.option("basePath", root).option("recursiveFileLookup", True).text(paths), "value").where("__m is not null and __m.message_type is not null")


def legacy_fields(text_column: str) -> dict[str, Column]:
    """Vessel, time and place from older envelopes, which name them in two ways and may hold a header's words."""
    at = lambda k: F.get_json_object(text_column, f"$.metadata.{k}")
    number = lambda *ks: F.coalesce(*[F.nullif(at(k), F.lit(k)).try_cast("bigint") for k in ks])
    kind = F.get_json_object(text_column, "$.message_type")
    user = F.call_function("get_json_object", F.col(text_column), F.concat(F.lit("$.message."), kind, F.lit(".UserID"))).try_cast("bigint")
    place = lambda *ks: F.coalesce(*[at(k).try_cast("double") for k in ks])
    return {
        "mmsi": F.coalesce(number("MMSI", "mmsi"), user),
        "ts": F.coalesce(timefns.feed_timestamp(at("time_utc")), timefns.feed_timestamp(at("timestamp"))),
        "lat": place("latitude", "lat"),
        "lon": place("longitude", "lon"),
    }


def small_files(spark: SparkSession, folder: str, pattern: str = "*.ndjson") -> DataFrame:
    """Text files below a folder as rows (file_id, path, n_bytes, body), for `compaction.compact`.

    The id is a digest of the path, so it stays the same from run to run. Sizes come from the listing; a body is only
    read where it is used.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.xxhash64("path").alias("file_id"), "path", F.col("length").alias("n_bytes"), F.col("content").cast("string").alias("body"))


def bodies(files: DataFrame, body: str = "body") -> DataFrame:
    """Envelopes of files that are rows of a table."""
    return parse(files.select(F.explode(F.split(body, "\n")).alias("value")), "value").where("__m is not null and __m.message_type is not null")


def valid(parsed: DataFrame) -> DataFrame:
    """What ingestion keeps: a vessel and a place that is there; zero is a place."""
    return parsed.where(F.col("__m.metadata.MMSI").isNotNull() & domain.placed("__m.metadata.latitude", "__m.metadata.longitude"))


def flatten(parsed: DataFrame, fallback: bool = False) -> DataFrame:
    """The 40 silver columns from the envelope struct `__m`; other columns are kept. Rows without a vessel are left out.

    The vessel is the metadata's, with `fallback` where that is missing the message's own user.
    """
    m, kind = F.col("__m"), F.col("__m.message_type")
    own = F.try_element_at(m["message"], kind)
    report = F.try_element_at(m["message"], F.lit("StaticDataReport"))
    ts = timefns.feed_timestamp(m["metadata"]["time_utc"])
    side = lambda k: F.coalesce(own["Dimension"][k], report["ReportB"]["Dimension"][k], F.lit(0.0))
    # the key 'Fixtype' differs from 'FixType' in case only, which a struct can't hold
    other_fix = F.call_function("get_json_object", F.col("__raw"), F.concat(F.lit("$.message."), kind, F.lit(".Fixtype"))).try_cast("int")
    kept = [c for c in parsed.columns if not c.startswith("__")]
    e = own["Eta"]
    vessel = F.coalesce(m["metadata"]["MMSI"], own["UserID"]) if fallback else m["metadata"]["MMSI"]
    staged = parsed.where(vessel.isNotNull()).withColumn("__ts", ts)
    cols: dict[str, Column] = {
        "message_type": kind,
        "mmsi": vessel,
        "ts": F.col("__ts"),
        "lat": m["metadata"]["latitude"],
        "lon": m["metadata"]["longitude"],
        "received_at": F.try_to_timestamp(m["received_at"]),
        "source_listener": m["listener_id"],
        "sog": own["Sog"],
        "cog": own["Cog"],
        "true_heading": own["TrueHeading"],
        "navigational_status": own["NavigationalStatus"],
        "rate_of_turn": own["RateOfTurn"],
        "message_id": own["MessageID"],
        "position_accuracy": own["PositionAccuracy"],
        "raim": own["Raim"],
        "valid": own["Valid"],
        "name": F.coalesce(own["Name"], report["ReportA"]["Name"], F.nullif(m["metadata"]["ShipName"], F.lit(""))),
        "call_sign": F.coalesce(own["CallSign"], report["ReportB"]["CallSign"]),
        "imo_number": own["ImoNumber"],
        "ship_type": F.coalesce(own["Type"], report["ReportB"]["ShipType"]),
        "ais_version": own["AisVersion"],
        "length": side("A") + side("B"),
        "width": side("C") + side("D"),
        "dimension_a": side("A"),
        "dimension_b": side("B"),
        "dimension_c": side("C"),
        "dimension_d": side("D"),
        "max_static_draught": own["MaximumStaticDraught"],
        "destination": own["Destination"],
        "eta": F.when((kind == "ShipStaticData") & e.isNotNull(), timefns.eta_with_year("__ts", e["Month"], e["Day"], e["Hour"], e["Minute"])),
        "dte": own["Dte"],
        "fix_type": F.coalesce(own["FixType"], other_fix),
        "type_of_aton": F.when(kind == "AidsToNavigationReport", own["Type"]),
        "off_position": own["OffPosition"],
        "virtual_aton": own["VirtualAtoN"],
        "raw_message": F.lit(None).cast("string"),
        "metadata_json": F.lit(None).cast("string"),
        "year": F.year("__ts"),
        "month": F.month("__ts"),
        "day": F.dayofmonth("__ts"),
    }
    return staged.select(*[c for c in kept if c not in cols], *[v.alias(k) for k, v in cols.items()])


def shards(spark: SparkSession) -> DataFrame:
    """The feed's quarters of the world, five rows."""
    return spark.createDataFrame([(k, *v) for k, v in SHARDS.items()], "shard string, south double, west double, north double, east double")


def by_shard(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with every shard whose box they lie in; a row on a border lies in both."""
    s = F.broadcast(shards(df.sparkSession))  # five rows
    return df.join(s, F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east")))


NOAA = ("mmsi", "base_date_time", "longitude", "latitude", "sog", "cog", "heading", "vessel_name", "imo", "call_sign", "vessel_type", "status", "length", "width", "draft", "cargo", "transceiver")


def noaa_positions(raw: DataFrame) -> DataFrame:
    """Typed columns from the all-text rows of a NOAA-style day; unreadable values become null."""
    have = {c.lower(): c for c in raw.columns}
    col = lambda k: text.without_tokens(F.col(have[k])) if k in have else F.lit(None).cast("string")
    device = F.upper(F.coalesce(col("transceiver"), col("transceiver_class")))
    return raw.select(
        text.tolerant_int(col("mmsi")).alias("mmsi"),
        timefns.epoch_rounded(F.try_to_timestamp(col("base_date_time"))).alias("ts"),
        *[col(k).try_cast("float").alias(n) for k, n in (("latitude", "lat"), ("longitude", "lon"), ("sog", "sog"), ("cog", "cog"), ("draft", "draft"))],
        *[text.tolerant_int(col(k), t).alias(n) for k, t, n in (("heading", "smallint", "heading"), ("vessel_type", "smallint", "vessel_type"), ("status", "tinyint", "status"), ("length", "smallint", "length_m"), ("width", "smallint", "width_m"), ("cargo", "smallint", "cargo"))],
        col("vessel_name").alias("vessel_name"),
        text.imo(col("imo")).alias("imo_number"),
        col("call_sign").alias("call_sign"),
        F.when(device == "A", F.lit(1)).when(device == "B", F.lit(2)).cast("tinyint").alias("transceiver_class"),
    )


def noaa_vessels(positions: DataFrame) -> DataFrame:
    """One row a vessel: the most complete of what it has sent, the newest of equals."""
    named = positions.where("mmsi is not null and vessel_name is not null").withColumn("score", sum((F.col(c).isNotNull().cast("int") for c in ("vessel_name", "call_sign", "imo_number", "length_m", "width_m")), F.lit(0)))
    best = F.max_by(F.struct("vessel_name", "imo_number", "call_sign", "vessel_type", "length_m", "width_m", "transceiver_class"), F.struct("score", F.coalesce("ts", F.lit(-1)), "vessel_name", F.coalesce("imo_number", F.lit(-1)))).alias("b")
    return named.groupBy("mmsi").agg(best).select("mmsi", "b.*")


def read_noaa(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV with a header, every column text; short rows are padded with nulls."""
    return noaa_positions(spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(list(paths)))


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """The port dimension from a UN/LOCODE-style CSV; of a repeated code the first row of the file counts.

    The file is one small reference list: it is read as one partition, whose row order is the file's.
    """
    raw = spark.read.option("header", True).csv(path).coalesce(1).withColumn("__row", F.monotonically_increasing_id())
    lat, lon = text.coordinate("Coordinates")
    ports = raw.select(
        F.concat(F.trim("Country"), F.trim("Location")).alias("lo_code"),
        F.trim("Country").alias("country"),
        F.trim("Name").alias("name"),
        F.trim("NameWoDiacritics").alias("name_ascii"),
        F.col("Function").contains("1").cast("int").alias("is_port"),
        F.col("Coordinates").alias("coord_raw"),
        F.col("Subdivision").alias("subdivision"),
        F.col("Status").alias("status"),
        lat.alias("lat"),
        lon.alias("lon"),
        "__row",
    )
    first = ports.groupBy("lo_code").agg(F.min_by(F.struct(*[c for c in ports.columns if c not in ("lo_code", "__row")]), "__row").alias("p"))
    return first.select("lo_code", "p.*")


def missing_days(spark: SparkSession, have: DataFrame, first: str, last: str, day: str = "date") -> DataFrame:
    """Days from first to last (inclusive) for which `have` has no row."""
    days = spark.sql("select explode(sequence(date(:a), date(:b), interval 1 day)) as date", args={"a": first, "b": last})
    return days.join(have.select(F.col(day).cast("date").alias("date")).distinct(), "date", "left_anti")


def day_range(first: str, last: str) -> list[str]:
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    return [(a + timedelta(k)).isoformat() for k in range((b - a).days + 1)]


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Row-group statistics of Parquet files: one row a file, group and column. Footers only, read by tasks."""
    import pyarrow as pa

    names = spark.read.parquet(path).select(F.input_file_name().alias("file")).distinct()

    def run(batches):
        import urllib.parse

        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                filesystem, at = fs.FileSystem.from_uri(name)
                with filesystem.open_input_file(urllib.parse.unquote(at)) as f:
                    meta = pq.ParquetFile(f).metadata
                    for g in range(meta.num_row_groups):
                        for k in range(meta.num_columns):
                            c = meta.row_group(g).column(k)
                            s = c.statistics
                            has = s is not None and s.has_min_max
                            rows.append((name, g, c.path_in_schema, meta.row_group(g).num_rows, str(s.min) if has else None, str(s.max) if has else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.string()), pa.array(list(cols[3]), pa.int64()), pa.array(list(cols[4]), pa.string()), pa.array(list(cols[5]), pa.string())], names=["file", "row_group", "column", "rows", "low", "high"])

    return names.mapInArrow(run, "file string, row_group int, column string, rows long, low string, high string")
