"""Captures on disk, and typed views of them. Schemas are declared; bad rows are dropped by filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import modes
from ..schema import FRAMES


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture CSV files as frames, without missing ticks and payloads that are no hex."""
    return clean(spark.read.schema(FRAMES).option("header", True).option("mode", "DROPMALFORMED").csv(path))


def clean(frames: DataFrame) -> DataFrame:
    return frames.where((F.col("timestamp_corrected") != 0) & F.col("raw_hex").rlike("^([0-9a-f]{2})+$"))


def land(frames: DataFrame, path: str) -> None:
    """Parquet by station and day: later scans prune by both."""
    day = F.to_date(F.timestamp_micros(F.floor(F.col("recv_utc_ns") / 1000).cast("long")))
    frames.withColumn("day", day).repartition("station", "day").sortWithinPartitions("recv_utc_ns").write.mode("errorifexists").partitionBy("station", "day").parquet(path)


def numbered(frames: DataFrame) -> DataFrame:
    """Adds id = station:row number by (time, tick, payload): the same on every run."""
    w = Window.partitionBy("station").orderBy("recv_utc_ns", "timestamp_corrected", "raw_hex")
    return frames.withColumn("id", F.concat("station", F.lit(":"), F.row_number().over(w) - 1))


def observations(frames: DataFrame) -> DataFrame:
    """Frames as association input, df and direct address decoded."""
    m = modes.decode(F.col("raw_hex"))
    df = frames.withColumn("_m", m)
    direct = F.when(F.col("_m.df").isin(11, 17), F.col("_m.icao"))
    return df.select("id", "station", F.col("timestamp_corrected").alias("tick"), F.col("recv_utc_ns").alias("utc_ns"), "raw_hex", F.col("_m.df").alias("df"), direct.alias("icao"), F.when(F.col("beast_type") == 1, "modeac").otherwise("modes").alias("family"))


def mode_ac(frames: DataFrame) -> DataFrame:
    """Two-byte payloads with their code, numbered by tick within the station."""
    w = Window.partitionBy("station").orderBy("timestamp_corrected", "raw_hex", "recv_utc_ns")
    raw = F.conv("raw_hex", 16, 10).cast("int")
    return frames.where("beast_type = 1 and length(raw_hex) = 4").withColumns({"raw": raw, "seq": F.row_number().over(w) - 1}).withColumns({"code": modes.mode_a(F.col("raw")), "spi": modes.spi(F.col("raw")), "altitude_hundreds": modes.gillham(F.col("raw"))})


def known_addresses(frames: DataFrame) -> DataFrame:
    """Addresses heard directly: what parity-derived ones are checked against (left_semi)."""
    m = frames.withColumn("_m", modes.decode(F.col("raw_hex")))
    return m.where("_m.df in (11, 17)").select(F.col("_m.icao").alias("icao")).distinct()


def acceptance(frames: DataFrame) -> DataFrame:
    """Per station: frames, first and last time, span, share of missing ticks, most frames in a second."""
    g = frames.groupBy("station").agg(F.count("*").alias("frames"), F.min("recv_utc_ns").alias("first_ns"), F.max("recv_utc_ns").alias("last_ns"), F.count_if(F.col("timestamp_corrected") == 0).alias("missing_ticks"))
    return g.withColumn("span_s", (F.col("last_ns") - F.col("first_ns")) / 1e9)


def common_window(frames: DataFrame) -> DataFrame:
    """Frames within the time that all stations share."""
    w = frames.groupBy("station").agg(F.min("recv_utc_ns").alias("a"), F.max("recv_utc_ns").alias("z")).agg(F.max("a").alias("a"), F.min("z").alias("z"))
    return frames.crossJoin(F.broadcast(w)).where("recv_utc_ns between a and z").drop("a", "z")  # one row


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def truth_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sampled position reports, one row a position: utc_ns, icao, lat, lon, alt_m."""
    s = "samples array<struct<utc: double, positions: array<struct<icao: string, lat: double, lon: double, altitude_ft: double>>>>"
    d = spark.read.schema(s).option("multiLine", True).json(path)
    p = d.select(F.explode("samples").alias("s")).select("s.utc", F.explode("s.positions").alias("p"))
    return p.select((F.col("utc") * 1e9).cast("long").alias("utc_ns"), "p.icao", "p.lat", "p.lon", (F.col("p.altitude_ft") * 0.3048).alias("alt_m"))
