"""Clock calibration between pairs of receivers from position reports that both heard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIGHT_MPS, TICKS_PER_US
from ..functions import geo, modes, stats
from .matching import nearest_gate
from .sequences import latest_pair

GATE_NS, MAX_PAIR_AGE_NS = 200_000_000, 10_000_000_000


def positions(reports: DataFrame, max_age_ns: int = MAX_PAIR_AGE_NS) -> DataFrame:
    """reports(..., icao, utc_ns, altitude_ft, cpr_odd, cpr_lat, cpr_lon) -> the same with lat, lon, alt_m where the
    latest even and odd report of the aircraft decode together and the result is plausible."""
    rows = reports.where("cpr_lat is not null and altitude_ft is not null").withColumn("_spot", F.struct("utc_ns", "cpr_lat", "cpr_lon"))
    rows = latest_pair(rows, ["icao"], ["utc_ns", "raw_hex"], F.col("cpr_odd"), "_spot").where("last_even is not null and last_odd is not null")
    e, o = F.col("last_even"), F.col("last_odd")
    rows = rows.where(F.abs(e["utc_ns"] - o["utc_ns"]) <= max_age_ns)
    spot = modes.global_position(e["cpr_lat"], e["cpr_lon"], o["cpr_lat"], o["cpr_lon"], o["utc_ns"] > e["utc_ns"])
    rows = rows.withColumn("_p", spot).where("_p is not null").withColumn("alt_m", F.col("altitude_ft") * 0.3048)
    return rows.select(*reports.columns, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), "alt_m").where(geo.inside_box("lat", "lon", "alt_m"))


def common_reports(frames: DataFrame, a: str, b: str, gate_ns: int = GATE_NS) -> DataFrame:
    """Equal payloads that both stations heard, by the nearest-in-time rule: raw_hex, utc_ns, ta, tb."""
    side = lambda s, k: frames.where(F.col("station") == s).select("raw_hex", F.col("recv_utc_ns").alias(f"utc_{k}"), F.col("timestamp_corrected").alias(f"t{k}"), F.struct("recv_utc_ns", "timestamp_corrected", "raw_hex").alias(f"id_{k}"))
    near = nearest_gate(side(a, "a"), side(b, "b"), ["raw_hex"], "utc_a", "utc_b", "id_a", "id_b", gate_ns)
    return near.select("raw_hex", F.col("utc_a").alias("utc_ns"), "ta", "tb")


def samples(frames: DataFrame, stations: DataFrame, a: str, b: str) -> DataFrame:
    """Clock samples of a pair: station_a, station_b, utc_ns, icao, ta, tb, geom_ticks, tb_clock (whole ticks and
    a fraction apart, so that no tick loses digits)."""
    reports = common_reports(frames, a, b).withColumn("m", modes.decode(F.col("raw_hex"))).where("m.df = 17").select("raw_hex", "utc_ns", "ta", "tb", "m.icao", "m.altitude_ft", "m.cpr_odd", "m.cpr_lat", "m.cpr_lon")
    at = positions(reports)
    place = lambda s, k: stations.where(F.col("name") == s).select(geo.geodetic_to_ecef("lat", "lon", "alt_m").alias(k))
    at = at.withColumn("_p", geo.geodetic_to_ecef("lat", "lon", "alt_m")).crossJoin(F.broadcast(place(a, "_a"))).crossJoin(F.broadcast(place(b, "_b")))  # one row each
    geom = (geo.distance_3d(F.col("_p"), F.col("_b")) - geo.distance_3d(F.col("_p"), F.col("_a"))) / LIGHT_MPS * TICKS_PER_US * 1e6
    return at.select(F.lit(a).alias("station_a"), F.lit(b).alias("station_b"), "utc_ns", "icao", "ta", "tb", geom.alias("geom_ticks"))


def links(sample: DataFrame, least: int = 20, least_quality: int = 100) -> DataFrame:
    """station_a, station_b, origins, samples, slope, offset_ticks, relative_clock_ppm, residual percentiles, quality.
    tb - geom = slope * ta + offset, fitted on ticks less their origin."""
    keys = ["station_a", "station_b"]
    origin = sample.groupBy(*keys).agg(F.min("ta").alias("origin_a"), F.min("tb").alias("origin_b"))
    rows = sample.join(F.broadcast(origin), keys).withColumn("_x", (F.col("ta") - F.col("origin_a")).cast("double")).withColumn("_y", (F.col("tb") - F.col("origin_b")) - F.col("geom_ticks"))
    fit = rows.groupBy(*keys, "origin_a", "origin_b").agg(F.count("*").alias("samples"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("offset_ticks"))
    left = rows.join(F.broadcast(fit.select(*keys, "slope", "offset_ticks")), keys).withColumn("_r", F.abs(F.col("_y") - F.col("slope") * F.col("_x") - F.col("offset_ticks")) / TICKS_PER_US)
    shape = left.groupBy(*keys).agg(*[F.percentile("_r", p).alias(f"{n}_us") for n, p in stats.BUNDLE.items() if n != "p75"])
    out = fit.join(shape, keys).withColumn("relative_clock_ppm", (F.col("slope") - 1) * 1e6)
    out = out.withColumns({c: F.when(F.col("samples") >= least, F.col(c)) for c in ("slope", "offset_ticks", "relative_clock_ppm")})
    return out.withColumn("quality", stats.clock_quality(F.col("samples"), F.col("p95_us"), least_quality))


def transforms(link: DataFrame, reference: str) -> DataFrame:
    """station, origin, slope, offset of the links from the reference; the reference itself is the identity."""
    of = link.where((F.col("station_a") == reference) & F.col("slope").isNotNull())
    return of.select(F.col("station_b").alias("station"), "origin_a", "origin_b", "slope", "offset_ticks")


def normalise(frames: DataFrame, tf: DataFrame, reference: str) -> DataFrame:
    """Adds norm: ticks of the reference's clock. Whole-number origins are taken off before anything becomes a double.
    Frames of stations without a link have a null norm."""
    j = frames.join(F.broadcast(tf), "station", "left")
    norm = ((F.col("timestamp_corrected") - F.col("origin_b")).cast("double") - F.col("offset_ticks")) / F.col("slope") + F.col("origin_a")
    return j.withColumn("norm", F.when(F.col("station") == reference, F.col("timestamp_corrected").cast("double")).otherwise(norm)).drop("origin_a", "origin_b", "slope", "offset_ticks")


def sigma_us(link: DataFrame) -> DataFrame:
    """station_a, station_b, sigma: the p95 residual, one microsecond at least, ten without a fit."""
    return link.select("station_a", "station_b", F.coalesce(F.greatest(F.col("p95_us"), F.lit(1.0)), F.lit(10.0)).alias("sigma_us"))
