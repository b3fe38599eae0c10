"""Reports and serving views: each endpoint or summary as a query over results."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Station
from ..functions import geo, stats
from ..operators import matching, planner, solver
from ..operators.association import ecef
from . import synthetic

#: Order of qualities.
QUALITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


# --- serving --------------------------------------------------------------------------------------


def receivers(frames: DataFrame, now_ns: int, stale_s: float = 10.0) -> DataFrame:
    """station, frames, last_seen_ns, state: connected if heard lately."""
    g = frames.groupBy("station").agg(F.count("*").alias("frames"), F.max("recv_utc_ns").alias("last_seen_ns"))
    return g.withColumn("state", F.when(F.lit(now_ns) - F.col("last_seen_ns") <= stale_s * 1e9, "connected").otherwise("silent"))


def clocks(links: DataFrame) -> DataFrame:
    return links.select("station_a", "station_b", "samples", "relative_clock_ppm", "p50_us", "p95_us", "quality")


def tracks(current: DataFrame, min_quality: str = "LOW") -> DataFrame:
    """Live tracks at or above a quality."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in QUALITY_RANK.items() for x in kv]), F.col("quality"))
    return current.where((F.coalesce(rank, F.lit(0)) >= QUALITY_RANK[min_quality]) & (F.col("state") != "EXPIRED"))


def track_stats(current: DataFrame) -> DataFrame:
    return current.groupBy("state", "quality").agg(F.count("*").alias("n"))


def latency(log: DataFrame, value: str = "latency_s") -> DataFrame:
    """count, p50 and p95 by nearest rank: the live endpoint's rule."""
    mid, top = (stats.nearest_rank(log, [], value, p).select(F.col("nearest_rank").alias(n)) for p, n in ((0.5, "p50"), (0.95, "p95")))
    return log.agg(F.count(value).alias("count")).join(mid).join(top)  # one row each


def health(frames: DataFrame, links: DataFrame, now_ns: int) -> DataFrame:
    """One row: stations connected, links usable, status."""
    a = receivers(frames, now_ns).agg(F.count_if(F.col("state") == "connected").alias("connected"), F.count("*").alias("stations"))
    b = links.agg(F.count_if(F.col("slope").isNotNull()).alias("links_ready"), F.count("*").alias("links"))
    ok = (F.col("connected") == F.col("stations")) & (F.col("links_ready") == F.col("links"))
    return a.join(b).withColumn("status", F.when(ok, "ok").otherwise("degraded"))


# --- evaluation -----------------------------------------------------------------------------------


def evaluate(solutions: DataFrame, truth: DataFrame, on: list[str], tq: str, tp: str, bracket, lone) -> DataFrame:
    """solutions(event_id, lat, lon, tq, on) with interpolated truth and east, north and horizontal error in metres."""
    cols = truth.select(*on, F.col(tp), F.col("lat").alias("truth_lat"), F.col("lon").alias("truth_lon"))
    j = matching.interpolate(cols, solutions, on, tp, tq, "event_id", ["truth_lat", "truth_lon"], bracket, lone).where("truth is not null")
    t, e = (geo.geodetic_to_ecef(a, b, F.lit(0.0)) for a, b in (("truth_lat", "truth_lon"), ("lat", "lon")))
    c = geo.error_components(t, e, "truth_lat", "truth_lon")
    return j.withColumns({"error_m": geo.horizontal_error(t, e), "_c": c}).withColumns({"error_east_m": F.col("_c.east"), "error_north_m": F.col("_c.north"), "error_bearing": F.col("_c.bearing")}).drop("_c")


def bias(errors: DataFrame, strata: list[str]) -> DataFrame:
    """Counts, median error and mean components by each stratum alone and over all, by grouping sets."""
    sets = [[F.col(s)] for s in strata] + [[]]
    g = errors.groupingSets(sets, *[F.col(s) for s in strata])
    return g.agg(F.count("*").alias("n"), F.percentile("error_m", 0.5).alias("p50_m"), F.percentile("error_m", 0.95).alias("p95_m"), F.avg("error_east_m").alias("east_m"), F.avg("error_north_m").alias("north_m"))


def quartile(df: DataFrame, at: str) -> Column:
    """Quarter (1 to 4) of the range of a column's quartiles."""
    q = df.agg(F.percentile(at, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q or [0, 0, 0]
    return F.when(F.col(at) <= q[0], 1).when(F.col(at) <= q[1], 2).when(F.col(at) <= q[2], 3).otherwise(4)


#: Fixed values: (verdict, least events, largest p50, largest p95).
GATES = (("STRONG PASS", 100, 500.0, 1500.0), ("PASS", 30, 1000.0, 5000.0), ("PARTIAL PASS", 10, 5000.0, float("inf")))


def verdict(errors: DataFrame, links: DataFrame) -> DataFrame:
    """One row: n, p50, p95, bad_links, verdict; a bad clock allows a partial pass at best."""
    s = errors.agg(F.count("*").alias("n"), F.percentile("error_m", 0.5).alias("p50"), F.percentile("error_m", 0.95).alias("p95"))
    s = s.join(links.agg(F.count_if(F.col("quality").isin("BAD", "UNAVAILABLE")).alias("bad_links")))
    case = None
    for name, n, a, b in GATES:
        ok = (F.col("n") >= n) & (F.col("p50") <= a) & (F.col("p95") <= b) & ((F.col("bad_links") == 0) | F.lit(name == "PARTIAL PASS"))
        case = F.when(ok, name) if case is None else case.when(ok, name)
    return s.withColumn("verdict", case.otherwise("FAIL"))


def common_reception(found: DataFrame, any_four: DataFrame, baseline: tuple[str, ...]) -> DataFrame:
    """One row: observations used, clusters by size, any four of five, the fixed four, and the increase over it."""
    c = found.where("verdict = 'cluster'")
    fixed = F.forall(F.array(*[F.lit(b) for b in baseline]), lambda x: F.array_contains("receiver_ids", x))
    sizes = [F.count_if(F.col("receiver_count") == n).alias(f"rx{n}") for n in (2, 3, 4, 5)]
    row = c.agg(F.sum("receiver_count").alias("observations"), *sizes, F.count_if(fixed).alias("baseline_fixed_4rx"))
    row = row.join(any_four.agg(F.count_distinct("component").alias("any_4_of_5")))
    return row.withColumns({"absolute_increase": F.col("any_4_of_5") - F.col("baseline_fixed_4rx"), "percent_increase": stats.percent_increase(F.col("any_4_of_5"), F.col("baseline_fixed_4rx"))})


def replay_summary(log: DataFrame, truth: DataFrame) -> DataFrame:
    """Published positions (code, t, lat, lon, latency_s) against sampled truth(code, tt, tlat, tlon): matched, error and latency shape."""
    a = log.withColumn("ida", F.monotonically_increasing_id())
    b = truth.withColumn("idb", F.struct("tt", "tlat", "tlon"))
    m = matching.nearest_in_time(a, b, ["code"], "t", "tt", "ida", "idb", 2.0).withColumn("error_m", geo.haversine("lat", "lon", "tlat", "tlon", 6_371_000.0))
    return m.agg(F.count("*").alias("matched"), F.percentile("error_m", 0.5).alias("error_p50_m"), F.percentile("error_m", 0.95).alias("error_p95_m"), F.percentile("latency_s", 0.5).alias("latency_p50_s"), F.percentile("latency_s", 0.95).alias("latency_p95_s"))


# --- studies --------------------------------------------------------------------------------------


def heat_map(spark: SparkSession, stations: list[Station], polygon, step_km: float, altitude_m: float, noises_us: list[float]) -> DataFrame:
    """noise_us, quality, points of the present network over a grid: the geometry part of the class only."""
    pts = planner.grid(spark, polygon, step_km)
    xyz = np.array([ecef(s) for s in stations])
    schema = "noise_us double, lat double, lon double, condition double, p95_error_m double, quality string"

    def run(it):
        for pdf in it:
            for noise in noises_us:
                m = solver.metrics(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), altitude_m, xyz, noise)
                cls = planner.quality(m["mc_p95_m"], m["condition"], np.full(len(pdf), np.inf))
                yield pdf[["lat", "lon"]].assign(noise_us=noise, condition=m["condition"], p95_error_m=m["mc_p95_m"], quality=cls)[["noise_us", "lat", "lon", "condition", "p95_error_m", "quality"]]

    return pts.select("lat", "lon").mapInPandas(run, schema)


def regions(points: DataFrame, boxes: dict[str, tuple[float, float, float, float]], good: Column) -> DataFrame:
    """One row for each named box (south, west, north, east): points and the share that is good."""
    rows = None
    for name, (s, w, n, e) in boxes.items():
        r = points.where(F.col("lat").between(s, n) & F.col("lon").between(w, e)).agg(F.lit(name).alias("region"), F.count("*").alias("points"), F.avg(good.cast("int")).alias("good_share"))
        rows = r if rows is None else rows.union(r)
    return rows


def sweep(spark: SparkSession, truths: list[tuple[float, float, float]], noises_us: list[float], offsets_m: list[float], subsets: bool = True) -> DataFrame:
    """Known-altitude solutions of synthetic events over noise, altitude offset and station subsets: error_m of each."""
    stations = synthetic.STATIONS[:4]
    sets = [tuple(range(4))] + (list(itertools.combinations(range(4), 3)) if subsets else [])
    cases = [(k, float(n), float(o), list(s)) for k in range(len(truths)) for n in noises_us for o in offsets_m for s in sets]
    df = spark.createDataFrame(cases, "truth int, noise_us double, offset_m double, stations array<int>").repartition(8)
    schema = "truth int, noise_us double, offset_m double, stations array<int>, error_m double, branches int, class string"

    def run(it):
        for pdf in it:
            out = []
            for c in pdf.itertuples():
                own = [stations[i] for i in c.stations]
                lat, lon, alt = truths[c.truth]
                f = solver.Frame(own)
                found = solver.branches(f, np.array([synthetic.tdoa_us(lat, lon, alt, own, c.noise_us, c.truth)]), np.array([alt + c.offset_m]))
                best = solver.select(found)
                err = None if best is None else float(np.hypot((best.lat - lat) * 111_132, (best.lon - lon) * f.lon_m))
                out.append((c.truth, c.noise_us, c.offset_m, list(c.stations), err, len(found), solver.classify_known_altitude(found)))
            yield pd.DataFrame(out, columns=["truth", "noise_us", "offset_m", "stations", "error_m", "branches", "class"])

    return df.mapInPandas(run, schema)
