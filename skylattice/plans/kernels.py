"""Queries for the operators that SQL cannot say: solvers, greedy association, path search, planner, decoding.

Input is made from the test tables by rule (a supplier's key gives a true position, and so on);
where the rule gives the answer too, there is SQL for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..config import Settings, Station
from ..functions import geo, modes
from ..operators import association, clock, planner, solver, strict, tracking, yields
from . import synthetic
from .proxy import HOUR, events, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TRUTH = "t AS (SELECT s_suppkey::VARCHAR AS event_id, 20.2 + (s_suppkey % 17) * 0.05 AS lat, 106.3 + (s_suppkey % 23) * 0.06 AS lon, (s_suppkey % 7 + 2) * 1524.0 AS altitude_m FROM supplier)"


def _truth(spark, d):
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(k.cast("string").alias("event_id"), (20.2 + k % 17 * 0.05).alias("lat"), (106.3 + k % 23 * 0.06).alias("lon"), ((k % 7 + 2) * 1524.0).alias("altitude_m"))

    @F.pandas_udf("array<double>")
    def differences(lat: pd.Series, lon: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series([synthetic.tdoa_us(*x) for x in zip(lat, lon, alt)])

    return t.withColumn("tdoa_us", differences("lat", "lon", "altitude_m")).repartition(8)


@query(f"WITH {TRUTH} SELECT event_id, round(lat, 4) AS lat, round(lon, 4) AS lon, true AS exact FROM t")
def solve_known_altitude(spark, d):
    r = solver.solve_with_altitude(_truth(spark, d).select("event_id", "tdoa_us", "altitude_m"), synthetic.STATIONS[:4])
    return r.select("event_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), (F.col("rms_us") < 1e-6).alias("exact"))


@query(f"WITH {TRUTH} SELECT event_id, round(lat, 3) AS lat, round(lon, 3) AS lon, round(altitude_m, 1) AS altitude_m FROM t")
def solve_blind(spark, d):
    """Position and altitude from time differences alone, over the altitude grid."""
    r = solver.solve(_truth(spark, d), synthetic.STATIONS[:4])
    return r.select("event_id", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.round("altitude_m", 1).alias("altitude_m"))


KINDS = ["click", "error", "purchase", "signup", "view"]


def _observations(spark, d):
    e = events(spark, d)
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("station"), (F.col("t") * 12.0).alias("norm"), (F.col("t") * 1000).alias("utc_ns"), F.col("user_id").cast("string").alias("raw_hex"), F.lit(None).cast("int").alias("df"), F.lit(None).cast("string").alias("icao"), F.lit("events").alias("family")
    )


_SITES = [Station(k, 20.0 + i, 106.0 + i, 0.0, i) for i, k in enumerate(KINDS)]


def _associated(spark, d, policy):
    return association.associate(_observations(spark, d), _SITES, policy, margin_us=float(2 * HOUR), ambiguity_ticks=6.0)


@query()
def associate_greedy(spark, d):
    r = association.clusters(_associated(spark, d, "greedy"))
    return r.select("cluster_id", "transmission_key", F.array_join("receiver_ids", "+").alias("receivers"), "utc_ns")


@query()
def associate_combination(spark, d):
    r = association.clusters(_associated(spark, d, "combination"))
    return r.select("cluster_id", "transmission_key", F.array_join("receiver_ids", "+").alias("receivers"), "utc_ns")


@query()
def associate_counters(spark, d):
    return association.counters(_associated(spark, d, "greedy"))


@query()
def cluster_tdoa(spark, d):
    r = association.tdoa(association.clusters(_associated(spark, d, "greedy")))
    return r.select("cluster_id", "station_a", "station_b", F.round("tdoa_us", 3).alias("tdoa_us"))


@query()
def any_four_of_five(spark, d):
    r = association.any_of(_observations(spark, d), _SITES, 4, margin_us=float(6 * HOUR))
    return r.groupBy("component").agg(F.count("*").alias("clusters"), F.min("cluster_id").alias("first_cluster"))


def _fixes(spark, d):
    e = events(spark, d)
    spot = F.col("t") / 1e6 % 86400 / 86400
    return e.select(
        F.col("event_type").alias("code"), F.col("event_id").cast("string").alias("event_id"), (F.col("t") / 1e6 / 60).alias("t"), (20 + 0.2 * F.sin(spot * 6.283185307)).alias("lat"), (107 + 0.2 * F.cos(spot * 6.283185307)).alias("lon"), (F.col("value") % 2).alias("weighted_rms"), F.lit("PASS").alias("clock_quality")
    )


@query()
def anonymous_tracks(spark, d):
    r = tracking.track(_fixes(spark, d), "code", Settings())
    return r.groupBy("track_id").agg(F.count("*").alias("fixes"), F.max_by("state", "fix").alias("state"), F.max_by("quality", "fix").alias("quality"))


@query()
def track_yield(spark, d):
    r = tracking.track_yield(_fixes(spark, d).select("code", "t", "lat", "lon"), "code")
    return r.select("code", "fixes", F.round("span_s", 3).alias("span_s"), F.round("covered_s", 3).alias("covered_s"), F.round("coherence", 6).alias("coherence"), "status")


def _branches(spark, d):
    """Each fix beside a false branch 100 km off; every ninth stands alone."""
    f = _fixes(spark, d)
    false = F.when(F.hash("event_id") % 3 != 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    both = F.array(F.struct("lat", "lon", F.lit(12.0).alias("condition")), F.struct((F.col("lat") + false).alias("lat"), (F.col("lon") - false).alias("lon"), F.lit(25.0).alias("condition")))
    two = f.select(F.col("code").alias("key"), "event_id", "t", F.explode(F.when(F.col("event_id").cast("long") % 9 == 0, F.slice(both, 1, 1)).otherwise(both)).alias("b"))
    return two.select("key", "event_id", "t", "b.lat", "b.lon", F.lit(0.05).alias("rms_us"), "b.condition", F.lit(100.0).alias("center_km"))


def _path(method):
    def run(spark, d):
        r = tracking.disambiguate(_branches(spark, d), method=method)
        return r.select("key", "event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "branches", "seed", "quality")

    return run


QUERIES |= {"dp_path": _path("global_dp"), "path_nearest_previous": _path("nearest_previous"), "path_cv_greedy": _path("cv_greedy")}


@query("""
WITH f AS (SELECT event_type AS key, event_id, epoch_us(ts::TIMESTAMP) % 86400000000 / 1e6 / 86400 * 6.283185307 AS turn FROM events)
SELECT key, event_id::VARCHAR AS event_id, CASE WHEN event_id % 9 = 0 THEN round(20 + 0.2 * sin(turn), 6) END AS lat, CASE WHEN event_id % 9 = 0 THEN round(107 + 0.2 * cos(turn), 6) END AS lon,
  CASE WHEN event_id % 9 = 0 THEN 'STRONG_SEED' ELSE 'NO_SEED' END AS seed, CASE WHEN event_id % 9 = 0 THEN 'HIGH' ELSE 'REJECT' END AS quality FROM f""")
def path_baseline(spark, d):
    return _path("baseline")(spark, d).drop("branches")


@query()
def yield_status(spark, d):
    r = yields.status(yields.points(_branches(spark, d)))
    return r.select("key", "candidate_events", "fixes", F.round("span_s", 3).alias("span_s"), F.round("coherence", 6).alias("coherence"), "catastrophic_jumps", "blind_quality")


def _strict(rule):
    def run(spark, d):
        wide = strict.Rule(float(2 * HOUR), strict.RULES[rule].depth, 4 * HOUR * 1000, strict.RULES[rule].windowed)
        r = strict.strict(_observations(spark, d), _SITES[:3], wide)
        return r.select("raw_hex", "id", "verdict", "utc_ns", F.array_join("ids", "+").alias("ids"))

    return run


QUERIES |= {"strict_modeac": _strict("modeac"), "strict_modes": _strict("modes")}


def _request(strategy="best_4_of_n", **more):
    sites = [planner.Receiver(s.name, s.name, s.lat, s.lon, s.alt_m, max_range_km=220.0) for s in synthetic.STATIONS]
    return planner.Request(tuple(sites), ((19.0, 105.0), (19.0, 108.5), (21.8, 108.5), (21.8, 105.0)), 2500.0, 0.25, 20.0, ("N", "W", "S", "E"), strategy, **more)


@query()
def planner_strict(spark, d):
    r = planner.analyze(spark, _request("strict_4"))
    return r.select("point", "receiver_count", "quality", "branch_safe", "inside_hull", F.round("p95_error_m", 3).alias("p95_error_m"), F.round("condition", 4).alias("condition"))


@query()
def planner_best4(spark, d):
    r = planner.analyze(spark, _request())
    return r.select("point", "receiver_count", "subset_count", "quality", "n_minus_1", F.array_join("subset_ids", "+").alias("best"), F.round("p95_error_m", 3).alias("p95_error_m"))


@query()
def planner_summary(spark, d):
    return planner.summary(planner.analyze(spark, _request()))


@query()
def planner_dependency(spark, d):
    return planner.dependency(planner.importance(planner.evaluate(spark, _request())[2]))


@query()
def planner_layouts(spark, d):
    targets = [(20 + 0.2 * i, 106 + 0.2 * j) for i in range(6) for j in range(6)]
    return planner.best_rotation(planner.score_layouts(planner.layouts(spark, 20.5, 106.5, [50.0, 100.0]), targets, 2500.0, 0.25))


def _payloads(spark, d):
    """14-byte payloads of format 17, by rule from the event's number, with their parity made right."""
    k = F.col("event_id")
    field = k * 104729 % 4194304 * 17179869184 + k * 600000007 % 17179869184  # all type codes, heights and places
    head = F.concat(F.lit("8d"), F.lpad(F.lower(F.hex(k * 7919 % 16777216)), 6, "0"), F.lpad(F.lower(F.hex(field)), 14, "0"))
    p = table(spark, d, "events").select("event_id", F.concat(head, F.lit("000000")).alias("body"))
    return p.select("event_id", F.concat(F.substring("body", 1, 22), F.lpad(F.lower(F.hex(modes.crc24(F.col("body")))), 6, "0")).alias("raw_hex"))


@query("""
WITH f AS (SELECT event_id, event_id * 104729 % 4194304 * 17179869184 + event_id * 600000007 % 17179869184 AS me FROM events),
t AS (SELECT event_id, me, me >> 51 AS tc, (me >> 36) & 4095 AS a FROM f),
u AS (SELECT *, tc BETWEEN 9 AND 18 AS airborne FROM t)
SELECT event_id, 17 AS df, lpad(lower(hex(event_id * 7919 % 16777216)), 6, '0') AS icao, 0::BIGINT AS residual, tc::INT AS type_code,
  CASE WHEN airborne AND (a & 16) <> 0 THEN ((a >> 5) * 16 + (a & 15)) * 25 - 1000 ELSE -9999 END::BIGINT AS altitude_ft, CASE WHEN airborne THEN (me >> 34) & 1 ELSE -1 END::BIGINT AS cpr_odd,
  CASE WHEN airborne THEN (me >> 17) & 131071 ELSE -1 END::BIGINT AS cpr_lat, CASE WHEN airborne THEN me & 131071 ELSE -1 END::BIGINT AS cpr_lon FROM u""")
def decode_payloads(spark, d):
    p = _payloads(spark, d).withColumn("m", modes.decode(F.col("raw_hex")))
    known = [F.coalesce(F.col(f"m.{c}").cast("long"), F.lit(none).cast("long")).alias(c) for c, none in (("altitude_ft", -9999), ("cpr_odd", -1), ("cpr_lat", -1), ("cpr_lon", -1))]
    return p.select("event_id", "m.df", "m.icao", modes.crc24(F.col("raw_hex")).cast("long").alias("residual"), "m.type_code", *known)


CPR_PLACES = "p AS (SELECT c_custkey, -60 + (c_custkey % 1201) * 0.1 AS lat, -179 + (c_custkey % 3571) * 0.1 AS lon FROM customer)"


@query(f"""
WITH {CPR_PLACES}, r AS (SELECT *, {", ".join(f"{360 / z} * (floor(131072 * (lat - {360 / z} * floor(lat / {360 / z})) / {360 / z} + 0.5) / 131072 + floor(lat / {360 / z})) AS r{z}" for z in (60, 59))} FROM p),
n AS (SELECT *, {", ".join(f"CASE WHEN abs(r{z}) >= 87 THEN 1 ELSE floor(2 * pi() / acos(1 - (1 - cos(pi() / 30)) / cos(radians(r{z})) ** 2)) END AS n{z}" for z in (60, 59))} FROM r)
SELECT c_custkey, n60 = n59 AS even_ok, n60 = n59 AS odd_ok FROM n""")
def position_round_trip(spark, d):
    """Positions coded as an even and an odd report, and decoded again to within the code's step."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", (-60 + k % 1201 * 0.1).alias("lat"), (-179 + k % 3571 * 0.1).alias("lon"))

    def code(odd: int):
        dlat = 360.0 / (60 - odd)
        y = F.floor(131072 * F.pmod(F.col("lat"), F.lit(dlat)) / dlat + 0.5)
        rlat = dlat * (y / 131072 + F.floor(F.col("lat") / dlat))
        dlon = 360.0 / F.greatest(modes.longitude_zones(rlat) - odd, F.lit(1))
        return F.pmod(y, F.lit(131072)), F.pmod(F.floor(131072 * F.pmod(F.col("lon"), dlon) / dlon + 0.5), F.lit(131072))

    (ey, ex), (oy, ox) = code(0), code(1)
    out = {}
    for name, odd in (("even_ok", False), ("odd_ok", True)):
        g = modes.global_position(ey, ex, oy, ox, F.lit(odd))
        near = (F.abs(g["lat"] - F.col("lat")) < 1e-3) & (geo.angle_difference(g["lon"], F.col("lon")) < 1e-3)
        out[name] = F.coalesce(near, F.lit(False))  # where the zones of the two differ there is no position
    return p.select("c_custkey", *[v.alias(n) for n, v in out.items()])


@query()
def clock_link(spark, d):
    """A link fitted on 48-bit ticks: drift of 2 ppm, offset, a known geometry term."""
    k = F.col("event_id")
    s = table(spark, d, "events").select(F.lit("N").alias("station_a"), F.lit("W").alias("station_b"), (F.lit(140_000_000_000_000) + k * 1_000_000).alias("ta"), (F.lit(90_000_000_000_000) + k * 1_000_002 + k % 3).alias("tb"), (k % 3).cast("double").alias("geom_ticks"))
    r = clock.links(s)
    return r.select("station_a", "station_b", "samples", F.round("relative_clock_ppm", 6).alias("ppm"), F.round("p95_us", 6).alias("p95_us"), "quality")
