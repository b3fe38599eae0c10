"""Receiver-layout evaluation over a surveillance grid.

A subset of receivers is one task: it scores the whole grid (25,000 points at most, by the guard)
as numpy blocks. Availability, ranking, survivability and summaries are DataFrame work.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EARTH_KM, Station
from ..functions import geo
from . import rings, solver
from .association import ecef

#: Guards, draws and the seed that results depend on.
MAX_POINTS, CONFIRM_SUBSETS, MAX_SUBSETS = 25_000, 70, 1000
PLANE_LAT_KM, PLANE_LON_KM = 111.132, 111.320
DRAWS, SEED, REMOTE_KM, SAFE_US = 256, 20260811, 25.0, 0.5
CLASSES = (("GOOD", 500.0, 10.0, 1.0), ("ACCEPTABLE", 1500.0, 30.0, 0.5), ("POOR", 5000.0, 100.0, 0.2))
STRATEGIES = ("strict_4", "best_4_of_n", "worst_4_of_n", "full_n_diagnostic")


@dataclass(frozen=True)
class Receiver:
    id: str
    name: str
    lat: float
    lon: float
    altitude_m: float = 0.0
    reception_model: str = "simulated"
    max_range_km: float | None = 400.0
    outline: tuple | None = None
    enabled: bool = True

    def station(self, rank: int = 0) -> Station:
        return Station(self.id, self.lat, self.lon, self.altitude_m, rank)


@dataclass(frozen=True)
class Request:
    receivers: tuple
    surveillance_polygon: tuple
    target_altitude_m: float = 2500.0
    timing_noise_us: float = 0.25
    grid_step_km: float = 10.0
    geometry_receiver_ids: tuple = field(default=())
    geometry_strategy: str = "strict_4"
    failed_receiver_id: str | None = None
    allow_high_subset_count: bool = False

    def __post_init__(self):
        ids = [r.id for r in self.receivers]
        bad = (
            (len(ids) < 4, "at least four receivers"), (len(set(ids)) != len(ids), "receiver ids must differ"), (len(self.surveillance_polygon) < 3, "a polygon of three points or more"),
            (not 0 <= self.target_altitude_m <= 30_000, "altitude 0 to 30000 m"), (not 0 < self.timing_noise_us <= 100, "noise above 0, to 100 us"), (self.grid_step_km not in (5, 10, 20), "grid step 5, 10 or 20 km"),
            (self.geometry_strategy not in STRATEGIES, "unknown strategy"), (not set(self.geometry_receiver_ids) <= set(ids), "unknown geometry receiver"),
            (any(not (-90 <= r.lat <= 90 and -180 <= r.lon <= 180) for r in self.receivers), "coordinates out of range"), (any(r.max_range_km is not None and not 0 < r.max_range_km <= 2000 for r in self.receivers), "range to 2000 km"),
            (any(r.reception_model not in ("simulated", "outline") for r in self.receivers), "unknown reception model"), (self.geometry_strategy == "strict_4" and len(self.geometry_receiver_ids) != 4, "strict_4 needs four geometry receivers"),
        )
        for wrong, what in bad:
            if wrong:
                raise ValueError(what)

    @property
    def enabled(self) -> list[Receiver]:
        return [r for r in self.receivers if r.enabled and r.id != self.failed_receiver_id]


def grid(spark: SparkSession, polygon, step_km: float) -> DataFrame:
    """point, lat, lon, x_km, y_km inside the polygon ([lat, lon]), on a plane about its mean; built in Catalyst."""
    lat0, lon0 = (sum(p[k] for p in polygon) / len(polygon) for k in (0, 1))
    kx, ky = PLANE_LON_KM * math.cos(math.radians(lat0)), PLANE_LAT_KM
    flat = [((lon - lon0) * kx, (lat - lat0) * ky) for lat, lon in polygon]
    xs, ys = zip(*flat)
    x0, y0 = math.floor(min(xs) / step_km) * step_km, math.floor(min(ys) / step_km) * step_km
    nx, ny = (int(math.ceil(max(v) / step_km) * step_km + 0.001 - o) // int(step_km) + 1 for v, o in ((xs, x0), (ys, y0)))
    points = spark.range(nx * ny).select(F.col("id").alias("point"), (F.lit(x0) + F.col("id") % nx * step_km).alias("x_km"), (F.lit(y0) + F.floor(F.col("id") / nx) * step_km).alias("y_km"))
    inside = points.where(geo.point_in_polygon("x_km", "y_km", flat))
    return inside.select("point", (F.lit(lat0) + F.col("y_km") / ky).alias("lat"), (F.lit(lon0) + F.col("x_km") / kx).alias("lon"), "x_km", "y_km")


def heard(points: DataFrame, sites: DataFrame, reach_km: float | Column) -> DataFrame:
    """points x sites(id, slat, slon): distance_km and in_range, inclusive. Sites are a small dimension."""
    d = geo.haversine("lat", "lon", "slat", "slon")
    return points.crossJoin(F.broadcast(sites)).withColumn("distance_km", d).withColumn("in_range", F.col("distance_km") <= reach_km)


def subsets(items: DataFrame, size: int, key: str = "id") -> DataFrame:
    """members: every subset of `size` rows as an array of structs, ids ascending. For guarded numbers of receivers."""
    one = items.select(F.struct(F.col(key), *[F.col(c) for c in items.columns if c != key]).alias("m"))
    out = one.select(F.array("m").alias("members"))
    for _ in range(size - 1):
        out = out.join(F.broadcast(one), F.element_at("members", -1)[key] < F.col("m")[key]).select(F.concat("members", F.array("m")).alias("members"))
    return out


def reception(r: Receiver, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Whether each point is heard: within the range, or inside the outline (boundary included); the altitude
    of the target scales neither."""
    if r.reception_model == "outline":
        if not r.outline:
            raise ValueError(f"receiver {r.name} has no outline")
        return rings.inside(np.array(r.outline), lat, lon)
    a, b = np.radians(lat), math.radians(r.lat)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * math.cos(b) * np.sin(np.radians(lon - r.lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1))) <= r.max_range_km


def collinear(stations: list[Station]) -> bool:
    k = math.cos(math.radians(np.mean([s.lat for s in stations])))
    xy = np.array([[s.lon * k, s.lat] for s in stations])
    return np.linalg.matrix_rank((xy - xy.mean(0)) * 111.2) < 2


def remote_separation(lat: np.ndarray, lon: np.ndarray, sig: np.ndarray, far_km: float = REMOTE_KM, block: int = 256) -> np.ndarray:
    """For each point the least RMS distance of signatures to points at least far_km away, by blocks."""
    a, o = np.radians(lat), np.radians(lon)
    unit = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)
    near = 2 * math.sin(min(far_km / EARTH_KM / 2, math.pi / 2))
    out, norm = np.full(len(lat), np.inf), (sig**2).sum(1)
    for i in range(0, len(lat), block):
        chord2 = np.maximum(2 - 2 * unit[i : i + block] @ unit.T, 0)
        d2 = np.maximum(norm[i : i + block, None] + norm[None] - 2 * sig[i : i + block] @ sig.T, 0)
        d2[chord2 < near * near] = np.inf
        out[i : i + block] = np.sqrt(d2.min(1) / sig.shape[1])
    return out


def quality(p95, cond, separation) -> np.ndarray:
    out = np.full(len(p95), "VERY_POOR", dtype=object)
    for name, a, b, c in reversed(CLASSES):
        out[(p95 <= a) & (cond <= b) & (separation >= c)] = name
    return out


def receiver_draws(receiver_id: str) -> np.ndarray:
    """A receiver's own stream, so that another site changes no one else's."""
    seed = int.from_bytes(hashlib.sha256(f"{SEED}:{receiver_id}".encode()).digest()[:8], "big")
    return np.random.default_rng(seed).normal(size=DRAWS)


def score(lat, lon, altitude_m: float, noise_us: float, stations: list[Station], draws: np.ndarray) -> pd.DataFrame:
    """Metrics of one set of stations over all points."""
    xyz = np.array([ecef(s) for s in stations])
    m = solver.metrics(lat, lon, altitude_m, xyz, noise_us, draws)
    line = collinear(stations)
    sep = np.zeros(len(lat)) if line else remote_separation(lat, lon, solver.signatures(lat, lon, altitude_m, xyz))
    hull = np.zeros(len(lat), bool) if line else rings.in_hull(np.array([[s.lon, s.lat] for s in stations]), lon, lat)
    fine = np.isfinite(m["condition"]) & np.isfinite(m["mc_p95_m"]) & np.isfinite(sep)
    cls = np.where(fine, quality(m["mc_p95_m"], m["condition"], sep), "VERY_POOR")
    out = pd.DataFrame({"condition": m["condition"], "p50_error_m": m["mc_p50_m"], "p95_error_m": m["mc_p95_m"], "branch_separation_us": sep, "inside_hull": hull, "branch_safe": fine & (sep >= SAFE_US) & (not line), "quality": cls})
    return out.replace([np.inf, -np.inf], np.nan)


SCORES = "point long, subset_ids array<string>, condition double, p50_error_m double, p95_error_m double, branch_separation_us double, inside_hull boolean, branch_safe boolean, quality string"


def evaluate(spark: SparkSession, request: Request) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, availability(point, id, in_range), scores) of a request; scores hold a row for each point and subset
    all of whose receivers hear it."""
    pts = grid(spark, request.surveillance_polygon, request.grid_step_km)
    n = pts.count()
    if not 0 < n <= MAX_POINTS:
        raise ValueError(f"{n} grid points; 1 to {MAX_POINTS} are possible")
    enabled = sorted(request.enabled, key=lambda r: r.id)
    by_id = {r.id: r for r in request.receivers}
    if request.geometry_strategy == "strict_4":
        sets, common = [tuple(request.geometry_receiver_ids)], np.random.default_rng(SEED).normal(size=(4, DRAWS))
    else:
        total = math.comb(len(enabled), 4)
        if total > MAX_SUBSETS or total > CONFIRM_SUBSETS and not request.allow_high_subset_count:
            raise ValueError(f"{total} subsets of four exceed the limit of {MAX_SUBSETS}, or of {CONFIRM_SUBSETS} without confirmation")
        sets, common = list(itertools.combinations([r.id for r in enabled], 4)), None
    flat = pts.orderBy("point").select("point", "lat", "lon").toPandas()  # guarded above
    lat, lon = flat["lat"].to_numpy(), flat["lon"].to_numpy()
    got = {r.id: reception(r, lat, lon) for r in enabled}
    availability = spark.createDataFrame(pd.DataFrame({"point": np.tile(flat["point"], len(got)), "id": np.repeat(list(got), n), "in_range": np.concatenate(list(got.values()))}), "point long, id string, in_range boolean")
    sent = spark.sparkContext.broadcast((flat["point"].to_numpy(), lat, lon, got, by_id, request, common))

    def run(it):
        point, la, lo, have, sites, req, fixed = sent.value
        for pdf in it:
            for ids in pdf["ids"]:
                ids = list(ids)
                ok = np.logical_and.reduce([have.get(i, np.zeros(len(la), bool)) for i in ids])
                draws = fixed if fixed is not None else np.stack([receiver_draws(i) for i in ids])
                s = score(la, lo, req.target_altitude_m, req.timing_noise_us, [sites[i].station() for i in ids], draws)
                s.insert(0, "point", point)
                s.insert(1, "subset_ids", [ids] * len(s))
                yield s[ok]

    rows = spark.createDataFrame([(list(s),) for s in sets], "ids array<string>").repartition(min(len(sets), 64))
    return pts, availability, rows.mapInPandas(run, SCORES)


def ranked(scores: DataFrame) -> DataFrame:
    """Adds best_rank and worst_rank of each point's subsets, all ties decided by the ids."""
    inf = F.lit(float("inf"))
    p95, cond = F.coalesce("p95_error_m", inf), F.coalesce("condition", inf)
    unsafe, outside = (~F.col("branch_safe")).cast("int"), (~F.col("inside_hull")).cast("int")
    w = Window.partitionBy("point")
    best = F.row_number().over(w.orderBy(unsafe, p95, cond, outside, "subset_ids"))
    worst = F.row_number().over(w.orderBy(unsafe.desc(), p95.desc(), cond.desc(), outside.desc(), F.col("subset_ids").desc()))
    return scores.withColumns({"best_rank": best, "worst_rank": worst})


def analyze(spark: SparkSession, request: Request) -> DataFrame:
    """One row for each grid point: receivers that hear it, the chosen subset and its metrics, subset counts, N-1
    survivability."""
    pts, avail, scores = evaluate(spark, request)
    have = avail.groupBy("point").agg(F.count_if("in_range").alias("receiver_count"), F.sort_array(F.collect_list(F.when(F.col("in_range"), F.col("id")))).alias("available"))
    r = ranked(scores)
    pick = "worst_rank" if request.geometry_strategy == "worst_4_of_n" else "best_rank"
    chosen = r.where(f"{pick} = 1").drop("best_rank", "worst_rank")
    counts = scores.groupBy("point").agg(F.count("*").alias("subset_count"), F.count_if(F.col("quality") == "GOOD").alias("good_subsets"), F.collect_set(F.when(F.col("quality") == "GOOD", F.col("subset_ids"))).alias("_good"))
    df = pts.join(have, "point").join(chosen, "point", "left").join(counts, "point", "left")
    survive = (F.col("receiver_count") >= 5) & F.forall("available", lambda lost: F.exists("_good", lambda s: ~F.array_contains(s, lost)))
    return df.withColumns({"quality": F.coalesce("quality", F.lit("NO_MLAT")), "branch_safe": F.coalesce("branch_safe", F.lit(False)), "inside_hull": F.coalesce("inside_hull", F.lit(False)), "subset_count": F.coalesce("subset_count", F.lit(0)), "good_subsets": F.coalesce("good_subsets", F.lit(0)), "n_minus_1": F.coalesce(survive, F.lit(False))}).drop("_good")


def importance(scores: DataFrame) -> DataFrame:
    """point, id, ratio: best p95 among the subsets without a receiver, over the best of all."""
    r = ranked(scores)
    best = r.where("best_rank = 1").select("point", F.col("p95_error_m").alias("best_p95"))
    each = r.select("point", F.explode("subset_ids").alias("id")).distinct()
    without = each.join(r.select("point", "subset_ids", "p95_error_m", "branch_safe", "condition", "inside_hull"), "point").where(~F.array_contains("subset_ids", F.col("id")))
    inf = F.lit(float("inf"))
    key = F.struct((~F.col("branch_safe")).cast("int"), F.coalesce("p95_error_m", inf), F.coalesce("condition", inf), (~F.col("inside_hull")).cast("int"), "subset_ids")
    alt = without.groupBy("point", "id").agg(F.min_by("p95_error_m", key).alias("alt_p95"))
    return each.join(best, "point").join(alt, ["point", "id"], "left").select("point", "id", F.when(F.col("best_p95") > 0, F.col("alt_p95") / F.col("best_p95")).alias("ratio"))


def summary(rows: DataFrame) -> DataFrame:
    """One row over the grid: coverage and quality shares, medians and p90 of the finite errors."""
    share = lambda cond: F.round(100.0 * F.avg(cond.cast("int")), 6)
    cells = [F.count("*").alias("grid_points")] + [share(F.col("receiver_count") >= k).alias(f"at_least_{k}_rx_percent") for k in (1, 2, 3, 4)]
    cells += [share(F.col("quality") == q).alias(f"{q.lower()}_percent") for q in ("GOOD", "ACCEPTABLE", "POOR", "VERY_POOR", "NO_MLAT")]
    cells += [F.percentile("p50_error_m", 0.5).alias("median_p50_m"), F.percentile("p95_error_m", 0.5).alias("median_p95_m"), F.percentile("p95_error_m", 0.9).alias("p90_p95_m"), F.percentile("condition", 0.5).alias("median_condition")]
    cells += [share(F.col("quality").isin("GOOD", "ACCEPTABLE")).alias("good_acceptable_percent"), share(F.coalesce(F.col("branch_separation_us") >= 1.0, F.lit(False))).alias("branch_good_percent")]
    cells += [share(F.col("good_subsets") >= k).alias(f"{n}_good_subsets_percent") for k, n in ((1, "one"), (2, "two"), (3, "three"))]
    cells.append(F.percentile(F.when(F.col("subset_count") > 0, F.col("good_subsets") / F.col("subset_count")).otherwise(0.0), 0.5).alias("median_good_fraction"))
    return rows.agg(*cells, share(F.col("branch_safe")).alias("branch_safe_percent"), share(F.col("n_minus_1")).alias("n_minus_1_percent"))


def at_point(rows: DataFrame, lat: float, lon: float) -> DataFrame:
    """The grid point nearest to a place."""
    return rows.orderBy(geo.haversine("lat", "lon", lat, lon), "point").limit(1)


def coverage_areas(request: Request) -> pd.DataFrame:
    """One row for each receiver: area_km2 of its reception, and of that inside the surveillance polygon."""
    out = []
    area = np.array(request.surveillance_polygon)
    for r in request.receivers:
        ring = np.array(r.outline) if r.reception_model == "outline" else rings.circle(r.lat, r.lon, r.max_range_km)
        whole = rings.area_km2(ring) if r.reception_model == "outline" else 2 * math.pi * EARTH_KM**2 * (1 - math.cos(r.max_range_km / EARTH_KM))
        out.append((r.id, r.enabled, whole, rings.intersection_km2(ring, area)))
    return pd.DataFrame(out, columns=["id", "enabled", "area_km2", "inside_km2"])


#: Codes of the levels from 4 to 0, and of the overall level.
LEVEL_CODES = ("RAT_TOT", "TOT", "TRUNG_BINH", "KEM", "RAT_KEM")
OVERALL_CODES = ("RAT_TOT", "TOT", "KHA", "TRUNG_BINH", "KEM")
LABELS = {"RAT_TOT": "Rất tốt", "TOT": "Tốt", "KHA": "Khá", "TRUNG_BINH": "Trung bình", "KEM": "Kém", "RAT_KEM": "Rất kém", "KHONG_AP_DUNG": "Không áp dụng", "KHONG_DU_DU_LIEU": "Chưa đủ dữ liệu"}
#: Least shares of the grid for levels 4 to 1.
SHARES = {"reception": (90, 75, 50, 25), "branch": (90, 75, 50, 25), "redundancy": (80, 60, 30, 10), "n_minus_1": (80, 60, 30, 10)}
#: Least shares of GOOD and of GOOD or ACCEPTABLE for levels 4 to 1; largest median and p90 of the 95 % error.
GEOMETRY_SHARES = ((75, 90), (50, 75), (25, 50), (10, 0))
ERRORS_M = ((250, 500), (500, 1500), (1500, 5000), (5000, math.inf))


def _level(ok: list[bool]) -> int:
    """4 for the first condition that holds, one less for each after it; 0 if none does."""
    return next((4 - k for k, x in enumerate(ok) if x), 0)


def assessment(s: dict, strategy: str = "best_4_of_n", eligible: int = 5) -> dict:
    """Levels from a summary() row by aspect, and overall: the least of reception, geometry, branch and error, capped by
    how the network bears the loss of a receiver and by how many good subsets there are."""
    strict = strategy == "strict_4"
    level = {k: _level([v >= t for t in SHARES[k]]) for k, v in {"reception": s["at_least_4_rx_percent"], "branch": s["branch_good_percent"], "redundancy": 0.0 if strict else s["two_good_subsets_percent"], "n_minus_1": s["n_minus_1_percent"]}.items()}
    level["geometry"] = _level([s["good_percent"] >= a and s["good_acceptable_percent"] >= b for a, b in GEOMETRY_SHARES])
    median, p90 = s["median_p95_m"], s["p90_p95_m"]
    known = median is not None and p90 is not None
    level["p95"] = _level([known and median <= a and p90 <= b for a, b in ERRORS_M])
    score = min(level[k] for k in ("reception", "geometry", "branch", "p95") if k != "p95" or known)
    lossless = not strict and eligible >= 5
    if not lossless or level["n_minus_1"] <= 1 or level["redundancy"] <= 1:
        score = min(score, 2)
    elif level["n_minus_1"] == 2:
        score = min(score, 3)
    codes = {k: LEVEL_CODES[4 - v] for k, v in level.items()}
    if not known:
        codes["p95"] = "KHONG_DU_DU_LIEU"
    if not lossless:
        codes["n_minus_1"] = "KHONG_AP_DUNG"
    overall = OVERALL_CODES[4 - score]
    return {"levels": codes, "overall": overall, "label": LABELS[overall], "text": [f"{k}: {LABELS[c]}" for k, c in codes.items()]}


#: Bands of distances between receivers, kilometres.
BASELINE_BANDS = {"very_close": (0, 50), "main": (150, 250), "long": (250, 350.0000001), "very_long": (350.0000001, math.inf)}


def baselines(receivers: DataFrame) -> DataFrame:
    """receivers(id, lat, lon): one row with least, median and largest distance and the pairs in each band."""
    a, b = receivers.select("id", "lat", "lon"), receivers.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = a.join(F.broadcast(b), F.col("id") < F.col("id2")).withColumn("km", geo.haversine("lat", "lon", "lat2", "lon2"))
    bands = [F.count_if((F.col("km") >= lo) & (F.col("km") < hi)).alias(f"{n}_pairs") for n, (lo, hi) in BASELINE_BANDS.items()]
    return d.agg(F.min("km").alias("min_km"), F.percentile("km", 0.5).alias("median_km"), F.max("km").alias("max_km"), *bands)


def dependency(imp: DataFrame) -> DataFrame:
    """Receivers by how much worse the grid is without them: id, median_ratio, lost_points, rank."""
    g = imp.groupBy("id").agg(F.percentile("ratio", 0.5).alias("median_ratio"), F.count_if(F.col("ratio").isNull()).alias("lost_points"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("lost_points"), F.desc("median_ratio"), "id")))


def candidate_sites(spark: SparkSession, existing: list[Station], candidates: DataFrame, targets: DataFrame, altitude_m: float, noise_us: float) -> DataFrame:
    """candidates(site, lat, lon) for one more receiver, each scored over the targets(lat, lon) with the existing
    ones: site, median_p95_m, median_condition, good_share, and the mean over leaving one existing out."""
    t = targets.select("lat", "lon").toPandas()
    if len(t) > MAX_POINTS:
        raise ValueError(f"{len(t)} targets; {MAX_POINTS} are possible")
    la, lo = t["lat"].to_numpy(), t["lon"].to_numpy()

    def run(it):
        for pdf in it:
            rows = []
            for c in pdf.itertuples():
                sets = [existing] + [existing[:k] + existing[k + 1 :] for k in range(len(existing))]
                p95 = [solver.metrics(la, lo, altitude_m, np.array([ecef(s) for s in [*own, Station("c", c.lat, c.lon)]]), noise_us) for own in sets]
                full = p95[0]
                worst = float(np.mean([np.median(m["mc_p95_m"]) for m in p95[1:]]))
                rows.append((c.site, float(np.median(full["mc_p95_m"])), float(np.median(full["condition"])), float(np.mean((full["mc_p95_m"] <= 500) & (full["condition"] <= 10))), worst))
            yield pd.DataFrame(rows, columns=["site", "median_p95_m", "median_condition", "good_share", "leave_one_out_p95_m"]).replace([np.inf, -np.inf], np.nan)

    return candidates.select("site", "lat", "lon").mapInPandas(run, "site string, median_p95_m double, median_condition double, good_share double, leave_one_out_p95_m double")


#: Templates of four receivers about the origin; only their shape counts.
LAYOUTS = {
    "square": ((-1, -1), (1, -1), (1, 1), (-1, 1)),
    "diamond": ((0, 1), (1, 0), (0, -1), (-1, 0)),
    "rectangle_2to1": ((-1, -0.5), (1, -0.5), (1, 0.5), (-1, 0.5)),
    "triangle_center": ((0, 1), (-math.sqrt(3) / 2, -0.5), (math.sqrt(3) / 2, -0.5), (0, 0)),
    "irregular": ((0.50, 0.12), (-0.08, 0.48), (-0.50, -0.18), (0.18, -0.40)),
    "linear": ((-0.5, 0), (-1 / 6, 0), (1 / 6, 0), (0.5, 0)),
}


def layouts(spark: SparkSession, lat0: float, lon0: float, spans_km: list[float], step_deg: int = 15) -> DataFrame:
    """layout, span_km, turn_deg, k, lat, lon: every template at every span (its largest distance between two receivers) and
    rotation of a half turn, as a parameter table."""
    spans = {n: max(math.dist(p, q) for p, q in itertools.combinations(pts, 2)) for n, pts in LAYOUTS.items()}
    corners = [(n, k, x / spans[n], y / spans[n]) for n, pts in LAYOUTS.items() for k, (x, y) in enumerate(pts)]
    base = spark.createDataFrame(corners, "layout string, k int, x double, y double")
    many = base.withColumn("span_km", F.explode(F.array(*[F.lit(float(s)) for s in spans_km]))).withColumn("turn_deg", F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(step_deg))))
    a = F.radians("turn_deg")
    e, n = (F.col("x") * F.cos(a) - F.col("y") * F.sin(a)) * F.col("span_km") * 1000, (F.col("x") * F.sin(a) + F.col("y") * F.cos(a)) * F.col("span_km") * 1000
    return many.withColumn("p", geo.from_plane(e, n, lat0, lon0)).select("layout", "span_km", "turn_deg", "k", "p.lat", "p.lon")


LAYOUT_SCORES = "layout string, span_km double, turn_deg int, median_p95_m double, p90_p95_m double, median_condition double, good_share double, inside_share double, score_300 double, score_350 double"


def score_layouts(sites: DataFrame, targets: list[tuple[float, float]], altitude_m: float, noise_us: float) -> DataFrame:
    """LAYOUT_SCORES over the targets: good_share has a 95 % error up to 1 km at a condition up to 30, score_N is that share
    times the share of targets that all receivers see within N km."""
    la, lo = np.array(targets).T

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("k")
        m = solver.metrics(la, lo, altitude_m, np.array([ecef(Station("", a, o)) for a, o in zip(p["lat"], p["lon"])]), noise_us)
        error, condition = np.asarray(m["mc_p95_m"]), np.asarray(m["condition"])
        good = float(((error <= 1000) & (condition <= 30)).mean())
        far = np.max([_km(la, lo, a, o) for a, o in zip(p["lat"], p["lon"])], axis=0)
        inside = float(np.mean([_in_hull(list(zip(p["lon"], p["lat"])), x) for x in zip(lo, la)]))
        v = [float(np.median(error)), float(np.quantile(error, 0.9)) if np.isfinite(error).all() else math.inf, float(np.median(condition)), good, inside, good * float((far <= 300).mean()), good * float((far <= 350).mean())]
        return pd.DataFrame([(*key, *[x if math.isfinite(x) else None for x in v])], columns=[c.split()[0] for c in LAYOUT_SCORES.split(", ")])

    return sites.groupBy("layout", "span_km", "turn_deg").applyInPandas(run, LAYOUT_SCORES)


def _km(lat, lon, lat1: float, lon1: float):
    a, b = np.radians(lat), math.radians(lat1)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * math.cos(b) * np.sin(np.radians(lon1 - np.asarray(lon)) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def _in_hull(corners: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    """Whether p lies in a triangle of three corners with an area: the hull of a few points is the union of these."""
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for a, b, c in itertools.combinations(corners, 3):
        if abs(cross(a, b, c)) > 1e-9:
            side = [cross(a, b, p), cross(b, c, p), cross(c, a, p)]
            if min(side) >= 0 or max(side) <= 0:
                return True
    return False


def best_rotation(scored: DataFrame) -> DataFrame:
    """The rotation of each layout and span with the highest score at 350 km, then good_share, inside_share and least 90 % error."""
    order = [F.col(c).desc_nulls_last() for c in ("score_350", "good_share", "inside_share")]
    w = Window.partitionBy("layout", "span_km").orderBy(*order, F.col("p90_p95_m").asc_nulls_last(), "turn_deg")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def colour(mode: str) -> Column:
    """The heat-map band of a row of analyze()."""
    bands = F.when(F.col("p95_error_m").isNull(), "none").when(F.col("p95_error_m") <= 500, "low").when(F.col("p95_error_m") <= 1500, "medium").when(F.col("p95_error_m") <= 5000, "high").otherwise("extreme")
    modes = {"quality": F.col("quality"), "p95": bands, "count": F.least(F.col("receiver_count"), F.lit(7)).cast("string"), "robustness": F.least(F.col("subset_count"), F.lit(35)).cast("string"), "survivability": F.when(F.col("n_minus_1"), "survives").otherwise("lost")}
    return modes[mode]
