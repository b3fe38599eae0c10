"""Tracks from fixes: greedy linking, path choice among ambiguous branches, yield, co-tracks.

Linking and path search are sequential within a key; each key's rows are cut at gaps first, so a
kernel sees one segment, not the history of a key.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import EARTH_M, LAT_M, LON_M, Settings
from ..functions import geo
from .matching import band_join
from .sequences import coverage, gap_segments


def metres(lat1, lon1, lat2, lon2) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def heading(lat1, lon1, lat2, lon2) -> float:
    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    return math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) % 360


@dataclass
class Track:
    """State of one track; update() takes a fix, age() tells its state at a time."""

    key: str
    t: float
    lat: float
    lon: float
    fixes: int = 1
    speed: float | None = None
    heading: float | None = None
    rate: tuple[float, float] | None = None
    expired: bool = False

    def miss(self, t: float, lat: float, lon: float, s: Settings) -> float | None:
        """Metres from the prediction, null if the fix is out of reach or not later."""
        dt = t - self.t
        if self.expired or not 0 < dt <= s.track_max_gap_s:
            return None
        at = (self.lat + self.rate[0] * dt, self.lon + self.rate[1] * dt) if self.rate else (self.lat, self.lon)
        off = metres(*at, lat, lon)
        near = metres(self.lat, self.lon, lat, lon) <= s.track_speed_mps * dt + s.track_allowance_m and off <= s.track_speed_mps * dt + s.track_prediction_m
        return off if near else None

    def update(self, t: float, lat: float, lon: float) -> None:
        dt = t - self.t
        self.speed, self.heading = metres(self.lat, self.lon, lat, lon) / dt, heading(self.lat, self.lon, lat, lon)
        self.rate = ((lat - self.lat) / dt, (lon - self.lon) / dt)
        self.t, self.lat, self.lon, self.fixes = t, lat, lon, self.fixes + 1

    def age(self, now: float, s: Settings) -> str:
        if now - self.t >= s.track_expire_s:
            return "EXPIRED"
        if now - self.t >= s.track_stale_s:
            return "STALE"
        return "CONFIRMED" if self.fixes >= s.track_confirm_fixes else "TENTATIVE"

    def quality(self, weighted_rms: float | None, clock: str | None) -> str:
        rms = 99.0 if weighted_rms is None or math.isnan(weighted_rms) else weighted_rms
        if self.fixes >= 5 and rms <= 1.0 and clock in ("STRONG", "PASS"):
            return "HIGH"
        return "MEDIUM" if self.fixes >= 3 and rms <= 1.5 else "LOW"


def link(fixes: pd.DataFrame, key: str, s: Settings = Settings(), several: bool = True) -> list[tuple]:
    """Rows (track, fix, t, lat, lon, state, quality, speed, heading) of fixes in time order. With `several`, a code may hold
    many tracks and a fix that none can take, a late one too, opens a new one; else late and unreachable fixes are dropped."""
    tracks: list[Track] = []
    out = []
    for f in fixes.sort_values(["t", "event_id"], kind="stable").itertuples():
        options = [(m, k) for k, tr in enumerate(tracks) if (m := tr.miss(f.t, f.lat, f.lon, s)) is not None]
        if options:
            k = min(options)[1]
            tracks[k].update(f.t, f.lat, f.lon)
        elif several or not tracks or f.t - tracks[-1].t > s.track_expire_s:
            k = len(tracks)
            tracks.append(Track(key, f.t, f.lat, f.lon))
        else:
            continue
        tr = tracks[k]
        out.append((f"{key}-{fixes['segment'].iloc[0]}-{k}", key, tr.fixes, tr.t, tr.lat, tr.lon, "CONFIRMED" if tr.fixes >= s.track_confirm_fixes else "TENTATIVE", tr.quality(f.weighted_rms, f.clock_quality), tr.speed, tr.heading))
    return out


def track(fixes: DataFrame, key: str = "code", settings: Settings = Settings(), several: bool = True) -> DataFrame:
    """fixes(code, event_id, t (s), lat, lon, weighted_rms, clock_quality) -> schema.TRACKS, one row a fix. A code's
    fixes are cut where they stand further apart than a track lives."""
    cut = gap_segments(fixes.withColumn("code", F.col(key)), ["code"], "t", settings.track_max_gap_s, ["event_id"])

    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(link(pdf, str(keys[0]), settings, several), columns=[c.split()[0] for c in schema.TRACKS.split(", ")])

    return cut.select("code", "segment", "event_id", "t", "lat", "lon", "weighted_rms", "clock_quality").groupBy("code", "segment").applyInPandas(run, schema.TRACKS)


# --- path choice ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class PathRules:
    """Thresholds of one configuration of the path search. Fixed values."""

    gap_s: float = 10.0
    normal_mps: float = 400.0
    hard_mps: float = 450.0
    prefer_accel: float = 10.0
    hard_accel: float = 25.0
    tolerance_m: float = 2000.0
    prediction_weight: float = 1.0
    geometry_weight: float = 0.15


CONFIGS = {"CONSERVATIVE": PathRules(5.0, 350.0, 420.0, 8.0, 20.0, 1500.0, 1.0, 0.15), "BALANCED": PathRules(), "PERMISSIVE": PathRules(20.0, 450.0, 500.0, 15.0, 30.0, 2500.0, 0.75, 0.30)}


def _plane(lat, lon, lat0, lon0):
    return np.stack([(np.asarray(lon) - lon0) * LON_M * math.cos(math.radians(lat0)), (np.asarray(lat) - lat0) * LAT_M], 1)


def _penalty(conditions: list[np.ndarray], r: PathRules) -> list[np.ndarray]:
    return [r.geometry_weight * np.maximum(0, np.log10(np.maximum(c, 1) / 10)) for c in conditions]


def _leg(a: np.ndarray, b: np.ndarray, dt: float, r: PathRules) -> np.ndarray:
    """Cost of the speed from each place of a to each of b, infinite beyond the hard limit."""
    d = np.linalg.norm(b[None] - a[:, None], axis=2)
    cost = (np.maximum(np.maximum(d - r.tolerance_m, 0) / dt - r.normal_mps, 0) / 100) ** 2
    return np.where(d <= r.hard_mps * dt + r.tolerance_m, cost, np.inf)


def _bend(a: np.ndarray, b: np.ndarray, c: np.ndarray, dt0: float, dt: float, r: PathRules) -> np.ndarray:
    """Cost of going on from a over b to c, for each triple: speed, miss of the straight prediction, acceleration, turn."""
    v0, v1 = (b[None] - a[:, None]) / dt0, (c[None] - b[:, None]) / dt
    miss = np.linalg.norm(c[None, None] - (b[None] + v0 * dt)[:, :, None], axis=3)
    turn = np.abs(np.arctan2(v1[..., 0], v1[..., 1])[None] - np.arctan2(v0[..., 0], v0[..., 1])[:, :, None])
    turn = np.degrees(np.minimum(turn, 2 * np.pi - turn)) / dt
    free = 0.5 * dt * dt
    accel = np.maximum(miss - r.tolerance_m, 0) / max(free, 1.0)
    cost = r.prediction_weight * (miss / max(r.tolerance_m, 50 * dt)) ** 2 + _leg(b, c, dt, r)[None] + (accel / r.prefer_accel) ** 2 + (turn / 5) ** 2
    return np.where(miss <= r.tolerance_m + r.hard_accel * free, cost, np.inf)


def best_path(times: list[float], places: list[np.ndarray], conditions: list[np.ndarray], r: PathRules) -> tuple[list[int] | None, float, int]:
    """(branch of each step, margin of the best final state over the second, first step that no path reaches).
    Second-order dynamic programming: a state is the last two branches."""
    n = len(times)
    pen = _penalty(conditions, r)
    if n == 1:  # nothing to choose by
        return ([0], math.inf, -1) if len(pen[0]) == 1 else (None, 0.0, 0)
    cost = pen[0][:, None] + _leg(places[0], places[1], times[1] - times[0], r) + pen[1][None]
    if not np.isfinite(cost).any():
        return None, 0.0, 1
    back: list[np.ndarray] = []
    for k in range(2, n):
        step = _bend(places[k - 2], places[k - 1], places[k], times[k - 1] - times[k - 2], times[k] - times[k - 1], r) + pen[k][None, None]
        total = cost[:, :, None] + step
        if not np.isfinite(total).any():
            return None, 0.0, k
        back.append(total.argmin(0))
        cost = total.min(0)
    flat = np.sort(cost[np.isfinite(cost)])
    j, l = np.unravel_index(np.argmin(cost), cost.shape)  # noqa: E741
    path = [int(l), int(j)]
    for b in reversed(back):
        path.append(int(b[path[-1], path[-2]]))
    return path[::-1], float(flat[1] - flat[0]) / n if len(flat) > 1 else math.inf, -1


def fragments(times, places, conditions, r: PathRules, at: int = 0) -> list[tuple[int, list[int], float]]:
    """(first step, branches, margin) of the pieces that a feasible path covers: an infeasible run with a step of one
    branch is split at the transition with the fewest feasible pairs, of equal ones the nearest to the middle."""
    path, margin, _ = best_path(times, places, conditions, r)
    if path is not None:
        return [(at, path, margin)]
    if len(times) == 1 or not any(len(c) == 1 for c in conditions):
        return []
    cut = min(range(1, len(times)), key=lambda k: (int(np.isfinite(_leg(places[k - 1], places[k], times[k] - times[k - 1], r)).sum()), abs(k - len(times) / 2)))
    return fragments(times[:cut], places[:cut], conditions[:cut], r, at) + fragments(times[cut:], places[cut:], conditions[cut:], r, at + cut)


def _seed(condition: float) -> str:
    return "STRONG_SEED" if condition <= 30 else "WEAK_SEED"


#: step -> (branch, margin, seed, whether the path is smooth), of the steps that have a choice
Choice = dict[int, tuple[int, float, str, bool]]


def only_branches(times, places, conditions, r: PathRules) -> Choice:
    """Steps of a single branch, each for itself."""
    return {k: (0, math.inf, _seed(c[0]), True) for k, c in enumerate(conditions) if len(c) == 1}


def from_seed(times, places, conditions, r: PathRules, steady: bool = False) -> Choice:
    """From the first step of a single branch outwards, in both directions, the cheapest next branch; steady: by the
    cost of going on at constant velocity, once two steps are known. A direction ends where nothing is feasible."""
    start = next((k for k, c in enumerate(conditions) if len(c) == 1), None)
    if start is None:
        return {}
    pen, out = _penalty(conditions, r), {start: (0, math.inf, _seed(conditions[start][0]), True)}
    for way in (range(start + 1, len(times)), range(start - 1, -1, -1)):
        behind = [start]
        for k in way:
            last = [places[h][out[h][0]][None] for h in behind[-2:]]
            dt = abs(times[k] - times[behind[-1]])
            if steady and len(last) == 2:
                cost = _bend(*last, places[k], abs(times[behind[-1]] - times[behind[-2]]), dt, r)[0, 0] + pen[k]
            else:
                cost = _leg(last[-1], places[k], dt, r)[0] + pen[k]
            best = np.argsort(cost, kind="stable")
            if not len(best) or not math.isfinite(cost[best[0]]):
                break
            margin = float(cost[best[1]] - cost[best[0]]) if len(best) > 1 else math.inf
            out[k] = (int(best[0]), margin, _seed(conditions[k][best[0]]), True)
            behind.append(k)
    return out


def whole_path(times, places, conditions, r: PathRules) -> Choice:
    """The cheapest path over the run or its fragments. A path without a step of a single branch is taken only if
    it has three steps and a margin."""
    out: Choice = {}
    for first, path, margin in fragments(times, places, conditions, r):
        steps = range(first, first + len(path))
        alone = next((conditions[k][0] for k in steps if len(conditions[k]) == 1), None)
        seed = _seed(alone) if alone is not None else "SEQUENCE_SEED" if len(path) >= 3 and margin >= 0.1 else None
        if seed:
            smooth = _smooth([times[k] for k in steps], [places[k][p] for k, p in zip(steps, path)])
            out |= {k: (p, margin, seed, smooth) for k, p in zip(steps, path)}
    return out


METHODS = {"baseline": only_branches, "nearest_previous": from_seed, "cv_greedy": partial(from_seed, steady=True), "global_dp": whole_path}


def path_quality(seed: str, condition: float, margin: float, smooth: bool) -> str:
    if seed == "SEQUENCE_SEED":  # without an anchor the path may be the mirrored one
        return "LOW"
    if condition <= 30 and margin >= 1 and smooth:
        return "HIGH"
    return "MEDIUM" if condition <= 70 and margin >= 0.1 else "LOW"


PATHS = "key string, segment long, event_id string, t double, lat double, lon double, condition double, branches int, margin double, seed string, quality string"


def disambiguate(branches: DataFrame, rules: PathRules = CONFIGS["BALANCED"], method: str = "global_dp") -> DataFrame:
    """branches(key, event_id, t (s), lat, lon, rms_us, condition, center_km): a row for each event with the branch that
    one of METHODS chooses over the key's segments. Events without a choice have the seed NO_SEED, the quality
    REJECT and no place; so has, of events at one time, every one after the first by id."""
    choose = METHODS[method]
    events = branches.groupBy("key", "event_id").agg(F.min("t").alias("t"))
    segment = gap_segments(events, ["key"], "t", rules.gap_s, ["event_id"]).select("key", "event_id", "segment")

    def step(rows: list[list], a: int, z: int, out: list) -> None:
        key, segment, event, t, lat, lon, rms, cond, centre = (c[a:z] for c in rows)
        events = [list(g) for _, g in itertools.groupby(range(len(event)), key=lambda k: event[k])]
        keep: list[list[int]] = []
        late = []
        for own in events:
            least = min(rms[k] for k in own) + 0.01
            good = [k for k in own if centre[k] <= 1500 and rms[k] <= least and cond[k] <= 1e6]
            if keep and t[own[0]] <= t[keep[-1][0]]:
                late.append(own[0])
            else:
                keep.append([own[0], *good])  # the event, and its credible branches
        origin = next((k for own in keep for k in own[1:]), 0)
        times = [t[own[0]] for own in keep]
        places = [_plane([lat[k] for k in own[1:]], [lon[k] for k in own[1:]], lat[origin], lon[origin]) for own in keep]
        conds = [np.array([cond[k] for k in own[1:]]) for own in keep]
        chosen = choose(times, places, conds, rules)
        head = {"key": key[0], "segment": segment[0]}
        none = {"lat": None, "lon": None, "condition": None, "margin": None, "seed": "NO_SEED", "quality": "REJECT"}
        for i, own in enumerate(keep):
            row = {**head, "event_id": event[own[0]], "t": t[own[0]], "branches": len(own) - 1, **none}
            if i in chosen:
                branch, margin, seed, smooth = chosen[i]
                k = own[1 + branch]
                row |= {"lat": lat[k], "lon": lon[k], "condition": cond[k], "margin": margin if math.isfinite(margin) else None, "seed": seed, "quality": path_quality(seed, cond[k], margin, smooth)}
            out.append(row)
        out += [{**head, "event_id": event[k], "t": t[k], "branches": 0, **none} for k in late]

    def run(batches):
        """Rows sorted by segment; a batch ends where its last segment may go on."""
        held: list[list] = [[] for _ in cols]
        for batch in batches:
            held = [h + c.to_pylist() for h, c in zip(held, batch.columns)]
            out, a = [], 0
            for k in range(1, len(held[0])):
                if held[1][k] != held[1][k - 1] or held[0][k] != held[0][k - 1]:
                    step(held, a, k, out)
                    a = k
            held = [h[a:] for h in held]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        out = []
        if held[0]:
            step(held, 0, len(held[0]), out)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    s, f, i = pa.string(), pa.float64(), pa.int64()
    arrow = pa.schema([("key", s), ("segment", i), ("event_id", s), ("t", f), ("lat", f), ("lon", f), ("condition", f), ("branches", pa.int32()), ("margin", f), ("seed", s), ("quality", s)])
    cols = ["key", "segment", "event_id", "t", "lat", "lon", "rms_us", "condition", "center_km"]
    rows = branches.join(segment, ["key", "event_id"]).select(F.col("key").cast("string"), F.col("segment").cast("long"), F.col("event_id").cast("string"), *[F.col(c).cast("double") for c in cols[3:]])
    return rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "t", "event_id", "rms_us").mapInArrow(run, PATHS)


def _smooth(times: list[float], at: list[np.ndarray]) -> bool:
    """No speed above 400 m/s and no acceleration above 10 m/s2 along a path."""
    if len(at) < 2:
        return True
    dt = np.diff(times)
    v = np.diff(np.stack(at), axis=0) / dt[:, None]
    a = np.linalg.norm(np.diff(v, axis=0), axis=1) / np.maximum((dt[1:] + dt[:-1]) / 2, 0.01)
    return not (np.linalg.norm(v, axis=1) > 400).any() and not (a > 10).any()


# --- yield and comparison -------------------------------------------------------------------------


def motion(points: DataFrame, keys: list[str], at: str = "t") -> DataFrame:
    """Adds dt, jump_m, speed_mps, heading_deg, accel of each point against the one before."""
    w = Window.partitionBy(*keys).orderBy(at)
    lag = lambda c: F.lag(c).over(w)
    df = points.withColumn("dt", F.col(at) - lag(at)).withColumn("jump_m", geo.haversine(lag("lat"), lag("lon"), "lat", "lon", EARTH_M))
    df = df.withColumn("speed_mps", F.when(F.col("dt") > 0, F.col("jump_m") / F.col("dt"))).withColumn("heading_deg", geo.bearing(lag("lat"), lag("lon"), "lat", "lon"))
    return df.withColumn("accel", F.when(F.col("dt") > 0, F.abs(F.col("speed_mps") - lag("speed_mps")) / F.col("dt")))


def track_yield(points: DataFrame, key: str, reach_s: float = 5.0) -> DataFrame:
    """One row for each key: fixes, span, covered seconds, coherence (mean of four shares) and status."""
    m = motion(points, [key])
    share = lambda ok, of: F.coalesce(F.avg(F.when(of.isNotNull(), ok.cast("int"))), F.lit(1.0))
    gap = F.percentile("dt", 0.5)
    g = m.groupBy(key).agg(
        F.count("*").alias("fixes"), (F.max("t") - F.min("t")).alias("span_s"), share(F.col("speed_mps") <= 450, F.col("speed_mps")).alias("a"), share(F.col("accel") <= 25, F.col("accel")).alias("b"),
        F.when(gap > 0, F.least(F.lit(1.0), 5.0 / gap)).otherwise(F.lit(1.0)).alias("c"), share(F.col("jump_m") <= 5000, F.col("jump_m")).alias("d"), F.max("jump_m").alias("largest_jump_m"),
    )
    g = g.withColumn("coherence", (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4).drop("a", "b", "c", "d")
    g = g.join(coverage(points, [key], "t", reach_s).select(key, F.col("covered").alias("covered_s")), key)
    status = F.when((F.col("fixes") < 3) | (F.col("span_s") < 30), "REJECT").when(F.col("coherence") >= 0.8, "GOOD").when(F.col("coherence") >= 0.6, "PARTIAL").otherwise("AMBIGUOUS")
    return g.withColumn("status", status)


def trajectory_distance(a: DataFrame, b: DataFrame, on: str, reach_s: float) -> DataFrame:
    """on, hausdorff_m, mean_nearest_m (of a's points), unmatched: distances between points(on, t, lat, lon) of two
    sources, each point against the other's points within reach in time. A point with none in reach has no
    distance: it counts as unmatched, and the Hausdorff distance of its key is infinite. Keys of one source
    alone are left out."""
    side = lambda d, k: d.select(F.col(on), F.col("t").alias(f"t{k}"), F.col("lat").alias(f"la{k}"), F.col("lon").alias(f"lo{k}"))
    near = band_join(side(a, 1), side(b, 2), [on], "t1", "t2", reach_s).withColumn("d", geo.haversine("la1", "lo1", "la2", "lo2", EARTH_M))

    def of(points: DataFrame, k: int) -> DataFrame:
        nearest = near.groupBy(on, f"t{k}").agg(F.min("d").alias("d"))
        every = points.select(on, F.col("t").alias(f"t{k}")).distinct().join(nearest, [on, f"t{k}"], "left")
        return every.groupBy(on).agg(F.max("d").alias(f"m{k}"), F.avg("d").alias(f"a{k}"), F.count_if(F.col("d").isNull()).alias(f"u{k}"))

    unmatched = F.col("u1") + F.col("u2")
    far = F.when(unmatched > 0, float("inf")).otherwise(F.greatest("m1", "m2"))
    return of(a, 1).join(of(b, 2), on).select(on, far.alias("hausdorff_m"), F.col("a1").alias("mean_nearest_m"), unmatched.alias("unmatched"))


def nearest_each(a: DataFrame, b: DataFrame, by: str, ta: str, tb: str, reach: float) -> DataFrame:
    """a with, for each value of `by` that has a row of b within reach in time, that value's nearest row (of two as near
    the earlier). Columns must differ; at one time a value has one row of b at most.

    Of the time bucket before its own a row needs the last row only, of the one after it the first, and of its own
    the neighbours, found by sorting both together: no pairs are made but those returned."""
    known = lambda df, t: df.where(F.col(t).isNotNull() & ~F.isnan(t)).withColumn("_bucket", F.floor(F.col(t) / reach))
    a, b = known(a, ta), known(b, tb)
    spot = F.struct(tb, *[c for c in b.columns if c not in (by, tb, "_bucket")])
    b = b.select(by, "_bucket", spot.alias("_spot"))
    ends = b.groupBy(by, "_bucket").agg(F.min("_spot").alias("_r"), F.max("_spot").alias("_l"))
    near = [F.struct((F.col("_bucket") + k).alias("_bucket"), *[(F.col(c) if k == at else F.lit(None).cast(ends.schema[c].dataType)).alias(c) for c, at in (("_l", 1), ("_r", -1))]) for k in (-1, 0, 1)]
    ends = ends.select(by, F.explode(F.array(*near)).alias("_e")).select(by, "_e.*").groupBy(by, "_bucket").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    rows = a.join(ends, "_bucket").select(by, "_bucket", F.col(ta).alias("_t"), F.lit(1).alias("_q"), F.struct(*[c for c in a.columns if c != "_bucket"]).alias("_row"), "_l", "_r")
    both = rows.unionByName(b.select(by, "_bucket", F.col(f"_spot.{tb}").alias("_t"), F.lit(0).alias("_q"), "_spot"), allowMissingColumns=True)
    w = Window.partitionBy(by, "_bucket")
    seen = lambda *order: F.last("_spot", True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", seen("_t", "_q")).withColumn("_a", seen(F.desc("_t"), "_q")).where("_q = 1")
    both = both.withColumns({"_l": F.coalesce("_b", "_l"), "_r": F.coalesce("_a", "_r")})
    left, right = F.col("_t") - F.col(f"_l.{tb}"), F.col(f"_r.{tb}") - F.col("_t")
    chosen = both.withColumn("_spot", F.when(right.isNull() | (left <= right), F.col("_l")).otherwise(F.col("_r")))
    return chosen.where(F.least(left, right) <= reach).select("_row.*", by, "_spot.*")


def cotracks(a: DataFrame, b: DataFrame, reach_s: float = 3.0, apart_s: float = 1.0) -> DataFrame:
    """Pairs of tracks of two sources, points(track_id, t, lat, lon, speed_mps, heading_deg), that go together: per point
    of a the nearest of b in time; within 5 km, 120 m/s and 50 degrees; matches at least `apart_s` apart. Of points of
    a track at one time the one of the greatest speed counts."""

    def side(d, k):
        points = d.groupBy(F.col("track_id").alias(f"id{k}"), F.col("t").alias(f"t{k}")).agg(F.max(F.struct("speed_mps", "heading_deg", "lat", "lon")).alias("p"))
        return points.select(f"id{k}", f"t{k}", *[F.col(f"p.{c}").alias(f"{n}{k}") for c, n in (("lat", "la"), ("lon", "lo"), ("speed_mps", "v"), ("heading_deg", "h"))])

    near = nearest_each(side(a, 1), side(b, 2), "id2", "t1", "t2", reach_s).withColumn("km", geo.haversine("la1", "lo1", "la2", "lo2"))
    fit = near.where((F.col("km") <= 5) & F.coalesce(F.abs(F.col("v1") - F.col("v2")) <= 120, F.lit(True)) & F.coalesce(geo.angle_difference("h1", "h2") <= 50, F.lit(True)))
    bucket = F.floor(F.col("t1") / apart_s)
    fit = fit.withColumn("_b", bucket).groupBy("id1", "id2", "_b").agg(F.min("t1").alias("t"), F.min_by("km", "t1").alias("km"))
    g = fit.groupBy("id1", "id2").agg(F.count("*").alias("matches"), (F.max("t") - F.min("t")).alias("span_s"), F.avg("km").alias("mean_km"))
    level = F.when((F.col("matches") >= 3) & (F.col("span_s") >= 5) & (F.col("mean_km") <= 3), "STRONG").when(F.col("matches") >= 2, "POSSIBLE")
    return g.withColumn("level", level).where("level is not null")
