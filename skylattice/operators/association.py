"""n-way association of equal payloads heard by several receivers.

The policies are not equivalent and are named: `greedy` (any set of two or more, seeds in time
order), `combination` (largest consistent combination per seed), `cliques` (mutual-nearest graph,
in matching.py) and `strict` (exactly the configured receivers). Rows of a key interact only
within the widest gate, so a key is cut where its rows stand further apart than that: the groups
that kernels see are short bursts, not whole keys, and the cut changes no result.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIGHT_MPS, TICKS_PER_US, WGS84_A, WGS84_F, Station
from ..functions.ids import cluster_id
from .sequences import gap_segments

CLUSTER_ROWS = "transmission_key string, members array<struct<rank:int,station:string,id:string,norm:double,utc_ns:long>>, df int, icao string, family string, verdict string"


def ecef(s: Station) -> np.ndarray:
    la, lo = np.radians(s.lat), np.radians(s.lon)
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / np.sqrt(1 - e2 * np.sin(la) ** 2)
    return np.array([(n + s.alt_m) * np.cos(la) * np.cos(lo), (n + s.alt_m) * np.cos(la) * np.sin(lo), (n * (1 - e2) + s.alt_m) * np.sin(la)])


def limits_us(stations: Iterable[Station]) -> np.ndarray:
    """Baseline over the speed of light for each pair of stations, in microseconds."""
    p = np.array([ecef(s) for s in stations])
    return np.linalg.norm(p[:, None] - p[None], axis=2) / LIGHT_MPS * 1e6


def normalise(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """Adds norm = (tick - offset) / slope; transforms(station, slope, offset) is a small dimension table."""
    return frames.join(F.broadcast(transforms), "station").withColumn("norm", (F.col("tick").cast("double") - F.col("offset")) / F.col("slope")).drop("slope", "offset")


class Burst:
    """Rows of one burst in seed order (time, receiver rank, id), as plain lists: bursts are short."""

    def __init__(self, norm: list[float], rank: list[int], ids: list[str], limits: list[list[float]], margin_us: float, ambiguity: float):
        self.norm, self.rank, self.ids = norm, rank, ids
        self.ticks = [[(v + margin_us) * TICKS_PER_US for v in row] for row in limits]
        self.reach = max(map(max, self.ticks))
        self.ambiguity = ambiguity
        self.free = [True] * len(norm)

    @classmethod
    def of(cls, pdf: pd.DataFrame, limits: np.ndarray, margin_us: float, ambiguity: float) -> Burst:
        """From a frame in any order; `rows` is that frame in seed order."""
        rows = pdf.assign(_id=pdf["id"].astype(str)).sort_values(["norm", "rank", "_id"], kind="stable").reset_index(drop=True)
        out = cls(rows["norm"].astype(float).tolist(), rows["rank"].astype(int).tolist(), rows["_id"].tolist(), np.asarray(limits).tolist(), margin_us, ambiguity)
        out.rows = rows
        return out

    def physical(self, i: int, j: int) -> bool:
        return abs(self.norm[i] - self.norm[j]) <= self.ticks[self.rank[i]][self.rank[j]]

    def nearest(self, pool: list[int], t: float) -> list[int]:
        return pool if len(pool) == 1 else sorted(pool, key=lambda k: (abs(self.norm[k] - t), self.ids[k]))

    def around(self, seed: int) -> dict[int, list[int]]:
        """Free rows within reach of a seed, by receiver."""
        t = self.norm[seed]
        out: dict[int, list[int]] = {}
        for k in range(bisect.bisect_left(self.norm, t - self.reach), bisect.bisect_right(self.norm, t + self.reach)):
            if self.free[k]:
                out.setdefault(self.rank[k], []).append(k)
        return out

    def take(self, rows: list[int]) -> None:
        for k in rows:
            self.free[k] = False

    def greedy(self):
        """(verdict, rows) for each free seed in turn."""
        for seed in range(len(self.norm)):
            if not self.free[seed]:
                continue
            pools, t, mine = self.around(seed), self.norm[seed], self.rank[seed]
            chosen, verdict = {mine: seed}, None
            for r in sorted(pools):
                if r == mine:
                    continue
                near = self.nearest(pools[r], t)
                if len(near) > 1 and abs(self.norm[near[1]] - t) - abs(self.norm[near[0]] - t) < self.ambiguity:
                    verdict = "ambiguous"
                    break
                chosen[r] = near[0]
            if verdict is None:
                while len(chosen) > 1 and (bad := next((p for p in itertools.combinations(sorted(chosen), 2) if not self.physical(chosen[p[0]], chosen[p[1]])), None)):
                    del chosen[bad[0] if bad[1] == mine else bad[1]]
                    yield "physical_reject", [seed]
                if len(chosen) < 2:
                    continue
                pairs = itertools.permutations(chosen, 2)
                verdict = "cluster" if all(self.nearest(pools[b], self.norm[chosen[a]])[0] == chosen[b] for a, b in pairs) else "nonreciprocal"
            rows = [chosen[r] for r in sorted(chosen)]
            if verdict == "cluster":
                self.take(rows)
            yield verdict, rows

    def combination(self):
        """Per seed the largest combination of rows, one a receiver, that is physical throughout; two of that
        size are ambiguous. A combination with a taken row does not count."""
        for seed in range(len(self.norm)):
            if not self.free[seed]:
                continue
            pools = self.around(seed)
            pools.pop(self.rank[seed], None)
            best: list[list[int]] = []
            for pick in itertools.product(*[[None, *pools[r]] for r in sorted(pools)]):
                rows = [seed, *[k for k in pick if k is not None]]
                if len(rows) < max(2, len(best[0]) if best else 2) or not all(self.physical(i, j) for i, j in itertools.combinations(rows, 2)):
                    continue
                best = [*best, rows] if best and len(rows) == len(best[0]) else [rows]
            if best:
                if len(best) == 1:
                    self.take(best[0])
                yield ("cluster" if len(best) == 1 else "ambiguous"), sorted(best[0], key=lambda k: self.rank[k])

    def strict(self, receivers: int):
        """Clusters of all `receivers` only: nearest free row of each, unambiguous, physical, mutually nearest."""
        for seed in range(len(self.norm)):
            if not self.free[seed]:
                continue
            pools, t = self.around(seed), self.norm[seed]
            if len(pools) < receivers:
                yield "insufficient_receivers", [seed]
                continue
            near = {r: [seed] if r == self.rank[seed] else self.nearest(pools[r], t) for r in pools}
            if any(len(v) > 1 and abs(self.norm[v[1]] - t) - abs(self.norm[v[0]] - t) < self.ambiguity for v in near.values()):
                yield "ambiguous", [seed]
                continue
            rows = [near[r][0] for r in sorted(near)]
            good = all(self.physical(i, j) for i, j in itertools.combinations(rows, 2)) and all(self.nearest(pools[self.rank[j]], self.norm[i])[0] == j for i, j in itertools.permutations(rows, 2))
            if good:
                self.take(rows)
            yield ("cluster" if good else "inconsistent"), rows


def associate(observations: DataFrame, stations: list[Station], policy: str = "greedy", margin_us: float = 3.0, ambiguity_ticks: float = 6.0) -> DataFrame:
    """observations(id, station, norm, utc_ns, raw_hex, df, icao, family) -> one row for each verdict, clusters with
    their id; verdict tells clusters from rejected seeds. Rows of unknown stations or without a key
    are left out, of rows with one id the first by time stays; keys that one station heard are
    pruned before any kernel runs."""
    limits = limits_us(stations)
    reach = float((limits.max() + margin_us) * TICKS_PER_US)
    names = [s.name for s in stations]
    rank = F.coalesce(*[F.when(F.col("station") == n, F.lit(i)) for i, n in enumerate(names)])
    rows = observations.withColumn("rank", rank).where("rank is not null and raw_hex is not null and norm is not null")
    rows = rows.groupBy("raw_hex", "id").agg(F.min_by(F.struct(*rows.columns), F.struct("norm", "rank", "utc_ns")).alias("r")).select("r.*")
    burst = gap_segments(rows, ["raw_hex"], "norm", reach, ["rank", "id"])
    shared = burst.groupBy("raw_hex", "segment").agg(F.min("rank").alias("_a"), F.max("rank").alias("_z")).where("_a < _z").select("raw_hex", "segment")
    burst = burst.join(shared, ["raw_hex", "segment"], "left_semi") if policy != "strict" else burst

    table = limits.tolist()

    def step(rows: list[list], a: int, z: int, out: list) -> None:
        key, _, norm, rank, ids, utc, df, icao, family = (c[a:z] for c in rows)
        b = Burst(norm, rank, ids, table, margin_us, ambiguity_ticks)
        for verdict, picked in {"greedy": b.greedy, "combination": b.combination, "strict": lambda: b.strict(len(names))}[policy]():
            first = min(picked)
            members = [{"rank": rank[k], "station": names[rank[k]], "id": ids[k], "norm": norm[k], "utc_ns": utc[k]} for k in picked]
            out.append({"transmission_key": key[0], "members": members, "df": df[first], "icao": icao[first], "family": family[first], "verdict": verdict})

    def run(batches):
        """Rows sorted by burst; a batch ends where its last burst may go on."""
        held: list[list] = [[] for _ in cols]
        for batch in batches:
            held = [h + c.to_pylist() for h, c in zip(held, batch.columns)]
            key, segment, n = held[0], held[1], len(held[0])
            out, a = [], 0
            for k in range(1, n):
                if segment[k] != segment[k - 1] or key[k] != key[k - 1]:
                    step(held, a, k, out)
                    a = k
            held = [h[a:] for h in held]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        out = []
        if held[0]:
            step(held, 0, len(held[0]), out)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    member = pa.struct([("rank", pa.int32()), ("station", pa.string()), ("id", pa.string()), ("norm", pa.float64()), ("utc_ns", pa.int64())])
    arrow = pa.schema([("transmission_key", pa.string()), ("members", pa.list_(member)), ("df", pa.int32()), ("icao", pa.string()), ("family", pa.string()), ("verdict", pa.string())])
    cols = ["raw_hex", "segment", "norm", "rank", "id", "utc_ns", "df", "icao", "family"]
    order = ["raw_hex", "segment", "norm", "rank", "id"]
    typed = burst.select("raw_hex", F.col("segment").cast("long"), F.col("norm").cast("double"), F.col("rank").cast("int"), F.col("id").cast("string"), F.col("utc_ns").cast("long"), F.col("df").cast("int"), "icao", "family")
    found = typed.repartition("raw_hex", "segment").sortWithinPartitions(*order).mapInArrow(run, CLUSTER_ROWS)
    ids = cluster_id(F.col("transmission_key"), F.transform("members", lambda m: F.concat(m["station"], F.lit(":"), m["id"])))
    receivers = F.transform("members", lambda m: m["station"])
    return found.select(
        F.when(F.col("verdict") == "cluster", ids).alias("cluster_id"), "transmission_key", receivers.alias("receiver_ids"), F.size("members").alias("receiver_count"),
        F.map_from_arrays(receivers, F.transform("members", lambda m: m["norm"])).alias("norm"), F.col("members").alias("obs"), "df", "icao", "family",
        F.array_min(F.transform("members", lambda m: m["utc_ns"])).alias("utc_ns"), "verdict",
    )


def clusters(found: DataFrame) -> DataFrame:
    return found.where("verdict = 'cluster'")


def counters(found: DataFrame) -> DataFrame:
    """verdict or size -> n, receiver sets, and sizes by downlink format (DF17:4RX): what the batch report shows."""
    sizes = clusters(found).groupBy(F.concat(F.col("receiver_count").cast("string"), F.lit("RX")).alias("counter")).agg(F.count("*").alias("n"))
    sets = clusters(found).groupBy(F.array_join("receiver_ids", "+").alias("counter")).agg(F.count("*").alias("n"))
    formats = F.concat(F.lit("DF"), F.col("df").cast("string"), F.lit(":"), F.col("receiver_count").cast("string"), F.lit("RX"))
    by_format = clusters(found).where("df is not null").groupBy(formats.alias("counter")).agg(F.count("*").alias("n"))
    return sizes.union(sets).union(by_format).union(found.where("verdict <> 'cluster'").groupBy(F.col("verdict").alias("counter")).agg(F.count("*").alias("n")))


def tdoa(found: DataFrame) -> DataFrame:
    """cluster_id, station_a, station_b, tdoa_us = (norm_b - norm_a) / 12 for every pair in rank order."""
    pair = found.select("cluster_id", F.explode("obs").alias("a"), "obs").select("cluster_id", "a", F.explode("obs").alias("b")).where("a.rank < b.rank")
    return pair.select("cluster_id", F.col("a.station").alias("station_a"), F.col("b.station").alias("station_b"), ((F.col("b.norm") - F.col("a.norm")) / TICKS_PER_US).alias("tdoa_us"))


def any_of(observations: DataFrame, stations: list[Station], size: int = 4, **settings) -> DataFrame:
    """Every `size`-subset of the receivers is associated for itself; its full clusters that share an observation
    are one event: component, cluster_id, receiver_ids."""
    from .graph import checkpointed, shared_members

    out = None
    for k, subset in enumerate(itertools.combinations(stations, size)):
        got = clusters(associate(observations, list(subset), **settings)).where(F.col("receiver_count") == size)
        got = got.select(F.concat(F.lit(f"{k}:"), "cluster_id").alias("cluster"), "cluster_id", "receiver_ids", F.transform("obs", lambda m: m["id"]).alias("ids"))
        out = got if out is None else out.unionByName(got)
    out = checkpointed(out)  # read several times below
    comp = shared_members(out.select("cluster", F.explode("ids").alias("member")), "cluster", "member")
    return out.join(comp, "cluster").select("component", "cluster_id", "receiver_ids")


def is_within(tdoa_us: Column, limit_us: Column, margin_us: float) -> Column:
    return F.abs(tdoa_us) <= limit_us + margin_us
