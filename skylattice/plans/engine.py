"""Façade: frames to tracks, and the planner."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import Settings, Station
from ..operators import association, clock, planner, solver, tracking
from ..sources import captures


class Engine:
    """One station table and one set of thresholds; every method takes and returns DataFrames."""

    def __init__(self, spark: SparkSession, stations: list[Station], reference: str | None = None, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings
        self.stations = sorted(stations, key=lambda s: s.rank)
        self.reference = reference or self.stations[0].name
        self.table = spark.createDataFrame([(s.name, s.port, s.lat, s.lon, s.alt_m, s.rank) for s in self.stations], schema.STATIONS)

    def frames(self, path: str) -> DataFrame:
        return captures.read_captures(self.spark, path)

    def calibrate(self, frames: DataFrame) -> DataFrame:
        """Links from the reference to every other station."""
        each = [clock.samples(frames, self.table, self.reference, s.name) for s in self.stations if s.name != self.reference]
        return clock.links(functools.reduce(DataFrame.unionByName, each), self.settings.min_link_samples, self.settings.min_quality_samples)

    def observations(self, frames: DataFrame, links: DataFrame) -> DataFrame:
        norm = clock.normalise(captures.numbered(frames), clock.transforms(links, self.reference), self.reference)
        return captures.observations(norm.withColumnRenamed("norm", "_norm")).join(norm.select("id", "norm"), "id")

    def associate(self, observations: DataFrame, policy: str = "greedy") -> DataFrame:
        return association.associate(observations, self.stations, policy, self.settings.margin_us, self.settings.ambiguity_ticks)

    def events(self, found: DataFrame) -> DataFrame:
        """Clusters of all stations as solver input: event_id, tdoa_us against the first station."""
        n = len(self.stations)
        full = association.clusters(found).where(F.col("receiver_count") == n)
        first = F.col("obs")[0]["norm"]
        return full.select(F.col("cluster_id").alias("event_id"), F.transform(F.slice("obs", 2, n - 1), lambda m: (m["norm"] - first) / 12.0).alias("tdoa_us"), "utc_ns", "transmission_key", "icao")

    def solve(self, events: DataFrame) -> DataFrame:
        return solver.solve(events, self.stations, self.settings)

    def track(self, solutions: DataFrame, events: DataFrame, key: str = "transmission_key") -> DataFrame:
        fixes = solutions.where("classification = 'BLIND_UNIQUE'").join(events, "event_id")
        fixes = fixes.select(F.col(key).alias("code"), "event_id", (F.col("utc_ns") / 1e9).alias("t"), "lat", "lon", "weighted_rms", F.lit("PASS").alias("clock_quality"))
        return tracking.track(fixes, "code", self.settings)


class Planner:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def analyze(self, request: planner.Request) -> DataFrame:
        return planner.analyze(self.spark, request)

    def analyze_point(self, request: planner.Request, lat: float, lon: float) -> DataFrame:
        return planner.at_point(self.analyze(request), lat, lon)

    def report(self, request: planner.Request) -> dict:
        row = planner.summary(self.analyze(request)).first().asDict()
        return {"summary": row, "assessment": planner.assessment(row, request.geometry_strategy, len(request.enabled)), "areas": planner.coverage_areas(request).to_dict("records")}
