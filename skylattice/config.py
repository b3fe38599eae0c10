"""Constants and the station table. Numbers that results depend on are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass

#: Speed of light (m/s), clock rate (ticks per microsecond), WGS84, mean radii.
LIGHT_MPS = 299_792_458.0
TICKS_PER_US = 12.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
EARTH_KM, EARTH_M = 6371.0088, 6_371_000.0
#: Flat-earth metres per degree.
LAT_M, LON_M = 111_132.0, 111_320.0
#: Tick corrections by frame type (1: Mode A/C, 2 and 3: Mode S).
TICK_CORRECTION = {1: 244, 2: 768, 3: 768}
FRAME_KINDS = {1: "modeac", 2: "modes_short", 3: "modes_long"}
PAYLOAD_BYTES = {1: 2, 2: 7, 3: 14}


@dataclass(frozen=True)
class Station:
    name: str
    lat: float
    lon: float
    alt_m: float = 0.0
    rank: int = 0
    port: int = 0


@dataclass(frozen=True)
class Settings:
    """Thresholds of the pipeline; the defaults are those of the system whose results are matched."""

    margin_us: float = 3.0
    modeac_margin_us: float = 10.0
    ambiguity_ticks: float = 6.0
    min_link_samples: int = 20
    min_quality_samples: int = 100
    link_window: int = 2000
    outlier_us: float = 100.0
    outlier_streak: int = 3
    settle_s: float = 0.05
    max_age_s: float = 1.0
    altitudes_ft: tuple = tuple(range(0, 45_001, 5000))
    primary_radius_km: float = 1500.0
    expanded_radius_km: float = 3000.0
    family_radius_km: float = 25.0
    track_max_gap_s: float = 120.0
    track_stale_s: float = 30.0
    track_expire_s: float = 120.0
    track_speed_mps: float = 450.0
    track_allowance_m: float = 2000.0
    track_prediction_m: float = 5000.0
    track_confirm_fixes: int = 3
