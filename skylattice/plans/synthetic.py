"""Geometry-consistent test input: true places to ticks."""

from __future__ import annotations

import numpy as np

from ..config import LIGHT_MPS, TICKS_PER_US, Station
from ..operators.solver import Frame

#: Four stations about a coast and a fifth inland.
STATIONS = [Station("N", 21.5, 107.9, 30.0, 0), Station("W", 20.9, 106.6, 12.0, 1), Station("S", 19.9, 106.0, 8.0, 2), Station("E", 20.7, 107.7, 40.0, 3), Station("X", 21.2, 105.8, 15.0, 4)]


def tdoa_us(lat: float, lon: float, alt_m: float, stations: list[Station] = STATIONS[:4], noise_us: float = 0.0, seed: int = 0) -> list[float]:
    """Arrival-time differences against the first station."""
    f = Frame(stations)
    en = np.array([(lon - f.lon0) * f.lon_m, (lat - f.lat0) * 111_132.0])
    d = f.differences(en[None], np.array([alt_m]))[0] / LIGHT_MPS * 1e6
    return (d + np.random.default_rng(seed).normal(0, noise_us, len(d)) if noise_us else d).tolist()


def ticks(lat: float, lon: float, alt_m: float, base: int, stations: list[Station] = STATIONS) -> list[int]:
    """Ticks at each station of one transmission at `base` of the first station's clock."""
    return [base] + [base + round(d * TICKS_PER_US) for d in tdoa_us(lat, lon, alt_m, stations)]
