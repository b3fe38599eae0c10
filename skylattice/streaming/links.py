"""Live clock links: one model per receiver pair, refitted as samples come."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import TICKS_PER_US, Settings

OUT = "station_a string, station_b string, utc_ns long, samples int, slope double, offset double, origin_a long, origin_b long, p95_us double, quality string, rejected int, resets int"


class Link:
    """Bounded samples of (ta, tb, geom); an outlier is left out, the third in a row starts the model anew."""

    def __init__(self, settings: Settings = Settings(), saved: dict | None = None):
        self.s = settings
        d = saved or {}
        self.samples: list[list] = d.get("samples", [])
        self.streak, self.rejected, self.resets = d.get("streak", 0), d.get("rejected", 0), d.get("resets", 0)
        self.model: list | None = d.get("model")
        self.p95: float | None = d.get("p95")

    def saved(self) -> dict:
        return {"samples": self.samples, "streak": self.streak, "rejected": self.rejected, "resets": self.resets, "model": self.model, "p95": self.p95}

    def add(self, ta: int, tb: int, geom: float) -> None:
        if self.model:
            a0, b0, slope, offset = self.model
            off = (tb - b0 - geom) - (slope * (ta - a0) + offset)
            if abs(off) / TICKS_PER_US > self.s.outlier_us:
                self.streak, self.rejected = self.streak + 1, self.rejected + 1
                if self.streak < self.s.outlier_streak:
                    return
                self.samples, self.model, self.p95, self.resets = [], None, None, self.resets + 1
            else:
                self.streak = 0
        else:
            self.streak = 0 if not self.resets or self.samples else self.streak
        self.samples = [*self.samples, [ta, tb, geom]][-self.s.link_window :]
        if len(self.samples) >= self.s.min_link_samples:
            self.fit()

    def fit(self) -> None:
        a0, b0 = self.samples[0][0], self.samples[0][1]
        x = np.array([r[0] - a0 for r in self.samples], float)
        y = np.array([r[1] - b0 for r in self.samples], float) - np.array([r[2] for r in self.samples])
        dx = x - x.mean()
        den = float(dx @ dx)
        slope = float(dx @ (y - y.mean()) / den) if den else 1.0
        offset = float(y.mean() - slope * x.mean())
        self.model = [a0, b0, slope, offset]
        self.p95 = float(np.percentile(np.abs(y - slope * x - offset), 95) / TICKS_PER_US)

    @property
    def quality(self) -> str:
        if len(self.samples) < self.s.min_quality_samples or self.p95 is None:
            return "UNAVAILABLE"
        return next((n for n, m in (("STRONG", 1.0), ("PASS", 5.0), ("MARGINAL", 10.0)) if self.p95 < m), "BAD")


def live_links(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """samples(station_a, station_b, utc_ns, ta, tb, geom_ticks), streaming -> the link after each micro-batch, update."""

    def step(key, batches, state):
        link = Link(settings, json.loads(state.get[0]) if state.exists else None)
        last = 0
        for pdf in batches:
            for r in pdf.sort_values(["utc_ns", "ta"]).itertuples():
                link.add(int(r.ta), int(r.tb), float(r.geom_ticks))
                last = max(last, int(r.utc_ns))
        state.update((json.dumps(link.saved()),))
        a0, b0, slope, offset = link.model or (None, None, None, None)
        yield pd.DataFrame([(*key, last, len(link.samples), slope, offset, a0, b0, link.p95, link.quality, link.rejected, link.resets)], columns=[c.split()[0] for c in OUT.split(", ")])

    cols = ["station_a", "station_b", "utc_ns", "ta", "tb", "geom_ticks"]
    return samples.select(*cols).groupBy("station_a", "station_b").applyInPandasWithState(step, OUT, "link string", "update", GroupStateTimeout.NoTimeout)
