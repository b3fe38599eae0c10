"""Strict association in order of arrival: one transmission, all configured receivers, decided row by row.

Two rules differ in what they look at and in what an event uses up; `RULES` states both. A payload's
rows are cut where nothing arrives for as long as rows are kept: its state is empty there, so a
kernel sees a burst and the cut changes no result. The same state machine runs on a batch and on a stream.
"""

from __future__ import annotations

import itertools
import json
from collections import deque
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import TICKS_PER_US, Station
from .association import limits_us
from .sequences import gap_segments

EVENT, FEW, UNCLEAR, UNFIT = "STRICT_4RX", "INSUFFICIENT_RECEIVERS", "AMBIGUOUS_ASSOCIATION", "INCONSISTENT_ASSOCIATION"
OUT = "raw_hex string, id string, verdict string, utc_ns long, receiver_ids array<string>, ids array<string>, norms array<double>"


@dataclass(frozen=True)
class Rule:
    """margin_us: allowance on a baseline. depth: rows kept of a receiver. age_ns: how long they are kept. windowed:
    candidates lie within the widest baseline, and used rows alone are spent; else all kept rows are
    candidates and an event spends the whole payload. Fixed values."""

    margin_us: float
    depth: int
    age_ns: int
    windowed: bool
    ambiguity_ticks: float = 6.0


RULES = {"modeac": Rule(10.0, 4000, 1_000_000_000, True), "modes": Rule(3.0, 8, 1_000_000_000, False)}


class Payload:
    """Rows of one payload that still count, by receiver rank, each (id, norm, utc_ns)."""

    def __init__(self, limits: list[list[float]], rule: Rule, kept: list | None = None):
        self.rule, self.n = rule, len(limits)
        self.ticks = [[(v + rule.margin_us) * TICKS_PER_US for v in row] for row in limits]
        self.gate = max(map(max, self.ticks))
        self.first, rows = kept or (None, [[]] * self.n)  # arrival of the first row since the payload was last empty
        self.rows = [deque((tuple(r) for r in own), maxlen=rule.depth) for own in rows]

    def _forget(self, now: int) -> None:
        if self.rule.windowed:  # row by row
            for rows in self.rows:
                while rows and rows[0][2] < now - self.rule.age_ns:
                    rows.popleft()
        elif self.first is not None and self.first < now - self.rule.age_ns:
            self._clear()  # with its first row

    def _clear(self) -> None:
        self.first = None
        for rows in self.rows:
            rows.clear()

    def _nearest(self, rank: int, norm: float) -> tuple:
        return min(self.rows[rank], key=lambda r: abs(r[1] - norm))

    def add(self, rank: int, row: tuple) -> tuple[str, list[tuple] | None]:
        """Verdict of a row on its arrival, and the rows of the event in rank order."""
        self._forget(row[2])
        self.first = row[2] if self.first is None else self.first
        self.rows[rank].append(row)
        picked = []
        if not self.rule.windowed and not all(self.rows):
            return FEW, None
        for other in range(self.n):
            if self.rule.windowed and other == rank:
                picked.append(row)
                continue
            near = sorted((abs(r[1] - row[1]), k) for k, r in enumerate(self.rows[other]) if not self.rule.windowed or abs(r[1] - row[1]) <= self.gate)
            if not near:
                return FEW, None
            if len(near) > 1 and near[1][0] - near[0][0] < self.rule.ambiguity_ticks:
                return UNCLEAR, None
            picked.append(self.rows[other][near[0][1]])
        pairs = list(itertools.combinations(range(self.n), 2))
        fits = [abs(picked[a][1] - picked[b][1]) <= self.ticks[a][b] for a, b in pairs]
        mutual = [self._nearest(b, picked[a][1])[0] == picked[b][0] and self._nearest(a, picked[b][1])[0] == picked[a][0] for a, b in pairs]
        if self.rule.windowed and not all(fits):
            return UNFIT, None
        for fit, both in zip(fits, mutual):  # the first pair that fails names the verdict
            if not (fit and both):
                return (UNCLEAR if fit else UNFIT), None
        if self.rule.windowed:
            for own, r in zip(self.rows, picked):
                own.remove(r)
        else:
            self._clear()
        return EVENT, picked

    def moment(self, picked: list[tuple]) -> int:
        """Time of an event: the median of its arrivals, or the upper of the middle two."""
        at = sorted(r[2] for r in picked)
        half = len(at) // 2
        return at[half] if len(at) % 2 or not self.rule.windowed else (at[half - 1] + at[half]) // 2


def _rows(observations: DataFrame, names: list[str]) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("station") == n, F.lit(i)) for i, n in enumerate(names)])
    rows = observations.withColumn("rank", rank).where("rank is not null and raw_hex is not null and norm is not null and utc_ns is not null and id is not null")
    return rows.select(F.col("raw_hex").cast("string"), F.col("id").cast("string"), F.col("rank").cast("int"), F.col("norm").cast("double"), F.col("utc_ns").cast("long"))


def _verdict(state: Payload, names: list[str], key: str, id_: str, rank: int, norm: float, utc: int) -> dict:
    verdict, picked = state.add(rank, (id_, norm, utc))
    if picked is None:
        return {"raw_hex": key, "id": id_, "verdict": verdict, "utc_ns": utc, "receiver_ids": None, "ids": None, "norms": None}
    return {"raw_hex": key, "id": id_, "verdict": verdict, "utc_ns": state.moment(picked), "receiver_ids": names, "ids": [r[0] for r in picked], "norms": [r[1] for r in picked]}


def strict(observations: DataFrame, stations: list[Station], rule: str | Rule = "modeac") -> DataFrame:
    """observations(id, station, norm, utc_ns, raw_hex) -> one row for each, with its verdict on arrival; an event
    (STRICT_4RX) has the receivers, ids and times it is made of. Arrival is by utc_ns, then receiver, then id.
    Rows of unknown stations, or without an id, key or time, are left out."""
    rule = RULES[rule] if isinstance(rule, str) else rule
    names, limits = [s.name for s in stations], limits_us(stations).tolist()
    cut = gap_segments(_rows(observations, names), ["raw_hex"], "utc_ns", rule.age_ns, ["rank", "id"])

    def run(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for key, segment, id_, rank, norm, utc in zip(*[c.to_pylist() for c in batch.columns]):
                if at != (key, segment):
                    at, state = (key, segment), Payload(limits, rule)
                out.append(_verdict(state, names, key, id_, rank, norm, utc))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    s, text, real = pa.string(), pa.list_(pa.string()), pa.list_(pa.float64())
    arrow = pa.schema([("raw_hex", s), ("id", s), ("verdict", s), ("utc_ns", pa.int64()), ("receiver_ids", text), ("ids", text), ("norms", real)])
    rows = cut.select("raw_hex", F.col("segment").cast("long"), "id", "rank", "norm", "utc_ns")
    return rows.repartition("raw_hex", "segment").sortWithinPartitions("raw_hex", "segment", "utc_ns", "rank", "id").mapInArrow(run, OUT)


def strict_stream(observations: DataFrame, stations: list[Station], rule: str | Rule = "modeac", delay: str = "2 seconds") -> DataFrame:
    """strict() on a stream: state is the kept rows of a payload, at most `depth` of a receiver, ended by a timer when
    they are too old. Rows of a micro-batch are taken in order of utc_ns; later batches are later arrivals."""
    rule = RULES[rule] if isinstance(rule, str) else rule
    names, limits = [s.name for s in stations], limits_us(stations).tolist()
    columns = [c.split()[0] for c in OUT.split(", ")]

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        payload = Payload(limits, rule, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["utc_ns", "rank", "id"], kind="stable")
        out = [_verdict(payload, names, key[0], str(r.id), int(r.rank), float(r.norm), int(r.utc_ns)) for r in rows.itertuples(index=False)]
        kept = [list(r) for r in payload.rows]
        if any(kept):
            newest = max(r[2] for own in kept for r in own)
            state.update((json.dumps([payload.first, kept]),))
            state.setTimeoutTimestamp(max((newest + rule.age_ns) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    rows = _rows(observations, names).withColumn("event_ts", F.timestamp_micros(F.floor(F.col("utc_ns") / 1000).cast("long"))).withWatermark("event_ts", delay)
    return rows.groupBy("raw_hex").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
