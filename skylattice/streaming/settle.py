"""Association of a live stream: rows of a payload settle, then go through the batch kernel.

A payload is emitted when all receivers have reported or nothing new came for `settle` in event
time; what is older than `max_age` without a second receiver expires. State is one short list per
payload, ended by timers, so its size follows the traffic of a second, not the run time.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import Settings, Station
from ..operators.association import Burst, limits_us

OUT = "transmission_key string, receiver_ids array<string>, ids array<string>, norms array<double>, utc_ns long, verdict string"
COLUMNS = ["id", "station", "rank", "norm", "utc_ns", "df", "icao", "family"]


def settle_associate(observations: DataFrame, stations: list[Station], settings: Settings = Settings(), delay: str = "2 seconds") -> DataFrame:
    """observations(id, station, norm, utc_ns, raw_hex, df, icao, family), streaming -> clusters and expired rows, append.
    An id counts once within the watermark; unknown stations and rows without a key are left out."""
    names, limits = [s.name for s in stations], limits_us(stations)
    rank = F.coalesce(*[F.when(F.col("station") == n, F.lit(i)) for i, n in enumerate(names)])
    rows = observations.withColumn("rank", rank).where("rank is not null and raw_hex is not null and norm is not null")
    rows = rows.withColumn("event_ts", F.timestamp_micros(F.floor(F.col("utc_ns") / 1000).cast("long"))).withWatermark("event_ts", delay)
    rows = rows.dropDuplicatesWithinWatermark(["raw_hex", "id"])
    settle_ms, age_ms = max(1, int(settings.settle_s * 1000)), int(settings.max_age_s * 1000)

    def emit(key, held: list[dict]) -> pd.DataFrame:
        b = Burst.of(pd.DataFrame(held, columns=COLUMNS), limits, settings.margin_us, settings.ambiguity_ticks)
        out = []
        for verdict, picked in b.greedy():
            if verdict != "cluster":
                continue
            r = b.rows.iloc[picked]
            out.append((key[0], [names[int(k)] for k in r["rank"]], [str(i) for i in r["id"]], [float(t) for t in r["norm"]], int(r["utc_ns"].min()), "cluster"))
        lost = [str(i) for i, free in zip(b.rows["id"], b.free) if free]
        if lost:
            out.append((key[0], [], lost, [], int(b.rows["utc_ns"].min()), "expired"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def step(key, batches, state):
        held = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield emit(key, held)
            return
        for pdf in batches:
            held += [[None if pd.isna(v) else v for v in row] for row in pdf[COLUMNS].astype(object).itertuples(index=False)]
        if len({h[2] for h in held}) == len(names):
            if state.exists:
                state.remove()
            yield emit(key, held)
            return
        newest, oldest = max(h[4] for h in held) // 1_000_000, min(h[4] for h in held) // 1_000_000
        state.update((json.dumps(held, default=float),))
        due = min(newest + settle_ms, oldest + age_ms)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return rows.select("raw_hex", *COLUMNS, "event_ts").groupBy("raw_hex").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
