"""Coverage outlines: JSON documents, validated."""

from __future__ import annotations

import json
import math
import re
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rings import crosses_itself, open_ring
from ..schema import OUTLINE

#: Limits of an upload and of the store.
MAX_BYTES, MAX_POINTS, MAX_STORED = 2 << 20, 10_000, 64


def parse(raw: bytes) -> list[tuple[float, float]]:
    """The open ring of [lat, lon], or ValueError: too large, no JSON, no points, not numeric, out of range, fewer than
    three distinct points, over the date line, or crossing itself."""
    if len(raw) > MAX_BYTES:
        raise ValueError("the document is larger than 2 MiB")
    try:
        points = json.loads(raw)["actualRange"]["last24h"]["points"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("no actualRange.last24h.points") from e
    if not isinstance(points, list) or len(points) > MAX_POINTS:
        raise ValueError("points must be a list of 10,000 at most")
    ring = []
    for p in points:
        if not isinstance(p, list) or len(p) < 2 or any(isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) for v in p[:2]):
            raise ValueError("points must be numbers")
        if abs(p[0]) > 90 or abs(p[1]) > 180:
            raise ValueError("a point is out of range")
        ring.append((float(p[0]), float(p[1])))
    if len(set(ring)) < 3:
        raise ValueError("fewer than three distinct points")
    out = open_ring(np.array(ring))
    if np.abs(np.diff(np.r_[out[:, 1], out[0, 1]])).max() > 180:
        raise ValueError("the outline crosses the date line")
    if crosses_itself(out):
        raise ValueError("the outline crosses itself")
    return [tuple(p) for p in out.tolist()]


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, k, lat, lon of many documents, adjacent repeats dropped; validation of whole rings is parse()'s."""
    d = spark.read.schema(OUTLINE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    ring = F.transform("actualRange.last24h.points", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon")))
    kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    return d.select("file", F.posexplode(kept).alias("k", "p")).select("file", "k", "p.lat", "p.lon")


class Store:
    """Outlines by id in a folder: create, list, get, delete; 64 at most, files replaced as a whole."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def create(self, raw: bytes, filename: str) -> str:
        ring = parse(raw)
        if len(self.list()) >= MAX_STORED:
            raise ValueError("the store is full")
        key = uuid.uuid4().hex
        part = self.folder / f"{key}.part"
        part.write_text(json.dumps({"id": key, "filename": filename, "points": ring}))
        part.rename(self.folder / f"{key}.json")
        return key

    def list(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def get(self, key: str) -> dict:
        if not re.fullmatch("[0-9a-f]{32}", key) or not (p := self.folder / f"{key}.json").exists():
            raise ValueError("no such outline")
        return json.loads(p.read_text())

    def delete(self, key: str) -> None:
        self.get(key)
        (self.folder / f"{key}.json").unlink()
