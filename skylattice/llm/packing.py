"""Best-fit packing: pattern packing by non-negative least squares.

Only the histogram of piece lengths (at most `limit` numbers) reaches the driver. There, patterns
of two and three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded without overdrawing any length, and
what is left over is packed best-fit-decreasing, still on the histogram. The plan has as many rows
as there are patterns, whatever the number of documents. Executors then number the pieces of each
length (a rank within the task that made them, plus the count of earlier tasks) and look the rank
up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenizer as tk
from .common import bounded, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"
SLOTS = "length long, lo long, hi long, copies long, base long, shift long"
#: Slot tables up to so many rows are broadcast (48 bytes a row); larger ones are joined by shuffle.
BROADCAST_SLOTS = 500_000


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full pieces, the remainder first."""
    if n <= limit:
        return [(0, n)]
    first = n % limit
    return ([(0, first)] if first else []) + [(s, limit) for s in range(first, n, limit)]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int | None = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, block, rank [, ids].

    block and rank number the pieces of a length within the task that made them, so write the rows
    before using both. A null text is an empty one; an empty document is its end id alone (no row
    without one). Documents that repeat are packed as often as they occur; other columns are ignored.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast((tokenizer_path, tk.file_bytes(tokenizer_path)))

    def run(batches):
        enc = tk.load(*data.value)
        block, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
        end = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([enc.ids(text.as_py() or ""), end]).astype("<u4", copy=False)
                for k, (start, n) in enumerate(cut(len(ids), limit) if len(ids) else []):
                    part = ids[start : start + n]
                    row = (doc, k, start, n, zlib.crc32(part.tobytes()), block, seen[n])
                    seen[n] += 1
                    for col, v in zip(out, row):
                        col.append(v)
                    if with_ids:
                        out[7].append(part.astype(np.int32))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank", "ids"][: 7 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(out, types, names)], names=names)

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def patterns(lengths: list[int], limit: int, most: int = 200_000) -> list[np.ndarray]:
    """Index arrays (pairs, triples) of lengths that add up to `limit`. Triples are enumerated over as
    many lengths as keep their number under `most`; they are a search space, not a cap on rows."""
    have = np.zeros(limit + 1, bool)
    have[[x for x in lengths if 0 < x < limit]] = True
    a = np.flatnonzero(have)
    two = a[(a <= limit - a) & have[limit - a]]
    out = [np.stack([two, limit - two], 1)]
    pool = a
    while len(pool) ** 2 > 12 * most:
        pool = pool[:: 2]
    x, y = np.meshgrid(pool, pool, indexing="ij")
    x, y = x[x <= y], y[x <= y]
    z = limit - x - y
    ok = z >= y
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    out.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return [p for p in out if len(p)]


def fit(hist: np.ndarray, groups: list[np.ndarray], rounds: int = 300) -> list[np.ndarray]:
    """Non-negative least squares of pattern repeats to the histogram, by accelerated projected
    gradient; a pattern's column of the matrix has a one for each of its lengths."""
    n, scale = len(hist), max(hist.max(), 1)
    target = hist / scale

    def forward(xs):
        got = np.zeros(n)
        for p, x in zip(groups, xs):
            for j in range(p.shape[1]):
                got += np.bincount(p[:, j], x, n)
        return got

    def back(r):
        return [r[p].sum(1) for p in groups]

    v = [np.ones(len(p)) for p in groups]
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(forward(v))
        norm = np.sqrt(sum((x**2).sum() for x in v))
        v = [x / norm for x in v]
    step = 1 / (1.05 * norm)
    x = [np.zeros(len(p)) for p in groups]
    y, t = x, 1.0
    for _ in range(rounds):
        new = [np.maximum(b + step * g, 0) for b, g in zip(y, back(target - forward(y)))]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = [a + (t - 1) / t2 * (a - b) for a, b in zip(new, x)]
        x, t = new, t2
    return [a * scale for a in x]


def plan(hist: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((length, copies), ...) -> number of sequences, for a histogram of lengths 1 to limit. Repeats are rounded to the
    nearest number, down, and (small histograms have such fits) to nothing; the plan of fewest sequences stands."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in hist.items():
        left[length] = n
    full = [(((limit, 1),), int(left[limit]))] if left[limit] else []
    left[limit] = 0
    groups = patterns(list(np.flatnonzero(left)), limit)
    fitted = fit(left.astype(float), groups) if groups else []
    tries = [_rounded(left, limit, groups, fitted, up) for up in (0.5, 0.0, None)]
    return full + min(tries, key=lambda p: sum(n for _, n in p))


def _rounded(left: np.ndarray, limit: int, groups: list[np.ndarray], fitted: list[np.ndarray], up: float | None) -> list:
    """Patterns with repeats floor(x + up), no length overdrawn, and best fit for the rest."""
    left, out = left.copy(), []
    for p, x in zip(groups, fitted) if up is not None else ():
        for i in np.argsort(-x, kind="stable"):
            if x[i] + up < 1:
                break
            need = defaultdict(int)
            for length in p[i].tolist():
                need[length] += 1
            n = min(int(x[i] + up), *(int(left[k]) // c for k, c in need.items()))
            if n > 0:
                out.append((tuple(need.items()), n))
                for k, c in need.items():
                    left[k] -= n * c
    return out + best_fit(left, limit)


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over counts: sequences alike are one group; placing a length splits at most one."""
    rooms: dict[int, list[list]] = {}
    keys: list[int] = []

    def put(room, pattern, n):
        if room not in rooms:
            rooms[room] = []
            bisect.insort(keys, room)
        rooms[room].append([pattern, n])

    for length in range(limit, 0, -1):
        c = int(left[length])
        while c:
            i = bisect.bisect_left(keys, length)
            if i == len(keys):
                room, pattern, n = limit, (), c
            else:
                room = keys[i]
                pattern, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], keys[i]
            q = room // length
            full = min(n, c // q)
            if full:
                put(room - q * length, (*pattern, (length, q)), full)
                c, n = c - full * q, n - full
            if n and 0 < c < q:
                put(room - c * length, (*pattern, (length, c)), 1)
                c, n = 0, n - 1
            if n and pattern:
                put(room, pattern, n)
    return [(pattern, n) for room in keys for pattern, n in rooms[room]]


def slots(planned) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, copies, base, shift): the pieces of a length ranked lo to hi go, `copies`
    at a time, to the sequences from `base`, the first of them at offset `shift`."""
    used, base, rows = defaultdict(int), 0, []
    for pattern, n in planned:
        shift = 0
        for length, copies in pattern:
            lo = used[length]
            used[length] = lo + n * copies
            rows.append((length, lo, used[length], copies, base, shift))
            shift += length * copies
        base += n
    return rows


def pack(made: DataFrame, limit: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces(); drops block and rank. An empty
    table gives an empty one."""
    spark = made.sparkSession
    counts = made.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    hist = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = slots(plan(hist, limit))
    place = spark.createDataFrame(rows, SLOTS)
    if len(rows) <= BROADCAST_SLOTS:
        place = F.broadcast(place)
    at = F.col("earlier") + F.col("rank")
    extra = [c for c in made.columns if c not in ("block", "rank")]
    nth = F.col("at") - F.col("lo")
    return (
        made.join(earlier, ["block", "length"])
        .withColumn("at", at)
        .join(place.withColumnRenamed("length", "slot"), (F.col("length") == F.col("slot")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        .select(*extra, (F.col("base") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("shift") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int | None = 2) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, tokenizer_path, limit, end_id)), limit)
