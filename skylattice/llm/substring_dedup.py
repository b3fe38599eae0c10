"""Substring dedup: remove every word that lies in a window of words which occurs elsewhere too.

The whole corpus is its own reference here, so automata of all of it cannot be broadcast (see the
README; spans shared with a reference of bounded size are in suffix_automaton.py). Instead every
window goes to the place where its equals go. A window's minimizer is the smallest hash among its
8-word grams; equal windows have equal minimizers, and windows that follow one another mostly
share theirs. So a run of windows travels as one row, keyed by its minimizer, with 48 bits of each
window's own hash: two windows are equal if key and hash are, 112 bits in all.

Minimizers that are very frequent (under HOT_KEYS of them, by counting) would put many rows on one
key. Their windows are keyed one by one, by their hash and 48 bits of a second one, and a task sends a
window once for each SEEN windows that it holds, however often it met it: windows met twice in between
are settled there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

WINDOW, GRAM = 35, 8
#: At most so many minimizers can each have 1 / HOT_KEYS of all runs; below HOT_RUNS none counts as hot.
HOT_KEYS, HOT_RUNS = 1 << 21, 1000  # 16 MB broadcast at most
#: Windows of frequent minimizers that a task holds before it sends them (about 300 bytes each).
SEEN = 500_000
#: Runs that a task compares at once (about 120 bytes each).
RUNS_A_TASK = 100_000
RUN, SINGLE, SETTLED = 0, 1, 2
ROWS = "key long, kind int, doc_id long, digest long, start int, n int, hashes binary"
_BASE = 0x9E3779B97F4A7C15
_WORDS_KEPT = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes, from those of powers of two."""
    out, length, step, size = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, length = step, size
            else:
                m = len(h) - length - size + 1
                out, length = out[:m] * _power(size) + step[length : length + m], length + size
        left >>= 1
        if left:
            m = len(h) - 2 * size + 1
            step, size = step[:m] * _power(size) + step[size : size + m], 2 * size
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def windows(text: str | None, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of each window: its hash and the position and hash of its minimizer. None without a window."""
    w = words(text)
    if len(w) < window:
        return None
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    g = mixed(grams(h, gram))
    view = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    at = np.arange(len(view)) + view.argmin(1)
    return mixed(grams(h, window)), at, g[at]


def second(text: str, window: int) -> np.ndarray:
    """48 bits of another hash of each window, as rows of six bytes."""
    w = words(text)
    h = mixed(np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)))
    return mixed(grams(h, window)).view(np.uint8).reshape(-1, 8)[:, :6]


def _starts(at: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, at[1:] != at[:-1]])


def frequent(docs: DataFrame, window: int, gram: int) -> tuple[np.ndarray, int]:
    """Minimizers of too many runs (sorted, HOT_KEYS at most), and the number of all runs."""

    def run(batches):
        held, size, total = [], 0, 0

        def rows():
            keys, n = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                got = windows(text.as_py(), window, gram)
                if got is None:
                    continue
                keys = got[2][_starts(got[1])]
                held.append(keys)
                size, total = size + len(keys), total + len(keys)
                if size > 1_000_000:
                    yield rows()
                    held, size = [], 0
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["key", "n"])

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts.where(f"key is null or n > {HOT_RUNS}"))
    total = counts.where("key is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = max(HOT_RUNS, total // HOT_KEYS)
    hot = [r.key for r in counts.where(f"key is not null and n > {least}").collect()]
    return np.sort(np.array(hot, dtype=np.int64).view(np.uint64)), total


class _Out:
    """Rows of one task, handed on in batches."""

    def __init__(self):
        self.parts, self.blobs, self.size = [], [], 0

    def add(self, key, kind, doc, digest, start, n, data=b"", offsets=None):
        k = len(key)
        if not k:
            return
        self.parts.append((key, np.full(k, kind, np.int32), np.full(k, doc if doc is not None else 0, np.int64), np.full(k, doc is None), np.full(k, digest, np.int64) if np.isscalar(digest) else digest, start.astype(np.int32), n.astype(np.int32)))
        self.blobs.append((data, np.zeros(k + 1, np.int64) if offsets is None else offsets))
        self.size += k

    def take(self) -> pa.RecordBatch:
        if self.parts:
            cols = [np.concatenate(c) for c in zip(*self.parts)]
        else:
            cols = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, bool, np.int64, np.int32, np.int32)]
        offsets, base, data = [np.zeros(1, np.int64)], 0, []
        for d, o in self.blobs:
            offsets.append(o[1:] + base)
            base += len(d)
            data.append(d)
        offsets = np.concatenate(offsets).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])
        self.__init__()
        key, kind, doc, none, digest, start, n = cols
        arrays = [pa.array(key.view(np.int64)), pa.array(kind), pa.array(doc, mask=none), pa.array(digest), pa.array(start), pa.array(n), blob]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "kind", "doc_id", "digest", "start", "n", "hashes"])


def _flag_runs(flags: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of set flags begin and how long they are; a run ends where `fresh` is set."""
    begin = flags & (fresh | ~np.r_[False, flags[:-1]])
    a = np.flatnonzero(begin)
    end = flags & np.r_[begin[1:] | ~flags[1:], True]
    return a, np.flatnonzero(end) - a + 1


def _send(hot_sent, window: int, gram: int):
    def run(batches):
        hot, out = hot_sent.value, _Out()
        seen: dict[int, list] = {}  # of frequent minimizers: window hash -> [times, doc, digest, start, second hash]

        def send_seen():
            for v, (times, doc, digest, i, more) in seen.items():
                out.add(np.array([v], np.uint64), SINGLE, doc, digest, np.array([i]), np.array([min(times, 2)]), more, np.array([0, 6]))
                if out.size > 20_000:
                    yield out.take()
            seen.clear()

        for batch in batches:
            for doc, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = windows(text.as_py(), window, gram)
                if got is None:
                    continue
                h, at, key = got
                a = _starts(at)
                n = np.diff(np.r_[a, len(at)])
                is_hot = hot[np.minimum(np.searchsorted(hot, key[a]), len(hot) - 1)] == key[a] if len(hot) else np.zeros(len(a), bool)
                six = h.view(np.uint8).reshape(-1, 8)[:, :6]
                if is_hot.any():
                    each = np.repeat(is_hot, n)
                    settled, other = np.zeros(len(h), bool), second(text.as_py(), window)
                    for i in np.flatnonzero(each).tolist():
                        met = seen.get(v := int(h[i]))
                        if met is None:
                            seen[v] = [1, doc, digest, i, other[i].tobytes()]
                        else:
                            settled[i] = True
                            met[0] += 1
                            if met[0] == 2:
                                out.add(np.array([mixed(h[i : i + 1])[0]]), SETTLED, met[1], met[2], np.array([met[3]]), np.array([1]))
                    s, m = _flag_runs(settled, np.zeros(len(h), bool))
                    out.add(mixed(h[s]), SETTLED, doc, digest, s, m)
                    six = six[~each]
                    a, n, key_a = a[~is_hot], n[~is_hot], key[a[~is_hot]]
                else:
                    key_a = key[a]
                out.add(key_a, RUN, doc, digest, a, n, six.tobytes(), np.r_[0, np.cumsum(n) * 6])
                if out.size > 20_000:
                    yield out.take()
                if len(seen) > SEEN:
                    yield from send_seen()
        yield from send_seen()
        yield out.take()

    return run


def _meet(batches):
    """All rows of a partition: spans (doc_id, digest, start, n) of windows that occur twice."""
    got = [b for b in batches if b.num_rows]
    names = ["doc_id", "digest", "start", "n"]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    kind, n, start = (t.column(c).to_numpy() for c in ("kind", "n", "start"))
    rows = [np.flatnonzero(kind == k) for k in (RUN, SINGLE, SETTLED)]
    yield t.select(names).take(pa.array(rows[SETTLED])).combine_chunks().to_batches()[0] if len(rows[SETTLED]) else pa.RecordBatch.from_pylist([], schema=t.select(names).schema)
    key = t.column("key").to_numpy().view(np.uint64)
    size = np.where(kind == RUN, n, np.where(kind == SINGLE, 1, 0)).astype(np.int64)
    owner = np.repeat(np.arange(len(kind)), size)
    first = np.cumsum(size) - size
    within = np.arange(len(owner)) - first[owner]
    run_at = kind[owner] == RUN
    raw = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint8).reshape(-1, 6)
    six = np.zeros((len(raw), 8), np.uint8)
    six[:, :6] = raw
    six, key = six.view(np.uint64).reshape(-1), key[owner]
    code = mixed(six * np.uint64(_BASE) + key + run_at)
    order = np.argsort(code, kind="stable")
    alike = lambda x: x[order[1:]] == x[order[:-1]]
    same = alike(code) & alike(key) & alike(six) & alike(run_at)
    twice = np.zeros(len(code), bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    twice &= run_at | (n[owner] == 1)  # a single met twice in its own task is settled already
    a, m = _flag_runs(twice, within == 0)
    if len(a):
        who = t.select(["doc_id", "digest"]).take(pa.array(owner[a])).combine_chunks()
        cols = [*(c.chunk(0) for c in who.columns), pa.array((start[owner[a]] + within[a]).astype(np.int32)), pa.array(m.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, digest (of the text), spans array<struct<start, n>>: the windows, by first word, that occur
    at another place too. One row for each doc_id and text that has any."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string"))
    hot, total = frequent(rows, window, gram)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RUNS_A_TASK + 1)
    sent = rows.mapInArrow(_send(spark.sparkContext.broadcast(hot), window, gram), ROWS)
    met = sent.repartition(parts, "key").mapInArrow(_meet, "doc_id long, digest long, start int, n int")
    return met.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 [, text (the kept words)] for each row of docs(doc_id, text).

    Null, empty and wordless texts have no words; texts shorter than a window keep all of theirs.
    Rows that repeat are copies of each other, with or without a doc_id; windows that a text repeats
    within itself count. Other columns are ignored.
    """
    spans = repeated_spans(docs, window, gram).select(F.col("doc_id").alias("s_doc"), F.col("digest").alias("s_digest"), "spans")

    def cut(batches):
        for batch in batches:
            n_words, removed, digests, texts = [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2).to_pylist()):
                w = words(text.as_py())
                kept = w
                if own:
                    edge = np.zeros(len(w) + 1, np.int64)
                    for s in own:
                        edge[s["start"]] += 1
                        edge[min(s["start"] + s["n"] + window - 1, len(w))] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [x for x, g in zip(w, gone.tolist()) if not g]
                joined = b" ".join(kept)
                n_words.append(len(w))
                removed.append(len(w) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode("utf-8", "surrogatepass"))
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_text, names=names + ["text"] * with_text)

    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("digest") == F.col("s_digest")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else ""))
