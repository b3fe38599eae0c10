"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints that differ in t bits of m segments on a ring have a segment from which every
chain of l consecutive segments differs in at most l * t / m bits. Candidates are met on the first
two links of such chains: segment i equal and segment i + 1 with at most one differing bit, so one
of its halves equal; the equal bits are the join key. Within a key, the longer chains are checked
before the full Hamming distance. Equal fingerprints are one class before any of this.

A key that holds more than CAP fingerprints is dealt again by the pigeonhole rule over the bits
that its key leaves open (one of four parts is equal), level by level: every link keeps a key at
each level, and once few bits are open a key cannot hold more than 2^open fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, connected_components, free_name, written

BITS, SEGMENTS, REACH = 64, 4, 3
#: Fingerprints compared with each other in one key; larger keys are split, never cut.
CAP = 1024


def words(text: str | None, lower: bool = True) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()  # bytes: A-Z only, and the six ASCII separators


def shingles(w: list[bytes], n: int) -> list[bytes]:
    """All n-word shingles, repeats included; fewer words: the whole sequence; none: nothing."""
    if len(w) < n:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)))))


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    s = shingles(words(text), n)
    if not s:
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(s), 1 << 16):
        part = s[at : at + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in part), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(s), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _part_masks(open_bits: int, parts: int) -> list[int]:
    """The set bits of a mask, dealt in order into `parts` runs as even as can be."""
    at = [b for b in range(BITS) if open_bits >> b & 1]
    cuts = [round(i * len(at) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in at[a:z]) for a, z in zip(cuts, cuts[1:])]


def first_masks() -> list[int]:
    """Segment i and one half of segment i + 1, for each i and half."""
    w = BITS // SEGMENTS
    return [(((1 << w) - 1) << w * i) | (((1 << w // 2) - 1) << (w * ((i + 1) % SEGMENTS) + half * w // 2)) for i in range(SEGMENTS) for half in (0, 1)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: the bits under the mask are the key."""
    which = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask")
    return fps.select(which, "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _chains(x: np.ndarray) -> np.ndarray:
    """Pigeonring check of xor words: from some segment on, every chain of l segments differs in at
    most l * REACH / SEGMENTS bits."""
    w = BITS // SEGMENTS
    d = [_bits(x >> np.uint64(w * i) & np.uint64((1 << w) - 1)).astype(np.int64) for i in range(SEGMENTS)]
    ok = np.zeros(len(x), bool)
    for i in range(SEGMENTS):
        total, here = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for n in range(1, SEGMENTS + 1):
            total = total + d[(i + n - 1) % SEGMENTS]
            here &= total * SEGMENTS <= n * REACH
        ok |= here
    return ok


def _links(batches):
    """Rows sorted by (mask, key): a forest of links for each run of equal keys."""
    rest = None
    for batch in _and_none(batches):
        if batch is not None:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rest = new if rest is None else np.concatenate([rest, new], 1)
            same = (rest[0] == rest[0, -1]) & (rest[1] == rest[1, -1]) if rest.shape[1] else np.zeros(0, bool)
            done = int(rest.shape[1] - same[::-1].argmin()) if not same.all() else 0
            now, rest = rest[:, :done], rest[:, done:]
        else:
            now = rest
        if now is None or not now.shape[1]:
            continue
        mask, key, fp = now[0], now[1], now[2].view(np.uint64)
        first = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(first)
        alive, step, pairs = np.arange(len(fp)), 1, []
        while True:
            alive = alive[alive + step < len(fp)]
            alive = alive[run[alive] == run[alive + step]]
            if not len(alive):
                break
            x = fp[alive] ^ fp[alive + step]
            good = _chains(x)
            good[good] = _bits(x[good]) <= REACH
            pairs.append(np.stack([alive[good], alive[good] + step]))
            step += 1
        if pairs:
            yield _forest(fp.view(np.int64), np.concatenate(pairs, 1))


def _and_none(it):
    yield from it
    yield None


def _forest(fp: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """Of links between rows, those that join two parts: no more than there are fingerprints."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    a, b = [], []
    for i, j in pairs.T.tolist():
        x, y = find(i), find(j)
        if x != y:
            parent[x] = y
            a.append(int(fp[i]))
            b.append(int(fp[j]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints within REACH bits: fps(fp), distinct."""
    spark = fps.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out, rows = None, keyed(fps, first_masks())
    for level in range(1, 6):
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(f"n > {cap}")
        large = written(sizes.select("mask", "key"))
        more = level < 5 and large.limit(1).count() > 0
        own = rows.join(large, ["mask", "key"], "left_anti") if more else rows
        met = own.select("mask", "key", "fp").repartition(parts, "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_links, "a long, b long")
        out = met if out is None else out.union(met)
        if not more:
            break
        split = F.udf(lambda m: [_signed((m & (1 << 64) - 1) | p) for p in _part_masks(~m & (1 << 64) - 1, 4)], T.ArrayType(T.LongType()))
        masks = large.select("mask").distinct().select("mask", F.explode(split("mask")).alias("finer"))
        rows = written(rows.join(large, ["mask", "key"], "left_semi").join(masks, "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp").distinct())
    return out.distinct()


def components(docs: DataFrame, n: int = 3, cap: int = CAP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself
    included) for each row of docs(doc_id, text).

    Null, empty and blank texts have the fingerprint zero, which links like any other. Equal texts
    are one class. A null doc_id keeps its row and takes part in links; a component of nothing but
    nulls has a null component_id. Other columns are ignored.
    """
    fps = written(fingerprints(docs, n))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected_components(links(classes.select("fp"), cap))
    rooted = classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate groups at a similarity below what three bits reach ------------------------------

#: Words of a shingle, least similarity of the shingle sets, and bits of the signatures of the sets of words and of shingles.
NEAR_WORDS, NEAR_SIMILARITY, MET, WIDE = 5, 0.8, 256, 512
#: Standard errors of the estimate by which pairs just below are still candidates for the exact comparison. Fewer
#: miss pairs at the very edge of the similarity (one: 23 of 8,999 links on 0.1 GB, two: 6).
NEAR_ERRORS = 3.0
#: Up to so many documents are picked by a broadcast of their ids; more by a bitmap of them and a shuffle of what it holds.
BROADCAST_NAMES = 1_000_000
#: Bits of that bitmap for each id, and at most (32 MB).
NAME_BITS, MAP_BITS = 8, 1 << 28
#: Keys of up to so many times CAP rows are compared block by block; larger ones are split by bits first.
BLOCKS = 16
#: Digests of shingles of a block of the texts that are compared by their sets; larger groups are cut into blocks.
SETS_HELD = 1 << 20
#: Rows of a run up to which all its pairs are compared at once; in longer ones a row that has been reached is left out.
STEPS = 32
_DIGESTS_KEPT = 200_000


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        d = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _DIGESTS_KEPT:
            self.clear()
        self[word] = d
        return d


_digests = _Digests()


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of further bits of 64-bit digests."""
    x = (x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def wide(digests: np.ndarray, bits: int) -> np.ndarray:
    """The majority bits of the digests, as words of 64."""
    total = np.zeros(bits, np.int64)
    for at in range(0, len(digests), 255 * 16):
        part = digests[at : at + 255 * 16]
        rows = np.stack([_mixed(part, k) for k in range(bits // 64)], 1).view(np.uint8)
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        for k in range(0, len(rows), 255):  # sums of 255 ones fit a byte
            total += rows[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(digests), bitorder="little").view(np.uint64)


def shingle_set(w: list[bytes]) -> np.ndarray:
    """Digests of the set of shingles, sorted."""
    parts = set(shingles(w, NEAR_WORDS))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)))


def signature(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Digest of the words, signature of the set of words (where candidates meet) and of the set of five-word
    shingles (what is compared)."""
    w = words(text)
    own = set(w)
    return xxhash.xxh3_64_intdigest(b" ".join(w)), wide(np.fromiter(map(_digests.__getitem__, own), np.uint64, len(own)), MET), wide(shingle_set(w), WIDE)


def most_bits(similarity: float = NEAR_SIMILARITY, errors: float = NEAR_ERRORS) -> int:
    """Differing bits that sets of that Jaccard similarity have, plus standard errors: the cosine of two sets is
    2 J / (1 + J), and a bit differs with the angle's share of pi."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * p + errors * np.sqrt(WIDE * p * (1 - p)))


_W, _G = [f"w{i}" for i in range(MET // 64)], [f"g{i}" for i in range(WIDE // 64)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the words), w0..w3, g0..g7."""
    names = ["doc_id", "node", *_W, *_G]

    def run(batches):
        for batch in batches:
            node, met, sig = zip(*[signature(t.as_py()) for t in batch.column(1)]) if batch.num_rows else ([], [], [])
            cols = np.concatenate([np.array(met, np.uint64).reshape(-1, len(_W)), np.array(sig, np.uint64).reshape(-1, len(_G))], 1).view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), *[pa.array(np.ascontiguousarray(c)) for c in cols]], names=names)

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _near(limit: int, k: int):
    """Rows (met, slot, node, root, w0..w3, g0..g7) sorted by met -> node, other, bits, more: the k nearest rows of a run
    of equal met for each of its rows, of another root and within the limit (by bits, then node); more: it has
    more than these. All rows of a run are compared with each other; a pair that meets under several of the first
    keys counts under the first of them only."""
    masks = [np.uint64(m) for m in first_masks()]

    def first_slot(x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape[1], -1, np.int64)
        for slot in reversed(range(len(x) * len(masks))):
            out[x[slot // len(masks)] & masks[slot % len(masks)] == 0] = slot
        return out

    def nearest(node: np.ndarray, found: list[np.ndarray], seen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        i, j, d = np.concatenate(found, 1)
        order = np.lexsort((node[j], d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        seen = np.maximum(seen, np.bincount(i, minlength=len(node)))
        return [np.stack([x[rank < k] for x in (i, j, d)])], seen

    def run(batches):
        rest = None
        for batch in _and_none(batches):
            if batch is not None:
                new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
                rest = new if rest is None else np.concatenate([rest, new], 1)
                same = rest[0] == rest[0, -1] if rest.shape[1] else np.zeros(0, bool)
                done = int(rest.shape[1] - same[::-1].argmin()) if not same.all() else 0
                now, rest = rest[:, :done], rest[:, done:]
            else:
                now = rest
            if now is None or not now.shape[1]:
                continue
            met, slot, node, root = now[:4]
            word, sig = now[4 : 4 + len(_W)].view(np.uint64), now[4 + len(_W) :].view(np.uint64)
            alive, step, found, held, seen = np.arange(len(met)), 1, [], 0, np.zeros(len(met), np.int64)
            while True:
                alive = alive[alive + step < len(met)]
                alive = alive[met[alive] == met[alive + step]]
                if not len(alive):
                    break
                apart = alive[root[alive] != root[alive + step]]
                d = _bits(sig[:, apart] ^ sig[:, apart + step]).astype(np.int64).sum(0)
                good = d <= limit
                i, d = apart[good], d[good]
                own = (slot[i] < 0) | (first_slot(word[:, i] ^ word[:, i + step]) == slot[i])
                i, d = i[own], d[own]
                found += [np.stack([i, i + step, d]), np.stack([i + step, i, d])]
                held += 2 * len(i)
                if held > 2_000_000:
                    found, seen = nearest(node, found, seen)
                    held = found[0].shape[1] - 1_000_000  # what is kept anyhow does not count
                step += 1
            if found:
                found, seen = nearest(node, found, seen)
                i, j, d = found[0]
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(d), pa.array(seen[i] > k)], names=["node", "other", "bits", "more"])

    return run


def _tree(sig: np.ndarray, limit: int) -> np.ndarray:
    """Pairs (i, j) within the limit that connect all columns which such pairs connect: fewer than there are columns.
    What has been reached is not compared again."""
    left, todo, pairs = np.arange(sig.shape[1]), [], [np.zeros((2, 0), np.int64)]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        hit = _bits(sig[:, left] ^ sig[:, i : i + 1]).astype(np.int64).sum(0) <= limit
        if hit.any():
            pairs.append(np.stack([np.full(int(hit.sum()), i), left[hit]]))
            todo, left = todo + left[hit].tolist(), left[~hit]
    return np.concatenate(pairs, 1)


def _trees(limit: int):
    """Rows (met, node, g0..g7) sorted by met -> a, b: for each run of equal met, pairs within the limit that connect
    all its rows which such pairs connect, fewer than it has rows."""

    def run(batches):
        rest = None
        for batch in _and_none(batches):
            if batch is not None:
                new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
                rest = new if rest is None else np.concatenate([rest, new], 1)
                same = rest[0] == rest[0, -1] if rest.shape[1] else np.zeros(0, bool)
                done = int(rest.shape[1] - same[::-1].argmin()) if not same.all() else 0
                now, rest = rest[:, :done], rest[:, done:]
            else:
                now = rest
            if now is None or not now.shape[1]:
                continue
            met, node, sig = now[0], now[1], now[2:].view(np.uint64)
            starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
            long = np.diff(np.r_[starts, len(met)])
            pairs = [_tree(sig[:, at : at + n], limit) + at for at, n in zip(starts[long > STEPS].tolist(), long[long > STEPS].tolist())]
            alive, step = np.flatnonzero(np.repeat(long <= STEPS, long)), 1
            while True:
                alive = alive[alive + step < len(met)]
                alive = alive[met[alive] == met[alive + step]]
                if not len(alive):
                    break
                good = alive[_bits(sig[:, alive] ^ sig[:, alive + step]).astype(np.int64).sum(0) <= limit]
                pairs.append(np.stack([good, good + step]))
                step += 1
            if pairs:
                yield _forest(node, np.concatenate(pairs, 1))

    return run


def _slots(classes: DataFrame) -> DataFrame:
    """A row for each class and key: met (digest of the key), slot (the key's number), mask and w (its word of the
    signature)."""
    masks = [_signed(m) for m in first_masks()]
    each = F.explode(F.array(*[F.struct(F.lit(i * len(masks) + k).cast("long").alias("slot"), F.lit(i).alias("word"), F.lit(m).cast("long").alias("mask"), F.col(f"w{i}").alias("w")) for i in range(len(_W)) for k, m in enumerate(masks)])).alias("s")
    return _keys(classes.select("node", "root", *_W, *_G, each).select("*", "s.*").drop("s"))


def _keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("met", F.xxhash64("word", "mask", F.col("w").bitwiseAND(F.col("mask"))))


def _compared(classes: DataFrame, columns: list[str], kernel, schema: str, cap: int, blocks: int) -> DataFrame:
    """What the kernel gives for the rows of each key, (met, *columns) sorted by met and node, of the classes (node,
    root, signatures).

    A key of more than cap rows is cut into blocks, and each pair of blocks is compared: no pair of its
    rows is left out. One of more than blocks * cap is dealt again by the bits its mask leaves open, as in
    links(), until few are open.
    """
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out, rows = None, _slots(classes)
    for level in range(1, 6):
        sizes = rows.groupBy("met").agg(F.count("*").alias("n")).where(f"n > {cap}")
        large = written(sizes.select("met", F.ceil(F.col("n") / cap).cast("long").alias("blocks")))
        more = level < 5 and not large.where(f"blocks > {blocks}").isEmpty()
        small = F.broadcast(large) if large.count() <= 100_000 else large
        dealt = rows.join(small, "met", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.where(f"blocks <= {blocks}") if more else dealt
        met = _block_pairs(dealt, "met", columns).repartition(parts, "met").sortWithinPartitions("met", "node").mapInArrow(kernel, schema)
        out = met if out is None else out.union(met)
        if not more:
            break
        split = F.udf(lambda m: [_signed((m & (1 << 64) - 1) | p) for p in _part_masks(~m & (1 << 64) - 1, 4)], T.ArrayType(T.LongType()))
        over = rows.join(small, "met").where(f"blocks > {blocks}").select(F.lit(-1).cast("long").alias("slot"), "node", "root", "word", "mask", "w", *_W, *_G)
        finer = written(over.select("mask").distinct().select("mask", F.explode(split("mask")).alias("finer")))
        rows = written(_keys(over.join(F.broadcast(finer), "mask").drop("mask").withColumnRenamed("finer", "mask").distinct()))
    return out


def _block_pairs(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and columns of rows(key, blocks, node, ...): a row of a key of several blocks comes once for each pair of
    blocks that its own is in, under a key for the pair."""
    dealt = rows.select("*", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    pair = F.when(F.col("blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("own", "with"), F.greatest("own", "with")))
    return dealt.select(pair.alias(key), *columns)


def candidate_trees(classes: DataFrame, cap: int = CAP, blocks: int = BLOCKS) -> DataFrame:
    """a, b: pairs of classes(node, signatures) within the limit that connect all classes which any candidates connect.
    A key gives fewer pairs than it has rows, however many of its rows are candidates of each other."""
    found = _compared(classes.withColumn("root", F.col("node")), ["node", *_G], _trees(most_bits()), "a long, b long", cap, blocks)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(classes: DataFrame, k: int = 1, cap: int = CAP, blocks: int = BLOCKS) -> DataFrame:
    """node, other, more: for each of the classes (node, root, signatures) the k nearest of other roots that it
    meets under a key within the limit; more: there are others. near_groups() goes by candidate_trees() instead,
    which do not grow with k."""
    out = _compared(classes, ["slot", "node", "root", *_W, *_G], _near(most_bits(), k), "node long, other long, bits long, more boolean", cap, blocks)
    if k == 1:  # a partial minimum before the shuffle
        nearest = out.groupBy("node").agg(F.min(F.struct("bits", "other")).alias("x"), (F.max("more") | (F.min("other") < F.max("other"))).alias("more"))
        return nearest.select("node", "x.other", "more")
    each = out.groupBy("node", "other").agg(F.min("bits").alias("bits"), F.max("more").alias("more"))  # a node has k under a key at most
    by = Window.partitionBy("node")
    ranked = each.select("node", "other", F.row_number().over(by.orderBy("bits", "other")).alias("rank"), (F.max("more").over(by) | (F.count("*").over(by) > k)).alias("more"))
    return ranked.where(F.col("rank") <= k).select("node", "other", "more")


def picked(docs: DataFrame, ids: DataFrame, without: bool = False) -> DataFrame:
    """The rows of docs whose doc_id is in the one column of ids (long, distinct, none null), or all others. The texts of a
    table are not shuffled for it: up to BROADCAST_NAMES ids are broadcast; of more, a bitmap, and only the rows that it
    holds (those picked and about one in eight of the others) meet the ids themselves."""
    how, name, id_ = "left_anti" if without else "left_semi", ids.columns[0], F.col("doc_id").cast("long")
    n = ids.count()
    if n <= BROADCAST_NAMES:
        return docs.join(F.broadcast(ids), id_ == F.col(name), how)
    bits, bucket, held = min(NAME_BITS * n, MAP_BITS), free_name(docs, "bucket"), free_name(docs, "held")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = ids.select(F.bitmap_bucket_number(at(F.col(name))).alias(bucket), F.bitmap_bit_position(at(F.col(name))).alias("bit"))
    maps = F.broadcast(written(own.groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(held))))
    bit = F.bitmap_bit_position(at(id_))
    byte = F.conv(F.hex(F.substring(held, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1, F.lit(False))
    marked = docs.join(maps, F.bitmap_bucket_number(at(id_)) == F.col(bucket), "left")
    met = marked.where(hit).drop(bucket, held).join(ids, id_ == F.col(name), how)
    return met.union(marked.where(~hit).drop(bucket, held)) if without else met


def shingle_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """node, grams (digests of the set of shingles) of the texts that need(node, least) asks for."""

    def run(batches):
        for batch in batches:
            own = [words(t.as_py()) for t in batch.column(0)]
            nodes = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in own], np.uint64).view(np.int64)
            grams = pa.array([shingle_set(w).view(np.int64) for w in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), grams], names=["node", "grams"])

    ids = written(need.select(F.col("least").alias("_least")).where("_least is not null").distinct())
    d = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = picked(d, ids)
    if not need.where("least is null").isEmpty():
        texts = texts.union(d.where("doc_id is null"))
    return texts.select("text").mapInArrow(run, "node long, grams array<long>").join(need.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _alike(node: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of texts whose sets have the similarity, exactly: as many as connect all texts which such pairs connect.
    flat: the digests of the sets, one set after the other.

    Sets x and y of the similarity share at least 0.8 of the larger, so one of the first 0.2 |x| + 1 shingles of x, by
    how many texts have them, is among those of y: only texts that meet there are compared, and no
    text that has been reached is compared again.
    """
    percent = round(100 * NEAR_SIMILARITY)
    n, doc = len(node), np.repeat(np.arange(len(node)), sizes)
    which, ids = np.unique(flat, return_inverse=True)
    held = np.ones(len(ids), bool)
    for _ in range(3):  # a shingle of one text links nothing, a text of too few others has no link
        held &= np.bincount(ids[held], minlength=len(which))[ids] > 1
        fit = (np.bincount(doc[held], minlength=n) * 100 >= sizes * percent) & (sizes > 0)
        if fit[doc[held]].all():
            break
        held &= fit[doc]
    if not held.any():
        return []
    doc, ids = doc[held], ids[held]
    _, ids, count = np.unique(ids, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ids = rank[ids]
    order = np.lexsort((ids, doc))
    doc, ids = doc[order], ids[order]
    ends = np.searchsorted(doc, np.arange(n + 1))
    kept = np.diff(ends)
    first = np.where(kept > 0, np.maximum(0, kept - -(-sizes * percent // 100) + 1), 0)  # of those held; the others come before
    prefix = np.flatnonzero(np.arange(len(doc)) - ends[doc] < first[doc])
    prefix = prefix[np.argsort(ids[prefix], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(ids[prefix]) > 0]) if len(prefix) else np.zeros(0, np.int64)
    meet = dict(zip(ids[prefix][cuts].tolist(), np.split(doc[prefix], cuts[1:])))
    left, mark, pairs = first > 0, np.zeros(len(count), bool), []
    for seed in np.flatnonzero(left).tolist():
        todo = [seed] if left[seed] else []
        left[seed] = False
        while todo:
            i = todo.pop()
            own, near = ids[ends[i] : ends[i + 1]], []
            for s in own[: first[i]].tolist():
                meet[s] = m = meet[s][left[meet[s]]]
                near.append(m)
            near = np.unique(np.concatenate(near))
            near = near[np.minimum(sizes[near], sizes[i]) * 100 >= np.maximum(sizes[near], sizes[i]) * percent]
            if not len(near):
                continue
            mark[own] = True
            if len(near) * 8 < n:
                same = np.array([np.count_nonzero(mark[ids[ends[j] : ends[j + 1]]]) for j in near.tolist()])
            else:
                same = np.bincount(doc[mark[ids]], minlength=n)[near]
            mark[own] = False
            hit = near[same * 100 >= (sizes[near] + sizes[i] - same) * percent].tolist()
            left[hit] = False
            pairs += [(i, j) for j in hit]
            todo += hit
    return pairs


def _judged(batches):
    """Rows (met, node, grams) sorted by met -> a, b: the pairs of _alike() of each run of equal met."""
    key, pieces = None, []

    def pairs():
        node, sizes, flat = (np.concatenate(x) for x in zip(*pieces))
        return [(int(node[i]), int(node[j])) for i, j in _alike(node, sizes, flat)] if len(node) > 1 else []

    for batch in _and_none(batches):
        found = []
        if batch is not None and batch.num_rows:
            met, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, at = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
            cuts = np.flatnonzero(np.r_[True, met[1:] != met[:-1], True]).tolist()
            for a, z in zip(cuts, cuts[1:]):
                if pieces and met[a] != key:
                    found += pairs()
                    pieces = []
                key = met[a]
                pieces.append((node[a:z], sizes[a:z], flat[at[a] : at[z]]))
        elif batch is None and pieces:
            found = pairs()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])


def near_roots(classes: DataFrame, docs: DataFrame, cap: int = CAP, blocks: int = BLOCKS, held: int = SETS_HELD) -> DataFrame:
    """node, root of classes(node, least, signatures) that are linked with others: root is the same for all that links
    of the similarity connect.

    Classes that candidates connect are a group; the sets of a group meet in one task, each once, and all its links are
    found there. A group of more than `held` shingles is cut into blocks, and each pair of blocks is compared. Every
    step gives fewer pairs than it has rows, however many of a group's pairs are candidates or links.
    """
    classes = classes.select("node", "least", *_W, *_G)
    shared = classes.groupBy("least").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1 and least is not null")
    edges = classes.join(shared, "least").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = written(connected_components(candidate_trees(classes, cap, blocks)))
    need = written(classes.select("node", "least").join(groups, "node"))
    sets = written(shingle_sets(docs, need).join(need.select("node", F.col("root").alias("met")), "node"))
    size = F.sum(F.size("grams").cast("long"))
    large = written(sets.groupBy("met").agg(F.ceil(size / held).cast("long").alias("blocks")).where("blocks > 1"))
    small = F.broadcast(large) if large.count() <= 100_000 else large
    dealt = bounded(sets).join(small, "met", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = _block_pairs(dealt, "met", ["node", "grams"]).repartition(parts, "met").sortWithinPartitions("met", "node").mapInArrow(_judged, "a long, b long")
    return connected_components(edges.union(near))


def near_groups(docs: DataFrame, cap: int = CAP, blocks: int = BLOCKS, held: int = SETS_HELD) -> DataFrame:
    """doc_id, component_id: documents whose sets of five-word shingles have a similarity of 0.8 or more are linked.

    Equal word sequences are one class. Classes meet where a segment and a half of the next agree in one of
    four SimHashes of their word sets; those whose 512-bit SimHashes of the shingle sets are within three
    standard errors are candidates, and what candidates connect is judged by the sets themselves (see near_roots()). Keys
    are dealt by their digest, so that none is cut between tasks, and all rows of a key are compared. Null, empty and blank texts
    are one class, texts of fewer than five words have their whole sequence as the only shingle; rows
    that repeat a doc_id are linked.
    """
    sig = written(signatures(docs))
    classes = written(sig.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in (*_W, *_G)]))
    roots = near_roots(classes, docs, cap, blocks, held)
    ids = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return sig.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their near_groups() (smallest doc_id), columns as they were. Of rows
    that repeat a doc_id the first by text stays (a null text before all others), of equal ones any; rows without a
    doc_id cannot be named and stay. Null, empty and blank texts are one group."""
    first, id_ = free_name(docs, "first"), F.col("doc_id").cast("long")
    heads = near_groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("head"))
    gone = written(heads.where(~F.col("head")).select(F.col("doc_id").alias(first)))
    named = picked(docs.where(id_.isNotNull()), gone, without=True)
    again = written(docs.groupBy(id_.alias(first)).agg(F.count("*").alias("n")).where(f"n > 1 and {first} is not null").select(first))
    nameless = docs.where(id_.isNull())
    if again.isEmpty():
        return named.union(nameless)
    row = F.struct("*")
    many = named.join(again, id_ == F.col(first), "left_semi").groupBy(id_.alias(first)).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    return named.join(again, id_ == F.col(first), "left_anti").union(many).union(nameless)
