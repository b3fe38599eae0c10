"""URL filters by a sorted array of 64-bit digests.

Rules (host, path) are hashed by xxhash64 into a sorted array with the full strings beside it. The
array is broadcast, each Python worker puts it into a file of its own and maps that into memory; a
batch of URLs is probed with one vectorised binary search, and every hit is confirmed against the
stored string. Rule lists beyond `MAX_BROADCAST` bytes are not broadcast: candidates are joined.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

ALLOW, BLOCK = "allow", "block"
MAX_BROADCAST = 256 << 20
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_mapped: dict[str, tuple] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #.
    A null, or a text without ://, has neither."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    host = host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    return host, rest[: min(ends)] if ends else rest


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def build(rules: list[tuple[str, str]]) -> dict:
    """rules: (verdict, 'host/path...'). A later rule of the same string replaces an earlier one."""
    verdicts = {r: v for v, r in rules}
    order = sorted(verdicts, key=lambda r: (digest(r), r))
    depths = sorted({len(r.partition("/")[2]) + 1 for r in order})
    return {
        "digests": np.array([digest(r) for r in order], dtype=np.uint64).tobytes(),
        "strings": order,
        "verdicts": [verdicts[r] for r in order],
        "depths": depths,  # lengths that rule paths have: the only prefixes of a path worth a probe
        "labels": sorted({r.partition("/")[0].count(".") + 1 for r in order}),  # numbers of labels that rule hosts have
    }


def candidates(host: str, path: str, depths: list[int], labels: list[int]) -> list[str]:
    """Rule strings that would fit: the host or a parent domain of as many labels as a rule has, longest first, and
    a prefix of the path. Linear in the URL, however many labels it has."""
    if not host or path[:1] != "/":
        return []
    parents, at = [], len(host)
    for n in range(1, labels[-1] + 1 if labels else 1):
        at = host.rfind(".", 0, at)
        if n in labels:
            parents.append(host[at + 1 :])
        if at < 0:
            break
    return [h + path[:n] for h in reversed(parents) for n in depths if n <= len(path)]


class DigestArray:
    """The rules of one build(), digests memory-mapped from a file that is unlinked at once."""

    def __init__(self, built: dict):
        self.strings, self.verdicts = np.array(built["strings"], dtype=object), built["verdicts"]
        self.depths, self.labels = built["depths"], built["labels"]
        if built["strings"]:
            fd, name = tempfile.mkstemp(suffix=".u64")
            with os.fdopen(fd, "wb") as f:
                f.write(built["digests"])
            self.digests = np.memmap(name, dtype=np.uint64, mode="r")
            os.unlink(name)
        else:
            self.digests = np.empty(0, np.uint64)

    def find(self, keys: list[str]) -> np.ndarray:
        """Index of each key's rule, -1 for none. Equal digests stand together: each is compared."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests) or not keys:
            return out
        probe = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, probe)
        live = np.flatnonzero(at < len(self.digests))
        while len(live):
            live = live[self.digests[at[live]] == probe[live]]
            same = np.array([self.strings[at[i]] == keys[i] for i in live], dtype=bool)
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < len(self.digests)]
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule string wins, of equally long ones that of the longer host. Without a rule: null and `default`. Null, empty or relative URLs have an empty
    host and path and no rule; repeated rows are each judged; other columns are ignored.
    """
    spark = pages.sparkSession
    built = build(rules)
    if len(built["digests"]) + sum(map(len, built["strings"])) > MAX_BROADCAST:
        return judge_by_join(pages, rules, default)
    sent = spark.sparkContext.broadcast(built)

    def run(batches):
        key = str(hash((built_key, os.getpid())))
        if key not in _mapped:
            _mapped[key] = DigestArray(sent.value)
        index = _mapped[key]
        for batch in batches:
            ids, urls = batch.column(0), batch.column(1).to_pylist()
            split = [split_url(u) for u in urls]
            keys, owner = [], []
            for i, (h, p) in enumerate(split):
                own = candidates(h, p, index.depths, index.labels)
                keys += own
                owner += [i] * len(own)
            hit = index.find(keys)
            best: list[int | None] = [None] * len(urls)
            for i, at in zip(owner, hit.tolist()):
                if at >= 0 and (best[i] is None or len(index.strings[at]) > len(index.strings[best[i]])):
                    best[i] = at
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([None if b is None else index.strings[b] for b in best], pa.string()), pa.array([default if b is None else index.verdicts[b] for b in best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    built_key = xxhash.xxh64_hexdigest(built["digests"] + "\n".join(built["strings"] + built["verdicts"]).encode())
    return bounded(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, SCHEMA)


def judge_by_join(pages: DataFrame, rules, default: str = ALLOW) -> DataFrame:
    """The same verdicts with the rules as a table: for lists too large to broadcast."""
    spark = pages.sparkSession
    built = build(rules)
    depths, labels = built["depths"], built["labels"]
    listed = spark.createDataFrame(pd.DataFrame({"key": built["strings"], "found": built["verdicts"]}), "key string, found string")

    @F.pandas_udf("struct<host:string,path:string,keys:array<string>>")
    def cut(urls: pd.Series) -> pd.DataFrame:
        split = [split_url(u) for u in urls]
        return pd.DataFrame({"host": [h for h, _ in split], "path": [p for _, p in split], "keys": [candidates(h, p, depths, labels) for h, p in split]})

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), cut(F.col("url").cast("string")).alias("u")).select("row", "page_id", "u.*")
    hits = rows.select("row", "page_id", "host", "path", F.explode_outer("keys").alias("key")).join(listed, "key", "left")
    rule = F.max(F.when(F.col("found").isNotNull(), F.struct(F.length("key").alias("n"), F.length(F.substring_index("key", "/", 1)).alias("host"), "key", "found"))).alias("r")
    return hits.groupBy("row", "page_id", "host", "path").agg(rule).select("page_id", "host", "path", F.col("r.key").alias("rule"), F.coalesce("r.found", F.lit(default)).alias("verdict"))
