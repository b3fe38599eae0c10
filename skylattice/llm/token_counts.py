"""Token counts: each distinct pre-token is counted once, documents carry frequencies only.

A pre-token is a run of blanks with the run of other characters after it. Byte-level BPE never
merges across its left edge, so a text's count is the sum over its pre-tokens. The distinct
pre-tokens of the corpus are counted once each by the library; documents are joined to them by
their pre-token frequencies. The most frequent pre-tokens, HEAD of them at most, are summed where
the document is read; the others are joined by shuffle, so no key of that join can be hot.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer as tk
from .common import bounded, written

#: At most so many pre-tokens are broadcast.
HEAD = 1 << 18
#: A pre-token of more characters is broadcast as its MD5: HEAD bounds the bytes as well as the rows.
LONG = 48
#: A task hands on its counts when it holds so many distinct pre-tokens, or has read so many characters.
HELD, HELD_CHARS = 400_000, 1 << 28
_CUT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space for one of Python and the library's pattern, but not for both, or before blanks: such texts are one pre-token.
_ODD = re.compile("[\x1c-\x1f]|[\x0b\x0c\x85\xa0  -     　][ \n\t\r]")


def pre_tokens(text: str, splits: bool = True) -> list[str]:
    """The text in parts that the vocabulary encodes independently."""
    if not text:
        return []
    return _CUT.findall(text) if splits and not _ODD.search(text) else [text]


def key(token: str) -> str:
    """What a pre-token is looked up by in the broadcast: itself, or its digest if it is long."""
    return token if len(token) <= LONG else "\0" + hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()


def vocabulary(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """token, pairs (documents that have it, rows counted singly), pieces; written."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast((tokenizer_path, tk.file_bytes(tokenizer_path)))

    def distinct(batches):
        splits, seen, chars = tk.load(*data.value).splits_at_space, Counter(), 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "pairs"])

        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                seen.update(set(pre_tokens(t, splits)))
                chars += len(t or "")
                if len(seen) > HELD or chars > HELD_CHARS:
                    yield rows()
                    seen, chars = Counter(), 0
        yield rows()

    def count(batches):
        enc = tk.load(*data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([enc.pieces(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["token", "pairs", "pieces"])

    found = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(distinct, "token string, pairs long").groupBy("token").agg(F.sum("pairs").alias("pairs"))
    return written(found.mapInArrow(count, "token string, pairs long, pieces long"))


def least_pairs(known: DataFrame, head: int) -> int:
    """The lowest of some thresholds, in steps of a fifth, that `head` pre-tokens at most reach."""
    steps = sorted({int(1.2**k) for k in range(1, 220)})
    counts = known.agg(*[F.count_if(F.col("pairs") >= t) for t in steps]).first()
    return next((t for t, n in zip(steps, counts) if n <= head), steps[-1] + 1)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs(doc_id, text).

    Null and empty texts have no bytes and no tokens. A row that repeats, with its doc_id or without
    one, is counted for itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = vocabulary(docs, tokenizer_path)
    often = F.col("pairs") >= least_pairs(known, head)
    short = F.when(F.length("token") <= LONG, F.col("token")).otherwise(F.concat(F.lit("\0"), F.md5("token")))
    top = dict(known.where(often).select(short, "pieces").collect())  # `head` rows of LONG characters at most
    data = spark.sparkContext.broadcast((tokenizer_path, tk.file_bytes(tokenizer_path)))
    shared = spark.sparkContext.broadcast(top)

    def part(batches):
        splits, known_here = tk.load(*data.value).splits_at_space, shared.value
        for batch in batches:
            size, done, rest, times = [], [], [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                size.append(len(t.encode("utf-8", "surrogatepass")))
                n, tokens, counts = 0, [], []
                for token, c in Counter(pre_tokens(t, splits)).items():
                    pieces = known_here.get(key(token))
                    if pieces is not None:
                        n += c * pieces
                    else:
                        tokens.append(token)
                        counts.append(c)
                done.append(n)
                rest.append(tokens)
                times.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(done, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "done", "rest", "times"]
            )

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(part, "doc_id long, n_bytes long, done long, rest array<string>, times array<int>")
    numbered = written(parts.withColumn("row", F.monotonically_increasing_id()))
    tail = numbered.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("token"), F.col("t.times").alias("times"))
    counted = tail.join(known.where(~often).select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = F.col("done") + F.coalesce("more", F.lit(0))
    return numbered.select("row", "doc_id", "n_bytes", "done").join(counted, "row", "left").select("doc_id", "n_bytes", n.cast("long").alias("n_tokens"), (n > limit).alias("over_limit"))
