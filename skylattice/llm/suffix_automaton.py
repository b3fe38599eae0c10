"""Spans that documents share with a reference, by broadcast suffix automata.

The reference is cut into shards; an executor builds the automaton of each, and the automata are
broadcast. Documents stream through them: the matching statistic of a word is the length of the
longest run ending there that the shard contains, and maximal runs at or above the threshold go.
For references of bounded size (test sets, licences, known boilerplate); the whole corpus against
itself is substring_dedup.py.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

from .substring_dedup import words

#: Words of a shard, and the most that a reference may have in all (about 250 bytes a word in an automaton).
SHARD_WORDS, MAX_WORDS = 100_000, 1_000_000


class Automaton:
    """Suffix automaton over words. Texts of one shard are kept apart by a word that none has."""

    def __init__(self, texts: list[list[bytes]]):
        self.names: dict[bytes, int] = {}
        self.edges: dict[int, int] = {}  # state << 32 | word -> state
        self.length, self.parent, self.out = [0], [-1], [[]]
        last = 0
        for k, text in enumerate(texts):
            if k:
                last = self._add(last, 1 + len(self.names) + (1 << 31))
            for w in text:
                last = self._add(last, self.names.setdefault(w, len(self.names)))
            if k < len(texts) - 1:
                self.names.setdefault(b" %d" % k, len(self.names))  # the separators stay distinct
        self.out = None

    def _state(self, length: int, parent: int, out: list[int]) -> int:
        self.length.append(length)
        self.parent.append(parent)
        self.out.append(out)
        return len(self.length) - 1

    def _edge(self, state: int, word: int, to: int) -> None:
        if (state << 32 | word) not in self.edges:
            self.out[state].append(word)
        self.edges[state << 32 | word] = to

    def _add(self, last: int, word: int) -> int:
        cur = self._state(self.length[last] + 1, 0, [])
        p = last
        while p >= 0 and (p << 32 | word) not in self.edges:
            self._edge(p, word, cur)
            p = self.parent[p]
        if p >= 0:
            q = self.edges[p << 32 | word]
            if self.length[q] == self.length[p] + 1:
                self.parent[cur] = q
            else:
                twin = self._state(self.length[p] + 1, self.parent[q], [])
                for w in self.out[q]:
                    self._edge(twin, w, self.edges[q << 32 | w])
                while p >= 0 and self.edges.get(p << 32 | word) == q:
                    self.edges[p << 32 | word] = twin
                    p = self.parent[p]
                self.parent[q] = self.parent[cur] = twin
        return cur

    def statistics(self, text: list[bytes]) -> np.ndarray:
        """For each word the length of the longest run ending there that the shard contains."""
        edges, parent, length, names = self.edges, self.parent, self.length, self.names
        out, state, n = np.zeros(len(text), np.int64), 0, 0
        for i, w in enumerate(text):
            word = names.get(w, -1)
            if word < 0:
                state = n = 0
                continue
            while state and (state << 32 | word) not in edges:
                state = parent[state]
                n = length[state]
            to = edges.get(state << 32 | word)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out[i] = n
        return out


def covered(stats: np.ndarray, least: int) -> np.ndarray:
    """Words that lie in a run of at least `least` words."""
    edge = np.zeros(len(stats) + 1, np.int64)
    ends = np.flatnonzero(stats >= least)
    np.add.at(edge, ends - stats[ends] + 1, 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_reference(docs: DataFrame, reference: DataFrame, least: int = 35, shard_words: int = SHARD_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, text for each row of docs(doc_id, text), without the maximal runs of `least` words or
    more that a text of reference(text) contains. Null and wordless texts have no words; references beyond
    max_words are refused."""
    spark = docs.sparkSession
    sized = reference.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct().withColumn("n", F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if total > max_words:
        raise ValueError(f"a reference of {total} words exceeds {max_words}: use substring_dedup")
    shards = max(1, -(-total // shard_words))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = Automaton([w for w in map(words, pdf["text"]) if len(w) >= least])
        return pd.DataFrame({"data": [zlib.compress(pickle.dumps(a, protocol=5), 1)]})

    made = sized.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards))).groupBy("shard").applyInPandas(build, "data binary")
    sent = [spark.sparkContext.broadcast(bytes(r.data)) for r in made.toLocalIterator()]

    def stream(batches):
        automata = [pickle.loads(zlib.decompress(b.value)) for b in sent]
        for batch in batches:
            n, gone, texts = [], [], []
            for text in batch.column(1):
                w = words(text.as_py())
                out = np.zeros(len(w), bool)
                for a in automata:
                    out |= covered(a.statistics(w), least)
                n.append(len(w))
                gone.append(int(out.sum()))
                texts.append(b" ".join(x for x, g in zip(w, out.tolist()) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(stream, "doc_id long, n_words long, n_removed long, text string")
