"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words under a fixed mask laid on consecutive words; the positions that
the mask leaves out may differ. Test items are hashed at every position, and so are documents;
equal hashes join. A hit names a diagonal (document position minus item position); on it, the
words around the hits are compared one by one, and a span counts as an overlap if a window of
WINDOW words (the whole item, if shorter) agrees in at least AGREE percent.

The masks miss some windows that agree so. What no window can do without is a run: with at most e
words that differ, `size div (e + 1)` words in a row are equal. Runs of that length are seeds too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Fixed masks: 1 is compared, 0 ignored. Of one span, so that a position has all its words at hand.
MASKS = ("110100110011", "111001010110")
SPAN = len(MASKS[0])
WINDOW, AGREE = 20, 80
#: Words kept on either side of the hits for the comparison.
AROUND = 40
#: Seed tables up to so many rows are broadcast (32 bytes a row); larger ones join by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Hits (40 bytes each) up to so many are taken to the documents; beyond, documents are shuffled to them.
BROADCAST_HITS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def seeds(rows: DataFrame, key: str, masks: dict[int, str]) -> DataFrame:
    """key, pos, seed of rows(key, words): one row for each position and mask (by its number, which is part of
    the hash) that the words from there on fill. Words are hashed and laid side by side once for all masks."""
    width = max(map(len, masks.values()))
    hashed = rows.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").alias("n"))
    side = F.arrays_zip(*[F.slice("h", j + 1, F.col("n")).alias(f"w{j}") for j in range(width)])  # null beyond the end
    at = hashed.where(F.col("n") >= min(map(len, masks.values()))).select(key, F.posexplode(side).alias("pos", "w"))
    each = [F.when(F.col(f"w.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"w.w{j}") for j, bit in enumerate(mask) if bit == "1"])) for k, mask in masks.items()]
    return at.select(key, "pos", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: int = AGREE) -> DataFrame:
    """doc_id, item_id, matches, compared, doc_start, item_start: one row for each document and item
    that overlap, at their best diagonal (most matching words, then the first).

    Where hits of the masks alone show the overlap, they say what is compared; else those of the runs
    do. Items and documents without words match nothing. Rows that repeat count once; rows without an id are compared as one document or item of that id.
    Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    b = b.withColumn("size", F.least(F.size("words"), F.lit(window))).withColumn("run", F.expr(f"int(size div (size * {100 - agree} div 100 + 1))"))
    spaced = dict(enumerate(MASKS))
    runs = {len(MASKS) + r.run: "1" * r.run for r in b.select("run").distinct().orderBy("run").collect()}  # window lengths at most
    test = seeds(b, "item_id", spaced).withColumn("masked", F.lit(True))
    for k, mask in runs.items():
        test = test.union(seeds(b.where(F.col("run") == len(mask)), "item_id", {k: mask}).withColumn("masked", F.lit(False)))
    test = test.select("item_id", F.col("pos").alias("item_pos"), "seed", "masked").distinct()
    test = F.broadcast(test) if test.count() <= BROADCAST_SEEDS else test
    hits = seeds(d, "doc_id", spaced | runs).join(test, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "masked")
    # the region of the masks' hits alone, and that of all
    region = lambda p: F.struct(p.alias("masked"), F.min(F.when(F.col("masked") | ~p, F.col("item_pos"))).alias("first"), F.max(F.when(F.col("masked") | ~p, F.col("item_pos"))).alias("last"))
    hits = hits.groupBy("doc_id", "item_id", "diagonal").agg(F.array_distinct(F.array(region(F.lit(True)), region(F.lit(False)))).alias("r")).select("doc_id", "item_id", "diagonal", F.inline("r")).where("first is not null")
    hits = written(hits.select(F.col("doc_id").alias("h_doc"), F.col("item_id").alias("h_item"), "diagonal", "masked", "first", "last"))
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    items = b.select(F.col("item_id").alias("b_item"), F.col("words").alias("item_words"))
    both = d.join(hits, F.col("h_doc").eqNullSafe(F.col("doc_id"))).join(items, F.col("h_item").eqNullSafe(F.col("b_item")))
    lo = F.greatest(F.col("first") - AROUND, -F.col("diagonal"), F.lit(0))
    hi = F.least(F.col("last") + SPAN + AROUND, F.size("item_words"), F.size("words") - F.col("diagonal"))
    near = both.withColumns({"lo": lo, "n": hi - lo, "size": F.least(F.size("item_words"), F.lit(window))}).where("n >= size")
    same = F.zip_with(F.slice("words", F.col("lo") + F.col("diagonal") + 1, F.col("n")), F.slice("item_words", F.col("lo") + 1, F.col("n")), lambda x, y: (x == y).cast("int"))
    near = near.select("doc_id", F.col("h_item").alias("item_id"), "masked", "diagonal", "lo", "n", "size", same.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.sequence(F.lit(0), F.col("n") - F.col("size"))
    good = F.exists(starts, lambda i: total(F.slice("same", i + 1, F.col("size"))) * 100 >= F.col("size") * agree)
    found = near.where(good).select("doc_id", "item_id", "masked", total(F.col("same")).cast("long").alias("matches"), F.col("n").cast("long").alias("compared"), (F.col("lo") + F.col("diagonal")).cast("long").alias("doc_start"), F.col("lo").cast("long").alias("item_start"))
    best = F.max(F.struct("masked", "matches", -F.col("doc_start"), -F.col("item_start"), "compared")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.matches", "m.compared", (-F.col("m.col3")).alias("doc_start"), (-F.col("m.col4")).alias("item_start"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap, columns as they were. Rows without a doc_id share one verdict, as do those
    that repeat one; null and empty texts have no overlap and stay."""
    leak = free_name(docs, "leak")
    found = written(overlaps(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(leak)), "left_anti")
