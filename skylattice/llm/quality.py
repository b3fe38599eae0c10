"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's counts are taken once. Four ratios, as integers, go into a mergeable quantile
sketch per language and source: a histogram with buckets exact below 2048 and of relative width
1/1024 above, so that partial counts add up in any order to the same sketch. Sketches of small
groups give way to the merged sketch of the language, and that to the merged sketch of all.
Thresholds come from the sketch's outer quantiles and their distance from the median; documents are
joined to them and judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, written

#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: A group of fewer documents takes the thresholds of the next larger one: its outer quantiles would rest on a few dozen.
LEAST_GROUP = 2000
#: Percents of the outer quantiles: a share of bad documents below 6 % does not move the upper one among them.
LOW, HIGH = 5, 94
#: Ratios (name, numerator, denominator, scale, slack): a document is out of line above the group's upper quantile
#: by more than SPREAD times its distance from the median plus slack (mean_word_length: also below the lower one).
#: The slack is what groups that know no such thing at all allow: a tenth of a symbol a word and so on.
SPREAD = 2
RATIOS = [
    ("mean_word_length", "word_chars", "n_words", 100, 100),
    ("symbols_per_word", "n_symbols", "n_words", 1000, 100),
    ("dup_line_share", "n_dup_lines", "n_lines", 1000, 300),
    ("repeat_word_share", "n_repeat_words", "n_words", 1000, 150),
]
#: Threshold tables up to so many groups are broadcast (under 100 bytes each).
BROADCAST_GROUPS = 200_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _covered(at: Column) -> Column:
    """Positions covered by windows of three from the sorted starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(at, zero, lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")))["n"]


def with_counts(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as they are), lang, source, COUNTS for each row. A null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select(F.struct("*").alias("row"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]).withColumns({"_words": F.array_remove(F.split(text, WORD_GAP), ""), "_lines": lines})
    n = F.size("_words")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_hashes", hashes)
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(_covered(F.col("_at")), F.lit(0)),
        "n_lines": F.size("_lines"),
    }
    return df.select("row", "lang", "source", *[v.cast("long").alias(k) for k, v in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(num: str, den: str, scale: int) -> Column:
    return F.when(F.col(den) > 0, F.floor(F.col(num) * scale / F.col(den))).otherwise(F.lit(0)).cast("long")


def bucket(v: Column) -> Column:
    """The sketch's bucket: v itself below 2048, then v with all but its 11 leading bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - 11, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n over the documents that pass the base rule. Sketches of the same
    group merge by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("ratio"), bucket(ratio(num, den, scale)).alias("bucket")) for name, num, den, scale, _ in RATIOS])).alias("r")
    return counted.where(~base_failed()).select("lang", "source", each).groupBy("lang", "source", "r.ratio", "r.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, total, low, mid (median), high of merged sketches."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket")))
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), at(LOW).alias("low"), at(50).alias("mid"), at(HIGH).alias("high"))


def thresholds(counted: DataFrame) -> DataFrame:
    """lang, source, floor_<ratio>, ceil_<ratio> for every group that counted has."""
    sketch = written(sketches(counted))
    groups = counted.select("lang", "source").distinct()
    own = {k: _wide(quantiles(sketch, keys), keys, k) for k, keys in (("s", ["lang", "source"]), ("l", ["lang"]), ("a", []))}
    same = lambda d, keys, k: [groups[c].eqNullSafe(d[f"{k}_{c}"]) for c in keys]
    df = groups.join(own["s"], same(own["s"], ["lang", "source"], "s"), "left").join(own["l"], same(own["l"], ["lang"], "l"), "left").crossJoin(F.broadcast(own["a"]))  # own["a"] is one row
    out = ["lang", "source"]
    for name, _, _, _, slack in RATIOS:
        pick = lambda what: F.when(F.col("s_total") >= LEAST_GROUP, F.col(f"s_{name}_{what}")).when(F.col("l_total") >= LEAST_GROUP, F.col(f"l_{name}_{what}")).otherwise(F.col(f"a_{name}_{what}"))
        above, below = SPREAD * (pick("high") - pick("mid")) + slack, SPREAD * (pick("mid") - pick("low")) + slack
        out += [(pick("high") + above).alias(f"ceil_{name}"), (pick("low") - below).alias(f"floor_{name}")]
    return df.select(*out)


def _wide(q: DataFrame, keys: list[str], k: str) -> DataFrame:
    cells = [F.max("total").alias(f"{k}_total")] + [F.max(F.when(F.col("ratio") == name, F.col(c))).alias(f"{k}_{name}_{c}") for name, *_ in RATIOS for c in ("low", "mid", "high")]
    return q.groupBy(*[F.col(c).alias(f"{k}_{c}") for c in keys]).agg(*cells)


def judge(counted: DataFrame, base: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows of with_counts(); thresholds come from base, a written table of such
    rows. A document without language or source is in the group of such documents. Where no document
    passes the base rule there are no thresholds, and none is kept."""
    limits = thresholds(base)
    n = limits.count()
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    limits = F.broadcast(limits) if n <= BROADCAST_GROUPS else limits
    df = counted.withColumn("base_failed", base_failed())
    df = df.join(limits, df["lang"].eqNullSafe(limits["_lang"]) & df["source"].eqNullSafe(limits["_source"]), "left")
    fine = ~F.col("base_failed")
    for name, num, den, scale, _ in RATIOS:
        v = ratio(num, den, scale)
        fine = fine & (v <= F.col(f"ceil_{name}")) & ((v >= F.col(f"floor_{name}")) if name == "mean_word_length" else F.lit(True))
    return df.withColumn("kept", F.coalesce(fine, F.lit(False))).select(*counted.columns, "base_failed", "kept")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines for
    each row of docs(doc_id, text, lang, source); repeated rows each have one, other columns are ignored.
    A null or empty text fails the base rule; in an empty table there is nothing to judge."""
    counted = with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"))
    counted = written(counted.select(F.col("row.doc_id").alias("doc_id"), "lang", "source", *COUNTS))
    return judge(counted, counted).select("doc_id", *COUNTS[:-1], "base_failed", "kept", "n_lines")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns they came with, whatever their names. Texts are counted twice,
    for the thresholds and for the verdicts: a written copy of them would cost more than that."""
    counted = with_counts(docs)
    return judge(counted, written(counted.select("lang", "source", *COUNTS))).where("kept").select("row.*")
