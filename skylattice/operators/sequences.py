"""Operators on ordered rows of a key, all by window functions: one shuffle on the key, sorted, spillable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def segments(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "segment") -> DataFrame:
    """Adds a running segment number (from 0); a new one begins where `breaks` holds. breaks may use lag()."""
    w = _over(keys, order)
    flagged = df.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(0)))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_segments(df: DataFrame, keys: list[str], at: str, gap, ties: list[str] = ()) -> DataFrame:
    """Segments split where the step to the row before is more than `gap`, strictly."""
    order = [at, *ties]
    return segments(df, keys, order, F.col(at) - F.lag(at).over(_over(keys, order)) > gap)


def value_or_gap_segments(df: DataFrame, keys: list[str], at: str, value: str, gap, pad=0, least: int = 2, ties: list[str] = ()) -> DataFrame:
    """keys, value, start, end, n: runs of one value without a gap over `gap`, of `least` rows or more, padded."""
    order = [at, *ties]
    w = _over(keys, order)
    change = (F.col(value) != F.lag(value).over(w)) | (F.col(at) - F.lag(at).over(w) > gap)
    runs = segments(df, keys, order, change).groupBy(*keys, "segment", value).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(*keys, value, (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"), "n")


def dedup_by_gap(df: DataFrame, keys: list[str], at: str, gap, prefer: Column | None = None, ties: list[str] = ()) -> DataFrame:
    """One row of each chain of rows at most `gap` apart: of the preferred ones if any, the one nearest to the
    chain's median, then the earliest."""
    seg = gap_segments(df, keys, at, gap, ties)
    mid = seg.groupBy(*keys, "segment").agg(F.percentile(at, 0.5).alias("_mid"), F.count("*").alias("copies"))
    ranked = seg.join(mid, [*keys, "segment"]).withColumn("_far", F.abs(F.col(at) - F.col("_mid")))
    first = [] if prefer is None else [F.when(prefer, 0).otherwise(1)]
    w = Window.partitionBy(*keys, "segment").orderBy(*first, "_far", at, *ties)
    return ranked.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_far", "_mid")


def coverage(df: DataFrame, keys: list[str], at: str, reach, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """keys, islands, covered: the union of [at - reach, at + reach], clipped to [lo, hi] where given."""
    a, z = F.col(at) - reach, F.col(at) + reach
    a, z = (F.greatest(a, lo), F.least(z, hi)) if lo is not None else (a, z)
    spans = df.select(*keys, a.alias("_a"), z.alias("_z")).where("_z >= _a")
    w = _over(keys, ["_a", "_z"])
    before = F.max("_z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isl = segments(spans.withColumn("_before", before), keys, ["_a", "_z"], F.col("_before").isNull() | (F.col("_a") > F.col("_before")), "_i")
    return isl.groupBy(*keys, "_i").agg((F.max("_z") - F.min("_a")).alias("_len")).groupBy(*keys).agg(F.count("*").alias("islands"), F.sum("_len").alias("covered"))


def latest_pair(df: DataFrame, keys: list[str], order: list[str], is_odd: Column, value: str) -> DataFrame:
    """Adds last_even and last_odd: the latest value of either kind up to each row."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"last_even": F.last(F.when(~is_odd, F.col(value)), ignorenulls=True).over(w), "last_odd": F.last(F.when(is_odd, F.col(value)), ignorenulls=True).over(w)})


def best_per_bucket(df: DataFrame, keys: list[str], bucket: Column, rank: list[Column | str], name: str = "bucket") -> DataFrame:
    """The best row of each key and bucket."""
    w = Window.partitionBy(*keys, name).orderBy(*rank)
    return df.withColumn(name, bucket).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def min_gap_keep_first(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Rows kept greedily: the first, then each at least `gap` after the last kept one. Sequential by nature:
    one ordered fold for each key."""
    folded = df.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("_at"))
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc)
    kind = df.schema[at].dataType.simpleString()
    kept = folded.select(*keys, F.explode(F.aggregate("_at", F.array().cast(f"array<{kind}>"), step)).alias(at))
    return df.join(kept, [*keys, at], "left_semi")


def adjacent(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds prev_<v> and d_<v> for each value."""
    w = _over(keys, order)
    cols = {f"prev_{v}": F.lag(v).over(w) for v in values} | {f"d_{v}": F.col(v) - F.lag(v).over(w) for v in values}
    return df.withColumns(cols)


def density(df: DataFrame, keys: list[str], at: str, reach: int, name: str = "density") -> DataFrame:
    """Adds the number of rows of the key within +- reach, itself included."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, reach)))


def rate(df: DataFrame, keys: list[str], at: str, span: int, name: str = "rate") -> DataFrame:
    """Adds the number of rows in the last `span` units."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-span, 0)))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows at ranks round(i (N - 1) / (n - 1)), halves to even; all rows where there are no more."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = r.select(*keys, "_n").distinct().select(*keys, "_n", i.alias("_i")).select(*keys, F.bround(F.col("_i") * (F.col("_n") - 1) / (n - 1)).cast("int").alias("_k")).distinct()
    return r.join(wanted, [*keys, "_k"], "left_semi").drop("_k", "_n")


def lifecycle(df: DataFrame, keys: list[str], at: str, now: Column, confirm: int, stale, expire) -> DataFrame:
    """keys, fixes, last_at, state as of `now`: EXPIRED, STALE, CONFIRMED or TENTATIVE."""
    t = df.groupBy(*keys).agg(F.count("*").alias("fixes"), F.max(at).alias("last_at"))
    age = now - F.col("last_at")
    return t.withColumn("state", F.when(age >= expire, "EXPIRED").when(age >= stale, "STALE").when(F.col("fixes") >= confirm, "CONFIRMED").otherwise("TENTATIVE"))


def latest(df: DataFrame, keys: list[str], at: str, ties: list[str] = ()) -> DataFrame:
    """The last row of each key: out-of-order updates lose."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in ties])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reconcile(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """What a full snapshot changes: its rows as 'upsert', keys that it lacks as 'delete'."""
    gone = current.join(snapshot, keys, "left_anti").select(*keys).distinct().withColumn("change", F.lit("delete"))
    return snapshot.withColumn("change", F.lit("upsert")).unionByName(gone, allowMissingColumns=True)
