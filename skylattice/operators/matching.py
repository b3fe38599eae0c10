"""Pair joins in time: equal key, then a band. Bands are bucketed so that the join stays an equi-join;
nothing compares all rows of a key with each other unless they share a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(a: DataFrame, b: DataFrame, on: list[str], ta: str, tb: str, reach, how: str = "inner") -> DataFrame:
    """Rows of a with rows of b of equal `on` and |tb - ta| <= reach. b's rows are dealt to their bucket and both
    neighbours, a's to their own. Columns besides `on` must differ."""
    bucket = lambda t: F.floor(F.col(t) / reach)
    left = a.withColumn("_bucket", bucket(ta))
    right = b.withColumn("_bucket", F.explode(F.array(*[bucket(tb) + k for k in (-1, 0, 1)])))
    near = F.abs(F.col(tb) - F.col(ta)) <= reach
    cond = [left[k] == right[k] for k in [*on, "_bucket"]] + [near]
    out = left.join(right, cond, how)
    return out.select(*[left[c] for c in a.columns], *[right[c] for c in b.columns if c not in on])


def nearest_gate(a: DataFrame, b: DataFrame, on: list[str], ta: str, tb: str, ida: str, idb: str, gate) -> DataFrame:
    """For each a the nearest b of its key within the gate (ties: the later b, then by id), whether or not it is
    taken; of several a that chose one b, the first keeps it and the others go unmatched."""
    near = band_join(a, b, on, ta, tb, gate)
    best = Window.partitionBy(ida).orderBy(F.abs(F.col(tb) - F.col(ta)), F.col(tb).desc(), idb)
    owner = Window.partitionBy(idb).orderBy(ta, ida)
    chosen = near.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return chosen.withColumn("_k", F.row_number().over(owner)).where("_k = 1").drop("_k")


def unique_candidate(a: DataFrame, b: DataFrame, on: list[str], ta: str, tb: str, ida: str, idb: str, gate) -> DataFrame:
    """Every a with `candidates` (b within the gate) and `outcome`: none, ambiguous, conflict (another a took its
    only candidate first) or accepted, with that b's id."""
    near = band_join(a, b, on, ta, tb, gate).select(ida, ta, idb)
    only = near.groupBy(ida, ta).agg(F.count("*").alias("candidates"), F.min(idb).alias(idb))
    first = Window.partitionBy(idb).orderBy(ta, ida)
    one = only.where("candidates = 1").withColumn("_k", F.row_number().over(first))
    judged = one.unionByName(only.where("candidates > 1"), allowMissingColumns=True).select(ida, "candidates", idb, "_k")
    out = a.join(judged, ida, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    outcome = F.when(F.col("candidates") == 0, "none").when(F.col("candidates") > 1, "ambiguous").when(F.col("_k") > 1, "conflict").otherwise("accepted")
    return out.withColumn("outcome", outcome).withColumn(idb, F.when(F.col("outcome") == "accepted", F.col(idb))).drop("_k")


def reciprocal_nearest(a: DataFrame, b: DataFrame, on: list[str], ta: str, tb: str, ida: str, idb: str, gate) -> DataFrame:
    """Pairs that are each other's nearest within the gate (ties by id)."""
    near = band_join(a, b, on, ta, tb, gate)
    far = F.abs(F.col(tb) - F.col(ta))
    fore = F.row_number().over(Window.partitionBy(ida).orderBy(far, idb))
    back = F.row_number().over(Window.partitionBy(idb).orderBy(far, ida))
    return near.withColumns({"_f": fore, "_b": back}).where("_f = 1 and _b = 1").drop("_f", "_b")


def interpolate(points: DataFrame, queries: DataFrame, on: list[str], tp: str, tq: str, idq: str, values: list[str], bracket, lone) -> DataFrame:
    """queries with `values` read off the points of the same key: linear between the neighbours if both are
    within `bracket`, else the nearest within `lone`, else null; `truth` says which. By one sort of the union."""
    keep = [c for c in queries.columns]
    q = queries.select(*on, F.col(tq).alias("_t"), F.lit(1).alias("_q"), F.struct(*keep).alias("_row"), *[F.lit(None).cast("double").alias(v) for v in values])
    p = points.select(*on, F.col(tp).alias("_t"), F.lit(0).alias("_q"), F.lit(None).alias("_row"), *[F.col(v).cast("double") for v in values])
    w = Window.partitionBy(*on).orderBy("_t", "_q")
    spot = F.when(F.col("_q") == 0, F.struct("_t", *values))
    back = Window.partitionBy(*on).orderBy("_t", F.col("_q").desc())
    both = q.unionByName(p.withColumn("_row", F.lit(None).cast(q.schema["_row"].dataType)))
    both = both.withColumn("_l", F.last(spot, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_r", F.first(spot, True).over(back.rowsBetween(0, Window.unboundedFollowing))).where("_q = 1")
    dl, dr = F.col("_t") - F.col("_l._t"), F.col("_r._t") - F.col("_t")
    inside = (dl <= bracket) & (dr <= bracket)
    share = F.when(dl + dr == 0, F.lit(0.0)).otherwise(dl / (dl + dr))
    left_is = dr.isNull() | (dl <= dr)
    lone_ok = F.coalesce(F.least(dl, dr) <= lone, F.lit(False))
    how = F.when(F.coalesce(inside, F.lit(False)), "interpolated").when(lone_ok, "nearest")
    out = {v: F.when(F.col("truth") == "interpolated", F.col(f"_l.{v}") + (F.col(f"_r.{v}") - F.col(f"_l.{v}")) * share).when(F.col("truth") == "nearest", F.when(left_is, F.col(f"_l.{v}")).otherwise(F.col(f"_r.{v}"))) for v in values}
    return both.withColumn("truth", how).select(*[F.col(f"_row.{c}").alias(c) for c in keep], "truth", *[c.alias(v) for v, c in out.items()])


def nearest_in_time(a: DataFrame, b: DataFrame, on: list[str], ta: str, tb: str, ida: str, idb: str, gate) -> DataFrame:
    """For each a the nearest b of its key within the gate (ties by id); a b can serve many."""
    near = band_join(a, b, on, ta, tb, gate)
    w = Window.partitionBy(ida).orderBy(F.abs(F.col(tb) - F.col(ta)), idb)
    return near.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def active_intervals(events: DataFrame, intervals: DataFrame, on: list[str], at: str, ide: str, start: str, end: str, width) -> DataFrame:
    """events with the interval of the same key that holds them, of several the one whose nearer bound is nearest,
    then the earlier. Intervals are dealt to the buckets of `width` that they touch."""
    e = events.withColumn("_bucket", F.floor(F.col(at) / width))
    i = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    held = e.join(i, [*on, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")
    near = F.least(F.abs(F.col(at) - F.col(start)), F.abs(F.col(end) - F.col(at)))
    w = Window.partitionBy(ide).orderBy(near, start, end)
    return held.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: Fixed values: (class, largest rms, largest residual, least gap, least ratio to the runner-up).
TRUTH_CLASSES = (("STRONG_TRUTH_MATCH", 1.0, 2.0, 1.0, 2.0), ("PLAUSIBLE_TRUTH_MATCH", 3.0, 5.0, 0.5, 1.5))


def truth_match(scores: DataFrame, event: str, candidate: str, rms: str, largest: str) -> DataFrame:
    """The best-scored candidate of each event, classified by its score and its lead over the second."""
    w = Window.partitionBy(event).orderBy(rms, candidate)
    best = scores.withColumn("_second", F.lead(rms).over(w)).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    gap, ratio = F.col("_second") - F.col(rms), F.col("_second") / F.greatest(F.col(rms), F.lit(1e-12))
    out = F.lit(None).cast("string")
    case = None
    for name, r, m, g, q in TRUTH_CLASSES:
        ok = (F.col(rms) <= r) & (F.col(largest) <= m) & (F.col("_second").isNull() | ((gap >= g) & (ratio >= q)))
        case = F.when(ok, name) if case is None else case.when(ok, name)
    out = case.when((F.col(rms) <= 3.0) & (F.col(largest) <= 5.0), "AMBIGUOUS_TRUTH_MATCH").otherwise("NO_TRUTH_MATCH")
    return best.withColumn("truth_class", out).drop("_second", "_k")


def code_transitions(tracks: DataFrame, gap: float = 120.0, speed: float = 450.0, allowance: float = 2000.0) -> DataFrame:
    """Pairs of tracks(track_id, code, first_t, last_t, first_lat, first_lon, last_lat, last_lon): one ends, another
    of a different code begins within `gap` seconds and reach. Joined on time buckets."""
    from ..functions.geo import haversine

    cols = {c: f"{c}_2" for c in tracks.columns}
    a = tracks.withColumn("_b", F.explode(F.array(F.floor(F.col("last_t") / gap), F.floor(F.col("last_t") / gap) + 1)))
    b = tracks.select(*[F.col(c).alias(n) for c, n in cols.items()]).withColumn("_b", F.floor(F.col("first_t_2") / gap))
    dt = F.col("first_t_2") - F.col("last_t")
    dist = haversine("last_lat", "last_lon", "first_lat_2", "first_lon_2", 6_371_000.0)
    return a.join(b, "_b").where((F.col("code") != F.col("code_2")) & (dt > 0) & (dt <= gap) & (dist <= speed * dt + allowance)).select("track_id", "code", "track_id_2", "code_2", dt.alias("gap_s"), dist.alias("distance_m"))


def mutual_edges(df: DataFrame, on: list[str], station: str, at: str, ident: str, limit: Column | float) -> DataFrame:
    """Edges (on, station_a, id_a, station_b, id_b) between rows of different stations that are each other's
    nearest within the limit, for every pair of stations."""
    a = df.select(*on, F.col(station).alias("station_a"), F.col(at).alias("t_a"), F.col(ident).alias("id_a"))
    b = df.select(*on, F.col(station).alias("station_b"), F.col(at).alias("t_b"), F.col(ident).alias("id_b"))
    near = band_join(a, b, on, "t_a", "t_b", limit).where("station_a < station_b")
    far = F.abs(F.col("t_b") - F.col("t_a"))
    fore = F.row_number().over(Window.partitionBy("id_a", "station_b").orderBy(far, "id_b"))
    back = F.row_number().over(Window.partitionBy("id_b", "station_a").orderBy(far, "id_a"))
    return near.withColumns({"_f": fore, "_b": back}).where("_f = 1 and _b = 1").drop("_f", "_b")


def triangles(edges: DataFrame) -> DataFrame:
    """3-cliques (id_1, id_2, id_3) of mutual edges, stations ascending."""
    e = lambda a, b: edges.select(F.col("id_a").alias(a), F.col("id_b").alias(b))
    return e("id_1", "id_2").join(e("id_2", "id_3"), "id_2").join(e("id_1", "id_3"), ["id_1", "id_3"]).select("id_1", "id_2", "id_3")


def cliques(edges: DataFrame) -> DataFrame:
    """Maximal cliques of 4 or 3 nodes that share no node with another: members array, sorted."""
    t = triangles(edges)
    e = lambda a, b: edges.select(F.col("id_a").alias(a), F.col("id_b").alias(b))
    four = t.join(e("id_3", "id_4"), "id_3").join(e("id_1", "id_4"), ["id_1", "id_4"]).join(e("id_2", "id_4"), ["id_2", "id_4"]).select(F.array("id_1", "id_2", "id_3", "id_4").alias("members"))
    parts = four.select(F.explode(F.array(*[F.array(*[F.col("members")[i] for i in range(4) if i != j]) for j in range(4)])).alias("members"))
    three = t.select(F.array("id_1", "id_2", "id_3").alias("members")).join(parts, "members", "left_anti")
    every = four.union(three)
    shared = every.select("members", F.explode("members").alias("_id")).withColumn("_n", F.count("*").over(Window.partitionBy("_id"))).where("_n > 1").select("members").distinct()
    return every.join(shared, "members", "left_anti").withColumn("size", F.size("members"))
