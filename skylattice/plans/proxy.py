"""Each operator as a query over the test tables.

The tables hold no radio frames, so `events` stands in: user_id for the transmitted payload,
event_type for the receiver, the time stamp in microseconds for the tick. Every query has SQL for
DuckDB that gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import EARTH_KM, LAT_M, LON_M, WGS84_A, WGS84_F
from ..functions import geo, ids, modes, stats
from ..operators import graph, matching, sequences

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOUR = 3_600_000_000
#: Distances that the gates of the queries use, in microseconds.
SIX_HOURS, TWO_HOURS, DAY = 6 * HOUR, 2 * HOUR, 24 * HOUR


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    """events with t, microseconds since 1970 of the wall-clock time."""
    e = table(spark, sf_dir, "events")
    origin = "timestamp_ntz'1970-01-01 00:00:00'" if e.schema["ts"].dataType.typeName() == "timestamp_ntz" else "timestamp'1970-01-01 00:00:00'"
    return e.withColumn("t", F.expr(f"timestampdiff(MICROSECOND, {origin}, ts)"))


EV = "ev AS (SELECT *, epoch_us(ts) AS t FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _two(e, a, b):
    side = lambda kind, k: e.where(F.col("event_type") == kind).select("user_id", F.col("t").alias(f"t{k}"), F.col("event_id").alias(f"id{k}"))
    return side(a, "a"), side(b, "b")


A_KIND, B_KIND = "click", "view"
TWO = f"""a AS (SELECT user_id, t AS ta, event_id AS ida FROM ev WHERE event_type = '{A_KIND}'),
b AS (SELECT user_id, t AS tb, event_id AS idb FROM ev WHERE event_type = '{B_KIND}')"""

# --- statistics -----------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT l_returnflag, min(l_quantity) ox, min(l_extendedprice) oy FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS samples, round(regr_slope(l_extendedprice - oy, l_quantity - ox), 6) AS slope,
  round(regr_intercept(l_extendedprice - oy, l_quantity - ox), 4) AS "offset"
FROM lineitem JOIN o USING (l_returnflag) GROUP BY l_returnflag""")
def link_fit(spark, d):
    r = stats.ols(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "samples", F.round("slope", 6).alias("slope"), F.round("offset", 4).alias("offset"))


@query(f"""
WITH {EV}, s AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) k, count(*) OVER (PARTITION BY event_type) n FROM ev),
tr AS (SELECT * FROM s WHERE k <= floor(n * 0.7)),
o AS (SELECT event_type, min(event_id) ox, min(value) oy FROM tr GROUP BY 1),
f AS (SELECT event_type, ox, oy, count(*) train, regr_slope(value - oy, event_id - ox) a, regr_intercept(value - oy, event_id - ox) c FROM tr JOIN o USING (event_type) GROUP BY ALL)
SELECT event_type, train, count(*) AS test, round(quantile_cont(abs(value - oy - (a * (event_id - ox) + c)), 0.95), 6) AS p95
FROM s JOIN f USING (event_type) WHERE k > floor(n * 0.7) GROUP BY event_type, train""")
def link_fit_holdout(spark, d):
    r = stats.holdout(events(spark, d), ["event_type"], ["t", "event_id"], "event_id", "value")
    return r.select("event_type", "train", "test", F.round("p95", 6).alias("p95"))


def _refit_sql(limits):
    ctes, src = [], "lineitem"
    for k, limit in enumerate(limits):
        ctes.append(f"""o{k} AS (SELECT l_returnflag, min(l_quantity) ox, min(l_extendedprice) oy FROM {src} GROUP BY 1),
f{k} AS (SELECT l_returnflag, ox, oy, regr_slope(l_extendedprice - oy, l_quantity - ox) a, regr_intercept(l_extendedprice - oy, l_quantity - ox) c FROM {src} JOIN o{k} USING (l_returnflag) GROUP BY ALL),
r{k} AS (SELECT s.*, l_extendedprice - oy - (a * (l_quantity - ox) + c) AS resid FROM {src} s JOIN f{k} USING (l_returnflag)),
m{k} AS (SELECT l_returnflag, quantile_cont(resid, 0.5) mid FROM r{k} GROUP BY 1),
k{k} AS (SELECT r{k}.* EXCLUDE (resid) FROM r{k} JOIN m{k} USING (l_returnflag) WHERE abs(resid - mid) <= {limit})""")
        src = f"k{k}"
    return f"WITH {', '.join(ctes)} SELECT l_returnflag, count(*) AS samples, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope FROM {src} GROUP BY 1"


@query(_refit_sql((15000.0, 9000.0)))
def robust_refit(spark, d):
    kept = stats.robust_refit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", (15000.0, 9000.0))
    r = stats.ols(kept, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "samples", F.round("slope", 5).alias("slope"))


@query("""
SELECT l_returnflag, count(*) AS count, max(l_extendedprice) AS max, min(l_extendedprice) AS min, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
FROM lineitem GROUP BY 1""")
def dist_bundle(spark, d):
    r = stats.bundle(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", True)
    return r.select("l_returnflag", "count", "max", "min", *[F.round(c, 4).alias(c) for c in ("mean", "p01", "p05", "p50", "p75", "p90", "p95", "p99")])


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 k, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type, value AS nearest_rank FROM r WHERE k = round_even((n - 1) * 0.95, 0)""")
def pct_nearest_rank(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 0.95)


@query("""
SELECT event_type, least(floor(value / 25.0), 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2""")
def hist_fixed_width(spark, d):
    return stats.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0, 20)


@query(f"""
WITH {EV} SELECT event_type, floor(t / {DAY})::BIGINT AS chunk, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.05), 6) AS p05,
  round(quantile_cont(value, 0.95), 6) AS p95, sum(CASE WHEN value > 400 THEN 1 ELSE 0 END)::BIGINT AS violations FROM ev GROUP BY 1, 2""")
def chunk_stats(spark, d):
    e = events(spark, d).withColumn("chunk", F.floor(F.col("t") / DAY).cast("long"))
    cells = [F.round(F.percentile("value", p), 6).alias(n) for n, p in (("p50", 0.5), ("p05", 0.05), ("p95", 0.95))]
    return e.groupBy("event_type", "chunk").agg(F.count("*").alias("n"), *cells, F.count_if(F.col("value") > 400).alias("violations"))


@query("""
SELECT event_type, count(*) AS samples, CASE WHEN count(*) < 100 THEN 'UNAVAILABLE' WHEN quantile_cont(value, 0.95) / 60 < 1 THEN 'STRONG' WHEN quantile_cont(value, 0.95) / 60 < 5 THEN 'PASS'
  WHEN quantile_cont(value, 0.95) / 60 < 10 THEN 'MARGINAL' ELSE 'BAD' END AS quality FROM events GROUP BY 1""")
def clock_classes(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("samples"), (F.percentile("value", 0.95) / 60).alias("p95"))
    return g.select("event_type", "samples", stats.clock_quality(F.col("samples"), F.col("p95")).alias("quality"))


@query("""
SELECT o_orderstatus, round(CASE WHEN count(*) = 0 THEN 0 ELSE 100.0 * sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) / count(*) END, 6) AS share,
  round(100.0 * (count(*) - sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)) / nullif(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END), 0), 6) AS increase
FROM orders GROUP BY 1""")
def safe_ratios(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").like("1%")).alias("u"), F.count_if(F.col("o_totalprice") > 100000).alias("o"))
    return g.select("o_orderstatus", F.round(stats.ratio_percent(F.col("u"), F.col("n")), 6).alias("share"), F.round(stats.percent_increase(F.col("n"), F.col("o")), 6).alias("increase"))


@query("""
WITH m AS (SELECT l_suppkey, round(avg(l_extendedprice), 6) m1, round(avg(l_quantity), 6) m2, round(avg(l_discount), 6) m3, round(avg(l_tax), 6) m4, count(*) m5 FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(0.30 * (row_number() OVER (ORDER BY m1, l_suppkey) - 1) / (count(*) OVER () - 1) + 0.20 * (row_number() OVER (ORDER BY m2, l_suppkey) - 1) / (count(*) OVER () - 1)
  + 0.15 * (row_number() OVER (ORDER BY m3, l_suppkey) - 1) / (count(*) OVER () - 1) + 0.15 * (row_number() OVER (ORDER BY m4, l_suppkey) - 1) / (count(*) OVER () - 1)
  + 0.20 * (row_number() OVER (ORDER BY m5, l_suppkey) - 1) / (count(*) OVER () - 1), 9) AS score FROM m""")
def rank_composite(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("m1"), F.round(F.avg("l_quantity"), 6).alias("m2"), F.round(F.avg("l_discount"), 6).alias("m3"), F.round(F.avg("l_tax"), 6).alias("m4"), F.count("*").alias("m5"))
    for k in range(5):
        m = stats.rank01(m, f"m{k + 1}", "l_suppkey", f"r{k + 1}")
    score = sum((w * F.col(f"r{k + 1}") for k, w in enumerate(stats.COMPOSITE_WEIGHTS)), F.lit(0.0))
    return m.select("l_suppkey", F.round(score, 9).alias("score"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def top_codes(spark, d):
    """A top-k report: the limit is the feature."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END >= 4""")
def quality_rank_filter(spark, d):
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in {"1": 5, "2": 4, "3": 3, "4": 2, "5": 1}.items() for x in (k, v)]), F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").where(rank >= 4).select("o_orderkey", "o_orderpriority")


# --- matching -------------------------------------------------------------------------------------


@query(f"""
WITH {EV}, {TWO}, c AS (SELECT a.ida, a.ta, count(b.idb) AS candidates, min(b.idb) AS idb FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.tb BETWEEN a.ta - {SIX_HOURS} AND a.ta + {SIX_HOURS} GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN candidates = 1 THEN row_number() OVER (PARTITION BY candidates = 1, CASE WHEN candidates = 1 THEN idb END ORDER BY ta, ida) END k FROM c),
o AS (SELECT ida, candidates, CASE WHEN candidates = 0 THEN 'none' WHEN candidates > 1 THEN 'ambiguous' WHEN k > 1 THEN 'conflict' ELSE 'accepted' END AS outcome, idb FROM r)
SELECT ida, candidates, outcome, CASE WHEN outcome = 'accepted' THEN idb END AS idb FROM o""")
def multiplicity_match(spark, d):
    a, b = _two(events(spark, d), A_KIND, B_KIND)
    return matching.unique_candidate(a, b, ["user_id"], "ta", "tb", "ida", "idb", SIX_HOURS).select("ida", "candidates", "outcome", "idb")


@query(f"""
WITH {EV}, {TWO}, n AS (SELECT a.user_id, ta, tb, ida, idb, row_number() OVER (PARTITION BY ida ORDER BY abs(tb - ta), tb DESC, idb) k FROM a JOIN b ON a.user_id = b.user_id AND abs(tb - ta) <= {SIX_HOURS}),
o AS (SELECT *, row_number() OVER (PARTITION BY idb ORDER BY ta, ida) g FROM n WHERE k = 1)
SELECT ida, idb, tb - ta AS dt FROM o WHERE g = 1""")
def nearest_pair_gate(spark, d):
    a, b = _two(events(spark, d), A_KIND, B_KIND)
    return matching.nearest_gate(a, b, ["user_id"], "ta", "tb", "ida", "idb", SIX_HOURS).select("ida", "idb", (F.col("tb") - F.col("ta")).alias("dt"))


@query(f"""
WITH {EV}, {TWO}, n AS (SELECT ida, idb, row_number() OVER (PARTITION BY ida ORDER BY abs(tb - ta), idb) f, row_number() OVER (PARTITION BY idb ORDER BY abs(tb - ta), ida) g
  FROM a JOIN b ON a.user_id = b.user_id AND abs(tb - ta) <= {SIX_HOURS})
SELECT ida, idb FROM n WHERE f = 1 AND g = 1""")
def reciprocal_nearest(spark, d):
    a, b = _two(events(spark, d), A_KIND, B_KIND)
    return matching.reciprocal_nearest(a, b, ["user_id"], "ta", "tb", "ida", "idb", SIX_HOURS).select("ida", "idb")


@query(f"""
WITH {EV}, {TWO}, n AS (SELECT ida, idb, row_number() OVER (PARTITION BY ida ORDER BY abs(tb - ta), idb) f FROM a JOIN b ON a.user_id = b.user_id AND abs(tb - ta) <= {TWO_HOURS})
SELECT ida, idb FROM n WHERE f = 1""")
def nearest_in_time(spark, d):
    a, b = _two(events(spark, d), A_KIND, B_KIND)
    return matching.nearest_in_time(a, b, ["user_id"], "ta", "tb", "ida", "idb", TWO_HOURS).select("ida", "idb")


EDGES = f"""n AS (SELECT a.user_id, a.event_type AS station_a, b.event_type AS station_b, a.event_id AS id_a, b.event_id AS id_b, abs(b.t - a.t) AS far
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type < b.event_type AND abs(b.t - a.t) <= {SIX_HOURS}),
m AS (SELECT *, row_number() OVER (PARTITION BY id_a, station_b ORDER BY far, id_b) f, row_number() OVER (PARTITION BY id_b, station_a ORDER BY far, id_a) g FROM n),
e AS (SELECT * FROM m WHERE f = 1 AND g = 1)"""


def _edges(spark, d):
    return matching.mutual_edges(events(spark, d), ["user_id"], "event_type", "t", "event_id", SIX_HOURS)


@query(f"WITH {EV}, {EDGES} SELECT station_a || '+' || station_b AS members, count(*) AS n, round(avg(far) / 1000000.0, 3) AS mean_gap_s FROM e GROUP BY 1")
def cluster_membership(spark, d):
    """Which receiver pairs heard a transmission, and how far apart."""
    far = F.abs(F.col("t_b") - F.col("t_a"))
    return _edges(spark, d).groupBy(F.concat_ws("+", "station_a", "station_b").alias("members")).agg(F.count("*").alias("n"), F.round(F.avg(far) / 1e6, 3).alias("mean_gap_s"))


@query(f"""
WITH {EV}, {EDGES} SELECT x.id_a AS id_1, x.id_b AS id_2, y.id_b AS id_3 FROM e x JOIN e y ON x.id_b = y.id_a JOIN e z ON z.id_a = x.id_a AND z.id_b = y.id_b""")
def clique3(spark, d):
    return matching.triangles(_edges(spark, d))


@query(f"""
WITH {EV}, {EDGES}, t AS (SELECT x.id_a AS i1, x.id_b AS i2, y.id_b AS i3 FROM e x JOIN e y ON x.id_b = y.id_a JOIN e z ON z.id_a = x.id_a AND z.id_b = y.id_b),
q AS (SELECT i1, i2, i3, p.id_b AS i4 FROM t JOIN e p ON p.id_a = i3 JOIN e r ON r.id_a = i1 AND r.id_b = p.id_b JOIN e s ON s.id_a = i2 AND s.id_b = p.id_b),
sub AS (SELECT i1, i2, i3 FROM q UNION SELECT i1, i2, i4 FROM q UNION SELECT i1, i3, i4 FROM q UNION SELECT i2, i3, i4 FROM q),
k AS (SELECT i1, i2, i3, i4 FROM q UNION ALL SELECT i1, i2, i3, NULL FROM (SELECT i1, i2, i3 FROM t EXCEPT SELECT i1, i2, i3 FROM sub)),
l AS (SELECT *, row_number() OVER () AS c FROM k), x AS (SELECT c, unnest([i1, i2, i3, i4]) AS i FROM l),
bad AS (SELECT DISTINCT c FROM (SELECT c, count(*) OVER (PARTITION BY i) n FROM x WHERE i IS NOT NULL) WHERE n > 1)
SELECT concat_ws('-', i1, i2, i3, i4) AS members, CASE WHEN i4 IS NULL THEN 3 ELSE 4 END::INT AS size FROM l WHERE c NOT IN (SELECT c FROM bad)""")
def maximal_cliques(spark, d):
    return matching.cliques(_edges(spark, d)).select(F.array_join(F.transform("members", lambda x: x.cast("string")), "-").alias("members"), "size")


@query("SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer")
def shared_obs_components(spark, d):
    """Customers linked by sharing a nation and segment."""
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("member"))
    return graph.shared_members(c, "c_custkey", "member")


LINEAR = f"""u AS (SELECT user_id, t, event_id, 1 AS q, NULL::DOUBLE AS v FROM ev WHERE event_type = '{A_KIND}' UNION ALL SELECT user_id, t, event_id, 0, value FROM ev WHERE event_type = '{B_KIND}'),
w AS (SELECT *, last_value(CASE WHEN q = 0 THEN t END IGNORE NULLS) OVER l AS lt, last_value(v IGNORE NULLS) OVER l AS lv, first_value(CASE WHEN q = 0 THEN t END IGNORE NULLS) OVER r AS rt, first_value(v IGNORE NULLS) OVER r AS rv FROM u
  WINDOW l AS (PARTITION BY user_id ORDER BY t, q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY user_id ORDER BY t, q DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""
WITH {EV}, {LINEAR}, c AS (SELECT event_id, CASE WHEN t - lt <= {5 * DAY} AND rt - t <= {5 * DAY} THEN 'interpolated' WHEN least(t - lt, rt - t) <= {2 * DAY} THEN 'nearest' END AS truth, t, lt, lv, rt, rv FROM w WHERE q = 1)
SELECT event_id, truth, round(CASE truth WHEN 'interpolated' THEN lv + (rv - lv) * CASE WHEN rt = lt THEN 0 ELSE (t - lt)::DOUBLE / (rt - lt) END WHEN 'nearest' THEN CASE WHEN rt IS NULL OR t - lt <= rt - t THEN lv ELSE rv END END, 6) AS value FROM c""")
def asof_interpolate(spark, d):
    e = events(spark, d)
    q = e.where(F.col("event_type") == A_KIND).select("user_id", "event_id", F.col("t").alias("tq"))
    p = e.where(F.col("event_type") == B_KIND).select("user_id", F.col("t").alias("tp"), "value")
    r = matching.interpolate(p, q, ["user_id"], "tp", "tq", "event_id", ["value"], 5 * DAY, 2 * DAY)
    return r.select("event_id", "truth", F.round("value", 6).alias("value"))


SEG = f"""s AS (SELECT *, sum(CASE WHEN g > {TWO_HOURS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM ev))"""


@query(f"WITH {EV}, {SEG} SELECT user_id, segment::BIGINT AS segment, count(*) AS n, min(t) AS start, max(t) AS \"end\" FROM s GROUP BY 1, 2")
def gap_segments(spark, d):
    s = sequences.gap_segments(events(spark, d), ["user_id"], "t", TWO_HOURS, ["event_id"])
    return s.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


RUNS = f"""p AS (SELECT *, lag(event_type) OVER x AS pe, t - lag(t) OVER x AS g FROM ev WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id)),
z AS (SELECT *, sum(CASE WHEN event_type <> pe OR g > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS seg FROM p),
runs AS (SELECT user_id, event_type, min(t) - {HOUR} AS start, max(t) + {HOUR} AS "end", count(*) AS n FROM z GROUP BY user_id, seg, event_type HAVING count(*) >= 2)"""


def _runs(spark, d):
    return sequences.value_or_gap_segments(events(spark, d), ["user_id"], "t", "event_type", DAY, HOUR, 2, ["event_id"])


@query(f"WITH {EV}, {RUNS} SELECT * FROM runs")
def value_or_gap_segments(spark, d):
    return _runs(spark, d)


@query(f"""
WITH {EV}, {RUNS}, h AS (SELECT e.event_id, r.start, r."end", row_number() OVER (PARTITION BY e.event_id ORDER BY least(abs(e.t - r.start), abs(r."end" - e.t)), r.start, r."end") k
  FROM ev e JOIN runs r ON e.user_id = r.user_id AND e.t BETWEEN r.start AND r."end")
SELECT event_id, start, "end" FROM h WHERE k = 1""")
def interval_join(spark, d):
    runs = _runs(spark, d).select("user_id", "start", "end")
    return matching.active_intervals(events(spark, d).select("user_id", "event_id", "t"), runs, ["user_id"], "t", "event_id", "start", "end", DAY).select("event_id", "start", "end")


@query(f"""
WITH {EV}, s AS (SELECT *, sum(CASE WHEN g > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS segment
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS g FROM ev)),
m AS (SELECT user_id, event_type, segment, quantile_cont(t::DOUBLE, 0.5) AS mid, count(*) AS copies FROM s GROUP BY ALL),
r AS (SELECT s.event_id, copies, row_number() OVER (PARTITION BY s.user_id, s.event_type, s.segment ORDER BY CASE WHEN value > 100 THEN 0 ELSE 1 END, abs(t - mid), t, event_id) k FROM s JOIN m USING (user_id, event_type, segment))
SELECT event_id, copies FROM r WHERE k = 1""")
def gap_dedup_rep(spark, d):
    return sequences.dedup_by_gap(events(spark, d), ["user_id", "event_type"], "t", DAY, F.col("value") > 100, ["event_id"]).select("event_id", "copies")


@query(f"""
WITH {EV}, s AS (SELECT user_id, t - {TWO_HOURS} AS a, t + {TWO_HOURS} AS z FROM ev),
b AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM b),
l AS (SELECT user_id, k, max(z) - min(a) AS len FROM i GROUP BY 1, 2)
SELECT user_id, count(*) AS islands, sum(len)::BIGINT AS covered FROM l GROUP BY 1""")
def coverage_union(spark, d):
    return sequences.coverage(events(spark, d), ["user_id"], "t", TWO_HOURS)


@query(f"""
WITH {EV} SELECT event_id, last_value(CASE WHEN event_id % 2 = 0 THEN value END IGNORE NULLS) OVER w AS last_even, last_value(CASE WHEN event_id % 2 = 1 THEN value END IGNORE NULLS) OVER w AS last_odd
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def evenodd_last(spark, d):
    return sequences.latest_pair(events(spark, d), ["user_id"], ["t", "event_id"], F.col("event_id") % 2 == 1, "value").select("event_id", "last_even", "last_odd")


@query(f"""
WITH {EV}, r AS (SELECT user_id, floor(t / {DAY})::BIGINT AS day, event_id, value, row_number() OVER (PARTITION BY user_id, floor(t / {DAY}) ORDER BY value, event_id) k FROM ev)
SELECT user_id, day, event_id, value FROM r WHERE k = 1""")
def thin_best_per_bucket(spark, d):
    return sequences.best_per_bucket(events(spark, d), ["user_id"], F.floor(F.col("t") / DAY).cast("long"), ["value", "event_id"], "day").select("user_id", "day", "event_id", "value")


@query(f"""
WITH RECURSIVE {EV}, k AS (SELECT user_id, min(t) AS t FROM ev GROUP BY 1 UNION ALL SELECT k.user_id, (SELECT min(e.t) FROM ev e WHERE e.user_id = k.user_id AND e.t >= k.t + {DAY}) FROM k WHERE k.t IS NOT NULL)
SELECT event_id FROM ev JOIN k USING (user_id, t)""")
def thin_min_gap(spark, d):
    return sequences.min_gap_keep_first(events(spark, d), ["user_id"], "t", DAY).select("event_id")


@query(f"""
WITH {EV} SELECT event_id, t - lag(t) OVER w AS d_t, round(value - lag(value) OVER w, 6) AS d_value FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def adjacent_deltas(spark, d):
    return sequences.adjacent(events(spark, d), ["user_id"], ["t", "event_id"], ["t", "value"]).select("event_id", "d_t", F.round("d_value", 6).alias("d_value"))


@query(f"""
WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {TWO_HOURS} PRECEDING AND {TWO_HOURS} FOLLOWING) AS density,
  count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS rate FROM ev""")
def density_range(spark, d):
    return sequences.rate(sequences.density(events(spark, d), ["user_id"], "t", TWO_HOURS), ["user_id"], "t", DAY).select("event_id", "density", "rate")


@query(f"""
WITH {EV}, r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM ev),
w AS (SELECT DISTINCT event_type, round_even(i * (n - 1) / 99.0, 0)::BIGINT AS k FROM (SELECT DISTINCT event_type, n FROM r), range(100) x(i))
SELECT event_id FROM r JOIN w USING (event_type, k)""")
def evenly_spaced(spark, d):
    """100 representatives a type: the number is the feature."""
    return sequences.evenly_spaced(events(spark, d), ["event_type"], ["t", "event_id"], 100).select("event_id")


NOW = 1_706_486_400_000_000  # a fixed value: 2024-01-29 00:00 UTC


@query(f"""
WITH {EV}, g AS (SELECT user_id, count(*) AS fixes, max(t) AS last_at FROM ev GROUP BY 1)
SELECT user_id, fixes, last_at, CASE WHEN {NOW} - last_at >= {3 * DAY} THEN 'EXPIRED' WHEN {NOW} - last_at >= {DAY} THEN 'STALE' WHEN fixes >= 60 THEN 'CONFIRMED' ELSE 'TENTATIVE' END AS state FROM g""")
def lifecycle_states(spark, d):
    return sequences.lifecycle(events(spark, d), ["user_id"], "t", F.lit(NOW), 60, DAY, 3 * DAY)


@query(f"WITH {EV} SELECT user_id, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) k FROM ev) WHERE k = 1")
def latest_state(spark, d):
    return sequences.latest(events(spark, d), ["user_id"], "t", ["event_id"]).select("user_id", "event_id", "t")


@query("""
SELECT c_custkey, 'upsert' AS change FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 'delete' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""")
def snapshot_reconcile(spark, d):
    cur = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sequences.reconcile(cur, table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"), ["c_custkey"])


@query(f"""
WITH {EV}, s AS (SELECT event_type, min(t) AS a, max(t) AS z FROM ev GROUP BY 1), w AS (SELECT max(a) AS a, min(z) AS z FROM s)
SELECT event_type, count(*) AS n FROM ev, w WHERE t BETWEEN w.a AND w.z GROUP BY 1""")
def common_window(spark, d):
    """Rows within the time that all receivers share."""
    e = events(spark, d)
    w = e.groupBy("event_type").agg(F.min("t").alias("a"), F.max("t").alias("z")).agg(F.max("a").alias("a"), F.min("z").alias("z"))
    return e.crossJoin(F.broadcast(w)).where("t between a and z").groupBy("event_type").agg(F.count("*").alias("n"))  # one row


@query(f"""
WITH {EV}, {SEG}, t AS (SELECT user_id || '-' || segment AS track_id, user_id % 5 AS code, min(t) / 1000000.0 AS ft, max(t) / 1000000.0 AS lt, (user_id % 9) * 0.1 + 20 AS lat, (user_id % 7) * 0.1 + 106 AS lon FROM s GROUP BY user_id, segment)
SELECT a.track_id, a.code, b.track_id AS track_id_2, b.code AS code_2, round(b.ft - a.lt, 3) AS gap_s FROM t a JOIN t b ON a.code <> b.code AND b.ft - a.lt > 0 AND b.ft - a.lt <= 600
WHERE 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) <= 450.0 * (b.ft - a.lt) + 2000.0""")
def code_transitions(spark, d):
    s = sequences.gap_segments(events(spark, d), ["user_id"], "t", TWO_HOURS, ["event_id"])
    g = s.groupBy("user_id", "segment").agg((F.min("t") / 1e6).alias("first_t"), (F.max("t") / 1e6).alias("last_t"))
    lat, lon = F.col("user_id") % 9 * 0.1 + 20, F.col("user_id") % 7 * 0.1 + 106
    g = g.select(F.concat_ws("-", "user_id", "segment").alias("track_id"), (F.col("user_id") % 5).alias("code"), "first_t", "last_t", lat.alias("first_lat"), lon.alias("first_lon"), lat.alias("last_lat"), lon.alias("last_lon"))
    return matching.code_transitions(g, 600.0).select("track_id", "code", "track_id_2", "code_2", F.round("gap_s", 3).alias("gap_s"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_tax * 25 AS rms, l_quantity / 10 AS mx FROM lineitem),
r AS (SELECT *, lead(rms) OVER (PARTITION BY l_orderkey ORDER BY rms, l_linenumber) AS s2, row_number() OVER (PARTITION BY l_orderkey ORDER BY rms, l_linenumber) AS k FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN rms <= 1 AND mx <= 2 AND (s2 IS NULL OR (s2 - rms >= 1 AND s2 / greatest(rms, 1e-12) >= 2)) THEN 'STRONG_TRUTH_MATCH' WHEN rms <= 3 AND mx <= 5 AND (s2 IS NULL OR (s2 - rms >= .5 AND s2 / greatest(rms, 1e-12) >= 1.5)) THEN 'PLAUSIBLE_TRUTH_MATCH'
  WHEN rms <= 3 AND mx <= 5 THEN 'AMBIGUOUS_TRUTH_MATCH' ELSE 'NO_TRUTH_MATCH' END AS truth_class FROM r WHERE k = 1""")
def truth_classes(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 25).alias("rms"), (F.col("l_quantity") / 10).alias("mx"))
    return matching.truth_match(s, "l_orderkey", "l_linenumber", "rms", "mx").select("l_orderkey", "l_linenumber", "truth_class")


@query("""
SELECT user_id, 'NRX-' || substr(sha256(user_id::VARCHAR || '|' || string_agg(event_type || ':' || event_id, '|' ORDER BY event_id)), 1, 20) AS cluster_id FROM events GROUP BY 1""")
def cluster_sha_id(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("m"))
    members = F.transform("m", lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"].cast("string")))
    return g.select("user_id", ids.cluster_id(F.col("user_id").cast("string"), members).alias("cluster_id"))


# --- geometry -------------------------------------------------------------------------------------

PLACE = "p AS (SELECT c_custkey, 18 + (c_custkey % 97) / 25.0 AS lat, 104 + (c_custkey % 89) / 22.0 AS lon, (c_custkey % 12000) * 1.0 AS alt FROM customer)"


def _places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (18 + k % 97 / 25.0).alias("lat"), (104 + k % 89 / 22.0).alias("lon"), (k % 12000).cast("double").alias("alt"))


@query(f"""
WITH {PLACE} SELECT c_custkey, round(2 * {EARTH_KM} * asin(sqrt(least(pow(sin(radians(20.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(20.5)) * pow(sin(radians(107 - lon) / 2), 2), 1.0))), 6) AS km,
  round((degrees(atan2(sin(radians(107 - lon)) * cos(radians(20.5)), cos(radians(lat)) * sin(radians(20.5)) - sin(radians(lat)) * cos(radians(20.5)) * cos(radians(107 - lon)))) + 360) % 360, 6) AS bearing FROM p""")
def haversine_bearing(spark, d):
    return _places(spark, d).select("c_custkey", F.round(geo.haversine("lat", "lon", 20.5, 107), 6).alias("km"), F.round(geo.bearing("lat", "lon", 20.5, 107), 6).alias("bearing"))


_E2 = WGS84_F * (2 - WGS84_F)
ECEF = f"""q AS (SELECT *, {WGS84_A} / sqrt(1 - {_E2!r} * pow(sin(radians(lat)), 2)) AS n FROM p),
x AS (SELECT c_custkey, lat, lon, alt, (n + alt) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + alt) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - {_E2!r}) + alt) * sin(radians(lat)) AS z FROM q)"""


@query(f"WITH {PLACE}, {ECEF} SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 3) AS alt FROM x")
def ecef_round_trip(spark, d):
    p = _places(spark, d).withColumn("p", geo.geodetic_to_ecef("lat", "lon", "alt"))
    p = p.withColumn("g", geo.ecef_to_geodetic(F.col("p")))
    return p.select("c_custkey", *[F.round(f"p.{k}", 3).alias(k) for k in "xyz"], F.round("g.lat", 7).alias("lat"), F.round("g.lon", 7).alias("lon"), (F.round("g.alt", 3) + 0.0).alias("alt"))


@query(f"""
WITH {PLACE} SELECT c_custkey, round((lon - 106) * {LON_M} * cos(radians(20)), 4) AS east, round((lat - 20) * {LAT_M}, 4) AS north,
  round(least(((c_custkey % 720) - 90 + 720) % 360, 360 - ((c_custkey % 720) - 90 + 720) % 360)::DOUBLE, 4) AS turn, round(2 * pi() * {EARTH_KM * EARTH_KM!r} * (1 - cos(alt / 20 / {EARTH_KM})), 3) AS cap_km2 FROM p""")
def plane_and_cap(spark, d):
    p = _places(spark, d).withColumn("e", geo.to_plane("lat", "lon", 20, 106))
    return p.select("c_custkey", F.round("e.east", 4).alias("east"), F.round("e.north", 4).alias("north"), F.round(geo.angle_difference(F.col("c_custkey") % 720, F.lit(90.0)), 4).alias("turn"), F.round(geo.cap_area_km2(F.col("alt") / 20), 3).alias("cap_km2"))


RING = [(104.2, 18.2), (107.5, 18.4), (107.1, 21.6), (105.6, 20.1), (104.4, 21.3)]


def _ring_sql(x, y):
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]):
        parts.append(f"CASE WHEN (({y1} > {y}) <> ({y2} > {y})) AND {x} < {x2 - x1!r} * ({y} - {y1}) / {y2 - y1!r} + {x1} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(f"WITH {PLACE} SELECT c_custkey, {_ring_sql('lon', 'lat')} AS inside FROM p")
def point_in_ring(spark, d):
    return _places(spark, d).select("c_custkey", geo.point_in_polygon("lon", "lat", RING).alias("inside"))


SITES = [("S1", 20.9, 107.0), ("S2", 20.1, 106.2), ("S3", 19.4, 105.7), ("S4", 21.3, 106.4), ("S5", 18.9, 105.2)]
REACH_KM = 160.0
GRID = "g AS (SELECT 18 + i * 0.1 AS lat, 104 + j * 0.1 AS lon FROM range(40) a(i), range(40) b(j))"
_HAV = f"2 * {EARTH_KM} * asin(sqrt(least(pow(sin(radians(s.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - g.lon) / 2), 2), 1.0)))"
_SITES_SQL = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in SITES) + ") v(id, lat, lon))"


def _grid(spark):
    i = spark.range(40)
    return i.select((18 + F.col("id") * 0.1).alias("lat"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j")).select("lat", (104 + F.col("j") * 0.1).alias("lon"))


@query(f"WITH {GRID}, {_SITES_SQL} SELECT s.id, sum(CASE WHEN {_HAV} <= {REACH_KM} THEN 1 ELSE 0 END)::BIGINT AS points FROM g, s GROUP BY 1")
def grid_coverage(spark, d):
    from ..operators.planner import heard

    sites = spark.createDataFrame(SITES, "id string, slat double, slon double")
    return heard(_grid(spark), sites, REACH_KM).groupBy("id").agg(F.count_if("in_range").alias("points"))


@query(f"""
WITH {GRID}, {_SITES_SQL}, a AS (SELECT g.lat, g.lon, list_sort(list(s.id)) AS ids FROM g, s WHERE {_HAV} <= {REACH_KM} GROUP BY 1, 2)
SELECT len(ids)::BIGINT AS receivers, count(*) AS points, sum(len(ids) * (len(ids) - 1) * (len(ids) - 2) * (len(ids) - 3) / 24)::BIGINT AS subsets FROM a GROUP BY 1""")
def subset_counts(spark, d):
    from ..operators.planner import heard

    sites = spark.createDataFrame(SITES, "id string, slat double, slon double")
    n = heard(_grid(spark), sites, REACH_KM).where("in_range").groupBy("lat", "lon").agg(F.count("*").alias("receivers"))
    r = F.col("receivers")
    return n.groupBy("receivers").agg(F.count("*").alias("points"), F.sum(r * (r - 1) * (r - 2) * (r - 3) / 24).cast("long").alias("subsets"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 7)
SELECT a.id AS id_1, b.id AS id_2, c.id AS id_3, e.id AS id_4, round(a.s_acctbal + b.s_acctbal + c.s_acctbal + e.s_acctbal, 4) AS score FROM s a JOIN s b ON a.id < b.id JOIN s c ON b.id < c.id JOIN s e ON c.id < e.id""")
def subset_best4(spark, d):
    """All 4-subsets of seven receivers: the planner's guard on the number of receivers is the limit."""
    from ..operators.planner import subsets

    s = table(spark, d, "supplier").orderBy("s_suppkey").limit(7).select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return subsets(s, 4).select(*[F.col("members")[k]["id"].alias(f"id_{k + 1}") for k in range(4)], F.round(sum((F.col("members")[k]["s_acctbal"] for k in range(4)), F.lit(0.0)), 4).alias("score"))


# --- decoding -------------------------------------------------------------------------------------


def _xor_sql(pairs):
    out = "0"
    for mask, flip in pairs:
        out = f"xor({out}, CASE WHEN raw & {mask} <> 0 THEN {flip} ELSE 0 END)"
    return out


@query(f"""
WITH w AS (SELECT i::INT AS raw FROM range(65536) r(i)), h AS (SELECT raw, {_xor_sql(modes.GILLHAM_HUNDREDS)} AS o, {_xor_sql(modes.GILLHAM_FIVES)} AS f FROM w),
k AS (SELECT raw, CASE WHEN o & 5 = 5 THEN xor(o, 2) ELSE o END AS o, f FROM h)
SELECT raw, ((raw >> 12) & 7)::VARCHAR || ((raw >> 8) & 7)::VARCHAR || ((raw >> 4) & 7)::VARCHAR || (raw & 7)::VARCHAR AS code,
  CASE WHEN raw & {0xFFFF8889 & 0xFFFF} <> 0 OR raw & 240 = 0 OR o > 5 THEN NULL ELSE 5 * f + CASE WHEN f % 2 = 1 THEN 6 - o ELSE o END - 13 END::INT AS hundreds_ft FROM k""")
def gillham(spark, d):
    t = modes.gillham_table(spark)
    return t.select("raw", "code", F.col("hundreds_ft").cast("int"))


def _digit_sql(at):
    return "(" + " + ".join(f"((f >> {b}) & 1) * {w}" for b, w in zip(at, (1, 2, 4))) + ")::VARCHAR"


@query(f"""
WITH w AS (SELECT i::INT AS f FROM range(8192) r(i)) SELECT f, {" || ".join(_digit_sql(modes.ID13_BITS[k]) for k in "ABCD")} AS squawk,
  CASE WHEN f & 16 <> 0 THEN (((f & 8064) >> 2) | ((f & 32) >> 1) | (f & 15)) * 25 - 1000 END::INT AS altitude_ft FROM w""")
def identity_and_altitude(spark, d):
    f = spark.range(8192).select(F.col("id").cast("int").alias("f"))
    return f.select("f", modes.identity_13(F.col("f")).alias("squawk"), modes.altitude_13(F.col("f")).cast("int").alias("altitude_ft"))


@query(f"""
WITH w AS (SELECT i AS k, i / 100.0 - 90 AS lat FROM range(18001) r(i)) SELECT k, CASE WHEN abs(lat) < 1e-10 THEN 59 WHEN abs(lat) > 87 THEN 1 WHEN abs(lat) = 87 THEN 2
  ELSE floor(2 * pi() / acos(greatest(1 - {1 - math.cos(math.pi / 30)!r} / pow(cos(radians(abs(lat))), 2), -1.0))) END::INT AS zones FROM w""")
def longitude_zones(spark, d):
    w = spark.range(18001).select(F.col("id").alias("k"), (F.col("id") / 100.0 - 90).alias("lat"))
    return w.select("k", modes.longitude_zones(F.col("lat")).alias("zones"))


@query("""
SELECT event_id, event_id % 65536 AS raw, (((event_id % 65536) >> 12) & 7)::VARCHAR || (((event_id % 65536) >> 8) & 7)::VARCHAR || (((event_id % 65536) >> 4) & 7)::VARCHAR || ((event_id % 65536) & 7)::VARCHAR AS code, ((event_id % 65536) & 128) <> 0 AS spi FROM events""")
def mode_a_code(spark, d):
    raw = (F.col("event_id") % 65536).alias("raw")
    return table(spark, d, "events").select("event_id", raw).select("event_id", "raw", modes.mode_a(F.col("raw")).alias("code"), modes.spi(F.col("raw")).alias("spi"))
