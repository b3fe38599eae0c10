import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.config import Settings, Station
from skylattice.operators import association, graph, matching, planner, rings, sequences, solver, tracking
from skylattice.plans import synthetic

CLOSE = [Station(f"R{i}", 20.0 + 0.05 * i, 106.0 + 0.03 * i, 0.0, i) for i in range(5)]


def obs(spark, rows):
    """(id, station, norm, key)"""
    full = [(i, s, float(t), int(t * 1000 / 12), k, 17, "abcdef", "modes") for i, s, t, k in rows]
    return spark.createDataFrame(full, "id string, station string, norm double, utc_ns long, raw_hex string, df int, icao string, family string")


def found(spark, rows, policy="greedy", stations=CLOSE):
    return association.associate(obs(spark, rows), stations, policy, 3.0).collect()


FIVE = [(f"R{i}:0", f"R{i}", 1000 + 12 * i, "aa") for i in range(5)]


@pytest.mark.parametrize("policy", ["greedy", "combination", "strict"])
def test_five_receivers_are_one_cluster(spark, policy):
    got = [r for r in found(spark, FIVE, policy) if r.verdict == "cluster"]
    assert len(got) == 1 and got[0].receiver_count == 5


def test_row_order_does_not_matter(spark):
    a, b = found(spark, FIVE), found(spark, FIVE[::-1])
    assert [r.cluster_id for r in a] == [r.cluster_id for r in b]


def test_two_keys_do_not_mix(spark):
    rows = [(f"a{i}", f"R{i}", 1000 + i, "aa") for i in range(3)] + [(f"b{i}", f"R{i}", 1000 + i, "bb") for i in (3, 4)]
    assert sorted(r.receiver_count for r in found(spark, rows) if r.verdict == "cluster") == [2, 3]


def test_duplicate_one_tick_away_is_ambiguous(spark):
    got = found(spark, [*FIVE, ("R2:1", "R2", 1025, "aa")])
    assert any(r.verdict == "ambiguous" for r in got)


def test_unphysical_member_is_dropped(spark):
    far = [*CLOSE, Station("Z", 25.0, 106.0, 0.0, 5)]
    got = found(spark, [*FIVE[:3], ("R3:0", "R3", 1000 + 2000, "aa")], stations=far)
    assert any(r.verdict == "physical_reject" for r in got)
    assert all("R3" not in r.receiver_ids for r in got if r.verdict == "cluster")


def test_same_key_at_two_times_gives_two_clusters(spark):
    later = [(f"R{i}:1", f"R{i}", 10_000_000 + 12 * i, "aa") for i in range(5)]
    got = [r for r in found(spark, FIVE + later) if r.verdict == "cluster"]
    assert len(got) == 2 and not {m.id for m in got[0].obs} & {m.id for m in got[1].obs}


def test_bursts_give_what_whole_keys_give():
    """Cutting a key at gaps wider than the gate changes nothing."""
    rng = random.Random(5)
    limits = association.limits_us(CLOSE)
    rows = [(f"{k}", rng.randrange(5), float(rng.randrange(0, 30_000))) for k in range(300)]
    pdf = pd.DataFrame(rows, columns=["id", "rank", "norm"]).assign(utc_ns=0, df=None, icao=None, family=None)
    whole = [sorted(pdf_.rows.iloc[r]["id"]) for pdf_ in [association.Burst.of(pdf, limits, 3.0, 6.0)] for v, r in pdf_.greedy() if v == "cluster"]
    reach = (limits.max() + 3.0) * 12
    s = pdf.sort_values("norm")
    parts = (s["norm"].diff() > reach).cumsum()
    cut = []
    for _, g in s.groupby(parts):
        b = association.Burst.of(g, limits, 3.0, 6.0)
        cut += [sorted(b.rows.iloc[r]["id"]) for v, r in b.greedy() if v == "cluster"]
    assert sorted(whole) == sorted(cut) and len(whole) > 10


def test_any_four_counts_an_event_once(spark):
    r = association.any_of(obs(spark, FIVE), CLOSE, 4).collect()
    assert len(r) == 5 and len({x.component for x in r}) == 1


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_solver_finds_true_positions():
    f = solver.Frame(synthetic.STATIONS[:4])
    truths = [(20.5, 107.0, 10_000.0), (20.0, 106.5, 6000.0), (21.2, 107.4, 3000.0), (19.5, 107.0, 9000.0), (20.8, 106.1, 12_000.0)]
    for lat, lon, alt in truths:
        found = solver.branches(f, np.array([synthetic.tdoa_us(lat, lon, alt)]), np.array([alt]))
        best = solver.select(found)
        assert abs(best.lat - lat) < 1e-6 and abs(best.lon - lon) < 1e-6 and best.rms_us < 1e-6


def test_unconstrained_solver():
    r = solver.solve_3d(np.array(synthetic.tdoa_us(20.5, 107.0, 10_000.0)), synthetic.STATIONS[:4])
    assert ((r.alt_m - 10_000).abs() < 1).any() and (r.plausibility == "VALID").any()


def test_metrics_agree_with_linear_algebra():
    xyz = np.array([association.ecef(s) for s in synthetic.STATIONS[:4]])
    lat, lon = np.array([20.5, 20.0]), np.array([107.0, 106.4])
    draws = np.random.default_rng(1).normal(size=(4, 256))
    m, g = solver.metrics(lat, lon, 2500.0, xyz, 0.25, draws), solver.design(lat, lon, 2500.0, xyz)
    for k in range(2):
        s = np.linalg.svd(g[k], compute_uv=False)
        sigma = 299_792_458.0 * 0.25e-6
        p = np.eye(4) - 0.25
        radial = np.linalg.norm((np.linalg.pinv(g[k]) @ p @ (draws * sigma)).T, axis=1)
        assert m["condition"][k] == pytest.approx(s[0] / s[1]) and m["mc_p95_m"][k] == pytest.approx(np.percentile(radial, 95))
        assert m["linear_hrmse_m"][k] == pytest.approx(sigma * np.sqrt(np.trace(np.linalg.inv(g[k].T @ g[k]))))


def test_remote_separation_against_all_pairs():
    rng = np.random.default_rng(4)
    lat, lon = 20 + rng.random(60), 106 + rng.random(60)
    xyz = np.array([association.ecef(s) for s in synthetic.STATIONS[:4]])
    sig = solver.signatures(lat, lon, 2500.0, xyz)
    got = planner.remote_separation(lat, lon, sig, block=7)
    for i in range(60):
        far = [j for j in range(60) if tracking.metres(lat[i], lon[i], lat[j], lon[j]) * 6371.0088 / 6371.0 >= 25_000]
        assert got[i] == pytest.approx(min(np.sqrt(((sig[i] - sig[j]) ** 2).mean()) for j in far), rel=1e-6)


def test_rings():
    assert 12_300 < rings.area_km2(np.array([[0, 0], [0, 1], [1, 1], [1, 0]])) < 12_450
    a, b = np.array([[0, 0], [0, 2], [2, 2], [2, 0]]), np.array([[1, 1], [1, 3], [3, 3], [3, 1]])
    assert rings.intersection_km2(a, b) == pytest.approx(rings.area_km2(np.array([[1, 1], [1, 2], [2, 2], [2, 1]])), rel=2e-3)
    assert rings.crosses_itself(np.array([[0, 0], [1, 1], [0, 1], [1, 0]])) and not rings.crosses_itself(a)
    ell = np.array([[0, 0], [0, 2], [1, 2], [1, 1], [2, 1], [2, 0]])
    assert sum(abs(rings.signed(t)) for t in rings.triangulate(ell.astype(float))) == pytest.approx(3)
    assert rings.inside(a, np.array([0.0, 1, 3]), np.array([1.0, 1, 1])).tolist() == [True, True, False]


def test_planner_request_and_grid(spark):
    sites = tuple(planner.Receiver(s.name, s.name, s.lat, s.lon, max_range_km=250.0) for s in synthetic.STATIONS)
    area = ((19.5, 106.0), (19.5, 107.5), (21.0, 107.5), (21.0, 106.0))
    with pytest.raises(ValueError):
        planner.Request(sites[:3], area)
    rows = planner.analyze(spark, planner.Request(sites, area, grid_step_km=20, geometry_strategy="best_4_of_n")).collect()
    worst = planner.analyze(spark, planner.Request(sites, area, grid_step_km=20, geometry_strategy="worst_4_of_n")).collect()
    by = {r.point: r for r in worst}
    assert len(rows) > 40 and all(r.subset_count == 5 for r in rows if r.receiver_count == 5)
    assert all(r.p95_error_m <= by[r.point].p95_error_m + 1e-9 for r in rows if r.branch_safe and by[r.point].branch_safe and r.p95_error_m)


def test_path_takes_the_smooth_branch():
    t = [float(k) for k in range(12)]
    true = [np.array([[200.0 * k, 0.0]]) for k in range(12)]
    places = [np.concatenate([p, p + [[60_000.0, 40_000.0 * (-1) ** k]]]) for k, p in enumerate(true)]
    path, margin, _ = tracking.best_path(t, places, [np.array([12.0, 12.0])] * 12, tracking.CONFIGS["BALANCED"])
    assert path == [0] * 12 and margin > 0
    broken = [p if k < 6 else p + 500_000.0 for k, p in enumerate(true)]
    got = tracking.fragments(t, broken, [np.array([12.0])] * 12, tracking.CONFIGS["BALANCED"])
    assert [(a, len(p)) for a, p, _ in got] == [(0, 6), (6, 6)]


def test_late_fix_opens_or_drops():
    f = pd.DataFrame({"t": [0.0, 1.0, 2.0, 2.0], "event_id": list("abcd"), "lat": 20.0, "lon": 107.0, "weighted_rms": 0.5, "clock_quality": "PASS", "segment": 0})
    assert len({r[0] for r in tracking.link(f, "1234", Settings(), True)}) == 2
    assert len(tracking.link(f, "abcdef", Settings(), False)) == 3


def test_sequences(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2, 10, 11, 30)], "k string, t long")
    assert sequences.gap_segments(df, ["k"], "t", 5).agg(F.max("segment")).first()[0] == 2
    assert sequences.coverage(df, ["k"], "t", 1).first().covered == 4 + 3 + 2
    assert sorted(r.t for r in sequences.min_gap_keep_first(df, ["k"], "t", 10).collect()) == [0, 10, 30]


def test_band_join_against_all_pairs(spark):
    rng = random.Random(9)
    a = [(rng.randrange(3), rng.randrange(200), k) for k in range(80)]
    b = [(rng.randrange(3), rng.randrange(200), k) for k in range(80)]
    A, B = spark.createDataFrame(a, "k int, ta long, ia long"), spark.createDataFrame(b, "k int, tb long, ib long")
    got = {(r.ia, r.ib) for r in matching.band_join(A, B, ["k"], "ta", "tb", 7).collect()}
    assert got == {(x[2], y[2]) for x, y in itertools.product(a, b) if x[0] == y[0] and abs(x[1] - y[1]) <= 7}


def _solution(weighted, center_km, lat=20.0, lon=106.0):
    return {"weighted_rms": weighted, "rms_us": weighted, "center_km": center_km, "lat": lat, "lon": lon, "altitude_m": 3000.0, "condition": 10.0}


@pytest.mark.parametrize("rows, kind", [
    ([], "BLIND_INCONSISTENT"), ([_solution(0.2, 2000)], "BLIND_INCONSISTENT"), ([_solution(1.6, 100)], "BLIND_INCONSISTENT"), ([_solution(0.2, 100)], "BLIND_UNIQUE"),
    ([_solution(0.2, 100), _solution(0.3, 110, 20.1)], "BLIND_UNIQUE"),  # one family
    ([_solution(0.2, 100), _solution(0.6, 200, 21.5)], "BLIND_MULTIPLE"),  # a rival inside the radius, whatever the ratio
    ([_solution(0.2, 100), _solution(0.6, 2500, 40.0)], "BLIND_MULTIPLE"),  # and one beyond it
    ([_solution(0.2, 100), _solution(0.8, 200, 21.5)], "BLIND_UNIQUE"), ([_solution(1.0, 100), _solution(1.4, 200, 21.5)], "BLIND_MULTIPLE"), ([_solution(0.2, 100), _solution(0.3, 3500, 50.0)], "BLIND_UNIQUE"),
    ([_solution(0.2, 100) | {"condition": 1e9}], "BLIND_INCONSISTENT"),
])
def test_each_branch_of_the_blind_class(rows, kind):
    found = pd.DataFrame(rows, columns=list(_solution(0, 0))).astype(float)
    assert solver.classify(found)[0] == kind


def test_far_points_make_the_distance_infinite(spark):
    cols = "key string, t double, lat double, lon double"
    a = spark.createDataFrame([("x", 0.0, 20.0, 106.0), ("x", 10.0, 20.1, 106.0), ("y", 0.0, 20.0, 106.0), ("y", 500.0, 20.0, 106.0)], cols)
    b = spark.createDataFrame([("x", 1.0, 20.0, 106.0), ("x", 11.0, 20.1, 106.0), ("y", 1.0, 20.0, 106.0)], cols)
    got = {r.key: r for r in tracking.trajectory_distance(a, b, "key", 5.0).collect()}
    assert got["x"].hausdorff_m == 0 and got["x"].unmatched == 0 and got["y"].hausdorff_m == float("inf") and got["y"].unmatched == 1


def test_scans_of_the_robust_refit_do_not_grow(spark):
    from skylattice.functions import stats

    df = spark.range(400).selectExpr("id % 2 as k", "double(id) as x", "double(id * 3 + case when id % 50 = 0 then 1000 else id % 3 end) as y")
    plans = [stats.robust_refit(df, ["k"], "x", "y", (500.0, 100.0, 10.0, 5.0)[:n]) for n in (1, 4)]
    scans = [p._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 400") for p in plans]
    assert scans == [1, 1] and plans[1].count() == 392


def test_rank_over_ranges(spark):
    from skylattice.functions import stats

    df = spark.range(1000).selectExpr("id", "id * 7919 % 101 as v")
    want = {r: i / 999 for i, r in enumerate(sorted(range(1000), key=lambda k: (k * 7919 % 101, k)))}
    got = {r.id: r.rank for r in stats.rank01(df, "v", "id", "rank").collect()}
    assert got == pytest.approx(want) and stats.rank01(df.limit(1), "v", "id", "rank").first().rank == 0 and stats.rank01(df.limit(0), "v", "id", "rank").count() == 0


def test_nearest_each_against_all_pairs(spark):
    rng = random.Random(5)
    a = [(k % 3, rng.choice([rng.uniform(-9, 40), float(rng.randrange(-9, 40))]), k) for k in range(150)] + [(0, None, 900), (0, float("nan"), 901)]
    b = {(f"T{k % 4}", rng.choice([rng.uniform(-9, 60), float(rng.randrange(-9, 60))])): k for k in range(200)}
    A = spark.createDataFrame(a, "ia int, t1 double, va int")
    B = spark.createDataFrame([(*k, v) for k, v in b.items()] + [("T9", None, 1), ("T9", float("nan"), 2)], "ib string, t2 double, vb int")
    got = sorted((r.va, r.ib, r.t2, r.vb) for r in tracking.nearest_each(A, B, "ib", "t1", "t2", 3.0).collect())
    want = []
    for _, t1, va in a:
        for name in ("T0", "T1", "T2", "T3"):
            near = [(abs(t - t1), t, v) for (n, t), v in b.items() if n == name and t1 is not None and abs(t - t1) <= 3.0]
            if near:
                want.append((va, name, *min(near)[1:]))
    assert got == sorted(want) and len(got) > 300


def test_cotracks_make_no_pairs(spark):
    """20,000 points each in one time bucket: 400 million pairs, of which none is made."""
    row = lambda name, c: spark.range(20_000).select(F.lit(name).alias("track_id"), (c + F.col("id") / 20_000).alias("t"), F.lit(20.0).alias("lat"), F.lit(107.0).alias("lon"), F.lit(100.0).alias("speed_mps"), F.lit(90.0).alias("heading_deg"))
    made = []
    df = tracking.cotracks(row("a", 0.0), row("b", 0.00001), 3.0, 0.01)
    assert [r.matches for r in df.collect()] == [100]
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:  # rows that the plan's joins made
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if "QueryStageExec" in p.getClass().getSimpleName():
            todo.append(p.plan())
        if "Join" in p.nodeName():
            made.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    assert made and sum(made) <= 50_000


def test_cotracks_at_one_time_take_the_point_with_a_speed(spark):
    row = lambda name, speeds: spark.createDataFrame([(name, float(t), 20.0, 107.0, v, 90.0) for t in range(0, 9, 2) for v in speeds], "track_id string, t double, lat double, lon double, speed_mps double, heading_deg double")
    assert tracking.cotracks(row("a", [None, 300.0]), row("b", [100.0, None])).count() == 0
    assert tracking.cotracks(row("a", [None, 150.0]), row("b", [100.0, None])).first().matches == 5
