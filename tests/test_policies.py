"""Path methods, yield policies, strict rules in order of arrival, layouts, three-receiver classes."""

import math

import numpy as np
import pandas as pd
import pytest

from skylattice.config import Station
from skylattice.operators import association, planner, solver, strict, tracking, yields

SITES = [Station(n, 20.0 + 0.5 * a, 106.0 + 0.5 * b, 0.0, i) for i, (n, a, b) in enumerate([("N", 1, 0), ("W", 0, -1), ("S", -1, 0), ("E", 0, 1)])]
RULES = tracking.CONFIGS["BALANCED"]


def run_of(n, single=(0,)):
    t = [float(k) for k in range(n)]
    true = [np.array([[200.0 * k, 0.0]]) for k in range(n)]
    places = [p if k in single else np.concatenate([p + [[9_000.0, 7_000.0 * (-1) ** k]], p]) for k, p in enumerate(true)]
    return t, places, [np.full(len(p), 12.0) for p in places]


@pytest.mark.parametrize("method", ["nearest_previous", "cv_greedy", "global_dp"])
def test_methods_follow_the_smooth_branch_from_a_seed(method):
    got = tracking.METHODS[method](*run_of(8, single=(3,)), RULES)
    assert {k: v[0] for k, v in got.items()} == {k: 0 if k == 3 else 1 for k in range(8)}
    assert {v[2] for v in got.values()} == {"STRONG_SEED"}


def test_baseline_takes_single_branches_alone():
    assert sorted(tracking.METHODS["baseline"](*run_of(8, single=(1, 5)), RULES)) == [1, 5]


def test_a_direction_ends_where_nothing_is_feasible():
    t, places, conds = run_of(8, single=(0,))
    places[4] = places[4] + 400_000.0
    assert sorted(tracking.from_seed(t, places, conds, RULES)) == [0, 1, 2, 3]


def test_ambiguous_runs_have_no_path():
    t = [float(k) for k in range(4)]
    places = [np.array([[200.0 * k, 0.0], [200.0 * k, 1000.0]]) for k in range(4)]
    conds = [np.full(2, 12.0)] * 4
    assert tracking.whole_path(t, places, conds, RULES) == {}
    assert tracking.from_seed(t, places, conds, RULES) == {}


def test_steps_without_a_branch_part_the_path():
    t, places, conds = run_of(7, single=(0, 5))
    places[3], conds[3] = np.empty((0, 2)), np.empty(0)
    assert sorted(tracking.whole_path(t, places, conds, RULES)) == [0, 1, 2, 4, 5, 6]


@pytest.mark.parametrize("method", sorted(tracking.METHODS))
def test_every_event_has_one_row(spark, method):
    rows = [("k", f"e{k:02}", float(k), 20.0 + 0.002 * k + off, 107.0 + off, 0.05, 12.0, centre) for k in range(10) for off, centre in ((0.0, 100.0), (0.7, 100.0 if k else 9000.0))]
    rows.append(("k", "late", 4.0, 20.0, 107.0, 0.05, 12.0, 100.0))
    b = spark.createDataFrame(rows, "key string, event_id string, t double, lat double, lon double, rms_us double, condition double, center_km double")
    got = {r.event_id: r for r in tracking.disambiguate(b, method=method).collect()}
    assert len(got) == 11 and got["late"].quality == "REJECT" and got["late"].lat is None
    assert got["e00"].quality == "HIGH" and abs(got["e00"].lat - 20.0) < 1e-9
    chosen = [e for e in got.values() if e.lat is not None]
    assert len(chosen) == (1 if method == "baseline" else 10) and all(abs(e.lon - 107.0) < 1e-9 for e in chosen)


def frozen(spark, lats, policy="ANCHORED_TEMPORAL", step=4.0):
    rows = [(p, "SELECTED", "k", str(k), step * k, float(lat), 107.0, "HIGH", "STRONG_SEED") for k, lat in enumerate(lats) for p in (policy, yields.CANDIDATES)]
    return spark.createDataFrame(rows, "policy string, point_role string, key string, event_id string, t double, lat double, lon double, quality string, seed string")


def test_continuity_and_status(spark):
    smooth = frozen(spark, [20 + 0.005 * k for k in range(12)])
    row = yields.status(smooth).first()
    assert row.blind_quality == "GOOD" and row.coherence == 1.0 and row.candidate_events == 12 and row.transitions == 11
    errors = spark.createDataFrame([(str(k), 200.0, -100.0) for k in range(12)], "event_id string, horizontal_error_m double, cross_track_error_m double")
    assert yields.status(smooth, errors).first().validation_status == "TRACK_VALID"
    wild = yields.status(frozen(spark, [20 + (k % 2) for k in range(12)]), errors).first()
    assert wild.catastrophic_jumps == 11 and wild.speed_over_600 == 11 and wild.blind_quality == "AMBIGUOUS" and wild.validation_status == "TRACK_PARTIAL"
    one = yields.status(frozen(spark, [20.0])).first()
    assert one.blind_quality == "AMBIGUOUS" and one.transitions == 0 and one.coherence == 1.0
    assert yields.status(smooth.limit(0)).count() == 0


def test_path_length_and_motion(spark):
    p = frozen(spark, [20 + 0.01 * k for k in range(5)]).where("policy = 'ANCHORED_TEMPORAL'")
    want = 4 * 1107.0
    assert abs(yields.path_length(p, ["key"]).first().length_m - want) < 5
    truth = p.selectExpr("*", "lat as truth_lat", "lon + 0.01 * t / 4 as truth_lon")
    got = yields.motion_agreement(truth).collect()
    assert len(got) == 4 and all(abs(r.heading_error_deg - math.degrees(math.atan(math.cos(math.radians(r.t * 0 + 20.02))))) < 0.2 for r in got)
    assert all(r.speed_error_mps > 90 for r in got)


def arrivals(spark, rows):
    return spark.createDataFrame(rows, "id string, station string, norm double, utc_ns long, raw_hex string")


def test_strict_rules_differ(spark):
    four = [(n, n, 100.0 * i, 1000 + i, "aa") for i, n in enumerate("NWSE")]
    early = [("x", "N", 100_000.0, 500, "aa")]  # same payload, far from the others in time
    got = {r.id: r for r in strict.strict(arrivals(spark, early + four), SITES, "modeac").collect()}
    assert got["E"].verdict == strict.EVENT and got["E"].ids == list("NWSE") and got["E"].utc_ns == 1001 and got["W"].verdict == strict.FEW
    got = {r.id: r for r in strict.strict(arrivals(spark, early + four), SITES, "modes").collect()}
    assert got["E"].verdict == strict.EVENT and got["E"].utc_ns == 1002
    again = [(n + "2", n, 500.0 + 100 * i, 2000 + i, "aa") for i, n in enumerate("NWSE")]
    verdicts = lambda rule: {r.id: r.verdict for r in strict.strict(arrivals(spark, early + four + again), SITES, rule).collect()}
    assert verdicts("modeac")["E2"] == strict.EVENT and verdicts("modes")["E2"] == strict.EVENT
    twin = [("n", "N", 3.0, 1003, "aa"), *[r for r in four if r[0] == "N"], *[r for r in four if r[0] != "N"]]
    got = {r.id: r.verdict for r in strict.strict(arrivals(spark, twin), SITES, "modeac").collect()}
    assert got["E"] == strict.UNCLEAR
    far = [(n, n, 1e7 * (n == "E"), 1000 + i, "aa") for i, n in enumerate("NWSE")]
    assert {r.id: r.verdict for r in strict.strict(arrivals(spark, far), SITES, "modes").collect()}["E"] == strict.UNFIT
    assert {r.id: r.verdict for r in strict.strict(arrivals(spark, far), SITES, "modeac").collect()}["E"] == strict.FEW


def test_strict_forgets_and_leaves_out(spark):
    late = 2_000_000_000
    rows = [("N", "N", 0.0, 1000, "aa"), *[(n, n, 100.0, 1000 + late, "aa") for n in "WSE"], ("u", "??", 0.0, 1, "aa"), ("v", "N", None, 1, "aa"), ("w", "N", 1.0, 1, None)]
    got = strict.strict(arrivals(spark, rows), SITES, "modeac").collect()
    assert sorted(r.id for r in got) == ["E", "N", "S", "W"] and all(r.verdict == strict.FEW for r in got)


def test_strict_stream_gives_the_batch_rows(spark, tmp_path):
    rows = [(f"{n}{j}", n, 1e6 * j + 100.0 * i, 10_000_000 * (j + 1) + i, f"p{j % 3}") for j in range(9) for i, n in enumerate("NWSE")]
    arrivals(spark, rows).write.parquet(str(tmp_path / "in"))
    for rule in strict.RULES:
        want = sorted(map(str, strict.strict(arrivals(spark, rows), SITES, rule).collect()))
        source = spark.readStream.schema("id string, station string, norm double, utc_ns long, raw_hex string").parquet(str(tmp_path / "in"))
        q = strict.strict_stream(source, SITES, rule).writeStream.format("memory").queryName(f"strict_{rule}").option("checkpointLocation", str(tmp_path / rule)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(f"strict_{rule}").collect())) == want


def test_layouts_have_their_span(spark):
    p = planner.layouts(spark, 20.5, 106.5, [50.0, 100.0]).toPandas()
    assert len(p) == 6 * 2 * 12 * 4 and set(p["turn_deg"]) == set(range(0, 180, 15))
    for (_, span, _), g in p.groupby(["layout", "span_km", "turn_deg"]):
        km = [tracking.metres(a, b, c, d) / 1000 for a, b in zip(g.lat, g.lon) for c, d in zip(g.lat, g.lon)]
        assert abs(max(km) / span - 1) < 0.01
    targets = [(20.5 + 0.1 * i, 106.5 + 0.1 * j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    best = planner.best_rotation(planner.score_layouts(planner.layouts(spark, 20.5, 106.5, [100.0], 90), targets, 2500.0, 0.25)).toPandas().set_index("layout")
    assert len(best) == 6 and best.loc["linear", "inside_share"] == 0 and best.loc["square", "inside_share"] == 1


def test_three_receiver_classes():
    row = {"condition": 5.0, "center_km": 100.0, "rms_us": 0.1}
    of = lambda *rows: solver.classify_three(pd.DataFrame(rows, columns=list(row), dtype=float))[0]
    assert of() == of({**row, "center_km": 2000.0}) == "ALT_3RX_INCONSISTENT"
    assert of(row, {**row, "condition": 1e9}) == "ALT_3RX_UNIQUE" and of(row, {**row, "rms_us": 9.0}) == "ALT_3RX_MULTIPLE"


def test_counters_by_format(spark):
    rows = [(f"{n}", n, 10.0 * i, 1000 + i, "aa", 17, "abc", "f") for i, n in enumerate("NWS")]
    obs = spark.createDataFrame(rows, "id string, station string, norm double, utc_ns long, raw_hex string, df int, icao string, family string")
    got = {r.counter: r.n for r in association.counters(association.associate(obs, SITES)).collect()}
    assert got == {"3RX": 1, "N+W+S": 1, "DF17:3RX": 1}
