from pyspark.sql import functions as F

from skylattice.plans import reports, synthetic


def test_serving_views(spark):
    frames = spark.createDataFrame([("N", 10), ("W", 20_000_000_000)], "station string, recv_utc_ns long")
    assert {r.station: r.state for r in reports.receivers(frames, 21_000_000_000).collect()} == {"N": "silent", "W": "connected"}
    t = spark.createDataFrame([("a", "HIGH", "CONFIRMED"), ("b", "LOW", "CONFIRMED"), ("c", "HIGH", "EXPIRED")], "track_id string, quality string, state string")
    assert [r.track_id for r in reports.tracks(t, "MEDIUM").collect()] == ["a"]


def test_evaluation_chain(spark):
    truth = spark.createDataFrame([("x", float(t), 20.0 + 0.001 * t, 107.0) for t in range(0, 60, 5)], "code string, tt double, lat double, lon double")
    sol = spark.createDataFrame([(str(t), "x", float(t), 20.0 + 0.001 * t + 0.0001, 107.0, t % 2) for t in range(1, 50)], "event_id string, code string, t double, lat double, lon double, s int")
    e = reports.evaluate(sol, truth, ["code"], "t", "tt", 10.0, 5.0)
    r = e.agg(F.count("*").alias("n"), F.min("error_m").alias("a"), F.max("error_m").alias("z"), F.avg("error_north_m").alias("north")).first()
    assert r.n == 49 and 11 < r.a <= r.z < 11.2 and 11 < r.north < 11.2
    assert reports.bias(e, ["s"]).count() == 3
    links = spark.createDataFrame([("STRONG",)], "quality string")
    assert reports.verdict(e, links).first().verdict == "PASS"


def test_studies(spark):
    area = ((19.5, 106.0), (19.5, 107.5), (21.0, 107.5), (21.0, 106.0))
    h = reports.heat_map(spark, synthetic.STATIONS[:4], area, 20, 2500.0, [0.25, 1.0])
    a, b = (h.where(F.col("noise_us") == n).agg(F.avg("p95_error_m")).first()[0] for n in (0.25, 1.0))
    assert abs(b / a - 4) < 1e-6
    s = reports.sweep(spark, [(20.5, 107.0, 10_000.0)], [0.0], [0.0, 1000.0], subsets=False).collect()
    assert {r.offset_m: r.error_m < 1e-3 for r in s} == {0.0: True, 1000.0: False}
