import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, ids, modes, stats


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def syndrome(payload: bytes) -> int:
    """Bit by bit, by definition."""
    reg = 0
    for byte in payload[:-3]:
        for k in range(8):
            top = (reg >> 23 & 1) ^ (byte >> (7 - k) & 1)
            reg = (reg << 1 & 0xFFFFFF) ^ (0xFFF409 if top else 0)
    return reg ^ int.from_bytes(payload[-3:], "big")


def test_parity_matches_definition(spark):
    rng = np.random.default_rng(3)
    payloads = [bytes(rng.integers(0, 256, n, dtype=np.uint8).tolist()) for n in (7, 14) for _ in range(40)]
    df = spark.createDataFrame([(p.hex(),) for p in payloads], "h string").select("h", modes.crc24(F.col("h")).alias("c"))
    assert {r.h: r.c for r in df.collect()} == {p.hex(): syndrome(p) for p in payloads}


def test_known_frames(spark):
    r = one(spark, m=modes.decode(F.lit("28000a2435fa3f")), d=modes.decode(F.lit("5dabcdef000000")), x=modes.decode(F.lit("00")))
    assert (r.m.icao, r.m.squawk, r.m.df) == ("780c77", "3102", 5)
    assert (r.d.icao, r.d.icao_source) == ("abcdef", "DIRECT")
    assert r.x is None


def test_airborne_position_pair(spark):
    even, odd = modes.decode(F.lit("8d40621d58c382d690c8ac2863a7")), modes.decode(F.lit("8d40621d58c386435cc412692ad6"))
    r = one(spark, e=even, o=odd, p=modes.global_position(even["cpr_lat"], even["cpr_lon"], odd["cpr_lat"], odd["cpr_lon"], F.lit(False)))
    assert (r.e.altitude_ft, r.e.cpr_odd, r.o.cpr_odd) == (38000, False, True)
    assert r.p.lat == pytest.approx(52.25720, abs=1e-5) and r.p.lon == pytest.approx(3.91937, abs=1e-5)


def test_altitude_code_table_by_column_and_by_hand(spark):
    got = {r.raw: r.hundreds_ft for r in modes.gillham_table(spark).collect()}
    assert got == {raw: modes.gillham_value(raw) for raw in range(65536)}
    values = sorted(v for v in got.values() if v is not None)
    assert values[0] == -12 and len(values) == len(set(values)) == 1280


def test_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert stats.nearest_rank(df, [], "v", 0.5).first().nearest_rank == 2.0
    inf = float("inf")
    r = one(spark, a=stats.percentile_with_inf(F.array(F.lit(1.0), F.lit(2.0), F.lit(inf)), 0.5), b=stats.percentile_with_inf(F.array(F.lit(1.0), F.lit(2.0), F.lit(inf)), 0.9))
    assert (r.a, r.b) == (2.0, inf)


def test_rebased_fit_keeps_digits(spark):
    rows = [((1 << 47) + 1_000_003 * k, (1 << 46) + 1_000_005 * k) for k in range(500)]
    f = stats.ols(spark.createDataFrame(rows, "x long, y long"), [], "x", "y").first()
    assert abs(f.slope * (rows[-1][0] - f.origin_x) + f.offset - (rows[-1][1] - f.origin_y)) < 1e-3


def test_geodesy(spark):
    p = geo.geodetic_to_ecef(F.lit(20.5), F.lit(107.0), F.lit(10_000.0))
    r = one(spark, p=p, g=geo.ecef_to_geodetic(p), h=geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), b=geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), t=geo.angle_difference(F.lit(350.0), F.lit(10.0)), c=geo.cap_area_km2(F.lit(350.0)))
    assert r.g.lat == pytest.approx(20.5, abs=1e-10) and r.g.alt == pytest.approx(10_000, abs=1e-5)
    assert r.h == pytest.approx(6371.0088 * math.radians(1)) and r.b == 0 and r.t == 20
    assert 384_000 < r.c < 386_000


def test_cluster_id(spark):
    import hashlib

    r = one(spark, i=ids.cluster_id(F.lit("aa"), F.array(F.lit("N:1"), F.lit("W:2"))))
    assert r.i == "NRX-" + hashlib.sha256(b"aa|N:1|W:2").hexdigest()[:20]


def test_formats(spark):
    r = one(spark, n=ids.number_vi(F.lit(1234.56)), e=ids.number_vi(F.lit(None).cast("double")), t=ids.iso_utc(F.lit(1_704_164_645_123_456_789)), m=ids.map_to_pairs(ids.pairs_to_map(F.lit("a__b:1.5;a__c:2"))))
    assert (r.n, r.e, r.t, r.m) == ("1234,6", "—", "2024-01-02T03:04:05.123456Z", "a__b:1.5;a__c:2.0")


def test_bundle_counts_values_and_gathers_no_key(spark):
    rows = [(k, float(v % 97) if v % 5 else None) for v in range(400) for k in ("a", None)] + [("b", None), ("c", float("nan")), ("c", 1.0), ("d", -0.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    names = stats.BUNDLE | {"p01": 0.01, "p05": 0.05}
    got = stats.bundle(df, ["k"], "v", True)
    want = df.groupBy("k").agg(F.count("v").alias("count"), *[F.percentile("v", p).alias(n) for n, p in names.items()], F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("mean"))
    cell = lambda x: round(x, 9) if isinstance(x, float) else x
    plain = lambda d: sorted((tuple((c, str(cell(r[c]))) for c in sorted(want.columns)) for r in d.collect()), key=str)
    assert got.columns == ["k", "count", *stats.BUNDLE, "max", "min", "p01", "p05", "mean"] and plain(got) == plain(want)
    assert "percentile(" not in got._jdf.queryExecution().toString()
    assert stats.bundle(df.where("v < -9"), [], "v").collect() == [(0, *[None] * 6)]
