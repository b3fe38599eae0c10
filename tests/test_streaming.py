import pandas as pd

from skylattice.config import Settings, Station
from skylattice.streaming import lifecycle, settle
from skylattice.streaming.links import Link

CLOSE = [Station(f"R{i}", 20.0 + 0.05 * i, 106.0 + 0.03 * i, 0.0, i) for i in range(3)]


def test_link_resets_on_the_third_outlier():
    link = Link()
    for k in range(30):
        link.add(k * 12_000_000, k * 12_000_000 + 50, 0.0)
    for k in range(30, 33):
        link.add(k * 12_000_000, k * 12_000_000 + 50 + 5000, 0.0)
    assert link.resets == 1 and len(link.samples) == 1 and link.rejected == 3
    assert Link(saved=link.saved()).saved() == link.saved()


def test_lifecycle_changes():
    s = Settings()
    fixes = pd.DataFrame({"t": [0.0, 5.0, 10.0], "lat": 20.0, "lon": 107.0, "weighted_rms": 0.5, "clock_quality": "PASS"})
    saved, log = lifecycle.advance("1200", {}, fixes, 10.0, s, True)
    assert [x[2] for x in log] == ["track_created", "track_updated", "track_updated", "track_state_changed"]
    saved, log = lifecycle.advance("1200", saved, fixes.iloc[:0], 45.0, s, True)
    assert [x[2] for x in log] == ["track_stale"]
    saved, log = lifecycle.advance("1200", saved, fixes.iloc[:0], 131.0, s, True)
    assert [x[2] for x in log] == ["track_removed"] and not saved["tracks"]


def test_settled_stream_gives_the_batch_clusters(spark, tmp_path):
    from skylattice.operators import association

    schema = "id string, station string, norm double, utc_ns long, raw_hex string, df int, icao string, family string"
    base = 1_700_000_000_000_000_000
    rows = []
    for k in range(12):
        t = base + k * 10_000_000_000
        for i in range(3 if k % 3 else 2):
            rows.append((f"{k}:{i}", f"R{i}", (t - base) * 0.012 + 12.0 * i, t + 1000 * i, f"key{k % 4}", 17, None, "modes"))
    rows.append(("end", "R0", 1e13, base + 10**12, "last", 17, None, "modes"))
    df = spark.createDataFrame(rows, schema)
    for n in range(0, len(rows), 9):
        df.where(df.id.isin([r[0] for r in rows[n : n + 9]])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = settle.settle_associate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), CLOSE)
    q = live.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {tuple(sorted(r.ids)) for r in spark.table("settled").where("verdict = 'cluster'").collect()}
    want = {tuple(sorted(m.id for m in r.obs)) for r in association.clusters(association.associate(df, CLOSE)).collect()}
    assert want and got <= want and len(got) >= len(want) - 1


def test_drained_rows_are_files_not_the_drivers(spark, tmp_path):
    from pyspark.sql import functions as F

    from skylattice.plans import live

    for k in (0, 1):
        spark.range(5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    read = lambda at: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / at))
    rows = live.drained(read("in"), "append")
    assert rows.inputFiles() and sorted(r.id for r in rows.collect()) == list(range(10))
    sums = live.drained(read("in").groupBy((F.col("id") % 2).alias("odd")).agg(F.count("*").alias("n")), "complete")
    assert sums.inputFiles() and sorted(map(tuple, sums.collect())) == [(0, 5), (1, 5)]
    assert live.drained(read("none"), "append").collect() == []


def test_changes_come_in_pieces(monkeypatch):
    monkeypatch.setattr(lifecycle, "PIECE", 7)
    fixes = pd.DataFrame({"t": [float(k) for k in range(100)], "lat": 20.0, "lon": 107.0, "weighted_rms": 0.5, "clock_quality": "PASS"})
    parts = list(lifecycle.advancing("1200", {}, fixes, 0.0, Settings(), True))
    assert len(parts) > 10 and max(len(log) for _, log in parts) <= 8 and [s is None for s, _ in parts] == [True] * (len(parts) - 1) + [False]
    assert lifecycle.advance("1200", {}, fixes, 0.0, Settings(), True) == (parts[-1][0], [x for _, log in parts for x in log])
    odd = fixes.iloc[:3].assign(clock_quality=None)
    both = lifecycle.together(iter([odd, fixes.iloc[3:]]))
    assert len(both) == 100 and list(both.clock_quality[3:5]) == ["PASS", "PASS"] and both.clock_quality[:3].isna().all()


def test_stale_is_the_last_word_of_its_fix(spark):
    rows = [("a", "track_stale", "STALE", None), ("a", "track_updated", "CONFIRMED", "HIGH"), ("a", "track_state_changed", "CONFIRMED", "HIGH"), ("b", "track_removed", "EXPIRED", None), ("b", "track_updated", "TENTATIVE", "LOW")]
    log = spark.createDataFrame([(i, i, c, 5.0, 20.0, 107.0, 3, s, q, None, None) for i, c, s, q in reversed(rows)] + [(i, i, c, 5.0, 20.0, 107.0, 3, s, q, None, None) for i, c, s, q in [("c", "track_updated", "TENTATIVE", "LOW"), ("c", "track_stale", "STALE", None)]], lifecycle.OUT)
    got = lifecycle.snapshot(log)
    assert got.columns == log.columns and sorted((r.track_id, r.state) for r in got.collect()) == [("a", "STALE"), ("c", "STALE")]
