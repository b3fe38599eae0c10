import json

import pytest

from skylattice.sources import beast, captures, outlines, sinks


def frame(kind: int, tick: int, signal: int, payload: bytes) -> bytes:
    body = tick.to_bytes(6, "big") + bytes([signal]) + payload
    return bytes([0x1A, 0x30 + kind]) + body.replace(b"\x1a", b"\x1a\x1a")


FRAMES = [frame(1, 1000, 9, b"\x12\x34"), frame(2, 0x1A1A, 26, bytes(range(7))), frame(3, 5, 255, b"\x1a" * 14), frame(1, 0, 1, b"\x77\x77")]


@pytest.mark.parametrize("step", [1, 5, 11, 1000])
def test_parser_by_chunks(step):
    data, p = b"\x00garbage" + b"".join(FRAMES), beast.Parser()
    got = [f for k in range(0, len(data), step) for f in p.feed(data[k : k + step])]
    assert [g[0] for g in got] == [1, 2, 3, 1] and got[2][1][7:] == b"\x1a" * 14 and p.errors > 0


def test_parser_resumes_after_a_cut_frame():
    p = beast.Parser()
    got = list(p.feed(FRAMES[0][:5] + FRAMES[1] + b"\x1a\x39" + FRAMES[3]))
    assert [g[0] for g in got] == [2, 1] and p.errors >= 2


def test_decode_and_missing_tick():
    p = beast.Parser()
    rows = [beast.decode("N", k, b, 7, 8) for k, b in p.feed(FRAMES[0] + FRAMES[3])]
    assert rows[0] == ("N", 7, 8, 1, "modeac", 1000, 756, 9, "1234") and rows[1][6] == 0


def test_file_source_and_captures(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"".join(FRAMES))
    spark.dataSource.register(beast.BeastSource)
    df = spark.read.format("beast").option("path", str(tmp_path / "*.bin")).option("station", "N").load()
    assert df.count() == 4 and captures.clean(df).count() == 3
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert captures.read_captures(spark, str(tmp_path / "csv")).count() == 3
    assert captures.mode_ac(captures.clean(df)).first().code == "1234"
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "csv"))


def doc(points):
    return json.dumps({"actualRange": {"last24h": {"points": points}}}).encode()


def test_outlines(tmp_path):
    good = doc([[0, 0, 1], [0, 2, 1], [0, 2, 1], [2, 2, 1], [2, 0, 1], [0, 0, 1]])
    assert len(outlines.parse(good)) == 4
    bad = [b"x", b"{}", doc([[0, 0], [1, 1]]), doc([[0, "a"], [1, 1], [2, 2]]), doc([[95, 0], [1, 1], [2, 2]]), doc([[0, 0], [1, 1], [0, 1], [1, 0]]), doc([[0, 179], [1, -179], [2, 179]]), b" " * (outlines.MAX_BYTES + 1)]
    for raw in bad:
        with pytest.raises(ValueError):
            outlines.parse(raw)
    store = outlines.Store(str(tmp_path))
    key = store.create(good, "a.json")
    assert store.list() == [key] and len(store.get(key)["points"]) == 4
    store.delete(key)
    with pytest.raises(ValueError):
        store.get("../etc")


def test_freeze(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    f = sinks.Freeze()
    f.add("a", a)
    f.verify("a", a.orderBy("k", ascending=False).repartition(3))
    with pytest.raises(ValueError):
        f.verify("a", a.where("k = 1"))
    with pytest.raises(ValueError):
        f.add("b", a.withColumnRenamed("v", "error_m"))
