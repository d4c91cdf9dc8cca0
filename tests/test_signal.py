import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import signal, windows_join
from pulsegrid.schema import SIGNALS
from pulsegrid.sources import recordings


def recursive(x, fs):
    """Direct forward-backward recursion over a whole recording, for comparison."""
    pad = min(signal.EDGE_PAD, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-2 - pad:-1]])
    for _ in range(2):
        level = y[0]
        for b0, b1, b2, _one, a1, a2 in signal.bandpass_sections(fs):
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z1, z2, out = (gain - b0) * level, (b2 - a2 * gain) * level, np.empty_like(y)
            for i, v in enumerate(y):
                out[i] = b0 * v + z1
                z1 = b1 * v - a1 * out[i] + z2
                z2 = b2 * v - a2 * out[i]
            y, level = out, gain * level
        y = y[::-1]
    return y[pad:pad + len(x)]


def chunked(spark, record, x, chunk, fs, lead=0, name="II"):
    rows = [(record, lead, name, fs, i // chunk, i, [float(v) for v in x[i:i + chunk]]) for i in range(0, len(x), chunk)]
    return spark.createDataFrame(rows, SIGNALS)


@pytest.mark.parametrize("n, chunk", [(9000, 1500), (700, 1500), (6100, 1000), (2000, 64), (100, 7), (29, 1)])
def test_chunked_filter_equals_whole_recording(spark, n, chunk):
    fs, t = 60.0, np.arange(n) / 60.0
    x = np.float32(np.sin(2 * np.pi * 3 * t) + 0.5 * t / t[-1] + 0.2 * np.sin(2 * np.pi * 0.05 * t) + 4.0).astype(float)
    got = signal.bandpass(chunked(spark, "r", x, chunk, fs)).orderBy("chunk").collect()
    y = np.concatenate([r["values"] for r in got])
    assert len(y) == n
    assert np.abs(y - recursive(x, fs)).max() < 1e-10


def test_pass_and_stop_bands(spark):
    fs, t = 360.0, np.arange(20 * 360) / 360.0
    for hz, lo, hi in ((10.0, 0.98, 1.02), (0.1, 0.0, 0.02), (120.0, 0.0, 0.02)):
        y = signal.zero_phase(np.sin(2 * np.pi * hz * t)[None, :], fs)[0][3 * 360:-3 * 360]
        assert lo <= np.abs(y).max() <= hi
    sections = signal.bandpass_sections(fs)
    assert sections.shape == (4, 6) and all(s[5] < 1 for s in sections)


def test_dominant_period(spark):
    t = np.arange(100)
    rows = [(i, [float(v) for v in np.sin(2 * np.pi * 5 * t / 100 + i) + 0.3 * np.cos(2 * np.pi * 20 * t / 100)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, series array<double>")
    got = [(r["freq"], r["period"]) for r in signal.dominant_periods(df, 100, 2).collect()]
    assert got == [(5, 20), (20, 5)]


def test_windows_cross_chunks_and_respect_bounds(spark):
    x, z = np.arange(1000.0), -np.arange(1000.0)
    sig = chunked(spark, "a", x, 64, 100.0).unionByName(chunked(spark, "a", z, 64, 100.0, 1, "V1"))
    sig = sig.unionByName(chunked(spark, "b", x[:300], 64, 100.0))
    ann = spark.createDataFrame(
        [(0, "a", 25), (1, "a", 24), (2, "a", 500), (3, "a", 960), (4, "a", 961), (5, "b", 128), (6, "b", 290)],
        "beat_id long, record string, sample long")
    got = {r["beat_id"]: r for r in windows_join.beat_windows(ann, sig, 64).collect()}
    assert sorted(got) == [0, 2, 3, 5]
    for i, r in got.items():
        lo = r["sample"] - 25
        assert r["b0"] == list(np.arange(lo, lo + 65.0))
        assert r["b1"] == [(-1 if r["record"] == "a" else 1) * v for v in r["b0"]]


def test_window_size_rounds_half_to_even(spark):
    df = spark.createDataFrame([(360.0,), (250.0,), (10.0,), (257.0,)], "fs double")
    got = [tuple(r) for r in df.select(*windows_join.window_size(F.col("fs"))).collect()]
    assert got == [(90, 144), (62, 100), (2, 4), (64, 103)]


def test_zscore_per_record_and_lead(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 3, 500).astype(np.float32).astype(float)
    got = windows_join.record_zscore(chunked(spark, "r", x, 64, 100.0)).orderBy("chunk").collect()
    z = np.concatenate([r["values"] for r in got])
    assert z == pytest.approx((x - x.mean()) / (x.std() + 1e-8), abs=1e-9)


@pytest.mark.parametrize("names, want", [
    (["MLII", "V1"], (0, 1)), (["V5", "II"], (1, 0)), (["v 1", "ml ii"], (1, 0)), (["I"], (0, 0)),
    (["I", "aVR"], (0, 1)), (["aVR", "I"], (1, 0)), (["X", "Y", "Z"], (0, 1)), (["ECG1", "ECG2"], (0, 1)), (["X", "V1", "II"], (2, 1)),
])
def test_lead_choice(spark, names, want):
    df = spark.createDataFrame([("r", i, n) for i, n in enumerate(names)], "record string, pos int, name string")
    r = recordings.choose_leads(df).first()
    assert (r["lead0"], r["lead1"]) == want


def test_resampled_windows_of_one_lead(spark):
    wave = [float(i % 7) for i in range(64)]
    sig = spark.createDataFrame([(1, 32.0, 0, 0, wave, 0), (2, 32.0, 0, 0, wave, 1), (3, 32.0, 0, 0, wave, 0), (3, 32.0, 0, 0, wave[::-1], 1)],
                                "record long, fs double, chunk long, start_idx long, values array<double>, lead int")
    ann = spark.createDataFrame([(1, 10, 30), (2, 20, 30), (3, 30, 30)], "record long, beat_id long, sample long")
    raw = {r["beat_id"]: r for r in windows_join.beat_windows(ann, sig, 64).collect()}
    got = {r["beat_id"]: r for r in windows_join.beat_windows(ann, sig, 64, points=50).collect()}
    assert set(got) == {10, 20, 30} and got[20]["b0"] is None
    for i, r in got.items():
        for b in ("b0", "b1"):
            v = raw[i][b]
            assert (r[b] is None) == (v is None)
            if v is not None:
                assert r[b] == pytest.approx(np.interp(np.linspace(0, len(v) - 1, 50), np.arange(len(v)), v))


def test_windows_are_resampled_after_their_joins(spark):
    sig = spark.createDataFrame([], "record long, fs double, chunk long, start_idx long, values array<double>, lead int")
    ann = spark.createDataFrame([], "record long, beat_id long, sample long")
    plan = windows_join.beat_windows(ann, sig, 64, points=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")


def test_windows_within_a_chunk_are_cut_where_they_meet_it(spark, monkeypatch):
    x, z = np.arange(1000.0), -np.arange(1000.0)
    sig = chunked(spark, "a", x, 100, 100.0).unionByName(chunked(spark, "a", z, 100, 100.0, 1, "V1")).unionByName(chunked(spark, "b", x[:300], 100, 100.0, 1, "V1"))
    rows = [(i, "ab"[i % 2], 26 + 7 * i) for i in range(60)] + [(4, "a", 326), (None, "a", 330), (70, "a", 526), (70, "a", 526), (71, "c", 40), (72, None, 40)]
    ann = spark.createDataFrame(rows, "beat_id long, record string, sample long")
    bounds = windows_join.window_bounds(ann, windows_join.record_lengths(sig)).where("inside")
    pieces = windows_join.pair_leads(windows_join.interval_join(bounds, sig, 100))
    want = sorted(map(str, bounds.join(pieces, "beat_id").collect()))
    asked, whole = [], windows_join.interval_join
    monkeypatch.setattr(windows_join, "interval_join", lambda windows, *a: asked.append(windows) or whole(windows, *a))
    got = windows_join.beat_windows(ann, sig, 100)
    assert sorted(map(str, got.collect())) == want and len(want) > 40
    moved = {(r["beat_id"], r["lo"] // 100 != (r["hi"] - 1) // 100) for r in asked[0].collect()}
    assert {(4, False), (70, False)} <= moved and {k for k, across in moved if not across} == {4, 70}
    assert len(moved) < len({r["beat_id"] for r in got.collect()})


def test_whole_chunks_do_not_reach_the_resampling(spark):
    sig = spark.createDataFrame([], "record long, fs double, chunk long, start_idx long, values array<double>, lead int")
    ann = spark.createDataFrame([], "record long, beat_id long, sample long")
    lines = windows_join.beat_windows(ann, sig, 64, points=50)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("_leads" in line for line in lines if "ArrowEvalPython" in line)
