"""Spectral operators against single-array NumPy, and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import artifacts as R
from tracewell.operators import connectivity as K
from tracewell.operators import spectral as G
from tracewell.operators import tensors as X

RATE = 128.0
T = np.arange(1024) / RATE


def signal(spark, **channels):
    rows = [("r", c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["rec", "channel", "sample_idx", "value"]))


def test_block_size_does_not_change_results(spark):
    s = signal(spark, a=np.random.default_rng(1).normal(size=1024))
    taps = G.sinc_taps(RATE, 5, 30, 6)
    a, b = (G.fir_filter(s, ["rec", "channel"], taps, n).orderBy("sample_idx").toPandas().value.to_numpy() for n in (100, 5000))
    assert np.allclose(a, b)
    m, n = (G.morlet(s, ["rec", "channel"], RATE, [8.0, 20.0], [3.0, 5.0], size=k).orderBy("f_pos", "sample_idx").toPandas().power.to_numpy() for k in (200, 5000))
    assert np.allclose(m, n)


def gappy(spark):
    """(signal, values with NaN where missing): NULL samples, and a stretch of absent indexes."""
    x = np.random.default_rng(7).normal(size=700) + 3
    x[[50, 51, 300]] = np.nan
    x[400:430] = np.nan
    rows = [("r", "a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x) if not 400 <= i < 430]
    return spark.createDataFrame(rows, "rec string, channel string, sample_idx long, value double"), x


def direct(x, w):
    """Convolution in the time domain, missing samples adding nothing."""
    y = np.convolve(np.nan_to_num(x), w)[len(w) // 2 : len(w) // 2 + len(x)].astype(complex)
    y[np.isnan(x)] = np.nan
    return y


@pytest.mark.parametrize("size", [100, 5000])
def test_missing_samples_and_gaps(spark, size):
    s, x = gappy(spark)
    there = np.r_[0:400, 430:700]
    key = ["rec", "channel"]
    taps = G.sinc_taps(RATE, 5, 30, 6)
    want = np.full(len(x), np.nan)
    ok = ~np.isnan(x)
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(ok)) + 1):
        if ok[part[0]]:
            want[part] = np.convolve(np.pad(x[part], len(taps) // 2, "edge"), taps, "valid")
    got = G.fir_filter(s, key, taps, size).orderBy("sample_idx").toPandas()
    assert got.sample_idx.tolist() == there.tolist() and np.allclose(got.value, want[there], equal_nan=True)
    m = G.morlet(s, key, RATE, [8.0, 20.0], [3.0, 5.0], size=size).orderBy("f_pos", "sample_idx").toPandas()
    want = np.concatenate([direct(x, G.morlet_kernel(f, c, RATE))[there] for f, c in ((8.0, 3.0), (20.0, 5.0))])
    assert np.allclose(m.re, want.real, equal_nan=True) and np.allclose(m.im, want.imag, equal_nan=True)
    assert np.allclose(m.power, np.abs(want) ** 2, equal_nan=True)
    n = max(3, int(round(6 / 16 * RATE)) | 1)
    t = (np.arange(n) - n // 2) / RATE
    want = np.mean([np.abs(direct(x, h * np.exp(32j * np.pi * t))) ** 2 for h in G.dpss(n, 2.0, 3)], axis=0)[there]
    p = G.multitaper(s, key, RATE, [16.0], [6.0], size=size).orderBy("sample_idx").toPandas()
    assert np.allclose(p.power, want, equal_nan=True)
    t = np.arange(-64, 65) / RATE
    band = 2 * 4 / RATE * np.sinc(4 * t) * np.hamming(129) * np.exp(20j * np.pi * t)
    e = G.envelope(s, key, RATE, [("alpha", 8, 12)], size, 0.5).orderBy("sample_idx").toPandas()
    assert np.allclose(e.value, np.abs(direct(x, band))[there], equal_nan=True)


def test_bursts_of_any_block_size(spark):
    s, _ = gappy(spark)
    masks = []
    for size in (128, 5000):
        env = G.envelope(s, ["rec", "channel"], RATE, [("alpha", 8, 12), ("alpha", 14, 16)], size)
        m = G.burst_mask(env, G.thresholds(env, ["rec", "channel", "band"], 75), ["rec", "channel", "band"], {"alpha": 10.0}, RATE, 1)
        masks.append([r.burst for r in m.orderBy("sample_idx").collect()])
    assert masks[0] == masks[1] and any(masks[0])


def test_grid_match_is_one_to_one(spark):
    grid = lambda *f: spark.createDataFrame([(x,) for x in f], "freq double")
    got = X.match_grid(grid(1.0, 2.0, 2.0, 3.04), grid(0.96, 1.05, 2.0, 3.0, 9.0), 0.1).collect()
    assert sorted((r.target, r.source) for r in got) == [(0.96, 1.0), (2.0, 2.0), (3.0, 3.04)]
    assert sorted(r.freq for r in X.grid_difference(grid(0.96, 1.05, 9.0), grid(1.0), 0.1).collect()) == [1.05, 9.0]


def test_sine_peaks_at_its_frequency(spark):
    s = signal(spark, a=np.sin(2 * np.pi * 16 * T))
    w = G.welch(s, ["rec", "channel"], RATE, 128).toPandas()
    assert w.loc[w.psd.idxmax(), "freq"] == 16
    p = G.morlet(s, ["rec", "channel"], RATE, [8.0, 16.0, 32.0], [4.0] * 3).groupBy("freq").agg(F.avg("power").alias("p")).toPandas()
    assert p.loc[p.p.idxmax(), "freq"] == 16
    q = G.multitaper(s, ["rec", "channel"], RATE, [8.0, 16.0, 32.0], [6.0] * 3).groupBy("freq").agg(F.avg("power").alias("p")).toPandas()
    assert q.loc[q.p.idxmax(), "freq"] == 16


def test_welch_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=1024)
    got = G.welch(signal(spark, a=x), ["rec", "channel"], RATE, 256).orderBy("freq").toPandas().psd.to_numpy()
    win = np.hanning(257)[:-1]
    segs = [x[i : i + 256] for i in range(0, 1024 - 255, 128)]
    want = np.mean([np.abs(np.fft.rfft((g - g.mean()) * win)) ** 2 for g in segs], axis=0) / (RATE * (win**2).sum())
    want[1:-1] *= 2
    assert np.allclose(got, want)


def test_filter_stops_what_it_should(spark):
    s = signal(spark, a=np.sin(2 * np.pi * 10 * T) + np.sin(2 * np.pi * 50 * T))
    y = G.fir_filter(s, ["rec", "channel"], G.sinc_taps(RATE, 4, 30, 4)).orderBy("sample_idx").toPandas().value.to_numpy()
    assert np.abs(y[200:800] - np.sin(2 * np.pi * 10 * T)[200:800]).max() < 0.05


def pairs(spark, *ps):
    return spark.createDataFrame(list(ps), "a string, b string")


def test_pair_identities(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1024)
    s = signal(spark, a=x, b=x, c=np.roll(x, 3), d=rng.normal(size=1024))
    coef = G.morlet(s, ["rec", "channel"], RATE, [10.0, 14.0, 18.0], [4.0] * 3)
    prod = K.pair_products(coef, pairs(spark, ("a", "b"), ("a", "c"), ("c", "a"), ("a", "d")), ["rec"])
    got = {(r.a, r.b, r.freq): r for r in K.pair_measures(prod, ["rec"]).collect()}
    copy = got[("a", "b", 14.0)]
    assert copy.plv == pytest.approx(1) and copy.coh == pytest.approx(1) and copy.wpli is None and copy.pli == 0
    assert got[("a", "c", 14.0)].plv > 0.8 > got[("a", "d", 14.0)].plv
    bands = spark.createDataFrame([("x", 10.0, 18.0)], "band string, start double, end double")
    psi = {(r.a, r.b): r.psi for r in K.phase_slope(prod, ["rec"], bands).collect()}
    assert psi[("a", "c")] == pytest.approx(-psi[("c", "a")]) and abs(psi[("a", "c")]) > 0.1
    win = K.windowed_measures(prod, ["rec"], {0: 20, 1: 20, 2: 10}, ("plv",)).where("a = 'a' and b = 'b' and freq = 10").orderBy("sample_idx").toPandas()
    assert win.plv[:20].isna().all() and win.plv[20:-20].notna().all()


def test_granger_direction(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1024)
    y = 0.8 * np.roll(x, 2) + 0.3 * rng.normal(size=1024)
    got = {(r.a, r.b): r.value for r in K.granger(signal(spark, x=x, y=y), pairs(spark, ("x", "y"), ("y", "x")), ["rec"], 4).collect()}
    assert got[("x", "y")] > 1 > 0.1 > got[("y", "x")]


def test_burst_runs(spark):
    x = np.where((T > 2) & (T < 4), 5, 0.2) * np.sin(2 * np.pi * 10 * T)
    env = G.envelope(signal(spark, a=x), ["rec", "channel"], RATE, [("alpha", 8, 12)])
    m = G.burst_mask(env, G.thresholds(env, ["rec", "channel", "band"], 75), ["rec", "channel", "band"], {"alpha": 10.0}, RATE, 3).orderBy("sample_idx").toPandas()
    on = m.burst.to_numpy()
    assert on[300:480].mean() > 0.9 and not on[:200].any() and not on[600:].any()


def test_aperiodic_exponent(spark):
    df = spark.createDataFrame([(1, f, 100 * f**-1.5 * (3 if f == 10 else 1)) for f in map(float, range(2, 40))], "k int, freq double, power double")
    r = G.aperiodic_fit(df, ["k"]).first()
    assert r.exponent == pytest.approx(1.5, abs=1e-6) and r.offset == pytest.approx(2, abs=1e-6)
    peak = G.periodic_part(df, G.aperiodic_fit(df, ["k"]), ["k"]).where("is_peak and periodic > 0.1").collect()
    assert [p.freq for p in peak] == [10.0]


def test_beats_are_removed(spark):
    rng = np.random.default_rng(5)
    x = 0.1 * rng.normal(size=1024)
    beat = 5 * np.exp(-0.5 * (np.arange(-10, 11) / 3) ** 2)
    at = list(range(60, 960, 80))
    for c in at:
        x[c - 10 : c + 11] += beat
    s = signal(spark, a=x)
    found = R.choose_polarity(s, ["rec", "channel"], 2.0, 40).orderBy("sample_idx").collect()
    assert len(found) == len(at) and all(abs(r.sample_idx - c) <= 3 for r, c in zip(found, at))
    b = spark.createDataFrame([("r", "a", c) for c in at], "rec string, channel string, sample_idx long")
    t = R.beat_template(s, b, ["rec", "channel"], 15, 15)
    for out in (R.subtract_template(s, b, t, ["rec", "channel"]), R.remove_beats(s, b, ["rec", "channel"], "svd", 15, 15)):
        assert out.agg(F.max(F.abs("value"))).first()[0] < 1.2
    assert R.crop_template(t, ["rec", "channel"], 3).count() >= 25


def test_interpolation_and_smoothing(spark):
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate([None, 10.0, None, 1000.0, None])], "k int, f_pos int, f_coord double, value double")
    assert [r.value for r in X.interpolate(df, ["k"]).orderBy("f_pos").collect()] == [10.0, 10.0, 505.0, 1000.0, 1000.0]
    assert X.interpolate_in(df, ["k"]).orderBy("f_pos").collect()[2].value == pytest.approx(100.0)
    assert X.interpolate(df.where("f_pos < 3"), ["k"]).where("value is not null").count() == 1
    filled = X.savgol_fill(df.withColumn("value", F.when(F.col("f_pos") != 2, F.col("f_coord") ** 2)), ["k"], 4, 2).where("f_pos = 2").first()
    assert filled.filled == pytest.approx(4.0)
    sm = X.smooth_gaussian(df.withColumn("t_pos", F.col("f_pos")), ["k"], 1.0).where("t_pos = 2").first().smooth
    assert 10 < sm < 1000
    padded = X.with_edges(df.withColumnRenamed("f_pos", "t_pos"), ["k"], 2, "reflect").orderBy("t_pos").collect()
    assert [r.t_pos for r in padded] == list(range(-2, 7)) and padded[0].value == 10.0


def test_slepian_tapers_are_orthonormal():
    v = G.dpss(64, 2.0, 3)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-8)


def test_grids(spark):
    assert [r.freq for r in X.frequency_grid(spark, 1, 3, 0.5).orderBy("f_pos").collect()] == [1, 1.5, 2, 2.5, 3]
    n = spark.createDataFrame([(50.0, 1.0), (50.0000001, 2.0), (100.0, 1.0)], "center double, width double")
    assert sorted((r.center, r.width) for r in X.merge_notches(n).collect()) == [(50.0, 2.0), (100.0, 1.0)]


def test_neighbours_of_all_channels(spark, tmp_path):
    from tracewell.plans.signal_queries import _neighbours

    rows = [(i, i % 2) for i in range(40)] + [(100, None)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b) for r in _neighbours(spark, str(tmp_path)).collect()}
    assert got == {(str(i), str(i + 2)) for i in range(38)}
