"""Sliding correlation, its threshold and mirror replacement against plain NumPy."""

import numpy as np
import pytest

from tracewell.operators import beats as B

SHAPE = np.array([0.0, -1.0, 4.0, 9.0, 3.0, -2.0, -0.5])


def heart(rng, n=900, every=60, noise=0.3, base=0.0):
    x = rng.normal(0, noise, n) + base
    at = np.arange(30, n - 10, every) + rng.integers(-4, 5, len(range(30, n - 10, every)))
    for a in at:
        x[a - 3 : a + 4] += SHAPE
    return x, at


def correlations(x, t):
    out = []
    for i in range(len(x) - len(t) + 1):
        w = x[i : i + len(t)]
        out.append(np.nan if np.isnan(w).any() or w.std() < 1e-12 else np.corrcoef(w, t)[0, 1])
    return np.array(out)


@pytest.mark.parametrize("base", [0.0, 1e5])
def test_sliding_correlation(base):
    x, _ = heart(np.random.default_rng(0), 300, base=base)
    x[100:103], x[200:220] = np.nan, 7.0
    got, want = B.sliding_correlation(x, SHAPE), correlations(x, SHAPE)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, atol=1e-5, equal_nan=True)
    assert len(B.sliding_correlation(x[:3], SHAPE)) == 0


def table(spark, traces):
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, sample_idx long, value double")


def shapes(spark, names):
    return spark.createDataFrame([(k, SHAPE.tolist()) for k in names], "k string, template array<double>")


def peaks_by_hand(x, t):
    r = np.nan_to_num(correlations(x, t), nan=-2.0)
    top = [i for i in range(len(r)) if r[i] > (r[i - 1] if i else -2) and r[i] >= (r[i + 1] if i + 1 < len(r) else -2)]
    return {i + int(np.argmax(np.abs(t))): r[i] for i in top}


def threshold_by_hand(peaks, least, most, tries=100):
    low, high = np.percentile(list(peaks.values()), 60), max(peaks.values())
    for j in range(tries):
        at = sorted(p for p, r in peaks.items() if min(tries - 1, np.floor((r - low) / ((high - low) / tries))) >= j)
        far = np.diff(at)
        if ((far >= least) & (far <= most)).sum() > len(far) * 0.95:
            return low + j * (high - low) / tries
    return None


@pytest.mark.parametrize("size", [40, 200, 10_000])
def test_peaks_and_threshold_do_not_depend_on_blocks(spark, size):
    rng = np.random.default_rng(2)
    traces = {"a": heart(rng)[0], None: heart(rng, 500, base=3.0)[0], "noise": rng.normal(size=300)}
    traces["a"][400:404] = np.nan
    signal = table(spark, traces | {"alone": traces["a"]})
    found = B.correlation_peaks(signal, shapes(spark, ["a", None, "noise"]), ["k"], size=size, longest=16)
    got: dict = {}
    for r in found.collect():
        assert r.sample_idx not in got.setdefault(r.k, {})
        got[r.k][r.sample_idx] = r.r
    cuts = {r.k: r.threshold for r in B.adaptive_threshold(found, ["k"], 45, 80, size=size).collect()}
    assert set(got) == set(traces)
    for k, x in traces.items():
        want = peaks_by_hand(x, SHAPE)
        assert set(got[k]) == set(want) and all(got[k][i] == pytest.approx(v, abs=1e-6) for i, v in want.items())
        cut = threshold_by_hand(got[k], 45, 80)
        assert (cut is None) == (k not in cuts) and (cut is None or cuts[k] == pytest.approx(cut))
    assert "a" in cuts and None in cuts and "noise" not in cuts


def test_removal(spark):
    """Beats go, the rest stays; every replaced sample is one of the trace's own; traces without beats or template are left alone."""
    rng = np.random.default_rng(3)
    (x, at), (y, other) = heart(rng), heart(rng, 500)
    noise = rng.normal(size=200)
    signal = table(spark, {"a": x, None: y, "noise": noise, "alone": x})
    got = B.remove_by_correlation(signal, shapes(spark, ["a", None, "noise"]), ["k"], 45, 80, size=128, longest=16)
    out = {k: np.full(n, np.nan) for k, n in (("a", 900), (None, 500), ("noise", 200), ("alone", 900))}
    for r in got.collect():
        out[r.k][r.sample_idx] = r.value
    assert (out["alone"] == x).all() and (out["noise"] == noise).all()
    for k, z, beats in (("a", x, at), (None, y, other)):
        want = z.copy()
        for b in sorted(beats):
            start, end = b - 3, b + 4
            for p in range(start, end):
                want[p] = z[min(max(2 * start - 1 - p if p <= b else 2 * end - 1 - p, 0), len(z) - 1)]
        assert np.allclose(out[k], want)
        assert np.abs(out[k]).max() < 3 < np.abs(z).max()


def test_beats_at_the_ends_and_side_by_side(spark):
    x = np.arange(12.0)
    sides = spark.createDataFrame([("a", 2, 1)], "k string, before int, after int")
    beats = spark.createDataFrame([("a", 1), ("a", 3), ("a", 11)], "k string, sample_idx long")
    got = [r.value for r in B.mirror_replace(table(spark, {"a": x}), beats, ["k"], sides).orderBy("sample_idx").collect()]
    # The beat at 3 takes samples 1 to 4 from 0, the end (twice) and 5; that of 11 takes 9 to 11 from 8, 7 and 6.
    assert got == [0.0, 0.0, 0.0, 0.0, 5.0, 5.0, 6.0, 7.0, 8.0, 8.0, 7.0, 6.0]


def test_empty(spark):
    signal = table(spark, {"a": np.arange(5.0)})
    assert B.remove_by_correlation(signal.limit(0), shapes(spark, ["a"]), ["k"], 1, 2).count() == 0
    assert B.remove_by_correlation(signal, shapes(spark, ["a"]).limit(0), ["k"], 1, 2).count() == 5
