"""Smoothing with edge modes against NumPy, long traces in blocks, and the cost of the moving median."""

import numpy as np
import pytest

from tracewell.operators import artifacts as R
from tracewell.operators import smoothing as X
from tracewell.operators import stages as P

PAD = {"nearest": "edge", "reflect": "symmetric", "mirror": "reflect", "wrap": "wrap"}


def padded(x, half, mode, cval):
    if mode == "constant":
        return np.pad(x, half, constant_values=cval)
    return np.pad(x, half, mode=PAD[mode])


def by_hand(x, half, mode, cval, kind, sigma=1.3):
    """Frame by frame; NaN is left out. A constant edge counts in a mean with its value for weight, as a signal of ones would."""
    y = padded(x, half, mode, cval) if mode else np.pad(x, half, constant_values=np.nan)
    w = np.ones(len(y)) if mode != "constant" else np.pad(np.ones(len(x)), half, constant_values=cval)
    g = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2) if kind == "gaussian" else np.ones(2 * half + 1)
    out = []
    for i in range(len(x)):
        f, v = y[i : i + 2 * half + 1], w[i : i + 2 * half + 1]
        ok = ~np.isnan(f)
        if kind == "median":
            out.append(np.median(f[ok]) if ok.any() else np.nan)
        else:
            share = (g * v)[ok].sum()
            out.append((g * f)[ok].sum() / share if share > 0 else np.nan)
    return np.array(out)


def traces(spark, rng, lengths):
    data, arrays = [], {}
    for k, n in lengths.items():
        x = rng.normal(size=n)
        x[rng.random(n) < 0.15] = np.nan
        arrays[k] = x
        data += [(k, i, None if np.isnan(v) else float(v), f"{k}{i}") for i, v in enumerate(x)]
    return spark.createDataFrame(data, "k string, t_pos int, value double, note string"), arrays


LENGTHS = {"long": 70, None: 23, "short": 3, "one": 1}


@pytest.mark.parametrize("mode", [*X.MODES, None])
def test_every_edge_mode(spark, mode):
    """Traces shorter than the frame are folded as often as it takes; the trace of a NULL key is a trace; blocks change nothing."""
    df, arrays = traces(spark, np.random.default_rng(4), LENGTHS)
    for kind, half in (("mean", 4), ("median", 4), ("gaussian", int(4 * 1.3 + 0.5))):
        for block in (5, None):
            if kind == "mean":
                got = X.smooth_mean(df, ["k"], half, mode=mode, cval=0.7, block=block)
            elif kind == "median":
                got = X.smooth_median(df, ["k"], 2 * half, mode=mode, cval=0.7, block=block or 1000)
            else:
                got = X.smooth_gaussian(df, ["k"], 1.3, mode=mode, cval=0.7, block=block)
            assert got.columns == ["k", "t_pos", "value", "note", "smooth"]
            rows = {(r.k, r.t_pos): (r.smooth, r.note) for r in got.collect()}
            assert len(rows) == sum(LENGTHS.values())
            for k, x in arrays.items():
                want = by_hand(x, half, mode, 0.7, kind)
                for i, v in enumerate(want):
                    s, note = rows[(k, i)]
                    assert note == f"{k}{i}" and (s is None) == bool(np.isnan(v)) and (s is None or s == pytest.approx(v, abs=1e-9))


def test_unknown_modes_are_refused(spark):
    df, _ = traces(spark, np.random.default_rng(0), {"a": 4})
    with pytest.raises(ValueError):
        X.smooth_mean(df, ["k"], 1, mode="cyclic")
    with pytest.raises(ValueError):
        X.smooth_gaussian(df, ["k"], 0.0)


class Counted(float):
    """A number that counts how often it is compared."""

    seen = 0

    def __lt__(self, other):
        Counted.seen += 1
        return float.__lt__(self, other)


@pytest.mark.parametrize("half", [4, 64, 1024])
def test_moving_median_compares_few_numbers(half):
    """A sample enters and leaves the frame by bisection: comparisons per sample grow with the logarithm of the frame."""
    x = np.random.default_rng(half).normal(size=6000)
    x[::17] = np.nan
    Counted.seen = 0
    got = X.sliding_median([Counted(v) for v in x], half)
    assert Counted.seen <= len(x) * 2 * (np.log2(2 * half + 1) + 2)
    for i in (0, 1, half, 3000, 5999):
        assert got[i] == np.nanmedian(x[max(0, i - half) : i + half + 1])


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_slow_baseline_in_blocks(spark, block):
    x = np.random.default_rng(9).normal(size=200)
    df = spark.createDataFrame([(k, i, float(v)) for k in ("r", None) for i, v in enumerate(x)], "k string, sample_idx int, value double")
    got = R.slow_baseline(df, ["k"], 12, block=block).toPandas().sort_values("sample_idx")
    want = np.array([np.median(x[max(0, i - 12) : i + 13]) for i in range(200)])
    for k in ("r", None):
        own = got[got.k == k] if k else got[got.k.isna()]
        assert np.allclose(own.baseline, want) and np.allclose(own.residual, x - want)


def test_decompose_at_its_defaults_against_numpy(spark):
    """Two records, one of a NULL name: nearest edges, sigma 1.5 in dB, then a log-log line refitted below the 75th percentile of its residuals."""
    freqs = np.arange(2.0, 31.0)
    rng = np.random.default_rng(1)
    power = {(rec, t): 40 * freqs**-2.0 * np.exp(rng.normal(0, 0.2, len(freqs))) for rec in ("r", None) for t in (0, 4)}
    df = spark.createDataFrame([(rec, t, float(f), float(v)) for (rec, t), p in power.items() for f, v in zip(freqs, p)], "rec string, sample_idx long, freq double, value double")
    periodic, fits = P.decompose(df, ["rec"], hop=4)
    found = {(r.rec, r.sample_idx): r for r in fits.collect()}
    lines = {(r.rec, r.sample_idx, r.freq): r.value for r in periodic.collect()}
    assert len(found) == 4 and len(lines) == 4 * len(freqs)
    for key, p in power.items():
        smooth = by_hand(10 * np.log10(p), 6, "nearest", 0, "gaussian", 1.5) / 10
        x = np.log10(freqs)
        slope, level = np.polyfit(x, smooth, 1)
        left = smooth - level - slope * x
        own = left <= np.percentile(left, 75)
        slope, level = np.polyfit(x[own], smooth[own], 1)
        assert found[key].exponent == pytest.approx(-slope) and found[key].offset == pytest.approx(level)
        for f, v in zip(freqs, smooth - level - slope * x):
            assert lines[(*key, f)] == pytest.approx(v, abs=1e-9)
    flat = spark.createDataFrame([("r", 0, float(f), float(50 * f**-2)) for f in freqs], "rec string, sample_idx long, freq double, value double")
    assert P.decompose(flat, ["rec"])[1].first().exponent == pytest.approx(1.87, abs=0.01)


def test_many_short_traces_go_through_one_call(spark):
    """A pandas call for each trace cost more than its median: 24,000 traces of 8 samples took minutes."""
    df = spark.range(60).selectExpr("id % 20 as k", "cast(id div 20 as int) as t_pos", "cast(id as double) as value", "cast(id as string) as name")
    out = X.smooth_median(df, ["k"], 3)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.k, r.t_pos): (r.smooth, r.name) for r in out.collect()} == {(k, t): (k + 20.0 * min(max(t, 0), 2), str(k + 20 * t)) for k in range(20) for t in range(3)}
