"""Values of the lag model, of windowed measures, of local regression and of the bases of the interval search against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.operators import cohort, connectivity, packets, spectral, statistics


def series(rng, n=160):
    a, b = rng.normal(size=n), np.zeros(n)
    for i in range(2, n):
        b[i] = 0.5 * b[i - 1] + 0.8 * a[i - 2] + 0.3 * rng.normal()
    return a, b


def lag_score(a, b, lags):
    """log of the residual variance of b given its past, over that given both pasts; a and b by index, NaN for what is missing. A sample counts if it and its lags are there in both."""
    rows = [[1.0, *(b[i - k] for k in range(1, lags + 1)), *(a[i - k] for k in range(1, lags + 1)), b[i]] for i in range(lags, len(b)) if not np.isnan(a[i - lags : i + 1]).any() and not np.isnan(b[i - lags : i + 1]).any()]
    m = np.array(rows)
    left = lambda x: float(np.sum((m[:, -1] - x @ np.linalg.lstsq(x, m[:, -1], rcond=None)[0]) ** 2))
    return np.log(left(m[:, : lags + 1]) / left(m[:, :-1]))


@pytest.mark.parametrize("reverse", [False, True])
def test_lag_model_with_missing_samples(spark, reverse):
    """NULL samples, absent ones, and a record of a NULL name: lags are steps of the index, never neighbours across a gap."""
    rng, data = np.random.default_rng(4), {}
    for rec in ("r", None):
        data[rec] = dict(zip("ab", series(rng)))
    data["r"]["a"][50] = data["r"]["b"][90:93] = np.nan
    absent = {("r", "b", 120), ("r", "b", 121)}
    rows = [(rec, c, i, None if np.isnan(v) else float(v)) for rec, own in data.items() for c, x in own.items() for i, v in enumerate(x) if (rec, c, i) not in absent]
    df = spark.createDataFrame(rows, "rec string, channel string, sample_idx long, value double")
    for rec, c, i in absent:
        data[rec][c][i] = np.nan
    got = {(r.rec, r.a, r.b): r.value for r in connectivity.granger(df, spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"), ["rec"], 3, reverse).collect()}
    assert len(got) == 4
    for rec, own in data.items():
        a, b = (own[c][::-1] if reverse else own[c] for c in "ab")
        assert got[(rec, "a", "b")] == pytest.approx(lag_score(a, b, 3), rel=1e-6) and got[(rec, "b", "a")] == pytest.approx(lag_score(b, a, 3), rel=1e-5, abs=1e-8)
        if not reverse:
            assert got[(rec, "a", "b")] > 10 * abs(got[(rec, "b", "a")])


def test_windows_count_samples_of_the_index(spark):
    """A window that lacks a sample, absent or NULL, has no measure; the others equal their definition."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=30) + 1j * rng.normal(size=30)
    pa, pb = rng.random(30) + 1, rng.random(30) + 1
    rows = [(None, "a", "b", 0, 8.0, 2 * i, float(c.real) if i != 20 else None, float(c.imag) if i != 20 else None, float(pa[i]), float(pb[i])) for i, c in enumerate(z) if i != 9]
    df = spark.createDataFrame(rows, "rec string, a string, b string, f_pos int, freq double, sample_idx long, re double, im double, pa double, pb double")
    got = {r.sample_idx // 2: r for r in connectivity.windowed_measures(df, ["rec"], {0: 3}, ("coh", "plv"), hop=2).collect()}
    for i in set(range(30)) - {9}:
        own = np.arange(i - 3, i + 4)
        if own[0] < 0 or own[-1] > 29 or 9 in own or 20 in own:
            assert got[i].coh is None and got[i].plv is None
        else:
            assert got[i].coh == pytest.approx(abs(z[own].mean()) / np.sqrt(pa[own].mean() * pb[own].mean()))
            assert got[i].plv == pytest.approx(abs((z[own] / abs(z[own])).mean()))


def lowess_by_hand(y, k, rounds):
    """Weighted straight lines by least squares, point by point."""
    n, fit, robust = len(y), y.copy(), np.ones(len(y))
    for _ in range(rounds + 1):
        new = fit.copy()
        for i in range(n):
            near = sorted(range(i - n, i + n + 1), key=lambda j: (abs(j - i), j))[:k]
            far = max(abs(j - i) for j in near) * 1.0001
            w = np.array([(1 - (abs(j - i) / far) ** 3) ** 3 * robust[j % n] * (not np.isnan(y[j % n])) for j in near])
            v = np.array([np.nan_to_num(y[j % n]) for j in near])
            if w.sum() > 0:
                m = np.sqrt(w)[:, None] * np.array([[1.0, j - i] for j in near])
                new[i] = np.linalg.lstsq(m, np.sqrt(w) * v, rcond=None)[0][0]
        fit = new
        left = np.abs(y - fit)
        scale = 6 * np.nanmedian(left)
        robust = np.where(np.isnan(left), 1.0, np.clip(1 - (left / scale) ** 2, 0, None) ** 2)
    return fit


@pytest.mark.parametrize("frac,rounds", [(0.05, 0), (0.05, 2), (0.2, 2), (0.6, 1)])
def test_circular_lowess(spark, frac, rounds):
    rng = np.random.default_rng(6)
    data = {"a": np.sin(np.arange(60) / 60 * 2 * np.pi) + rng.normal(0, 0.1, 60), None: rng.normal(size=45)}
    data["a"][10] = 9.0
    data[None][3] = np.nan
    df = spark.createDataFrame([(k, i, None if np.isnan(v) else float(v)) for k, y in data.items() for i, v in enumerate(y)], "k string, t_pos int, value double")
    got = {(r.k, r.t_pos): r.smooth for r in cohort.circular_lowess(df, ["k"], frac, rounds).collect()}
    for k, y in data.items():
        want = lowess_by_hand(y, max(2, int(np.ceil(frac * 3 * len(y)))), rounds)
        assert [got[(k, i)] for i in range(len(y))] == [pytest.approx(v, abs=1e-8) for v in want]


def test_significance_and_bases(spark):
    rows = [(0, 1.0, 0.01, 2.0, 0.01), (1, 1.0, 0.01, -2.0, 0.01), (2, 0.0, 0.01, 1.0, 0.2), (3, -1.0, None, -1.0, 0.04), (4, -1.0, 0.05, -1.0, 0.04), (5, 3.0, 0.001, 1.0, 0.001), (6, 3.0, 0.001, 1.0, 0.001)]
    df = spark.createDataFrame([(None, *r) for r in rows], "k string, pos int, estimate double, p double, robust double, robust_p double")
    s = statistics.significance(df).orderBy("pos").collect()
    assert [r.plain_sig for r in s] == [True, True, True, False, False, True, True] and [r.robust_sig for r in s] == [True, True, False, True, True, True, True]
    assert [r.joint_sig for r in s] == [True, False, False, False, False, True, True] and [r.direction for r in s][1:4] == ["above_0", "none", "below_0"]
    got = sorted((r.basis, r.first, r["last"], r.span, r.way) for r in statistics.basis_intervals(statistics.significance(df), ["k"], "pos", 7, 1).collect())
    assert got == [("joint", 5, 0, 3, "above_0"), ("plain", 5, 1, 4, "above_0"), ("robust", 1, 1, 1, "below_0"), ("robust", 3, 4, 2, "below_0"), ("robust", 5, 0, 3, "above_0")]
    assert statistics.significance(df.limit(0)).count() == 0


def test_synchronised_samples(spark):
    df = spark.createDataFrame([(k, i, float(i + 1)) for k in ("r", None) for i in range(6)], "rec string, sample_idx int, value double")
    read = lambda d: sorted(((r.rec, r.sample_idx, r.value) for r in d.collect()), key=str)
    want = lambda x: sorted(((k, i, v) for k in ("r", None) for i, v in enumerate(x)), key=str)
    assert read(packets.sync_samples(df, ["rec"], 0.5, 5.0)) == want([3.0, 4.0, 5.0, 6.0])  # 2.5 samples: two
    assert read(packets.sync_samples(df, ["rec"], -0.5, 4.0)) == want([0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    assert read(packets.sync_samples(df, ["rec"], 0.0, 4.0)) == want([1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    with pytest.raises(ValueError, match="whole record"):
        packets.sync_samples(df, ["rec"], 1.5, 4.0)
    notes = spark.createDataFrame([(1.0, 2.0), (0.2, 9.0), (5.0, 5.0)], "start double, end double")
    got = sorted((r.start, r.end) for r in packets.sync_annotations(notes, 0.5, 250.0, 200.0, 4.0).collect())
    assert got == [(0.75, 2.0)]


def test_baselines_by_label_and_guarded_edges(spark):
    """Thresholds over labelled samples, all samples or an error without any; bursts end where a guarded edge begins."""
    x = {"r": np.arange(40.0) % 7, None: np.arange(40.0) % 5}
    env = spark.createDataFrame([(k, "beta", i, float(v)) for k, y in x.items() for i, v in enumerate(y)], "rec string, band string, sample_idx long, value double")
    notes = spark.createDataFrame([(None, "Rest 1", 1.0, 1.5), (None, "point rest", 3.0, 3.0), ("r", "walk", 0.0, 1.0), (None, "other", 0.0, 4.0)], "rec string, label string, start double, end double")
    spans = spectral.label_samples(notes, ["rec"], ["rest"], 10.0)
    assert sorted((r.rec, r.start, r.end) for r in spans.collect()) == [(None, 10, 15), (None, 30, 31)]
    assert spectral.label_samples(notes, ["rec"], ["REST 1"], 10.0, "exact").count() == 1
    got = {r.rec: r.threshold for r in spectral.thresholds(env, ["rec", "band"], 60, spans).collect()}
    own = np.r_[x[None][10:16], x[None][30:32]]
    assert got == {None: pytest.approx(np.percentile(own, 60)), "r": pytest.approx(np.percentile(x["r"], 60))}
    with pytest.raises(PySparkException, match="baseline"):
        spectral.thresholds(env, ["rec", "band"], 60, spans, fallback="raise").collect()
    assert spectral.thresholds(env.where("rec is null"), ["rec", "band"], 60, spans, fallback="raise").count() == 1
    edges = spark.createDataFrame([(None, 1.0, 1.2), (None, 1.3, 1.3), ("r", 3.8, 3.9)], "rec string, start double, end double")
    wide = spectral.guarded(edges, ["rec"], 0.1, F.lit(0.0), F.lit(3.9))
    assert sorted((r.rec, round(r.start, 6), round(r.end, 6)) for r in wide.where("rec is null").collect()) == [(None, 0.9, 1.4)]
    assert [(round(r.start, 6), r.end) for r in wide.where("rec = 'r'").collect()] == [(3.7, 3.9)]
    limits = spark.createDataFrame([("r", "beta", 3.5), (None, "beta", 1.5)], "rec string, band string, threshold double")
    at = wide.select("rec", F.bround(F.col("start") * 10).cast("long").alias("start"), F.bround(F.col("end") * 10).cast("long").alias("end"))
    hits = {(r.rec, r.sample_idx): r.burst for r in spectral.burst_mask(env, limits, ["rec", "band"], {"beta": 10.0}, 10.0, 2.0, edges=at).collect()}
    for k, y in x.items():
        lo, hi = (9, 14) if k is None else (37, 39)
        on = (y > (1.5 if k is None else 3.5)) & ~((np.arange(40) >= lo) & (np.arange(40) <= hi))
        runs = np.split(np.arange(40), np.flatnonzero(np.diff(on.astype(int))) + 1)
        want = {i for r in runs if on[r[0]] and len(r) >= 2 for i in r.tolist()}
        assert {i for (rec, i), b in hits.items() if rec == k and b} == want
