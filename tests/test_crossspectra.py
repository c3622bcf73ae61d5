"""Pair measures against their definitions in NumPy, for Morlet wavelets and Slepian tapers."""

import numpy as np
import pytest

from tracewell.operators import crossspectra as C
from tracewell.operators import spectral as G

RATE, FREQS, CYCLES = 64.0, [6.0, 9.0, 12.0, 16.0], [2.0, 3.0, 3.0, 4.0]
PAIRS = [("1", "2"), ("2", "3"), ("3", "1"), ("1", "1"), ("1", "9")]


def recordings(seed):
    """Two records, one of a NULL name, of three channels that share a delayed source; one sample is NULL, one channel ends early."""
    rng, data = np.random.default_rng(seed), {}
    for rec, n in (("r", 300), (None, 180)):
        source = rng.normal(size=n + 10)
        for i, c in enumerate("123"):
            data[(rec, c)] = source[i : i + n] + 0.7 * rng.normal(size=n)
    data[("r", "2")][100] = np.nan
    data[(None, "3")] = data[(None, "3")][:150]
    return data


def table(spark, data):
    return spark.createDataFrame([(rec, c, i, None if np.isnan(v) else float(v)) for (rec, c), x in data.items() for i, v in enumerate(x)], "rec string, channel string, sample_idx int, value double")


def convolved(x, k):
    y = np.convolve(np.nan_to_num(x), k)[len(k) // 2 : len(k) // 2 + len(x)].astype(complex)
    y[np.isnan(x)] = np.nan
    return y


def by_hand(x, y, kernels, hop):
    """Coherency and the five measures of each frequency, by their definitions."""
    n, out, cs = min(len(x), len(y)), [], []
    for own in kernels:
        a = np.concatenate([convolved(x, k)[:n:hop] for k in own])
        b = np.concatenate([convolved(y, k)[:n:hop] for k in own])
        ok = ~np.isnan(a * b)
        a, b = a[ok], b[ok]
        s = a * np.conj(b)
        unit = np.mean(s / np.abs(s))
        im = np.where(np.abs(s.imag) > 1e-12 * np.abs(s), s.imag, 0)
        c = np.mean(s) / np.sqrt(np.mean(np.abs(a) ** 2) * np.mean(np.abs(b) ** 2))
        lag = np.mean(np.abs(im))
        real = np.sqrt(max(0.0, 1 - unit.real**2))
        out.append((abs(c), abs(unit), abs(unit.imag) / real if real > 1e-9 else None, abs(np.mean(np.sign(im))), abs(np.mean(im)) / lag if lag else None))
        cs.append(c)
    return out, np.array(cs)


def kernels(kind):
    return C.morlet_kernels(RATE, FREQS, CYCLES) if kind == "morlet" else C.multitaper_kernels(RATE, FREQS, CYCLES)


@pytest.mark.parametrize("kind", ["morlet", "multitaper"])
@pytest.mark.parametrize("size,hop", [(64, 1), (100, 3), (10_000, 1), (10_000, 4)])
def test_measures_of_pairs(spark, kind, size, hop):
    data, ks = recordings(1), kernels(kind)
    sums = C.cross_sums(table(spark, data), spark.createDataFrame(PAIRS, "a string, b string"), ["rec"], FREQS, ks, hop, size).cache()
    got = {(r.rec, r.a, r.b, r.freq): r for r in C.measures_of(sums, ["rec"]).collect()}
    assert len(got) == 2 * 4 * len(FREQS)
    for rec in ("r", None):
        for a, b in PAIRS[:4]:
            want, _ = by_hand(data[(rec, a)], data[(rec, b)], ks, hop)
            for f, row in zip(FREQS, want):
                r = got[(rec, a, b, f)]
                for v, w in zip((r.coh, r.plv, r.ciplv, r.pli, r.wpli), row):
                    if a != b:
                        assert v == pytest.approx(w, abs=1e-9)
                if a == b:
                    assert (r.coh, r.plv, r.pli, r.wpli) == (pytest.approx(1), pytest.approx(1), 0.0, None)


@pytest.mark.parametrize("kind", ["morlet", "multitaper"])
def test_phase_slope(spark, kind):
    data, ks = recordings(2), kernels(kind)
    sums = C.cross_sums(table(spark, data), spark.createDataFrame(PAIRS[:3], "a string, b string"), ["rec"], FREQS, ks, 2, 128)
    bands = spark.createDataFrame([("all", 5.0, 20.0), ("split", 5.0, 10.0), ("split", 9.0, 20.0), ("one", 11.0, 13.0), ("none", 30.0, 32.0)], "band string, start double, end double")
    got = {(r.rec, r.a, r.b, r.band): r.psi for r in C.phase_slope_of(sums, ["rec"], bands, RATE).collect()}
    for rec in ("r", None):
        for a, b in PAIRS[:3]:
            _, c = by_hand(data[(rec, a)], data[(rec, b)], ks, 2)
            slope = lambda own: float(np.sum(np.imag(np.conj(own[:-1]) * own[1:])))
            assert got[(rec, a, b, "all")] == pytest.approx(slope(c), abs=1e-9)
            assert got[(rec, a, b, "split")] == pytest.approx((2 * slope(c[:2]) + 3 * slope(c[1:])) / 5, abs=1e-9)
            assert got[(rec, a, b, "one")] == 0 and (rec, a, b, "none") not in got
    # Channel 2 is ahead of channel 1 by a sample, so the phase falls with frequency one way and rises the other.
    assert got[("r", "1", "2", "all")] * got[("r", "3", "1", "all")] < 0


def test_nyquist_guard(spark):
    for bad in ([40.0], [0.0], []):
        with pytest.raises(ValueError):
            C.morlet_kernels(RATE, bad, [2.0] * len(bad))
        with pytest.raises(ValueError):
            C.multitaper_kernels(RATE, bad, [2.0] * len(bad))
    with pytest.raises(ValueError):
        C.multitaper_kernels(RATE, [8.0], [2.0], 0)
    sums = C.cross_sums(table(spark, recordings(3)), spark.createDataFrame(PAIRS, "a string, b string"), ["rec"], FREQS, kernels("morlet"))
    with pytest.raises(ValueError, match="half the rate"):
        C.phase_slope_of(sums, ["rec"], spark.createDataFrame([("x", 8.0, 33.0)], "band string, start double, end double"), RATE)


def test_coefficients_equal_those_of_the_tensor(spark):
    data = recordings(4)
    signal, ks = table(spark, data), kernels("morlet")
    tensor = {(r.rec, r.channel, r.f_pos, r.sample_idx): complex(r.re, r.im) for r in G.morlet(signal, ["rec", "channel"], RATE, FREQS, CYCLES, 4, 90).collect() if r.re is not None}
    seen = 0
    for r in C.coefficient_blocks(signal, ["rec"], ks, 4, 90).collect():
        for f, row in enumerate(np.frombuffer(r.coef, complex).reshape(len(FREQS), -1)):
            for i, v in enumerate(row):
                if not np.isnan(v):
                    assert abs(tensor[(r.rec, r.channel, f, r.first + 4 * i)] - v) < 1e-9
                    seen += 1
    assert seen == sum(not np.isnan(v.real) for v in tensor.values())


def test_empty(spark):
    signal, pairs = table(spark, recordings(5)), spark.createDataFrame(PAIRS, "a string, b string")
    for s, p in ((signal.limit(0), pairs), (signal, pairs.limit(0))):
        assert C.measures_of(C.cross_sums(s, p, ["rec"], FREQS, kernels("morlet")), ["rec"]).count() == 0


def test_batches_go_in_slices():
    """A task works on few blocks at a time, however many an Arrow batch holds; rows and order stay."""
    import pyarrow as pa

    from tracewell.operators.crossspectra import slices

    got = list(slices([pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1000, 5)]))
    assert max(b.num_rows for b in got) <= 64
    assert [x for b in got for x in b.column("x").to_pylist()] == [*range(1000), *range(5)]
