"""Prominence against brute force for every block size."""

import numpy as np
import pytest

from tracewell.operators.intervals import meet
from tracewell.operators.prominence import nearest_block, nearest_higher, prominences


def by_hand(x):
    at = [i for i, v in enumerate(x) if not np.isnan(v)]
    y, out = [x[i] for i in at], {}
    for j in range(1, len(y) - 1):
        if y[j] > y[j - 1] and y[j] >= y[j + 1]:
            lows = []
            for way in (range(j, -1, -1), range(j, len(y))):
                low = y[j]
                for k in way:
                    if y[k] > y[j]:
                        break
                    low = min(low, y[k])
                lows.append(low)
            out[at[j]] = (y[j], y[j] - max(lows))
    return out


def signals():
    rng = np.random.default_rng(8)
    x = rng.normal(size=140)
    x[rng.random(140) < 0.1] = np.nan
    stairs = np.repeat(np.arange(40.0), 2)
    stairs[::2] -= 5
    return {"noise": x, None: rng.integers(0, 4, 120).astype(float), "up": stairs, "down": stairs[::-1], "two": np.array([1.0, 2.0]), "none": np.full(5, np.nan), "walk": np.cumsum(rng.normal(size=150))}


@pytest.mark.parametrize("size", [1, 4, 33, 10_000])
def test_prominences(spark, size):
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, x in signals().items() for i, v in enumerate(x)]
    got: dict = {}
    for r in prominences(spark.createDataFrame(rows, "k string, sample_idx int, value double"), ["k"], size=size).collect():
        assert r.sample_idx not in got.setdefault(r.k, {})
        got[r.k][r.sample_idx] = (r.value, r.prominence)
    for k, x in signals().items():
        want = by_hand(x)
        assert set(got.get(k, {})) == set(want)
        assert all(got[k][i] == pytest.approx(v) for i, v in want.items())


def test_nearest_higher():
    low, found = nearest_higher(np.array([3.0, 1.0, 2.0, 2.0, 5.0, 4.0]))
    assert low.tolist() == [3, 1, 1, 1, 1, 4] and found.tolist() == [False, True, True, True, False, True]


def test_empty(spark):
    assert prominences(spark.createDataFrame([], "k string, sample_idx int, value double"), ["k"]).count() == 0


def test_nearest_block_against_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64):
        most = rng.integers(0, 12, n).astype(float)
        least = most - rng.integers(0, 5, n)
        first, v = np.tile(np.arange(n), 3), rng.integers(-1, 12, 3 * n).astype(float)
        place, passed = nearest_block(least, most, first, v)
        for f, x, p, low in zip(first, v, place, passed):
            want = max((i for i in range(f) if most[i] > x), default=-1)
            assert p == want and low == min(least[want + 1 : f], default=np.inf)


def test_one_row_a_slice_meets_the_extremes_of_its_record(spark, monkeypatch):
    """Each open peak once met its record's extremes by itself: rows times blocks."""
    from tracewell.operators import prominence as module

    rows = []
    monkeypatch.setattr(module, "meet", lambda a, b, on: (rows.append((a.columns, a.count())), meet(a, b, on))[1])
    x = np.random.default_rng(6).normal(size=400)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, sample_idx long, value double")
    assert {r.sample_idx: r.prominence for r in prominences(df, ["k"], size=8).collect()} == pytest.approx({i: p for i, (_, p) in by_hand(x).items()})
    assert rows[0] == (["k", "_slice", "_open"], 1)
