"""Lag scores from packed blocks."""

import numpy as np
import pytest

from tests.test_values import lag_score, series
from tracewell.operators import connectivity


def test_lag_scores_of_blocks(spark):
    """Any block size, both directions of time at once; gaps, a negative start, a NULL record; channels are exchanged as blocks, not sample by sample."""
    rng, data = np.random.default_rng(6), {}
    for rec in ("r", None):
        data[rec] = dict(zip("ab", series(rng)))
    data["r"]["a"][50] = data["r"]["b"][90:93] = np.nan
    rows = [(rec, c, i - 20, None if np.isnan(v) else float(v)) for rec, own in data.items() for c, x in own.items() for i, v in enumerate(x) if (rec, c, i) != ("r", "b", 91)]
    df = spark.createDataFrame(rows, "rec string, channel string, sample_idx long, value double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("a", "x")], "a string, b string")
    for size in (7, 65536):
        out = connectivity.granger_scores(df, pairs, ["rec"], 3, size=size)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.rec, r.a, r.b): r for r in out.collect()}
        assert len(got) == 4
        for rec, own in data.items():
            for a, b in ("ab", "ba"):
                assert got[(rec, a, b)].value == pytest.approx(lag_score(own[a], own[b], 3), rel=1e-5, abs=1e-8)
                assert got[(rec, a, b)].reversed == pytest.approx(lag_score(own[a][::-1], own[b][::-1], 3), rel=1e-5, abs=1e-8)
    assert "Window" not in connectivity.granger(df, pairs, ["rec"], 3)._jdf.queryExecution().executedPlan().toString()
