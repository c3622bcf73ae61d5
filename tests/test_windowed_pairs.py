"""Windowed pair measures from packed blocks."""

import numpy as np
import pytest

from tracewell.operators import connectivity as K
from tracewell.operators import crossspectra as Y
from tracewell.operators import spectral as G


def test_windows_of_blocks(spark):
    """Equal to windows over a row for each sample, for any block size; with NULL and absent samples, equal channels and a NULL record; no window over samples in the plan."""
    rng = np.random.default_rng(7)
    rows = [(rec, c, i, None if (rec, c, i) == ("r", "a", 60) else float(v)) for rec in ("r", None) for c in "abc" for i, v in enumerate(rng.normal(size=150)) if (rec, c, i) != ("r", "b", 101)]
    rows += [(rec, "d", i, v) for rec, c, i, v in rows if c == "c"]
    df = spark.createDataFrame(rows, "rec string, channel string, sample_idx long, value double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "x")], "a string, b string")
    freqs, cycles, half = (8.0, 16.0), (2.0, 3.0), {0: 8, 1: 4}
    coef = G.morlet(df, ["rec", "channel"], 64.0, freqs, cycles, hop=2)
    old = K.windowed_measures(K.pair_products(coef, pairs, ["rec"]), ["rec"], half, hop=2)
    name = lambda r: (r.rec, r.a, r.b, r.f_pos, r.freq, r.sample_idx)
    want = {name(r): [r[m] for m in K.MEASURES] for r in old.collect()}
    for size in (16, 65536):
        out = Y.windowed(df, pairs, ["rec"], freqs, Y.morlet_kernels(64.0, freqs, cycles), half, hop=2, size=size)
        assert "RangeFrame" not in out._jdf.queryExecution().executedPlan().toString()
        got = {name(r): [r[m] for m in K.MEASURES] for r in out.collect()}
        assert got.keys() == want.keys()
        for k, values in want.items():
            if k[1] == "c":  # equal channels: ciplv is 0 / 0 up to rounding
                values, own = values[:2] + values[3:], got[k][:2] + got[k][3:]
            else:
                own = got[k]
            assert [x is None for x in own] == [x is None for x in values]
            assert [x for x in own if x is not None] == pytest.approx([x for x in values if x is not None], abs=1e-9)
