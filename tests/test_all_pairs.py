"""Pair measures of every two channels of a record, met in squares."""

import itertools

import numpy as np
import pytest

from tests.parity import SF
from tracewell.operators import crossspectra as Y
from tracewell.plans import registry

FREQS, CYCLES = [6.0, 9.0, 16.0], [2.0, 3.0, 4.0]


@pytest.mark.parametrize("size,side", [(64, 4), (100, 3), (1024, 256)])
def test_sums_of_all_pairs(spark, size, side):
    """Equal to the sums of listed pairs, for any block and square; with NULL and absent samples, channels of other lengths, equal channels and a NULL record."""
    rng = np.random.default_rng(3)
    rows = [(rec, f"c{i}", t, None if (i, t) == (2, 60) else float(v)) for rec, n in (("r", 11), (None, 5), ("one", 1)) for i in range(n) for t, v in enumerate(rng.normal(size=150 - 5 * i)) if (i, t) != (1, 101)]
    rows += [(rec, "twin", t, v) for rec, c, t, v in rows if c == "c3"]
    signal = spark.createDataFrame(rows, "rec string, channel string, sample_idx long, value double")
    names = {rec: sorted({r[1] for r in rows if r[0] == rec}) for rec in ("r", None, "one")}
    channels = spark.createDataFrame([(rec, c, -i) for rec, own in names.items() for i, c in enumerate(own)] * 2 + [("r", None, 5)], "rec string, channel string, pos int")
    ks = Y.multitaper_kernels(64.0, FREQS, CYCLES)
    pairs = [(b, a) for a, b in itertools.combinations(names["r"], 2)]
    listed = Y.cross_sums(signal, spark.createDataFrame(pairs, "a string, b string"), ["rec"], FREQS, ks, 2)
    every = Y.all_cross_sums(signal, channels, ["rec"], FREQS, ks, 2, size, side=side)
    name = lambda r: (r.rec, r.a, r.b, r.f_pos, r.freq)
    want, got = ({name(r): r for r in Y.measures_of(x, ["rec"]).collect()} for x in (listed, every))
    assert every.count() == len(got) == (12 * 11 + 6 * 5) // 2 * len(FREQS) and got.keys() == want.keys()
    for k, r in want.items():
        for m in Y.MEASURES:
            assert got[k][m] == (None if r[m] is None else pytest.approx(r[m], abs=1e-9)), (k, m)


def test_query_takes_every_pair(spark):
    labels = spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()
    got = registry.queries()["pair_measures_multitaper"](spark, SF)
    assert got.count() == got.select("rec", "a", "b", "freq").distinct().count() == sum(r["count"] * (r["count"] - 1) // 2 for r in labels) * 4


def test_no_rows(spark):
    signal = spark.createDataFrame([], "rec string, channel string, sample_idx long, value double")
    channels = spark.createDataFrame([], "rec string, channel string, pos int")
    assert Y.all_cross_sums(signal, channels, ["rec"], FREQS, Y.multitaper_kernels(64.0, FREQS, CYCLES)).count() == 0
