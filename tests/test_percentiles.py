"""Exact percentiles without a task that holds a key's values."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import transforms


def test_percentiles_by_ranges(spark):
    """Keys of one, two and many values, of NULLs alone, a NULL key, repeats and NaN: as F.percentile, over several ranges."""
    rows = [(k, float((i * 7919) % 101)) for k, n in (("a", 1), ("b", 2), (None, 37), ("d", 400)) for i in range(n)]
    rows += [("e", None), ("e", None), ("d", None), ("f", float("nan")), ("f", 1.0), ("f", 1.0)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    got = {r.k: r for r in transforms.percentiles(df, ["k"], shares, rows=50).collect()}
    want = df.groupBy("k").agg(F.percentile("value", F.array(*map(F.lit, shares))).alias("q"), F.min("value").alias("lo")).collect()
    assert len(got) == len(want) == 6
    for r in want:
        assert repr(got[r.k]["_min"]) == repr(r.lo)
        assert got[r.k]["_q"] == ([None] * 6 if r.q is None else pytest.approx(r.q, nan_ok=True))


def test_box_stats_holds_no_values_of_a_key(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("a", 90.0)], "k string, value double")
    for whiskers, want in (("tukey", (12, 2.75, 5.5, 8.25, 0.0, 10.0, 1)), ((0.1, 0.9), (12, 2.75, 5.5, 8.25, 2.0, 9.0, 4))):
        out = transforms.box_stats(df, ["k"], whiskers=whiskers)
        assert tuple(out.first())[1:] == want
        assert "percentile" not in out._jdf.queryExecution().toString()
