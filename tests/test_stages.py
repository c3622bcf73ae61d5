"""Stages against plain Python and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import intervals as I
from tracewell.operators import spectral as G
from tracewell.operators import stages as P
from tracewell.operators import statistics as S
from tracewell.operators import transforms as T


def test_null_keys(spark):
    """NULL keys are a key of their own in every interval operator."""
    iv = spark.createDataFrame([(None, 0.0, 4.0), ("r", 0.0, 4.0)], "rec string, start double, end double")
    bad = spark.createDataFrame([(None, 1.0, 2.0)], "rec string, start double, end double")
    spans = lambda df: sorted(((r.rec, r.start, r.end) for r in df.collect()), key=str)
    assert spans(I.keep_within(iv, bad, ["rec"])) == [(None, 1.0, 2.0)]
    assert spans(I.subtract(iv, bad, ["rec"])) == sorted([(None, 0.0, 1.0), (None, 2.0, 4.0), ("r", 0.0, 4.0)], key=str)
    assert spans(I.compress_annotations(iv, bad, ["rec"])) == sorted([(None, 0.0, 3.0), ("r", 0.0, 4.0)], key=str)
    s = spark.createDataFrame([(k, i) for k in (None, "r") for i in range(3)], "rec string, sample_idx long")
    b = spark.createDataFrame([(None, 0, 1)], "rec string, start long, end long")
    got = I.remove_and_close(s, b, ["rec"]).collect()
    assert sorted(((r.rec, r.sample_idx, r.new_idx) for r in got), key=str) == sorted([(None, 1, 0), (None, 2, 1), ("r", 0, 0), ("r", 1, 1), ("r", 2, 2)], key=str)
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, value double")
    out = T.normalize_by_group(df, ["k"], F.col("value") < 4, "mean")
    assert out.columns == ["k", "value"] and sorted(((r.k, r.value) for r in out.collect()), key=str) == sorted([(None, -1.0), (None, 1.0), ("a", None)], key=str)


def test_anova_of_large_means(spark):
    df = spark.createDataFrame([(g, 1e9 + g + e) for g in range(3) for e in (-0.5, 0.5)], "g int, value double")
    assert S.anova(df, [], "g").first().ss_between == pytest.approx(4.0)


def test_bad_spans_go(spark):
    s = spark.createDataFrame([("r", i) for i in range(20)], "rec string, sample_idx long")
    marks = spark.createDataFrame([("r", 5, 8, "BAD_x"), ("r", 7, 10, "edge"), ("r", 4, 12, "walk"), ("r", 6, 9, "inside"), ("r", 15, 18, "late")], "rec string, start long, end long, description string")
    kept, left = P.remove_bad_spans(s, marks, ["rec"], 1)
    assert [(r.sample_idx, r.new_idx) for r in kept.orderBy("new_idx").collect()] == [(i, n) for n, i in enumerate([*range(5), *range(10, 20)])]
    got = {(r.description, r.start, r.end) for r in left.collect()}
    assert got == {("walk", 4, 7), ("inside", 5, 5), ("late", 10, 13), ("EDGE", 0, 1), ("EDGE", 13, 14)}
    bad = marks.where(P.is_bad(F.col("description"))).select("rec", "start", "end")
    rest = marks.where(~P.is_bad(F.col("description")))
    assert {(r.description, r.start, r.end) for r in P.split_annotations(rest, bad, ["rec"]).collect()} == {("walk", 4, 5), ("walk", 5, 7), ("late", 10, 13)}
    assert {r.description for r in P.split_annotations(rest, bad, ["rec"], "drop").collect()} == {"late"}


def test_raw_power_and_decomposition(spark):
    x = np.random.default_rng(3).normal(size=256).cumsum()
    s = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "rec string, sample_idx long, value double")
    freqs, cycles = [4.0, 8.0, 12.0, 16.0, 20.0], [2.0, 3.0, 3.0, 3.0, 3.0]
    marks = spark.createDataFrame([("r", 100, 110)], "rec string, start long, end long")
    got = P.raw_power(s, ["rec"], 64.0, freqs, cycles, [(12.0, 2.0)], marks, hop=4).toPandas().pivot(index="sample_idx", columns="freq", values="value")

    def power(f, c):
        w = G.morlet_kernel(f, c, 64.0)
        return np.abs(np.convolve(x, w)[len(w) // 2 : len(w) // 2 + len(x)])[::4] ** 2

    at = np.arange(0, 256, 4)
    for f, c in zip(freqs, cycles):
        want = np.sqrt(power(8.0, 3.0) * power(16.0, 3.0)) if f == 12.0 else power(f, c)
        want[(at >= 100 - 64 * 5 * c / (2 * np.pi * f)) & (at <= 110 + 64 * 5 * c / (2 * np.pi * f))] = np.nan
        assert np.allclose(got[f].to_numpy(), want, equal_nan=True)
    with pytest.raises(ValueError):
        P.raw_power(s, ["rec"], 64.0, [50.0], [3.0], [(50.0, 1.0)])
    line = spark.createDataFrame([("r", t, float(f), 50.0 * f**-2 * (4 if f == 10 else 1)) for t in range(3) for f in range(2, 30)] + [("r", 0, 30.0, 0.0)], "rec string, sample_idx long, freq double, value double")
    periodic, fits = P.decompose(line, ["rec"], [10.0, 25.0], sigma=0.01, kernel=3, least=0.9)
    assert all(r.exponent == pytest.approx(2, abs=0.05) for r in fits.where("sample_idx > 0").collect())
    peaks = {(r.sample_idx, r.freq): r.value for r in periodic.collect()}
    assert len(peaks) == 6 and peaks[(1, 10.0)] == pytest.approx(np.log10(4), abs=0.05) and peaks[(1, 25.0)] == pytest.approx(0, abs=0.05)


def test_cohort_tables(spark):
    f = spark.createDataFrame([("burst", "a"), ("PSI", "b"), ("plv", "c"), ("plv", "zz")], "metric string, key string")
    one, two, three = (spark.createDataFrame([(k, float(i))], "key string, x double") for i, k in enumerate("abc"))
    assert {(r.metric, r.x) for r in P.join_by_metric(f, one, two, three).collect()} == {("burst", 0.0), ("PSI", 1.0), ("plv", 2.0), ("plv", None)}
    t = spark.createDataFrame([("1_2", True, False), ("0_3", True, True), ("x", None, None)], "channel string, snr_in boolean, stn_in boolean").selectExpr("'s' as subject", "*", "1 as mni_x", "2 as mni_y", "3 as mni_z")
    assert [(r.channel, r.region) for r in P.cohort_coordinates(t).orderBy("place").collect()] == [("0_3", "Mid"), ("1_2", "SNr"), ("x", "EXT")]
    cells = spark.createDataFrame([("s", c, p, i, i, float(k), 10.0**k) for i, (c, p) in enumerate([("b", "off"), ("a", "on"), ("b", "on")]) for k in range(4)], "subject string, channel string, phase string, row_id int, ord int, t_coord double, value double")
    got = P.subject_example(cells, "s", 1.0, 2.0, ["on", "off"]).orderBy("place", "t_coord").collect()
    assert [(r.channel, r.phase, r.value) for r in got] == [(c, p, v) for c, p in (("b", "on"), ("b", "off"), ("a", "on")) for v in (1.0, 2.0)]
    trace = spark.createDataFrame([(i, float(i) if i % 2 else None) for i in range(10)], "t_pos int, value double").selectExpr("'u' as subject", "*", "'Ipsi' as lat")
    with pytest.raises(Exception, match="not Contra"):
        P.long_traces(trace, ["subject"]).collect()
    assert [r.t_pct for r in P.long_traces(trace.withColumn("lat", F.lit(None).cast("string")), ["subject"]).orderBy("t_pct").collect()] == [25.0, 75.0]
    empty = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, None)], "k int, t_pos int, value double")
    assert sorted(((r.k, r.value) for r in P.normalise_filled(empty, ["k"], [(0, 50)], "mean").collect()), key=str) == [(1, 0.0), (1, 2.0), (2, None)]


def test_result_tables(spark):
    df = spark.createDataFrame([("x", "y", "0.004", 1)], "A string, B string, p string, n int")
    out = P.post_hoc_rows(df, "p", {"band": "beta"})
    assert out.columns == ["group1", "group2", "p.value", "stars", "band", "p", "n"] and tuple(out.first())[:5] == ("x", "y", 0.004, "**", "beta")
    assert P.summary_columns(spark.createDataFrame([(1, 2, 3)], "response int, lower int, upper int")).columns == ["emmean", "lower.CL", "upper.CL"]
    assert [r.x for r in P.level_map(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "l string, x double"), "l", "x", ["b", "a"], "mean").orderBy("place").collect()] == [None, 2.0]
