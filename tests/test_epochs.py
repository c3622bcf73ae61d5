"""Epochs as data against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import epochs as E

RATES = {"raw": (10.0, 60), "slow": (2.5, 15)}


def cells(spark, rng):
    """Two records (one of a NULL name) with two channels each; some samples are NULL."""
    data, arrays = [], {}
    for rec in ("r", None):
        for ch in (1, 2):
            for metric, (_, n) in RATES.items():
                x = rng.normal(size=n)
                x[rng.random(n) < 0.1] = np.nan
                arrays[(rec, ch, metric)] = x
                data += [(rec, ch, metric, i, None if np.isnan(v) else float(v), i) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "rec string, channel int, metric string, sample_idx int, value double, epoch int").drop("epoch"), arrays


def axes(spark):
    return spark.createDataFrame([(rec, m, r, n) for rec in ("r", None) for m, (r, n) in RATES.items()], "rec string, metric string, rate double, n long")


def by_hand(x, rate, parts):
    """The samples of an epoch's parts, stitched."""
    out = []
    for start, end in parts:
        a = max(int(np.round(start * rate)), 0)
        b = max(int(np.round(end * rate)), a + 1)
        out.append(x[min(a, len(x) - 1) : min(b, len(x))])
    return np.concatenate(out)


PARTS = {("r", 0): [(0.5, 1.0), (2.0, 2.0)], ("r", 1): [(-1.0, 0.3), (5.5, 9.0)], ("r", 2): [(8.0, 9.0)], (None, 0): [(1.25, 3.75)], (None, 1): [(0.0, 6.0)]}


def parts_table(spark):
    return spark.createDataFrame([(rec, e, "x", i, a, b) for (rec, e), own in PARTS.items() for i, (a, b) in enumerate(own)], "rec string, epoch int, label string, part int, start double, end double")


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_stitched_and_edge_padded(spark, block):
    df, arrays = cells(spark, np.random.default_rng(1))
    spans = E.sample_spans(parts_table(spark), axes(spark), ["rec"])
    got = {}
    for r in E.edge_padded(E.stitched(df, spans, ["rec"], block=block)).collect():
        assert got.setdefault((r.rec, r.epoch, r.channel, r.metric, r.pos), r.value) == r.value
    want = {}
    for (rec, ch, metric), x in arrays.items():
        own = {e: by_hand(x, RATES[metric][0], p) for (q, e), p in PARTS.items() if q == rec}
        longest = max(map(len, own.values()))
        for e, y in own.items():
            want |= {(rec, e, ch, metric, i): None if np.isnan(v) else float(v) for i, v in enumerate(np.pad(y, (0, longest - len(y)), mode="edge"))}
    assert got == want


@pytest.mark.parametrize("n", [2, 5, 16, 200])
def test_resampled_over_the_joint(spark, n):
    df, arrays = cells(spark, np.random.default_rng(n))
    got = {(r.rec, r.epoch, r.channel, r.metric, r.pos): (r.value, r.percent) for r in E.align_metrics(df, parts_table(spark), axes(spark), ["rec"], n).collect()}
    assert len(got) == len(PARTS) * 2 * len(RATES) * n
    for (rec, ch, metric), x in arrays.items():
        for (q, e), p in PARTS.items():
            if q != rec:
                continue
            y = by_hand(x, RATES[metric][0], p)
            at = np.linspace(0, len(y) - 1, n)
            lo = np.floor(at).astype(int)
            hi = np.minimum(lo + 1, len(y) - 1)
            value = np.where(at == lo, y[lo], (1 - (at - lo)) * y[lo] + (at - lo) * y[hi])
            for pos in range(n):
                v, percent = got[(rec, e, ch, metric, pos)]
                assert percent == pytest.approx(100 * pos / (n - 1))
                assert (v is None) == bool(np.isnan(value[pos])) and (v is None or v == pytest.approx(value[pos]))


def test_one_alignment_for_native_lengths(spark):
    df, _ = cells(spark, np.random.default_rng(2))
    got = E.align_metrics(df, parts_table(spark), axes(spark), ["rec"])
    assert [r[0] for r in got.groupBy("rec", "metric").agg(F.max("percent")).select(F.col("max(percent)")).distinct().collect()] == [100.0]
    assert E.align_metrics(df.limit(0), parts_table(spark), axes(spark), ["rec"]).count() == 0
    assert E.align_metrics(df, parts_table(spark).limit(0), axes(spark), ["rec"], 4).count() == 0


def notes(spark, rows):
    return spark.createDataFrame([("r", *x) for x in rows] + [(None, *x) for x in rows], "rec string, label string, start double, end double")


WINDOWS = [("walk", 1.0, 0.5, 0.25, 2.0), ("alk", 0.0, 0.0, 0.0, 0.0)]


def test_pad_parts_labels_drops_and_bounds(spark):
    a = notes(spark, [("Walk", 2.0, 4.0), ("walk", 9.0, 9.5), ("talk", 5.0, 6.0), ("walk", 0.0, 0.1)])
    w = spark.createDataFrame(WINDOWS, "label string, pad_left double, anno_left double, anno_right double, pad_right double")
    read = lambda df, rec="r": sorted((r.epoch, r.label, r.part, r.start, r.end) for r in df.collect() if r.rec == rec)
    got = E.pad_parts(a, w, ["rec"], "substring", low=0.5, high=3.0, bounds=(F.lit(0.0), F.lit(10.0)))
    want = [
        (0, "alk", 0, 2.0, 2.0), (0, "alk", 1, 4.0, 4.0), (1, "walk", 0, 1.0, 2.5), (1, "walk", 1, 3.75, 6.0),
        (2, "alk", 0, 5.0, 5.0), (2, "alk", 1, 6.0, 6.0), (3, "alk", 0, 9.0, 9.0), (3, "alk", 1, 9.5, 9.5), (4, "walk", 0, 8.0, 9.5), (4, "walk", 1, 9.25, 10.0),
    ]
    assert read(got) == want == read(got, None)
    drops = notes(spark, [("bad", 6.0, 7.0)])
    got = E.pad_parts(a, w, ["rec"], "exact", drops=drops)
    assert read(got) == read(got, None) == [(0, "walk", 0, -1.0, 0.5), (0, "walk", 1, -0.15, 2.1), (1, "walk", 0, 8.0, 9.5), (1, "walk", 1, 9.25, 11.5)]
    with pytest.raises(ValueError):
        E.pad_parts(a, w, ["rec"], "prefix")


def test_concat_parts(spark):
    a = notes(spark, [("sit", 1.0, 2.0), ("SIT", 2.0, 3.0), ("gait", 5.0, 5.0), ("sit", 8.0, 9.0)])
    read = lambda df: sorted((r.epoch, r.label, r.part, r.start, r.end) for r in df.collect() if r.rec is None)
    assert read(E.concat_parts(a, ["rec"], ["sit", "gait"])) == [(0, "sit+gait", 0, 1.0, 3.0), (0, "sit+gait", 1, 5.0, 5.0), (0, "sit+gait", 2, 8.0, 9.0)]
    got = E.concat_parts(a, ["rec"], ["it"], "substring", 1.5, notes(spark, [("bad", 10.0, 11.0)]), (F.lit(0.0), F.lit(20.0)))
    assert read(got) == [(0, "it", 0, 0.0, 6.5)]
