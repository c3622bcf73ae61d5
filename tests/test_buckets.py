"""Bucketed runs and running values equal the plain ones for every bucket size."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.operators import buckets as B
from tracewell.operators import cohort as H
from tracewell.operators import intervals as I
from tracewell.operators import packets as P
from tracewell.operators import tensors as X

SIZES = [1, 3, 40, 10_000]


def same(got, want):
    key = lambda r: str(r)
    a, b = sorted(got.select(*want.columns).collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or u == pytest.approx(v)


@pytest.fixture(scope="module")
def samples(spark):
    """Traces of three keys, one of them NULL: long runs, short runs, missing positions, missing values."""
    r, rows = random.Random(3), []
    for k, stay in (("long", 0.97), (None, 0.8), ("short", 0.3)):
        on = True
        for p in range(120):
            on = on if r.random() < stay else not on
            if p == 0 or r.random() < 0.95:
                rows.append((k, p, r.choice([0.0, 1.0, 2.5, -4.0]) if on or p == 0 else None, r.randrange(1, 5)))
    return spark.createDataFrame(rows, "k string, t_pos int, value double, n int").cache()


@pytest.mark.parametrize("size", SIZES)
def test_runs(samples, size):
    valid = F.col("value").isNotNull()
    for least in (1, 4):
        same(B.runs(samples, ["k"], "t_pos", valid, least, size), I.runs(samples, ["k"], "t_pos", valid, least))
    same(B.prune_runs(samples, ["k"], "t_pos", valid, 3, size), I.prune_runs(samples, ["k"], "t_pos", valid, 3))


@pytest.mark.parametrize("size", SIZES)
def test_interpolation(samples, size):
    same(B.interpolate(samples, ["k"], size, "t_pos"), X.interpolate(samples, ["k"], "t_pos"))
    one = samples.withColumn("value", F.when(F.col("t_pos") == 0, F.col("value")))
    same(B.interpolate(one, ["k"], size, "t_pos"), X.interpolate(one, ["k"], "t_pos"))
    # Every position once, as a cyclic trace has it.
    whole = samples.select("k").distinct().crossJoin(samples.sparkSession.range(120).select(F.col("id").cast("int").alias("t_pos")))
    v = samples.select(F.col("k").alias("_k"), F.col("t_pos").alias("_t"), "value").where("_t between 5 and 100")
    whole = whole.join(v, whole["k"].eqNullSafe(v["_k"]) & (whole["t_pos"] == v["_t"]), "left").select("k", "t_pos", "value")
    same(B.circular_fill(whole, ["k"], size), H.circular_fill(whole, ["k"]))
    lone = whole.withColumn("value", F.when(F.col("t_pos") == 33, F.lit(2.0)))
    assert [r.value for r in B.circular_fill(lone, ["k"], size).select("value").distinct().collect()] == [2.0]


def test_a_trace_without_values_is_an_error(samples):
    with pytest.raises(PySparkException):
        B.circular_fill(samples.withColumn("value", F.lit(None).cast("double")), ["k"]).collect()


@pytest.mark.parametrize("size", SIZES)
def test_packets(samples, size):
    same(B.missing_ranges(samples, ["k"], "t_pos", size), P.missing_ranges(samples, ["k"], "t_pos"))
    known = samples.where("k is not null")
    same(B.sample_cursor(known, ["k"], "t_pos", "n", 0, size), P.sample_cursor(known, ["k"], "t_pos", "n"))
    got = B.sample_cursor(samples, ["k"], "t_pos", "n", 0, size).where("k is null")
    alone = P.sample_cursor(samples.where("k is null").withColumn("k", F.lit("x")), ["k"], "t_pos", "n").withColumn("k", F.lit(None).cast("string"))
    same(got, alone)


@pytest.mark.parametrize("size", [0.3, 1.0, 5.0, 1e6])
def test_intervals(spark, size):
    r = random.Random(11)
    rows = [(r.choice(["a", None]), s, s + r.choice([0.0, 0.5, 1.0, -1.0, 20.0 if r.random() < 0.1 else 0.2])) for s in (round(r.uniform(0, 60), 1) for _ in range(90))]
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], "k string, start double, end double")
    for gap, empty in ((0.0, "keep"), (0.4, "keep"), (0.0, "drop")):
        merged = I.union_intervals(df, ["k"], gap=gap, empty=empty)
        same(B.union_intervals(df, ["k"], size, gap=gap, empty=empty), merged)
        same(B.gaps(merged, ["k"], size), I.gaps(merged, ["k"]))


def test_empty(samples):
    none = samples.limit(0)
    assert B.runs(none, ["k"], "t_pos", F.lit(True)).count() == B.interpolate(none, ["k"], 8, "t_pos").count() == B.missing_ranges(none, ["k"], "t_pos").count() == 0
