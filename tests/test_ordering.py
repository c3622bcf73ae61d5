"""Global order by ranges against plain Python; no task may see all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.parity import SF
from tracewell.operators import stages, statistics
from tracewell.operators.ordering import Ordered, numbered
from tracewell.plans import registry


def rows(seed, n):
    """(id, group, value): few groups with NULL among them, ties, NULL values; one group holds most rows."""
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "a", "a", None, "b", "c"]), r.choice([None, *range(6)])) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_numbers_and_running_values_by_group(spark, partitions):
    data = rows(partitions, 300)
    df = spark.createDataFrame(data, "id long, g string, v int").repartition(4)
    o = Ordered(df, [F.desc_nulls_last("v"), "id"], ["g"], partitions).numbered("n")
    got = {r.id: r for r in o.running("v", "low").running("v", "high", "max", after=True).running("v", "total", "sum").frame().collect()}
    assert len(got) == 300
    for g in ("a", "b", "c", None):
        own = sorted((x for x in data if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        for k, (i, _, _) in enumerate(own):
            before, after = [x[2] for x in own[: k + 1] if x[2] is not None], [x[2] for x in own[k:] if x[2] is not None]
            want = (k + 1, min(before, default=None), max(after, default=None), sum(before) if before else None)
            assert (got[i].n, got[i].low, got[i].high, got[i].total) == want


def test_equal_keys_get_their_own_numbers(spark):
    df = spark.createDataFrame([(1, "x")] * 50, "v int, position string")
    got = numbered(df, ["v"], partitions=5)
    assert sorted(r.position for r in got.collect()) == list(range(1, 51)) and got.columns == ["v", "position"]
    assert numbered(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("method", ["bonferroni", "holm", "bh", "by"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_adjusted_p_values(spark, method, by):
    r = random.Random(7)
    data = [(i, r.choice(["x", "x", None]), r.choice([None, 0.0, 0.01, 0.01, 0.2, 0.9, r.random()])) for i in range(120)]
    got = {x.id: x.p_adj for x in statistics.adjust(spark.createDataFrame(data, "id long, g string, p double"), by=by, method=method).collect()}
    assert len(got) == 120
    for g in {x[1] if by else 0 for x in data}:
        own = sorted((x for x in data if (x[1] if by else 0) == g and x[2] is not None), key=lambda x: x[2])
        n, h = len(own), sum(1 / k for k in range(1, len(own) + 1))
        for k, (i, _, p) in enumerate(own):
            if method == "bonferroni":
                want = p * n
            elif method == "holm":
                want = max(q[2] * (n - j) for j, q in enumerate(own) if q[2] <= p)
            else:
                want = min(q[2] * n / (j + 1) for j, q in enumerate(own) if q[2] >= p) * (h if method == "by" else 1)
            assert got[i] == pytest.approx(min(1, want))
    assert all(got[i] is None for i, _, p in data if p is None)


def test_example_order_keeps_null_channels(spark):
    df = spark.createDataFrame([("b", "q", 0), (None, "p", 1), ("a", "p", 2), ("b", "p", 3), (None, "z", 4)], "channel string, phase string, ord int")
    got = [(r.channel, r.phase, r.ord) for r in stages.example_order(df, ["p", "q"]).orderBy("place").collect()]
    assert got == [("b", "p", 3), ("b", "q", 0), (None, "p", 1), (None, "z", 4), ("a", "p", 2)]


@pytest.mark.parametrize("name", ["channel_sort", "sorted_rows", "sorted_running", "p_adjust_all_by", "p_adjust_all_holm", "p_adjust_bh", "p_adjust_holm"])
def test_no_task_sees_all_rows(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_harmonic_numbers(spark):
    got = {r.n: r.h for r in spark.range(0, 100_000, 97).select(F.col("id").alias("n"), statistics.harmonic(F.col("id")).alias("h")).collect()}
    total, at = 0.0, {}
    for k in range(1, 100_000):
        total += 1 / k
        at[k] = total
    assert all(abs(h - at[n]) < 1e-11 for n, h in got.items() if n)
    assert spark.range(1).select(statistics.harmonic(F.lit(10**12))).first()[0] == pytest.approx(math.log(10**12) + 0.5772156649015329, abs=1e-9)


def test_running_values_backwards_read_each_row_once(spark):
    """A frame up to the last row is added up anew for each row: quadratic in a partition's rows."""
    df = spark.range(40).selectExpr("id", "id % 3 as g", "id * 7 % 11 as v")
    after = Ordered(df, ["id"], ["g"], 2).running("v", "high", "max", after=True).frame()
    adjusted = statistics.adjust(df.selectExpr("id", "v / 20 as p"), method="by")
    for out in (after, adjusted):
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
